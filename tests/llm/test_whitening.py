"""Whitening against numpy's eigenvectors of the covariance, on a table, on hard matrices and on odd rows."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>"


def expected(vectors, components=4):
    """By plain Python and numpy: n, and for each vector its deviation and its values on the components, and the shares."""
    x = [[math.floor(256 * float(np.float32(c))) for c in v] for v in vectors]
    fit = np.array(sorted(set(map(tuple, x))), dtype=float)
    n, mean = len(fit), fit.mean(axis=0)
    cov = (fit - mean).T @ (fit - mean) / n
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1][:components], vecs[:, ::-1][:, :components]
    sums = [sum(int(r[j]) for r in set(map(tuple, x))) for j in range(len(x[0]))]
    deviations = [sum((n * v - s) ** 2 for v, s in zip(r, sums)) for r in x]
    return n, deviations, (np.array(x) - mean) @ vecs / np.sqrt(values), values / np.trace(cov)


def close(got, want):
    """Either sign, but the same one for all rows."""
    got, want = np.array(got), np.array(want)
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got * sign - want).max() < 1e-7


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    df = queries.op13_whitening(spark, sf)
    assert [t for _, t in df.dtypes] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    rows, table = df.collect(), {r.vec_id: list(r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids = sorted(table)
    n, deviations, white, explained = expected([table[i] for i in ids])
    assert len(rows) == 4 * len(ids) and {r.n for r in rows} == {n}
    by = {(r.vec_id, r.component): r for r in rows}
    close([[by[i, k].whitened for k in range(1, 5)] for i in ids], white)
    assert [by[i, 1].deviation for i in ids] == deviations
    assert all(abs(by[ids[0], k + 1].explained / explained[k] - 1) < 1e-9 for k in range(4))
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-9


@pytest.mark.parametrize("kind", ["graded", "nearly dependent", "dependent", "few rows", "constant column", "far from zero"])
def test_hard_matrices(spark, kind):
    rng = np.random.default_rng(7)
    n, d = (5, 12) if kind == "few rows" else (300, 12)
    m = rng.standard_normal((n, d))
    if kind == "graded":
        m = m * 10.0 ** -np.linspace(-3, 2, d)
    elif kind == "nearly dependent":
        m[:, 1] = m[:, 0] + np.where(np.arange(n) == 3, 1 / 256, 0)
        m = np.round(m * 256 * 400) / 256
    elif kind == "dependent":
        m = np.round(m)
        m[:, 5], m[:, 7] = m[:, 0] + m[:, 1], 2 * m[:, 3]
    elif kind == "constant column":
        m[:, 4] = 3
    elif kind == "far from zero":
        m = m + 5000
    m = m.astype(np.float32)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(m)], SCHEMA).repartition(3)
    got = {r.row.vec_id: r for r in whitening.whitened(df).collect()}
    size, deviations, white, explained = expected(m.tolist())
    assert got[0].n == size and [got[i].deviation for i in range(n)] == deviations
    close([got[i].whitened for i in range(n)], white)
    assert got[0].identity_error < 1e-8 and np.abs(np.array(got[0].explained) / explained - 1).max() < 1e-9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5]), (2, [0.0, -1.0, 4.0]), (3, None), (4, []), (5, [1.0, None, 2.0]), (6, [nan, 0.0, 0.0]), (7, [0.0, -inf, 0.0]), (8, [1.0, 2.0]), (None, [3.0, 3.0, 3.0]), (9, [1e9, 0.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit("r")).withColumn("x", F.lit(1)).withColumn("whitened", F.lit("w"))
    got = whitening.whitened(df).collect()
    assert sorted((r.row.vec_id or -1) for r in got) == [-1, 1, 1, 2, 9] and {r.row.x for r in got} == {1}
    assert {r.n for r in got} == {4} and all(len(r.whitened) == len(r.explained) >= 1 for r in got)
    ones = [r for r in got if r.row.vec_id == 1]
    assert ones[0].whitened == ones[1].whitened and next(r for r in got if r.row.vec_id == 9).deviation is None
    for few in (df.limit(0), df.where("vec_id = 3"), df.where("vec_id = 1")):
        got = whitening.whitened(few).collect()
        assert all(r.whitened == [] and r.identity_error is None and r.deviation == 0 for r in got) and len(got) == few.where("vec_id = 1").count()
