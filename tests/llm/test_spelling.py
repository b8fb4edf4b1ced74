"""Spelling variants against all pairs of words, on odd rows, and the query against its SQL."""

import os
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from auditlake.llm import queries, spelling


def one_edit(x, y):
    """Whether y is x with one character put in, taken out or replaced."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1 or x == y:
        return False
    i = next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), len(x))
    return x[i + 1 :] == y[i + 1 :] if len(x) == len(y) else x[i:] == y[i + 1 :]


def plainly(rows, slip):
    """word to (form, root, n, n_near, form_n), every word against every other."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if slip and h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    def root(w):
        return w if form[w] is None else root(form[w])
    return {w: (form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def judged(df, **kw):
    got = spelling.spelling_variants(df, **kw).collect()
    assert len(got) == len({r.word for r in got})
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


def test_against_all_pairs(spark):
    rng = random.Random(2)
    stems = ["aaaaa", "aaaaaa", "abababab", "orthography", "straße", "élève", "ÉTÉàà", "banana", "mississippi", "x" * 40]
    words = set(stems)
    for _ in range(700):
        w, at, c = rng.choice(sorted(words)), rng.randrange(12), rng.choice("aàbsxéÿ")
        at %= len(w) + 1
        words.add(rng.choice([w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :]]))
    rows = [(i, " ".join(rng.choices(sorted(words), weights=range(1, len(words) + 1), k=60)) + "\n") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for slip in (False, True):
        got = judged(df, read=spelling.slipped if slip else spelling.as_it_is)
        want = plainly(rows, slip)
        assert got == want and any(f[0] != f[1] and f[0] for f in got.values())


def test_chains_of_forms(spark):
    chain = [("colourx", 3), ("colours", 7), ("colour", 20), ("color", 50), ("kolor", 120)]
    rows = [(1, " ".join(w for w, n in chain for _ in range(n)))]
    got = judged(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == plainly(rows, False) and got["colourx"][1] == "kolor" and got["kolor"][0] is None


def test_odd_rows(spark):
    long = "Langwort " * 200_000 + "y" * 3000
    rows = [(1, None), (2, ""), (None, "hello Hello HELLO hellos hellos hellos"), (3, "hello"), (3, "hello"), (4, long), (5, "été été été ÉTÉ × ÷×÷×÷ 123 привет привет привет"), (6, "ab_cdefg hello's cdefg cdefg")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("w")).withColumn("n", F.lit(1)).withColumn("root", F.lit("r"))
    assert judged(df) == plainly(rows, False)
    assert judged(df, read=spelling.slipped) == plainly(rows, True)
    assert judged(df.limit(0)) == {}


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    duckdb = pytest.importorskip("duckdb")
    df = queries.op12_spelling_variants(spark, sf)
    assert [t for _, t in df.dtypes] == ["string", "string", "string", "bigint", "bigint", "bigint"]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL["op12_spelling_variants"]).select(*[f'"{c}"' for c in df.columns]).fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)
