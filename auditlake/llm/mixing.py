"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source gets the same fractional number of copies, target / source size. Its whole part is taken;
the fractions are rounded in pairs: words move from one document to the other, in a random direction that keeps both
expectations, until one of the two is integral. Each meeting draws a number of its own, a hash of the seed, the level of
the tree, the round and the two documents. A chunk's unrounded rest goes up a reduction tree whose groups are bounded,
until one document of each source is left; it is taken with the probability that is left.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import written

CAP = 3
CHUNK, FAN_IN = 2048, 64
BLOCK = 1 << 16  # equal rows that one task numbers at a time
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, source_rows) to the same with target: min(CAP * source_size, level * weight).

    Weights are 5, 2, 1, repeating, by the sources' code points, null last. The level that makes the targets add up to
    the sum of sizes is where water stands in vessels of the sources' capacities: it is read off the running sums over
    the sources by capacity per weight. One row a source; the windows' single task sees no document.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(F.lit(5), F.lit(2), F.lit(1)), (F.row_number().over(every) - 1) % 3 + 1).cast("double")
    w = sizes.withColumn("weight", weight).withColumn("fills_at", CAP * F.col("source_size") / F.col("weight"))
    order = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    full = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy(F.lit(1)))
    level = (total - CAP * F.coalesce(F.sum("source_size").over(full), F.lit(0))) / F.sum("weight").over(rest)
    w = w.withColumn("level", level)
    best = F.max(F.when(F.col("level") <= F.col("fills_at"), F.col("level"))).over(Window.partitionBy(F.lit(1)))
    return w.withColumn("target", F.least((CAP * F.col("source_size")).cast("double"), F.coalesce(best, F.lit(0.0)) * F.col("weight"))).select(
        "source", "source_size", "source_rows", "target"
    )


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no trace of order (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _drawn(seed: int, level: int, meeting: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1), one for each meeting of the documents with the hashes i and j."""
    key = _mixed(np.array([(seed << 32) ^ (level << 16) ^ meeting], np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return (_mixed(_mixed(_mixed(i ^ key) + j) + key) >> np.uint64(11)) / float(1 << 53)


def round_pairs(size: np.ndarray, part: np.ndarray, tie: np.ndarray, seed: int = 0, level: int = 0) -> np.ndarray:
    """Fractions after a tournament of pairings of neighbours: all but at most one end at 0 or 1.

    The sum of size * part stays (up to rounding error); part of each row keeps its expectation over the seeds. Rows
    come sorted by size, so that the two of a pair are about as large and one of them is settled at the first meeting.
    tie: a hash of each row.
    """
    out, tiny, tie = part.astype(float).copy(), 1e-9, tie.astype(np.int64).view(np.uint64)
    out[size <= 0] = 0.0
    left, meeting = np.flatnonzero((out > tiny) & (out < 1 - tiny)), 0
    while len(left) > 1:
        odd, pairs = left[len(left) // 2 * 2 :], left[: len(left) // 2 * 2].reshape(-1, 2)
        i, j = pairs[:, 0], pairs[:, 1]
        ratio = size[j] / size[i]
        up, down = np.minimum(1 - out[i], ratio * out[j]), np.minimum(out[i], ratio * (1 - out[j]))
        move = np.where(_drawn(seed, level, meeting, tie[i], tie[j]) * (up + down) < down, up, -down)
        out[i] += move
        out[j] -= move / ratio
        left = np.concatenate([pairs.ravel(), odd])
        left = left[(out[left] > tiny) & (out[left] < 1 - tiny)]
        meeting += 1
    near = (out <= tiny) | (out >= 1 - tiny)
    out[near] = np.round(out[near])
    return out


def _reduce_group(seed: int, level: int, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "tie", "doc_id"], ascending=[False, True, True], ignore_index=True)
        tie = rows["tie"].to_numpy()
        part = round_pairs(rows["size"].to_numpy(), rows["part"].to_numpy(), tie, seed, level)
        if last:
            hashes = tie.view(np.uint64)
            part = np.where((part > 0) & (part < 1), _drawn(seed, level + 1, 0, hashes, hashes) < part, part).astype(float)
        return rows.assign(part=part)

    return run


def _numbered(rows: DataFrame) -> DataFrame:
    """rows, where equal ones have different ties: they are counted before they are shuffled, and unfolded from their count in blocks."""
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    one = counted.where("n = 1").drop("n")
    blocks = counted.where("n > 1").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK)))).repartition("tie", "block")
    number = F.sequence(F.col("block") * BLOCK, F.least(F.col("n"), (F.col("block") + 1) * BLOCK) - 1)
    several = blocks.withColumn("number", F.explode(number)).withColumn("tie", F.xxhash64("tie", "number"))
    return one.unionByName(several.select(*rows.columns))


def mixture(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each row of docs.

    Null texts have size 0 and take nothing; a null source is a source of its own, last in the order of weights; null
    ids are allowed. Equal rows are counted and numbered, so that each draws numbers of its own and they spread over
    chunks; which of them gets which number of copies can't be told apart. A source without words has target 0. An empty
    table gives no rows. Reruns agree, however the rows are partitioned. No group of rows is larger than CHUNK or FAN_IN
    on average.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), F.xxhash64(doc_id, text).alias("tie"))
    rows = written(_numbered(slim))
    sources = written(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))))
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    hash_of = lambda n: F.xxhash64("tie", F.lit(n))
    start = (
        rows.join(sources, rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
        .withColumn("copies", copies).withColumn("whole", F.floor(F.col("copies") + 1e-9))
        .withColumn("part", F.greatest(F.col("copies") - F.col("whole"), F.lit(0.0)))
        .withColumn("chunk", F.pmod(hash_of(1), F.greatest(F.ceil(F.col("source_rows") / CHUNK), F.lit(1))))
        .select("doc_id", "source", "size", "source_size", "target", "tie", "whole", "part", "chunk")
    )
    chunks = sources.agg(F.max(F.ceil(F.col("source_rows") / CHUNK))).first()[0] or 1
    done, now = None, start
    for depth in itertools.count():
        last = chunks <= 1
        level = written(now.groupBy("source", "chunk").applyInPandas(_reduce_group(seed, depth, last), now.schema))
        whole = (F.col("part") == 0) | (F.col("part") == 1)
        ended = level.where(whole)
        done = ended if done is None else done.union(ended)
        if last:
            break
        chunks = -(-chunks // FAN_IN)
        now = level.where(~whole).withColumn("chunk", F.floor(F.col("chunk") / FAN_IN))
    taken = ((F.col("whole") + F.col("part")) * F.col("size")).cast("long")
    return done.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))
