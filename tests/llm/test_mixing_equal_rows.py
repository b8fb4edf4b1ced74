"""Mixing where most rows are equal: chunks stay small, sources come near their targets, reruns agree."""

from collections import Counter

from pyspark.sql import functions as F

from auditlake.llm import mixing


def test_equal_rows_spread_over_chunks(spark):
    hot = spark.range(60_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("a").alias("source"))
    rest = spark.range(8_000).select(F.col("id").alias("doc_id"), F.lit("w w w w").alias("text"), F.when(F.col("id") % 2 == 0, "b").alias("source"))
    slim = hot.select("doc_id", "source", F.lit(3).cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("tie"))
    made = mixing._numbered(slim)
    assert made.count() == 60_000 and made.select("tie").distinct().count() == 60_000
    docs = hot.unionByName(rest)
    one, two = (mixing.mixture(docs.repartition(k)).collect() for k in (3, 7))
    assert Counter(map(tuple, one)) == Counter(map(tuple, two)) and len(one) == 68_000
    for s in ("a", "b", None):
        rows = [r for r in one if r.source == s]
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 4 and all(r.taken <= 3 * r.size for r in rows)
