"""Joins of tables that Spark takes for smaller than they are: the driver may not collect a side of them."""

import random

from pyspark.sql import functions as F

from auditlake.llm import linededup, simhash


def broadcasts(df) -> int:
    """How many sides of joins the plan of df sends through the driver, before anything has run."""
    return df._jdf.queryExecution().sparkPlan().toString().count("Broadcast")


def test_unfolded_fingerprints_are_not_broadcast(spark):
    fps = spark.range(3000).select(F.xxhash64("id").alias("fp"))
    assert broadcasts(fps.join(fps.select("fp", F.lit(1)), "fp")) > 0  # small enough for Spark to choose it
    links = simhash.fingerprint_links(fps)
    assert broadcasts(links) == 0
    assert links.count() == 0


def test_groups_of_documents_are_not_broadcast(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abcdefgh", k=30)) for _ in range(20)]
    docs = spark.createDataFrame([(i, texts[i % 20]) for i in range(60)], "doc_id long, text string")
    groups = simhash.near_duplicate_groups(docs)
    assert broadcasts(groups) <= 1  # the table of linked fingerprints, as large as its file says
    assert {r.doc_id: r.component_id for r in groups.collect()} == {i: i % 20 for i in range(60)}


def test_lines_that_go_are_not_broadcast(spark):
    docs = spark.createDataFrame([(i, f"one two three four five line {i % 4}\nalone {i} {i * i} {i + 7}") for i in range(12)], "doc_id long, text string")
    cut = linededup.without_repeated_lines(docs)
    assert broadcasts(cut) == 0
    assert {r.doc_id: r.text.count("\n") for r in cut.collect()} == {i: int(i < 4) for i in range(12)}
    assert broadcasts(linededup.dedup_report(docs)) == 0
