"""The quality classifier learns from every row: beyond 6,000 rows and 20,000 characters, however rows are dealt to tasks."""

import numpy as np
from pyspark.sql import functions as F

from auditlake.llm import weaklabel
from auditlake.llm.rules import stats_of

GOOD = " ".join(f"text{k}" for k in range(60))
JUNK = "A%B$ | !! " * 30


def judged(docs):
    return {r.doc_id: r._quality for r in weaklabel.quality_scores(docs).collect()}


def test_long_texts_are_learned_from(spark):
    rows = [(i, f"{GOOD} {i}") for i in range(60)] + [(60 + i, JUNK * 80) for i in range(12)]
    got = judged(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(got[i].kept for i in range(60)) and not any(got[60 + i].kept for i in range(12))
    assert max(got[60 + i].score for i in range(12)) < 0.1


def test_all_rows_are_learned_from(spark):
    """The junk has the 100 ids of largest hash."""
    ids = spark.range(6_100).withColumnRenamed("id", "doc_id")
    last = {r.doc_id for r in ids.orderBy(F.xxhash64("doc_id").desc()).limit(100).collect()}
    rows = [(i, JUNK if i in last else f"{GOOD} {i}") for i in range(6_100)]
    got = judged(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {i for i in got if not got[i].kept} == last
    assert max(got[i].score for i in last) < 0.1


def test_scores_do_not_depend_on_tasks(spark):
    rng = np.random.default_rng(3)
    texts = [JUNK[: int(n)] + GOOD[: int(m)] for n, m in rng.integers(1, 300, (150, 2))] + [None, "", "\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    one, other = judged(docs.coalesce(1)), judged(docs.repartition(7))
    assert one == other
    alone = weaklabel.train(texts, np.array([one[i].posterior for i in range(len(texts))]))
    for i, t in enumerate(texts):
        assert abs(one[i].score - alone.score(t, stats_of(t))) < 1e-6 and one[i].kept == (one[i].score >= alone.cut)
    assert sum(q.kept for q in one.values()) >= round(sum(q.posterior for q in one.values())) > 0
