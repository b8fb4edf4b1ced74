"""The pipeline's stages on a small corpus."""

import corpus_pipeline
from auditlake.llm.common import written


def test_stages(spark, tmp_path):
    passage = " ".join(f"bench{i}" for i in range(14))
    body = [" ".join(f"d{d}w{i}" for i in range(60)) for d in range(30)]
    rows = [(d, f"shared first line of all the texts\n{t}", "en", f"s{d % 3}", len(t)) for d, t in enumerate(body)]
    rows += [(100, rows[4][1], "en", "s0", 1), (101, rows[5][1].replace("d5w30 ", ""), "en", "s0", 1), (102, f"{body[6][:40]} {passage} tail", "en", "s1", 1), (103, None, "en", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, sf = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, sf))
        assert out.columns == docs.columns
        docs, kept[name] = out, {r.doc_id: r.text for r in out.collect()}
    assert len(kept["toxicity"]) == len(rows)
    assert kept["line dedup"][0].startswith("shared first") and kept["line dedup"][1] == body[1] and kept["line dedup"][100] == ""
    assert 101 in kept["line dedup"] and kept["line dedup"][101] == ""
    assert 102 in kept["simhash near-dedup"] and 102 not in kept["decontamination"]
    assert set(range(30)) <= set(kept["decontamination"])
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == docs.count()
