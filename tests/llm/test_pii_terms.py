"""Disclosing terms are generalised wherever they stand, and those that occur once too."""

import re

from auditlake.llm import pii

FAR = "of the plain long text that goes on and on and says nothing at all "
ROWS = (
    [(i, f"{FAR}Zorgon {FAR}{FAR}me{i}@mail.example.com {FAR}\nzorgon again, İ ZORGON zorgons") for i in range(12)]
    + [(50, f"{FAR}zorgon, alone"), (51, f"Qwyzzle {FAR}is at 10.1.2.3 and {FAR}"), (52, None), (53, ""), (None, "zorgon")]
    + [(100 + i, FAR * 20) for i in range(60)]
)


def test_terms_far_from_entities_and_in_other_texts(spark):
    # the doubled line makes most of the name's occurrences stand with an entity
    rows = [(i, re.sub("^", "zorgon zorgon zorgon zorgon ", t)) if t and "@" in t else (i, t) for i, t in ROWS]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = pii.personal_spans(df)
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    for r in spans.collect():
        got = {(s.start, s.stop) for s in r.spans if s.kind == pii.TERM}
        assert got >= {m.span() for m in re.finditer(r"(?i)\bzorgon\b", texts[r.doc_id])}
        assert all(texts[r.doc_id][s.start : s.stop] == s.value for s in r.spans)
    out = {r.doc_id: r.text for r in pii.sanitised(df, spans).collect()}
    assert not any(re.search(r"(?i)\bzorgon\b", t or "") for t in out.values())
    assert "Qwyzzle" not in out[51] and "[IP]" in out[51]
    assert out[100] == FAR * 20 and "zorgons" in out[3]


def test_line_words(spark):
    from pyspark.sql import functions as F

    texts = ["one a@b.c two d@e.f\nthree\nFour 1.2.3.4", "x\n\n1.2.3.4", "none"]
    df = pii.base_spans(spark.createDataFrame([(t,) for t in texts], "text string"))
    got = [sorted(r.w) for r in df.select(pii._line_words(F.col("text"), F.col("_spans")).alias("w")).collect()]
    assert got == [sorted("one a b c two d e f four".split()), [], []]
