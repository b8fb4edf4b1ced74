"""Operators without SQL against plain loops: toxicity's scores, the decision list, license labels, weak labels, and the whole pipeline."""

import math
import os
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_corpus import shingle_fingerprint

from auditlake.llm import licenses, queries, rules, toxicity, weaklabel
from auditlake.llm.common import held_out, row_id, table, written

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
M64 = (1 << 64) - 1
LONG = "café naïve word, another Word! 12 " * 9_000  # some 300,000 characters


def plain_words(text):
    return [w.encode() for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]


def toxic_score(model, text):
    """Word by word and n-gram by n-gram, in whole numbers."""
    buckets = len(model.word_scores)
    place = lambda h: ((h * 0x9E3779B97F4A7C15 & M64) >> 33) % buckets

    def word(w):
        marked, at = b"<" + w + b">", [place(zlib.crc32(w))]
        for n in (3, 4, 5, 6):
            for i in range(len(marked) - n + 1):
                h = marked[i] + 1
                for c in marked[i + 1 : i + n]:
                    h = h * 0x100000001B3 + c & M64
                at.append(place(h + n & M64))
        return sum(model.word_scores[b] for b in at) / len(at)

    words = plain_words(text)
    known = {w: word(w) for w in set(words)}
    odds = 0.0
    for i in range(0, len(words), 8):
        run = words[i : i + 8]
        odds += math.exp(sum(known[w] for w in run) / len(run) + model.bias)
    return odds / (1 + odds)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def toxic(spark, docs):
    return toxicity.fit(docs, table(spark, SF, "labels"))


def test_toxicity_of_every_text(spark, docs, texts, toxic):
    more = spark.createDataFrame([(-1, LONG), (-2, None), (-3, "Жж 水")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score_with(toxic, docs.select("doc_id", "text").unionByName(more)).collect()}
    for i, t in {**texts, -1: LONG, -2: "", -3: "Жж 水"}.items():
        assert abs(got[i] - toxic_score(toxic, t)) < 1e-9


def test_toxicity_of_the_held_out_fold(spark):
    """Held-out quality where the labels are many enough to tell: the README's figures are 0.961, 0.81 and 0.014."""
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    marks = table(spark, sf, "labels").where(F.col("toxic").isNotNull() & held_out()).select("doc_id", "toxic")
    scored = queries.op1_toxicity(spark, sf).join(marks, "doc_id").select("toxic", "score").collect()
    good, bad = (np.sort([r.score for r in scored if r.toxic == k]) for k in (0, 1))
    area = (np.searchsorted(good, bad, "left").sum() + np.searchsorted(good, bad, "right").sum()) / 2 / len(good) / len(bad)
    assert area > 0.9 and (bad >= toxicity.THRESHOLD).mean() > 0.7 and (good >= toxicity.THRESHOLD).mean() < 0.05


def test_decision_list_rejects_by_its_rules(spark, docs, texts):
    made = rules.fit(docs, table(spark, SF, "labels"))
    assert made.rules
    more = spark.createDataFrame([(-1, LONG), (-2, None)], "doc_id long, text string")
    for r in rules.judged(docs.select("doc_id", "text").unionByName(more), made).collect():
        s = r._judged.stats.asDict()
        value = {name: s[a] / (max(s[b], 1) if b else 1) for name, a, b in rules.RATIOS}
        hit = any(all(value[n] <= x if op == "le" else value[n] > x for n, op, x in rule) for rule in made.rules)
        assert r._judged.kept == (not hit and not r._judged.base_failed)


def test_license_labels_at_every_offset(spark, docs, texts):
    grant = "Released under the MIT License. " + "filler words " * 40 + "permission is hereby granted free of charge to any man obtaining a copy of this software and associated documentation files"
    more = {-1: grant, -2: "cc-by-nc 4.0, licensed under CC BY-NC 4.0 " + LONG}
    every = {**texts, **more}
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(more.items()), "doc_id long, text string"))
    own = {i: plain_words(t) for i, t in every.items()}
    seen = Counter(w for ws in own.values() for w in set(ws))
    idf = {w: math.log((1 + len(own)) / n) for w, n in seen.items() if w in licenses.VOCABULARY}
    top, found = max(idf.values()), 0
    for r in licenses.license_scan(df).collect():
        words = own[r.doc_id]
        labels, best = {x for _, x in licenses.base_places(words)}, 0.0
        based = bool(labels)
        for label, template, needed in licenses.TEMPLATES:
            parts = template.encode().split()
            weight = [idf.get(w, top) for w in parts]
            whole = sum(weight)
            if not set(" ".join(needed).encode().split()) <= set(words):
                continue
            for o in range(-len(parts) + 1, len(words)):
                agree = sum(x for p, x in enumerate(weight) if 0 <= o + p < len(words) and words[o + p] == parts[p]) / whole
                near = b" " + b" ".join(words[max(0, o - 2) : max(0, o + len(parts) + 2)]) + b" "
                if agree and all(b" " + n.encode() + b" " in near for n in needed):
                    best = max(best, agree)
                    labels |= {label} if agree >= licenses.AGREE else set()
        found += len(labels)
        assert list(r._found.labels) == sorted(labels) and abs(r._found.score - (1.0 if based else min(1.0, best))) < 1e-9
    assert found


def test_weak_labels_by_plain_expectation(spark, docs):
    got = weaklabel.quality_scores(docs).select("doc_id", "text", "_quality.*").collect()
    votes = [tuple(r.votes) for r in got]
    good = [0.95 if -1 not in v else 0.4 if v.count(-1) == 1 else 0.03 for v in votes]
    for _ in range(60):
        table_of = lambda w: [[(sum(x for x, v in zip(w, votes) if v[i] == k) + 0.1) for k in (-1, 0, 1)] for i in range(9)]
        a, b = table_of(good), table_of([1 - g for g in good])
        prior = math.log((sum(good) + 0.1) / (len(good) - sum(good) + 0.1))
        add = [[math.log(a[i][k] / sum(a[i]) / (b[i][k] / sum(b[i]))) for k in range(3)] for i in range(9)]
        post = {v: 1 / (1 + math.exp(-min(50, max(-50, prior + sum(add[i][v[i] + 1] for i in range(9)))))) for v in set(votes)}
        good = [post[v] for v in votes]
    assert all(abs(r.posterior - post[tuple(r.votes)]) < 1e-6 for r in got)
    ids = {r.doc_id: i for r, i in zip(docs.collect(), docs.select(row_id()).collect())}
    rows = sorted((r for r in got if len(r.text or "") <= weaklabel.SAMPLE_CHARS), key=lambda r: ids[r.doc_id][0])
    scorer = weaklabel.train([r.text for r in rows], np.array([post[tuple(r.votes)] for r in rows]))
    for r in got:
        key, value = weaklabel.features(r.text, rules.stats_of(r.text))
        score = 1 / (1 + math.exp(-sum(scorer.weights[k] * x for k, x in zip(key, value)) - scorer.weights[-1]))
        assert abs(r.score - score) < 1e-4 and (r.kept == (score >= scorer.cut) or abs(score - scorer.cut) < 1e-4)


def without_repeats(texts):
    seen, copies, out = [], set(), {}
    for doc in sorted(texts):
        kept = []
        for line in (texts[doc] or "").split("\n"):
            words = frozenset(re.split("[ \t\r\x0b\x0c]+", line)) - {""}
            if words and line in copies:
                continue
            similar = words and any(10 * len(words & s) >= 8 * len(words | s) for s in seen if 0.8 * len(words) <= len(s) <= len(words) / 0.8)
            if words:
                copies.add(line)
                seen.append(words)
            if not similar:
                kept.append(line)
        out[doc] = "\n".join(kept) if texts[doc] is not None else None
    return out


def first_of_groups(texts):
    fp = {i: shingle_fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in fp}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in fp:
        for j in fp:
            if j < i and (fp[i] ^ fp[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: t for i, t in texts.items() if find(i) == i}


def test_pipeline_by_plain_loops(spark, docs, toxic):
    left = {r.doc_id: r.text for r in docs.collect()}
    left = {i: t for i, t in left.items() if toxic_score(toxic, t) < toxicity.THRESHOLD}
    left = first_of_groups(without_repeats(left))
    windows = set()
    for r in table(spark, SF, "benchmark").collect():
        w = plain_words(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    clean = {i: t for i, t in left.items() if not any(tuple(plain_words(t)[k : k + n]) in windows for n in sizes for k in range(len(plain_words(t)) - n + 1))}
    source, size = {r.doc_id: r.source for r in docs.collect()}, {i: len(re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in clean.items()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r["size"] for r in got} == size and len(got) == len(size) < docs.count()
    of_source, taken = Counter(), Counter()
    for r in got:
        of_source[source[r.doc_id]] += r["size"]
        taken[source[r.doc_id]] += r.taken
        assert 0 <= r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
    largest = max(size.values())
    assert all(r.source_size == of_source[source[r.doc_id]] and abs(taken[source[r.doc_id]] - r.target) <= 2 * largest for r in got)


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Nothing at all; and rows without id, source or text, repeated ones, and columns with names that stages use."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long, row string, hash long, _text string, `a.b` int"
    rows = [(None, "x y z same text", "en", None, 15, "r", 1, "t", 1)] * 3 + [(1, None, None, "s", None, None, None, None, None)] * 2 + [(2, "", "en", "s", 0, "r", 2, "t", 2), (3, LONG, "en", "s", len(LONG), "r", 3, "t", 3), (3, "other words of the same id", "en", "t", 26, "r", 3, "t", 3)]
    for name, some in (("none", []), ("odd", rows)):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(some, kinds).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
        if not some:
            assert corpus_pipeline.run(spark, at).collect() == []
            continue
        docs = table(spark, at, "documents")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = written(stage(spark, docs, at))
            assert out.columns == docs.columns
            docs = out
        got = sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in corpus_pipeline.STAGES[-1][1](spark, docs, at).collect())
        assert got == [(False, 1, 0), (False, 3, 6), (False, 3, len(LONG.split())), (True, 0, 5)]
