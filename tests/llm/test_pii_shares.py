"""Disclosing terms and their spans against a plain version; long lines; shares of lines with an entity."""

import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from auditlake.llm import pii

MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
WORD = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def plainly(texts):
    """The spans of each text, with mail addresses as the only entities."""
    n, k, lines, held = Counter(), Counter(), 0, 0
    for t in texts:
        for line in (t or "").split("\n"):
            words = [w.lower() for w in re.findall(WORD, line)]
            entity = re.search(MAIL, line)
            lines, held = lines + bool(words), held + bool(entity)
            n.update(words)
            k.update(words if entity else ())
    rate = held / lines if lines else 0

    def discloses(w):
        share = (k[w] + rate) / (n[w] + 1)
        return k[w] and rate < 1 and share >= 0.5 and math.log2(share / (1 - share) / (rate / (1 - rate))) >= 2

    out = []
    for t in texts:
        base = [m.span() for m in re.finditer(MAIL, t or "")]
        terms = [m.span() for m in re.finditer(WORD, t or "") if discloses(m[0].lower()) and not any(a < m.end() and m.start() < b for a, b in base)]
        out.append(",".join([*(f"email:{a}:{b}" for a, b in base), *(f"term:{a}:{b}" for a, b in terms)]))
    return out


def spans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).withColumn("key", F.lit(1)).withColumn("near", F.lit("x"))
    return [r[1] for r in sorted((r.doc_id, r.s) for r in pii.personal_spans(df).select("doc_id", pii.spans_text(F.col("spans")).alias("s")).collect())]


@pytest.mark.parametrize("share", [0.05, 0.2, 0.6])
def test_names_are_found_at_any_share_of_lines_with_an_entity(spark, share):
    rng = random.Random(8)
    names = [f"{a}{b}" for a in ("anna", "boris", "ćelia", "dirk") for b in ("son", "ova", "smith")]
    common = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    common = [re.sub(r"\d", "", w) for w in common]
    texts = []
    for _ in range(300):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            said = rng.choices(common, k=12)
            if rng.random() < share:
                who = rng.choice(names)
                said += [who.title(), f"{who[:1]}x@mail-{rng.randrange(9)}.example.org", f"({who})"]
            rng.shuffle(said)
            lines.append(rng.choice([" ", "  ", ", "]).join(said))
        texts.append("\n".join(lines))
    texts += [None, "", "\n\n", "no entity", "last line " + names[0]]
    got = spans(spark, texts)
    assert got == plainly(texts)
    found = {texts[i][int(a) : int(b)].lower() for i, s in enumerate(got) for kind, a, b in (x.split(":") for x in s.split(",") if x) if kind == "term"}
    assert set(names) <= found and not found & set(common)


def test_a_line_of_many_names(spark):
    for n in (100, 3000):
        names = " ".join("name" + "".join(chr(97 + int(c)) for c in str(i)) for i in range(n))
        texts = [*(f"other text {'abcdefghij'[i % 10] * 3}" for i in range(200)), f"{names} a@b.org"]
        assert spans(spark, texts)[200].count("term") == n


def test_long_texts_take_linear_time(spark):
    words = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(200_000))
    texts = [words + " zed a@b.org", *(f"line wab {i}" for i in range(50))]
    began = time.time()
    got = spans(spark, texts)
    assert time.time() - began < 60 and "email" in got[0]


def test_no_lines_without_an_entity(spark):
    assert spans(spark, ["anna a@b.org", "boris c@d.org"]) == ["email:5:12", "email:6:13"]
    assert spans(spark, []) == []
