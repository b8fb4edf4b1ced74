"""The opN_ queries on the smallest tables: columns, types, and their results against plain Python."""

import hashlib
import html
import os
import re
import zlib
from collections import Counter

import pytest

from auditlake.llm import mixing, queries, toxicity
from auditlake.llm.common import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
TYPES = {
    "op1_toxicity": "doc_id:bigint,held_out:boolean,score:double,predicted:int", "op2_quality_rules": "doc_id:bigint,n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,base_failed:boolean,kept:boolean",
    "op3_simhash": "doc_id:bigint,fingerprint:string,component_id:bigint", "op4_pii": "doc_id:bigint,n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,base_sha256:string,spans:string",
    "op5_license_scan": "doc_id:bigint,n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double", "op6_decontamination": "doc_id:bigint,n_words:bigint,n_hit:bigint,n_items:bigint,items_sha256:string,contaminated:boolean",
    "op7_line_dedup": "doc_id:bigint,n_lines:bigint,n_copies:bigint,n_similar:bigint,removed:string", "op8_quality_classifier": "doc_id:bigint,posterior:double,score:double,kept:boolean",
    "op9_mixing": "doc_id:bigint,size:bigint,source_size:bigint,target:double,taken:bigint", "op10_html_text": "page_id:bigint,url:string,text:string,n_chars:bigint",
}
PLAIN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPACED = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}


@pytest.fixture(scope="module")
def rows(spark):
    made = {}

    def of(name):
        if name not in made:
            df = queries.QUERIES[name](spark, SF)
            made[name] = (df.dtypes, df.collect())
        return made[name][1]

    of.types = lambda name: of(name) is not None and made[name][0]
    return of


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def near_type(kind):
    return kind.replace("bigint", "n").replace("int", "n")


@pytest.mark.parametrize("name", sorted(TYPES))
def test_columns(rows, texts, spark, name):
    want = dict(x.split(":") for x in TYPES[name].split(","))
    got = dict(rows.types(name))
    assert list(got) == list(want)
    loose = ("doc_id", "page_id")  # these keep the table's type
    assert {k: v for k, v in got.items() if k not in loose} == {k: v for k, v in want.items() if k not in loose}
    n = table(spark, SF, "pages").count() if name == "op10_html_text" else len(texts)
    assert len(rows(name)) == n


def test_op1(spark, rows, texts):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.fit(docs, labels)
    for r in rows("op1_toxicity"):
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3)
        assert abs(r.score - model.scorer()([texts[r.doc_id]])[0]) < 1e-9


def test_op2(rows, texts):
    for r in rows("op2_quality_rules"):
        t = texts[r.doc_id]
        w = SPACED.findall(t)
        lines = [x for x in t.split("\n") if SPACED.search(x)]
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w)) and not (r.base_failed and r.kept)


def luhn(d):
    return sum(sum(divmod(2 * int(x), 10)) if i % 2 else int(x) for i, x in enumerate(reversed(d))) % 10 == 0


def test_op4(rows, texts):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v, d: True), "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v, d: all(int(x) < 256 for x in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v, d: 13 <= len(d) <= 19 and luhn(d)), "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v, d: 9 <= len(d) <= 15),
    }
    for r in rows("op4_pii"):
        found = {k: [m.span() for m in re.finditer(p, texts[r.doc_id]) if ok(m[0], re.sub("[^0-9]", "", m[0]))] for k, (p, ok) in kinds.items()}
        text = ",".join(f"{k}:{a}:{b}" for k, spans in found.items() for a, b in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(map(len, found.values()))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.spans.startswith(text)


def test_op5(rows, texts):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    for r in rows("op5_license_scan"):
        w = PLAIN.findall(lower(texts[r.doc_id]))
        at = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        places, labels = [i for i, _ in at], sorted({x for _, x in at})
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(labels) and set(labels) <= set(r.labels.split(",")) | {""} and r.labels == ",".join(sorted(set(r.labels.split(",")))) and 0 <= r.score <= 1


def test_op6_against_sql(spark, rows):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL["op6_decontamination"])
    assert sorted(map(tuple, rows("op6_decontamination"))) == sorted(want.select(*[f'"{c}"' for c in rows("op6_decontamination")[0].asDict()]).fetchall())


def test_op7(rows, texts):
    seen, copies = [], set()
    for doc in sorted(texts):
        gone, n = {}, 0
        for k, line in enumerate(texts[doc].split("\n")):
            words = frozenset(re.sub(r"[\t\r\x0b\x0c]", " ", line).split(" ")) - {""}
            if not words:
                continue
            n += 1
            if line in copies:
                gone[k] = "copy"
                continue
            if any(0.8 * len(words) <= len(s) <= len(words) / 0.8 and 10 * len(words & s) >= 8 * len(words | s) for s in seen):
                gone[k] = "similar"
            copies.add(line)
            seen.append(words)
        texts_row = next(r for r in rows("op7_line_dedup") if r.doc_id == doc)
        assert (texts_row.n_lines, texts_row.n_copies, texts_row.removed) == (n, sum(v == "copy" for v in gone.values()), ",".join(map(str, sorted(gone))))


def test_op8(rows):
    got = rows("op8_quality_classifier")
    cut = min(r.score for r in got if r.kept)
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 and r.kept == (r.score >= cut) for r in got)


def test_op9(spark, rows, texts):
    source = {r.doc_id: r.source for r in table(spark, SF, "documents").collect()}
    sizes = Counter()
    for d, t in texts.items():
        sizes[source[d]] += len(SPACED.findall(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, total, done = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in done]
        rest = total - sum(done.values())
        over = [s for s in free if rest * weight[s] / sum(weight[x] for x in free) > 3 * sizes[s] + 1e-9]
        done |= {s: 3 * sizes[s] for s in over}
        if not over:
            done |= {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
            break
    taken, largest = Counter(), Counter()
    for r in rows("op9_mixing"):
        s = source[r.doc_id]
        assert r.size == len(SPACED.findall(texts[r.doc_id])) and r.source_size == sizes[s] and abs(r.target - done[s]) < 1e-6 * total
        assert 0 <= r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert all(abs(taken[s] - done[s]) <= largest[s] for s in sizes)
    assert sorted(map(tuple, mixing.mixture(table(spark, SF, "documents").repartition(5)).select("doc_id", "taken").collect())) == sorted((r.doc_id, r.taken) for r in rows("op9_mixing"))


def test_op10(spark, rows):
    pages = {r.page_id: r.html or "" for r in table(spark, SF, "pages").collect()}
    for r in rows("op10_html_text"):
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = re.split(r"</?(?:p|h1|h2|div|ul|li)[^>]*>", article)
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", "\n")))).strip() for b in blocks]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
