"""The corpus operators against brute-force versions, on odd rows and on held-out labels."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from auditlake.llm import decontaminate, htmltext, licenses, linededup, mixing, pii, rules, simhash, toxicity, weaklabel

LONG = " ".join(f"w{i % 997}x{i // 7}" for i in range(30_000))
BASE = " ".join(f"word{i}" for i in range(60))
NEAR = BASE.replace("word30", "other")
ROWS = [
    (1, BASE, "en", "a", 1), (2, BASE, "en", "a", 1), (3, NEAR, "en", None, 1), (4, None, None, "b", None), (5, "", "en", "b", 0), (6, LONG, "en", "c", 1),
    (None, "no id here", "en", "a", 1), (7, "tie\ntie\n\n tie ", "en", "a", 3), (7, "tie\ntie\n\n tie ", "en", "a", 3), (8, "a b c", "de", "b", 5), (9, "\t \n", "de", "b", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns whose names the operators might use themselves
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("_found", F.lit(1)).withColumn("score", F.lit("x")).withColumn("row", F.lit(2)).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (99, 1, 1), (None, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int")


def shingle_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_is_exact(spark):
    rng = np.random.default_rng(3)
    texts = [ROWS[i][1] for i in range(len(ROWS))]
    for _ in range(120):
        w = BASE.split() * 3
        for _ in range(rng.integers(0, 4)):
            w[rng.integers(0, len(w))] = f"new{rng.integers(0, 9)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = simhash.near_duplicate_groups(df).collect()
    fp = {i: shingle_fingerprint(t) for i, t in enumerate(texts)}
    root = {i: i for i in fp}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in fp:
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{f:016x}" for i, f in fp.items()}
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in fp}


def test_simhash_links_in_blocks_and_large_cells(spark):
    rng = np.random.default_rng(5)
    center = int(rng.integers(0, 2**63))
    fps = sorted({center ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (300, 2))} | {int(x) for x in rng.integers(0, 2**63, 50)})
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in fps], "fp long"), block=16)
    pairs = {tuple(sorted((r.a, r.b))) for r in links.collect()}
    assert all((a ^ b).bit_count() <= 8 for a, b in pairs)
    near = {x for x in fps if (x ^ center).bit_count() <= 2}
    seen = {x for p in pairs for x in p}
    assert near <= seen


def test_edges_of_every_operator(spark, docs, labels):
    n = len(ROWS)
    assert simhash.near_duplicate_groups(docs).count() == n
    assert toxicity.with_toxicity(docs, labels, into="_t").where("_t between 0 and 1").count() == n
    assert rules.judged(docs, rules.fit(docs, labels)).where("_judged.base_failed is not null and _judged.kept is not null").count() == n
    assert weaklabel.quality_scores(docs).where("_quality.score between 0 and 1 and _quality.posterior between 0 and 1 and _quality.kept is not null").count() == n
    assert pii.personal_spans(docs).count() == n
    assert licenses.license_scan(docs, into="_license").where("_found = 1").count() == n
    assert linededup.dedup_report(docs).count() == n
    mixed = mixing.mixture(docs).collect()
    assert len(mixed) == n and all(0 <= r.taken <= 3 * r.size for r in mixed)
    bench = spark.createDataFrame([(1, BASE), (2, None), (None, "x y"), (3, "")], "item_id long, text string")
    out = decontaminate.decontaminate(docs, bench)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {None, 4, 5, 6, 7, 8, 9}


def test_empty_tables(spark, docs, labels):
    none, bare = docs.limit(0), labels.limit(0)
    assert simhash.near_duplicate_groups(none).count() == 0
    assert toxicity.drop_toxic(none, bare).count() == 0
    assert toxicity.drop_toxic(docs, bare).count() == len(ROWS)
    assert rules.judged(none, rules.fit(none, bare)).count() == 0
    assert weaklabel.quality_scores(none).count() == 0
    assert pii.personal_spans(none).count() == 0
    assert licenses.license_scan(none, into="_f").count() == 0
    assert linededup.dedup_report(none).count() == 0
    assert mixing.mixture(none).count() == 0
    assert decontaminate.decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).count() == len(ROWS)


def test_decontamination_in_blocks(spark, docs):
    bench = spark.createDataFrame([(i, " ".join(f"word{k}" for k in range(i, i + 12))) for i in range(0, 40, 5)], "item_id long, text string")
    one = decontaminate.contaminated_words(docs, bench, into="f").select("doc_id", "f").collect()
    many = decontaminate.contaminated_words(docs, bench, block_chars=200, into="f").select("doc_id", "f").collect()
    plain = lambda rows: sorted((r.doc_id or 0, r.f.n_hit, r.f["items"]) for r in rows)
    assert plain(one) == plain(many)
    assert next(r.f.n_hit for r in one if r.doc_id == 1) == 47


def test_repeated_words():
    def brute(w):
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
        return len(hit)

    rng = np.random.default_rng(1)
    for size, kinds in ((3, 2), (40, 3), (200, 5), (300, 40)):
        w = [b"%d" % x for x in rng.integers(0, kinds, size)]
        assert rules.repeated_words(w) == brute(w)
    many = [b"%d" % i for i in range(5000)]
    assert rules.repeated_words(many + many[:7]) == 14


def test_base_spans(spark):
    texts = ["mail a@b.c_d@e.f x", "1.2.3.4.5.6.7.8 and 256.1.1.1", "card 4111 1111 1111 1111, 4111-1111-1111-1112", "+1 (132) 555-1352 or +12", "é a@b.cé", None, "7" * 3000 + " " + "9." * 500]
    want = [["a@b.c", "_d@e.f"], ["1.2.3.4", "5.6.7.8"], ["4111 1111 1111 1111"], ["+1 (132) 555-1352"], ["a@b.c"], [], []]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.base_spans(df).orderBy("doc_id").collect():
        text = r.text or ""
        assert all(text[s.start : s.stop] == s.value for s in r._spans)
        assert [s.value for s in r._spans if r.doc_id != 6] == want[r.doc_id]


def test_disclosing_terms_are_generalised(spark):
    rows = [(i, f"filler the word{i} zorgon me{i}@mail.example.com the rest of it goes on and on") for i in range(12)] + [(100 + i, "the plain text has no mail at all " * 20) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = pii.personal_spans(df)
    out = {r.doc_id: r.text for r in pii.sanitised(df, spans).collect()}
    assert "zorgon" not in out[3] and "[EMAIL]" in out[3] and "[TERM]" in out[3] and out[100] == rows[12][1]


def test_licenses():
    index = licenses.TemplateIndex({})
    words = licenses.plain_words("Some text.\nThis work is licensed under the GNU General Public License, version 3.")
    assert licenses.base_places(words) == [(9, "gpl")]
    assert "gpl-3.0" in index.scan(words)[0]
    assert index.scan(licenses.plain_words("a general note about the license of the public"))[0] == set()
    assert "mit" in index.scan(licenses.plain_words("Released under the MIT License."))[0]


def brute_verdicts(rows):
    """(doc, variant, line number) to verdict, for rows (doc, text) in the order of the documents."""
    seen, want, texts = [], {}, {}
    for d, text in rows:
        v = texts.setdefault(d, []).index(text) if text in texts.setdefault(d, []) else len(texts[d])
        if v < len(texts[d]):
            continue
        texts[d].append(text)
        for i, line in enumerate((text or "").split("\n")):
            s = set(re.sub(r"[\t\r\x0b\x0c]", " ", line).split(" ")) - {""}
            if s:
                near = any(10 * len(s & t) >= 8 * len(s | t) for t, _ in seen)
                want[d, v, i] = "copy" if any(x == line for _, x in seen) else "similar" if near else "keep"
                seen.append((s, line))
    return want


def verdicts(spark, rows):
    got = linededup.line_verdicts(spark.createDataFrame(rows, "doc_id long, text string"))
    return {(r.doc, r.variant, r.k): r.verdict for r in got.collect()}


def test_line_dedup_is_exact(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"v{i}" for i in range(60)]
    bases = [list(rng.choice(vocabulary, rng.integers(1, 25))) for _ in range(14)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(5):
            w = list(bases[rng.integers(0, len(bases))])
            for _ in range(rng.integers(0, 3)):
                w[rng.integers(0, len(w))] = str(rng.choice(vocabulary))
            lines.append(" ".join(w[: len(w) - rng.integers(0, 3)] or w))
        rows.append((d, "\n".join(lines)))
    assert verdicts(spark, rows) == brute_verdicts(rows)


def test_line_dedup_of_a_hot_line(spark):
    """Hundreds of variants of one line, most of them too far from each other, among them a base that comes late."""
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(20)]
    rows = []
    for d in range(300):
        w = list(base)
        for _ in range(rng.integers(1, 4)):
            w[rng.integers(0, 20)] = f"n{rng.integers(0, 400)}"
        rows.append((d, " ".join(base if d == 150 else w) + "\nthe hot line of all texts"))
    assert verdicts(spark, rows) == brute_verdicts(rows)


def test_line_dedup_posts_two_fifths_of_a_line(spark):
    """Lines of n words post 0.4 n + 1 runs, and pairs at and just under the threshold are told apart at all lengths."""
    rng = np.random.default_rng(5)
    sizes = [1, 2, 3, 4, 5, 8, 9, 10, 14, 27, 45, 63, 90, 180, 300]
    rows = []
    for n in sizes:
        base = [f"w{x}" for x in rng.choice(5000, n, replace=False)]
        for cut in range(4):  # Jaccard similarity of 0.8 allows n // 5 words less, or n // 9 replaced
            less, other = n // 5 + cut - 2, n // 9 + cut - 2
            fewer = list(rng.permutation(base)[max(less, 0) :])
            changed = list(rng.permutation(base)[max(other, 0) :]) + [f"x{x}" for x in rng.choice(5000, max(other, 0), replace=False)]
            rows += [(len(rows) + i, " ".join(w)) for i, w in enumerate((fewer, changed) if cut % 2 else (changed, fewer))]
        rows.append((len(rows), " ".join(base)))
    assert verdicts(spark, rows) == brute_verdicts(rows)
    docs = linededup.numbered(spark.createDataFrame(rows[-1:], "doc_id long, text string"))
    none = spark.createDataFrame([], "key long, key2 long")
    posts = linededup.postings(linededup._lines(docs), none, linededup.rarity_table(docs))
    assert posts.count() == 121


def test_line_dedup_of_one_id_with_several_texts(spark):
    texts = ["wholly other opening words here\ntail one", "a shared line of five words\ntail two", "a shared line of five words\ntail two"]
    by_hash = sorted(set(texts), key=lambda t: xxhash.xxh64(t.encode(), 42).intdigest() - (1 << 64) * (xxhash.xxh64(t.encode(), 42).intdigest() >> 63))
    rows = [(1, "a shared line of five words\nfirst text"), *[(2, t) for t in by_hash], (2, by_hash[0]), (3, None), (3, "")]
    assert {k: v for k, v in verdicts(spark, rows).items() if k[0] < 3} == brute_verdicts(rows[:4])
    out = linededup.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit("x")).withColumn("variant", F.lit(1)))
    assert out.columns == ["doc_id", "text", "hash", "variant"]
    got = sorted((r.doc_id, r.text or "", r.hash) for r in out.collect())
    assert (2, texts[0], "x") in got and got.count((2, "tail two", "x")) + got.count((2, texts[1], "x")) >= 1 and len(got) == len(rows)
    report = linededup.dedup_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_lines) for r in report) == [(1, 2), (2, 2), (2, 2), (2, 2), (3, 0), (3, 0)]


def test_mixing_targets(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), s) for i, s in enumerate(rng.choice(list("abc"), 9000, p=[0.6, 0.3, 0.1]))]
    df = spark.createDataFrame([(i, t, str(s)) for i, t, s in rows], "doc_id long, text string, source string")
    one, two = (sorted(map(tuple, mixing.mixture(x).collect())) for x in (df, df.repartition(13)))
    assert one == two
    sizes = {s: sum(r[2] for r in one if r[1] == s) for s in "abc"}
    total, targets, w = sum(sizes.values()), {}, {"a": 5, "b": 2, "c": 1}
    left = dict(w)
    while True:
        rest = total - sum(targets.values())
        over = [s for s in left if rest * w[s] / sum(left.values()) > 3 * sizes[s]]
        if not over:
            targets |= {s: rest * w[s] / sum(left.values()) for s in left}
            break
        for s in over:
            targets[s] = 3 * sizes[s]
        left = {s: v for s, v in left.items() if s not in over}
    for s in "abc":
        mine = [r for r in one if r[1] == s]
        assert abs(mine[0][4] - targets[s]) < 1e-6 * total
        assert abs(sum(r[5] for r in mine) - targets[s]) <= 60


def test_html_text():
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/x>Menu</a></li></ul></nav><div class='ad'>Buy now</div>"
        "<article><h1>Head &amp; more</h1><p>First <b>bold</b>\n text.<p>Second<br>line.</p><div class=comments><p>Reader says</p></div></article><footer>&copy; x</footer></body></html>"
    )
    model = htmltext.train([page] * 3)
    assert htmltext.main_text(page, model) == "Head & more\nFirst bold text.\nSecond line."
    assert htmltext.main_text("", model) == "" and htmltext.main_text(None, model) == ""


def test_marginals_are_exact():
    import itertools

    nodes = htmltext.parse("<div><p>aaa</p><ul class=menu><li>b</li></ul></div><p>c</p>")
    rng = np.random.default_rng(4)
    seen = {f: rng.integers(0, 9, 3).astype(float) for f in ("t:p 0", "t:li 0", "t:div 0", "n:2 0")}
    container, text = (rng.dirichlet([1, 1, 1], 3) for _ in range(2))
    model = htmltext.DomModel(seen, np.array([20.0, 30.0, 9.0]), container, text)
    furniture, named, _ = htmltext.observed(nodes)
    assert [n.tag for n, f in zip(nodes, named) if f] == ["ul"] and not any(furniture)
    total, on = 0.0, np.zeros(len(nodes))
    for y in itertools.product(range(3), repeat=len(nodes)):
        w = float(y[0] == htmltext.WRAPPER)
        for node in nodes[1:]:
            w *= float(y[node.index] == htmltext.FURNITURE) if furniture[node.index] else model.likelihood(htmltext._features(node))[y[node.index]] / (htmltext.NAME_ODDS if named[node.index] and y[node.index] != htmltext.FURNITURE else 1.0)
            w *= (container if node.tag in htmltext.CONTAINERS else text)[y[node.parent.index], y[node.index]]
        total += w
        on += w * (np.array(y) == htmltext.CONTENT)
    assert np.allclose(model.marginals(nodes, furniture, named), on / total, atol=1e-6)


def test_toxicity_generalises_to_misspellings():
    rng = np.random.default_rng(6)
    clean = [f"w{i}" for i in range(300)]
    texts, y = [], []
    for i in range(400):
        w = list(rng.choice(clean, 40))
        if i % 5 == 0:
            w[rng.integers(0, 40)] = str(rng.choice(["horrible", "disgusting", "worthless"]))
        texts.append(" ".join(w))
        y.append(int(i % 5 == 0))
    score = toxicity.train(texts, y).scorer()
    bad, good, none, missing = score(["w1 w2 worthlesss w3 w4", "w1 w2 w5 w3 w4", "", None])
    assert bad > 0.3 > good and none == missing == 0


def test_subwords():
    words = [b"a", "é".encode(), b"abcdefgh", b"abcdefgh"[::-1], b"x" * 300, b"abc"]
    bucket, owner = toxicity.subwords(words, 1 << 17)
    for i, w in enumerate(words):
        assert (owner == i).sum() == 1 + sum(max(0, len(w) + 2 - n + 1) for n in toxicity.GRAMS)
        alone, _ = toxicity.subwords([w], 1 << 17)
        assert sorted(alone) == sorted(bucket[owner == i])
    assert len(set(bucket[owner == 2]) & set(bucket[owner == 5])) == 3  # "<ab", "abc" and "<abc"
    assert [len(x) for x in toxicity.subwords([], 8)] == [0, 0]


def test_weak_labels_find_junk(spark):
    good = [" ".join(f"text{(i * k) % 97}" for k in range(1, 80)) for i in range(60)]
    bad = [" ".join("A%B$ | !!" for _ in range(30)) for _ in range(12)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    out = weaklabel.quality_scores(df.withColumn("_s", F.lit(7)).withColumn("_stats", F.lit("own")))
    assert out.columns == ["doc_id", "text", "_s", "_stats", "_quality"] and {(r._s, r._stats) for r in out.collect()} == {(7, "own")}
    got = {r.doc_id: r._quality.kept for r in out.collect()}
    assert all(got[i] for i in range(60)) and not any(got[60 + i] for i in range(12))


def test_clashing_columns(spark, docs, labels):
    """Columns whose names the operators use themselves come back as they were."""
    odd = docs
    for c in ("_s", "_stats", "_votes", "_score", "_rid", "_text", "hash", "id", "line", "fp", "tie", "part", "key", "variant", "_t"):
        odd = odd.withColumn(c, F.lit(f"own {c}"))
    bench = spark.createDataFrame([(1, BASE)], "item_id long, text string")
    outs = [
        toxicity.with_toxicity(odd, labels, into="_new"), rules.judged(odd, rules.fit(odd, labels), into="_new"), weaklabel.quality_scores(odd, into="_new"), licenses.license_scan(odd, into="_new"),
        decontaminate.contaminated_words(odd, bench, into="_new"), toxicity.drop_toxic(odd, labels), decontaminate.decontaminate(odd, bench), linededup.without_repeated_lines(odd), simhash.keep_first_of_groups(odd),
    ]
    for out in outs:
        assert [c for c in out.columns if c != "_new"] == odd.columns
        for r in out.drop("_new").limit(3).collect():
            assert all(r[c] == f"own {c}" for c in odd.columns if c not in docs.columns)
    assert mixing.mixture(odd).count() == pii.personal_spans(odd).count() == linededup.dedup_report(odd).count() == len(ROWS)


def test_near_dedup_keeps_different_texts_of_one_id(spark):
    other = " ".join(f"quite different words number {i}" for i in range(30))
    df = spark.createDataFrame([(1, BASE), (1, other), (1, other), (2, BASE), (None, other), (None, "alone and unlike the rest"), (3, None), (4, "")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, (r.text or "")[:5]) for r in simhash.keep_first_of_groups(df).collect())
    assert got == [(0, "alone"), (1, "quite"), (1, "word0"), (3, "")]


def test_html_text_of_odd_pages(spark):
    page = "<html><body><nav><a href=x>Menu</a></nav><article><h1>T</h1><p>Some text of an article.</p></article></body></html>"
    df = spark.createDataFrame([(i, p) for i, p in enumerate([page, page, None, "", "<", "plain", "<p", "<article>x"])], "page_id long, html string").withColumn("_features", F.lit(1))
    got = {r.page_id: r._text for r in htmltext.extracted(df).collect()}
    assert got[0] == got[1] == "T\nSome text of an article." and got[2] == got[3] == "" and got[7] == "x" and len(got) == 8
    assert htmltext.extracted(df.limit(0)).count() == 0


def test_html_text_keeps_the_article():
    page = (
        "<html><body><header><h1>Site</h1></header><nav><ul><li><a href=/x>Menu</a></li></ul></nav><article><div class='article-header'><h1>Title</h1></div><p>First <math><mi>x</mi><mo>=</mo><mn>2</mn></math>."
        "</p><ul class='related-work'><li>One</li><li>Two</li></ul><h2 id='search-and-rescue'>Rescue</h2><p hidden>Kept</p><p aria-hidden=true>Too</p><div class='comment-list'><p>A reader says</p></div><aside>Side</aside>"
        "<form><label>Name</label></form></article><div id='sidebar-left'><p>Left</p></div><footer>End</footer></body></html>"
    )
    plain = "<html><body><nav><ul><li><a href=/x>Menu</a></li></ul></nav><div class=ad>Buy this thing now</div><article><h1>Title</h1><p>Some words of text</p><p>Yes.</p><p>No</p><p>And some more words</p></article><footer>Copyright of the site</footer></body></html>"
    model = htmltext.train([plain] * 40)
    assert htmltext.main_text(page, model) == "Title\nFirst x=2.\nOne\nTwo\nRescue\nKept\nToo"
    unmarked = "<body><div class=content><h1>Title</h1><p>Some text is here, and it is long.</p></div><div class=sidebar><p>Side text</p></div></body>"
    assert htmltext.main_text(unmarked, model) == "Title\nSome text is here, and it is long."


def test_html_text_takes_linear_time():
    import time

    model = htmltext.train([])
    for piece in ("<a ", "<b>x", "<td>x", '<a title="', "<a =", "<div>", "<p><b>", "<!--", "&amp"):
        began = time.process_time()
        htmltext.main_text(piece * (400_000 // len(piece)), model)
        assert time.process_time() - began < 8, piece


def test_pii_of_a_long_text(spark):
    text = "\n".join(f"user{i}@mail.example.com 10.0.0.{i % 250} t" for i in range(20_000))
    r = pii.base_spans(spark.createDataFrame([(text,)], "text string")).select(F.size("_spans").alias("n"), F.element_at("_spans", -1).alias("last"), F.size(pii._line_words(F.col("text"), F.col("_spans"))).alias("words")).first()
    assert r.n == 40_000 and text[r.last.start : r.last.stop] == r.last.value == "10.0.0.249" and r.last.line == 19_999 and r.words == 20_000 * 5
