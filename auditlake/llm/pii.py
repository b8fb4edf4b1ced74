"""Personal data: base patterns, and information-theoretic sanitisation of what stands beside them.

DataFrame functions only. Spans come from splitting a text at a pattern: the pieces and the matches alternate, so their
lengths give the positions. A term's occurrences on lines that hold a protected entity are counted against all its
occurrences; it discloses an entity if at least half of them stand on such lines and that is much more than lines do:
the log odds of an entity on the line, given the term, exceed those of any line by a number of bits, which no share of
such lines puts out of reach. One occurrence at the lines' rate is added, so that names that occur once count too. Such
terms are generalised wherever they stand, in every text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import written

# Possessive forms of the patterns: they match the same texts without backtracking. A mail address can only start
# where no earlier character of the same run does, or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
SPAN = "array<struct<kind:int,start:int,stop:int,value:string,line:int>>"
TERM = len(KINDS)
LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
GAPS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
PRIOR, DISCLOSURE, BITS = 1.0, 0.5, 2.0
CHUNK = 64
HASHES = 1 << 22  # most rows of the table that keeps other words out of the join with the terms


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row, however often the functions in body go over it."""
    return F.transform(F.array(value), body)[0]


def _folded(values: Column) -> Column:
    start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.array_append(acc["out"], acc["sum"] + x).alias("out"))
    return F.aggregate(values, start, step, lambda acc: acc["out"])


def _running(values: Column) -> Column:
    """Running sums of an array of int. Appending copies an array, so sums are made by chunks and then shifted: the time is in proportion to CHUNK * n."""

    def of(v: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda c: _folded(F.slice(v, c * CHUNK + 1, F.lit(CHUNK))))
        return _let(chunks, shifted)

    def shifted(local: Column) -> Column:
        sums = F.transform(local, lambda a: F.element_at(a, -1))
        before = F.zip_with(_folded(sums), sums, lambda x, y: x - y)
        return F.flatten(F.zip_with(local, before, lambda a, b: F.transform(a, lambda x: x + b)))

    return _let(values, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(F.array().cast("array<int>")))


def _spans(text: Column, matches: Column, pattern: str, kind: int) -> Column:
    """The matches of one pattern in a text as spans; line is the number of line breaks before one."""
    parts = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(matches)).alias("gap"), matches.alias("hit"))

    def made(parts: Column) -> Column:
        stops = _running(F.transform(parts, lambda x: F.length(x["gap"]) + F.length(x["hit"])))
        lines = _running(F.transform(parts, lambda x: F.length(x["gap"]) - F.length(F.replace(x["gap"], F.lit("\n"), F.lit("")))))
        at = F.arrays_zip(stops.alias("stop"), lines.alias("line"), F.transform(parts, lambda x: x["hit"]).alias("hit"))
        return F.transform(at, lambda x: F.struct(F.lit(kind).alias("kind"), (x["stop"] - F.length(x["hit"])).alias("start"), x["stop"].alias("stop"), x["hit"].alias("value"), x["line"].alias("line")))

    return F.when(F.size(matches) > 0, _let(parts, made)).otherwise(F.array().cast(SPAN))


def _luhn(digits: Column) -> Column:
    """Whether the digits' Luhn sum is a multiple of ten."""
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))
    last = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((last - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(places, F.lit(0), lambda acc, i: acc + F.coalesce(worth(i), F.lit(0))) % 10 == 0


def _valid(kind: str):
    def test(span: Column) -> Column:
        digits = F.regexp_replace(span["value"], "[^0-9]", "")
        if kind == "ip":
            return span["value"].rlike(r"^(0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(\.|$)){4}$")
        if kind == "card":
            return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
        if kind == "phone":
            return F.length(digits).between(9, 15)
        return F.lit(True)

    return test


def base_spans(docs: DataFrame, text: str = "text", into: str = "_spans") -> DataFrame:
    """docs with `into`: the valid spans of the four kinds, by kind, then start (code points, end exclusive)."""
    body = F.coalesce(F.col(text), F.lit(""))
    for kind, pattern in PATTERNS.items():
        first = "@" if kind == "email" else "+" if kind == "phone" else None
        found = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
        docs = docs.withColumn(f"_m_{kind}", F.when(F.contains(body, F.lit(first)), found).otherwise(F.array().cast("array<string>")) if first else found)
    made = [F.filter(_spans(body, F.col(f"_m_{k}"), PATTERNS[k], i), _valid(k)) for i, k in enumerate(KINDS)]
    return docs.withColumn(into, F.concat(*made)).drop(*[f"_m_{k}" for k in KINDS])


def _words(lines: Column) -> Column:
    """Lower-cased words of lines."""
    return F.filter(F.flatten(F.transform(lines, lambda x: F.split(F.lower(x), GAPS))), lambda w: w != "")


def _entity_lines(text: Column, spans: Column) -> Column:
    """The lines that hold a span."""
    at = F.array_distinct(F.transform(spans, lambda s: s["line"]))
    return _let(F.split(text, "\n", -1), lambda every: F.transform(at, lambda i: F.get(every, i)))


def _line_words(text: Column, spans: Column) -> Column:
    """Lower-cased words of the lines that hold a span, those of the spans among them; each line counts once."""
    return _words(_entity_lines(text, spans))


def disclosing_terms(docs: DataFrame, near: DataFrame, text: str = "text", prior: float = PRIOR, disclosure: float = DISCLOSURE, bits: float = BITS) -> DataFrame:
    """(term, bits): words of which a share of `disclosure` of the occurrences, at least, is on lines with an entity, and whose log odds are `bits` above the lines'.

    near: (near, lines) for each text, the words of its lines with an entity and how many these lines are. All words of
    all texts are counted. Shares are estimated with `prior` occurrences at the rate of all lines added. A corpus whose
    lines all hold an entity, or none, has no such terms.
    """
    lines = F.split(F.col(text), "\n", -1)
    total = docs.select(F.explode(F.split(F.lower(F.col(text)), GAPS)).alias("term")).where("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    close = near.select(F.explode("near").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("k"))
    spoken = F.size(F.filter(lines, lambda x: x.rlike(LETTERS)))
    all_lines = docs.where(F.col(text).isNotNull()).agg(F.sum(spoken).alias("all_n"))
    whole = all_lines.join(F.broadcast(near.agg(F.sum("lines").alias("all_k")))).select((F.col("all_k") / F.nullif("all_n", F.lit(0))).alias("rate"))  # one row each
    share = (F.col("k") + prior * F.col("rate")) / (F.col("n") + prior)
    both = close.join(total, "term").join(F.broadcast(whole)).where("rate < 1").withColumn("share", share).where(F.col("share") >= disclosure)
    odds = lambda c: F.col(c) / (1 - F.col(c))
    return both.select("term", F.log2(odds("share") / odds("rate")).alias("bits")).where(F.col("bits") >= bits)


def term_spans(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """(key, span): spans of kind TERM of every term in every text of docs (key, text), however it is written.

    Each character between words becomes a space, and running sums of the words' lengths give their positions. Words
    whose hash no term has are dropped before the join; the table of hashes is broadcast, of at most HASHES rows of one
    number. Where terms are so many that it tells nothing, the join with the terms has all words to shuffle.
    """
    hash_of = F.pmod(F.xxhash64("term"), F.lit(HASHES)).cast("int").alias("hash")

    def placed(words: Column) -> Column:
        stops = _running(F.transform(words, lambda w: F.length(w) + 1))
        return F.filter(F.zip_with(words, stops, lambda w, stop: F.struct(w.alias("word"), (stop - 1).alias("stop"))), lambda x: x["word"] != "")

    words = docs.select("key", F.explode(_let(F.split(F.regexp_replace(text, GAPS[:-1], " "), " "), placed)).alias("w")).select("key", "w.*")
    words = words.withColumn("term", F.lower("word")).withColumn("hash", hash_of)
    likely = words.join(F.broadcast(terms.select(hash_of).distinct()), "hash", "left_semi")
    span = F.struct(F.lit(TERM).alias("kind"), (F.col("stop") - F.length("word")).alias("start"), "stop", F.col("word").alias("value"), F.lit(None).cast("int").alias("line"))
    return likely.join(terms.select("term"), "term").select("key", span.alias("span"))


def outside(words: DataFrame, found: DataFrame) -> DataFrame:
    """The (key, span) of words that share no character with a base span of their text; found: (key, base).

    The spans of a text are sorted together: the furthest end of a base span that starts no later, and the nearest start
    of one that starts no earlier, tell.
    """
    base = found.join(words.select("key").distinct(), "key", "left_semi").select("key", F.explode("base").alias("span")).where("span.start < span.stop")
    rows = words.select("key", "span").unionByName(base.select("key", "span")).withColumn("at", F.col("span.start"))
    is_base = F.col("span.kind") < TERM
    upto = Window.partitionBy("key").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("key").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.withColumn("ends", F.max(F.when(is_base, F.col("span.stop"))).over(upto)).withColumn("begins", F.min(F.when(is_base, F.col("at"))).over(after))
    return seen.where(~is_base & (F.coalesce("ends", F.lit(0)) <= F.col("at")) & (F.col("begins").isNull() | (F.col("begins") >= F.col("span.stop")))).select("key", "span")


def personal_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, spans) for each row of docs; spans: base spans, then those of disclosing terms (kind TERM), sorted.

    Null and empty texts have no spans. Rows without id, repeated rows and other columns are fine: terms are looked up
    by id and text, and equal rows have equal spans. An empty table gives no rows.
    """
    key = F.struct(F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("hash"))
    slim = docs.select(key.alias("key"), F.col(text).alias("_text"))
    found = base_spans(slim, "_text")
    lines = F.when(F.size("_spans") > 0, _entity_lines(F.col("_text"), F.col("_spans"))).otherwise(F.array().cast("array<string>"))
    near = _let(lines, lambda x: F.struct(_words(x).alias("near"), F.size(x).alias("lines")))
    found = written(found.select("key", F.col("_spans").alias("base"), near.alias("near")))
    terms = written(disclosing_terms(docs, found.select("near.*"), text))
    words = written(term_spans(slim, terms, "_text"))  # else the joins of outside() are moved before those that leave few words
    extra = outside(words, found).groupBy("key").agg(F.array_sort(F.collect_set("span")).alias("extra"))
    spans = F.concat("base", F.coalesce("extra", F.array().cast(SPAN)))
    return found.join(extra, "key", "left").select(F.col("key.id").alias("doc_id"), F.col("key.hash").alias("text_hash"), "base", spans.alias("spans"))


def sanitised(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, text): texts with base spans replaced by their kind and disclosing terms by [TERM]. spans: personal_spans().

    Null texts stay null, texts without spans stay as they are. Rows are matched by id and text, so repeated rows, rows
    without id and several texts of one id get their own results. An empty table gives no rows.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    one = spans.groupBy(F.col("doc_id").alias("i"), F.col("text_hash").alias("j")).agg(F.first("spans").alias("spans"))
    both = keyed.join(one, keyed["doc_id"].eqNullSafe(one["i"]) & (keyed["h"] == one["j"]), "left")
    in_order = F.array_sort(F.transform(F.coalesce("spans", F.array().cast(SPAN)), lambda s: F.struct(s["start"].alias("a"), s["stop"].alias("b"), s["kind"].alias("k"))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in [*KINDS, "term"]])

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring("text", acc["at"] + 1, s["a"] - acc["at"])
        done = F.struct(s["b"].alias("at"), F.concat(acc["out"], gap, F.element_at(names, s["k"] + 1)).alias("out"))
        return F.when(s["a"] >= acc["at"], done).otherwise(acc)

    text = F.aggregate(in_order, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring("text", acc["at"] + 1, F.length("text"))))
    return both.select("doc_id", text.alias("text"))


def spans_text(spans: Column) -> Column:
    """kind:start:stop, comma-joined."""
    names = F.array(*[F.lit(k) for k in [*KINDS, "term"]])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))))
