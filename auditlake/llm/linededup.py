"""Line dedup as an exact set-similarity self-join, in DataFrame operations only.

A line is a set of words. Words are ordered by rarity (a table of corpus counts by hash bucket gives the level, the hash
breaks ties). Each word that only one of two lines has breaks at most two runs of two neighbours in its own line's order
and one in the other's, so lines of Jaccard similarity 0.8 share a run of two among the first 0.4 n + 1: these runs are
the prefix.

Postings (run, line) of distinct lines are shuffled once, with a map of 64 bits of the line's words. Where few lines have
a run, each is compared there with all earlier ones, else with the earliest, by size and positional filters and by the
maps; the pairs that pass are counted, and each line is first verified on its words with the one that it meets most
often: nearly all similar lines are settled there. Lines that this does not settle are verified with the others they met
and, in runs of many lines, with all earlier ones whose maps are near. Maps of 256 bits rule out pairs before words are
compared. A line goes if an earlier line is equal or similar.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import row_id, sorted_side, written

TENTHS = 8  # similarity in tenths
BUCKETS = 1 << 17
MARKS = 1 << 23  # bits of the tables that keep lines out of a shuffle; each is broadcast as MARKS / 64 rows at most
DENSE = 8  # in runs of more lines, lines are compared with the earliest one first, and with all others only if that does not settle them
FULL = 255  # sizes and positions of that and more are not told apart; the filters let such lines pass


def _spaced(text: Column) -> Column:
    """text with other white space of a line turned into spaces; most texts have none and are passed on as they are."""
    odd = [F.contains(text, F.lit(c)) for c in "\t\r\x0b\x0c"]
    return F.when(odd[0] | odd[1] | odd[2] | odd[3], F.translate(text, "\t\r\x0b\x0c", "    ")).otherwise(text)


def numbered(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc, variant, hash, body), one row for each id and text of docs; doc is row_id(), hash the text's.

    Different texts of one id are told apart by variant, their rank by hash. Where no id occurs twice (a count by id
    tells), all variants are 0 and no text is shuffled.
    """
    rows = docs.select(row_id(doc_id, text).alias("doc"), F.xxhash64(text).alias("hash"), F.col(text).alias("body"))
    zero = F.lit(0).cast("long")
    if docs.groupBy(doc_id).count().where(f"count > 1 or `{doc_id}` is null").isEmpty():
        return rows.withColumn("variant", zero)
    slim = rows.groupBy("doc", "hash").count()
    several = slim.groupBy("doc").count().where("count > 1").select("doc")
    ranks = slim.join(sorted_side(several), "doc").select("doc", "hash", (F.dense_rank().over(Window.partitionBy("doc").orderBy("hash")) - 1).cast("long").alias("variant"))
    return written(rows.groupBy("doc", "hash").agg(F.first("body").alias("body")).join(sorted_side(ranks), ["doc", "hash"], "left").withColumn("variant", F.coalesce("variant", zero)))


def _lines(rows: DataFrame) -> DataFrame:
    """(doc, variant, k, line): every line that holds a word; k is its number in the text, from 0."""
    lines = rows.select("doc", "variant", F.posexplode(F.split("body", "\n", -1)).alias("k", "line"))
    return lines.where(F.trim("line", F.lit(" \t\r\x0b\x0c")) != "")


def _keys(line: Column) -> list[Column]:
    """128 bits that stand for a line's text."""
    return [F.xxhash64(line).alias("key"), F.xxhash64(F.lit(1), line).alias("key2")]


def _table(rows: DataFrame, *cols: str) -> DataFrame:
    """(word, bits): a table of MARKS bits in which those are set that the hashes of cols have in some row."""
    mark = F.xxhash64(*cols).bitwiseAND(F.lit(MARKS - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), mark.bitwiseAND(F.lit(63)).cast("int"))
    return rows.select(F.shiftright(mark, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def _marked(rows: DataFrame, table: DataFrame, *cols: str, there: bool = True) -> DataFrame:
    """The rows whose bit in the (broadcast) table is set, or isn't. Many rows that were not put in have theirs set once the table fills."""
    mark = F.xxhash64(*cols).bitwiseAND(F.lit(MARKS - 1))
    found = rows.withColumn("mark", mark).withColumn("word", F.shiftright("mark", 6)).join(F.broadcast(table), "word", "inner" if there else "left")
    is_set = F.coalesce(F.getbit("bits", F.col("mark").bitwiseAND(F.lit(63)).cast("int")), F.lit(0)) == 1
    return found.where(is_set if there else ~is_set).select(*rows.columns)


def _packed(k: Column, n: Column, i: Column) -> Column:
    """A line's number, its number of words and the position of a run in one number.

    The bytes that change from row to row are the upper ones, beside those of the next column: shuffled rows compress
    to three quarters of what they take as columns of their own.
    """
    k = k.cast("long")
    low = F.shiftleft(k.bitwiseAND(F.lit(255)), 40) + F.shiftleft(F.shiftright(k, 8), 8)
    return F.shiftleft(F.least(i, F.lit(FULL)).cast("long"), 56).bitwiseOR(F.shiftleft(F.least(n, F.lit(FULL)).cast("long"), 48)).bitwiseOR(low)


def _line_number(at: Column) -> Column:
    byte = F.shiftrightunsigned(at, 40).bitwiseAND(F.lit(255))
    return (F.shiftleft(F.shiftrightunsigned(at, 8).bitwiseAND(F.lit((1 << 24) - 1)), 8) + byte).cast("int")


def rarity_table(rows: DataFrame) -> list[int]:
    """For each hash bucket of words a level from 1 to 127: four times the logarithm of its count over all texts."""
    words = rows.select(F.explode(F.split(F.replace("body", F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).alias("b")).count()
    table = [1] * BUCKETS
    for row in counts.collect():  # BUCKETS rows at most
        table[row["b"]] = min(127, 1 + int(4 * math.log2(row["count"])))
    return table


def _hashes(line: Column) -> Column:
    return F.array_remove(F.transform(F.split(_spaced(line), " "), lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))


def _ranked(line: Column, table: list[int]) -> Column:
    """The distinct words of a line as numbers whose order is by rarity, then by hash."""
    levels = F.split(F.lit(",".join(map(str, table))), ",").cast("array<tinyint>")  # folded to a literal, which plans show
    level = lambda h: F.shiftleft(F.get(levels, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")).cast("long"), 56)
    ranked = lambda w: level(F.xxhash64(w)).bitwiseOR(F.shiftrightunsigned(F.xxhash64(w), 8))
    return F.sort_array(F.array_distinct(F.array_remove(F.transform(F.split(_spaced(line), " "), ranked), ranked(F.lit("")))))


def _need(nx: Column, ny: Column) -> Column:
    """The least number of common words: ceil(t / (1 + t) * (nx + ny))."""
    return F.ceil(F.lit(TENTHS) * (nx + ny) / F.lit(10 + TENTHS)).cast("int")


def _may_match(x: Column, y: Column) -> Column:
    """Size and positional filters for a common run in two lines; x and y are _packed()."""
    nx, ny = (F.shiftrightunsigned(c, 48).bitwiseAND(F.lit(FULL)) for c in (x, y))
    ix, iy = (F.shiftrightunsigned(c, 56) for c in (x, y))
    room = F.least(ix, iy) + F.least(nx - ix, ny - iy)
    return (F.greatest(nx, ny) == FULL) | (10 * nx >= TENTHS * ny) & (10 * ny >= TENTHS * nx) & (room >= _need(nx, ny))


def _near(x: Column, y: Column, mx: Column, my: Column) -> Column:
    """Whether the postings' maps mx and my leave room for similarity; x and y are _packed()."""
    nx, ny = (F.shiftrightunsigned(c, 48).bitwiseAND(F.lit(FULL)) for c in (x, y))
    return (F.greatest(nx, ny) == FULL) | (F.bit_count(mx.bitwiseXOR(my)) <= nx + ny - 2 * _need(nx, ny))


def _bit(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))


def postings(lines: DataFrame, firsts: DataFrame, table: list[int]) -> DataFrame:
    """(t, doc, variant, at, m): the runs of two t in the prefix of the first place of each line text; at is _packed(), m the line's map.

    With o common words of n and m, at most 2 (n - o) + (m - o) <= (2 n - m) / 3 <= 0.4 n runs of n are broken, so one
    that is not is among the first 0.4 n + 1, in both lines; the run at the end is a single word. Only lines whose text
    may stand elsewhere (firsts has the first places of such texts), going by a broadcast table of bits, are shuffled by
    text to find the first place; once that table is full, all lines are.
    """
    place = ["doc", "variant", "k"]
    copied = _table(firsts, "key")
    keyed = lines.withColumn("key", F.xxhash64("line"))
    alone = _marked(keyed, copied, "key", there=False).select(*place, "line")
    several = _marked(keyed, copied, "key").select(*place, "line", *_keys(F.col("line")))
    first = several.groupBy("key", "key2").agg(F.min(F.struct(*place)).alias("p"), F.first("line").alias("line"))
    ranked = alone.union(first.select("p.*", "line")).select(*place, _ranked(F.col("line"), table).alias("r"))
    last = F.floor(F.col("n") * 2 / 5).cast("int")
    turned = F.aggregate("r", F.lit(0).cast("long"), lambda acc, h: acc.bitwiseXOR(_bit(h))).alias("m")
    slim = ranked.select(*place, F.size("r").alias("n"), "r", turned).select(*place, "n", "m", F.slice("r", 1, last + 2).alias("r"))
    runs = slim.select(*place, "n", "m", "r", F.explode(F.sequence(F.lit(0), F.least(last, F.col("n") - 1))).alias("i"))
    t = F.xxhash64(*[F.get("r", F.col("i") + j) for j in range(2)])
    return runs.select("variant", _packed(F.col("k"), F.col("n"), F.col("i")).alias("at"), t.alias("t"), "m", "doc")


def in_company(posts: DataFrame) -> DataFrame:
    """(p, met, t, at, m, lines, later): postings whose run other lines have too; p is the place.

    met holds the places before p that have the run and pass the filters: in runs of up to DENSE lines all, in others
    the earliest one at most. Postings of runs of up to DENSE lines stay only with such places, and without what follows
    met; later says whether an earlier posting has the run.
    """
    of_t = Window.partitionBy("t")
    some = posts.withColumn("lines", F.count(F.lit(1)).over(of_t)).where("lines > 1")
    some = some.select("t", "at", "m", "lines", F.struct("doc", "variant", _line_number(F.col("at")).alias("k")).alias("p"))
    few, spot = F.col("lines") <= DENSE, F.struct("p", "at", "m")
    some = some.withColumn("all", F.collect_list(F.when(few, spot)).over(of_t)).withColumn("head", F.min(F.when(~few, spot)).over(of_t))
    passes = lambda y: (y.p < F.col("p")) & _may_match(F.col("at"), y["at"]) & _near(F.col("at"), y["at"], F.col("m"), y["m"])
    met = F.transform(F.filter(F.when(few, F.col("all")).otherwise(F.array("head")), passes), lambda y: y.p)
    some = some.withColumn("met", met).where(~few | (F.size("met") > 0))
    return some.select("p", "met", *[F.when(~few, F.col(c)).alias(c) for c in ("t", "at", "m", "lines")], (F.col("p") != F.col("head.p")).alias("later"))


def _map(hashes: Column) -> list[Column]:
    """A map of 256 bits in which each number turns one bit over: two maps differ in no more bits than the sets in numbers."""
    turned = lambda acc, h: acc.bitwiseXOR(_bit(h))
    return [F.aggregate(F.filter(hashes, lambda h: F.shiftright(h, 6).bitwiseAND(F.lit(3)) == j), F.lit(0).cast("long"), turned).alias(f"b{j}") for j in range(4)]  # noqa: B023


def _texts(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(p, line, n, b0, b1, b2, b3) of the places p in pairs (x, y): the line, its number of words and its map.

    Broadcast tables of bits keep most other texts and lines out. While few bits are set, the lines that still pass are
    left in, up to one of 16; else lines are shuffled to meet their places.
    """
    at = ["doc", "variant", "k"]
    wanted = written(pairs.select(F.explode(F.array("x", "y")).alias("p")).distinct().select("p.*"))
    found = _marked(_lines(_marked(rows, _table(wanted, "doc"), "doc")), _table(wanted, *at), *at)
    if wanted.count() > MARKS // 16:  # not a semi-join: that would be moved before the one with the table
        found = found.join(sorted_side(wanted), at)
    found = found.select(F.struct(*at).alias("p"), "line", F.array_distinct(_hashes(F.col("line"))).alias("h"))
    return written(found.select("p", "line", F.size("h").alias("n"), *_map(F.col("h"))))


def _apart(x: str, y: str) -> Column:
    """In how many bits the maps of two lines differ."""
    return sum((F.bit_count(F.col(f"{x}b{j}").bitwiseXOR(F.col(f"{y}b{j}"))) for j in range(4)), F.lit(0))


def _close(x: str, y: str) -> Column:
    """Size and bitmap filters."""
    nx, ny = F.col(f"{x}n"), F.col(f"{y}n")
    return (F.least(nx, ny) >= _need(nx, ny)) & (_apart(x, y) <= nx + ny - 2 * _need(nx, ny))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The x of those (x, y) whose lines have Jaccard similarity 0.8 or more, one row each; texts has all their lines.

    The maps are compared first; only lines of pairs that pass are compared word by word.
    """
    side = lambda c: texts.select(F.col("p").alias(c), *[F.col(f).alias(f"{c}_{f}") for f in ("n", "b0", "b1", "b2", "b3")])
    close = written(sorted_side(pairs).join(side("x"), "x").join(sorted_side(side("y")), "y").where(_close("x_", "y_")).select("x", "y"))
    ends = _table(close.select(F.explode(F.array("x", "y")).alias("p")).select("p.*"), "doc", "variant", "k")
    words = _marked(texts.select("p.*", "line"), ends, "doc", "variant", "k").select(F.struct("doc", "variant", "k").alias("p"), "line")
    both = sorted_side(close).join(words.select(F.col("p").alias("x"), F.col("line").alias("lx")), "x").join(sorted_side(words.select(F.col("p").alias("y"), F.col("line").alias("ly"))), "y")
    both = both.select("x", *[F.array_distinct(_hashes(F.col(c))).alias(c) for c in ("lx", "ly")])
    return both.where(F.size(F.array_intersect("lx", "ly")) >= _need(F.size("lx"), F.size("ly"))).select("x").distinct()


def similar_to_earlier(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """(x): the first place (doc, variant, k) of every line text to which a different line text before it is similar."""
    company = written(in_company(postings(_lines(rows), firsts, rarity_table(rows))))
    met = written(company.select(F.col("p").alias("x"), F.explode("met").alias("y")).groupBy("x", "y").count())
    first = written(met.groupBy("x").agg(F.min_by("y", F.struct(-F.col("count"), "y")).alias("y")))  # of equal counts the earliest
    settled = written(_verified(first, _texts(rows, first)))
    dense = company.where("t is not null").drop("met")
    open_ = lambda some: some.join(sorted_side(settled), "x", "left_anti")
    late = written(open_(dense.where("later").withColumnRenamed("p", "x")))
    pair = (F.col("a.t") == F.col("b.t")) & (F.col("b.p") < F.col("a.x")) & _may_match(F.col("a.at"), F.col("b.at")) & _near(*map(F.col, ("a.at", "b.at", "a.m", "b.m")))
    meet = lambda some: some.alias("a").join(sorted_side(dense.alias("b")), pair)
    # a line of dense runs is settled most often by its nearest neighbour in the two smallest of them
    smallest = F.row_number().over(Window.partitionBy("x").orderBy("lines", "t"))
    apart = F.bit_count(F.col("a.m").bitwiseXOR(F.col("b.m")))
    nearest = meet(late.withColumn("rank", smallest).where("rank <= 2")).groupBy("a.x").agg(F.min_by("b.p", F.struct(apart, "b.p")).alias("y"))
    more = written(open_(met.select("x", "y").union(nearest)).distinct().join(sorted_side(first), ["x", "y"], "left_anti"))
    settled = written(settled.union(_verified(more, _texts(rows, more))).distinct())
    tried = first.union(more)
    rest = written(meet(open_(late)).select("a.x", F.col("b.p").alias("y")).distinct().join(sorted_side(tried), ["x", "y"], "left_anti"))
    return settled.union(_verified(rest, _texts(rows, rest)))


def _verdicts(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows: numbered(docs); places: (doc, variant, k, key, key2) of every line with a word; gone: (doc, variant, k, verdict) of lines that go."""
    rows = numbered(docs, text, doc_id)
    places = written(_lines(rows).select("doc", "variant", "k", *_keys(F.col("line"))))
    place = F.struct("doc", "variant", "k")
    firsts = written(places.groupBy("key", "key2").agg(F.min(place).alias("p"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    similar = similar_to_earlier(rows, firsts).select("x.*", F.lit("similar").alias("verdict"))
    likely = _marked(places, _table(firsts, "key"), "key")
    copies = likely.join(sorted_side(firsts), ["key", "key2"]).where(place != F.col("p")).select("doc", "variant", "k", F.lit("copy").alias("verdict"))
    return rows, places, written(similar.union(copies))


def line_verdicts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc, variant, k, verdict) for every line k with a word: 'keep', 'copy' (equal to an earlier line) or 'similar'.

    doc is row_id(): documents without an id count by their text. Earlier: smaller doc, then smaller line number. Of
    different texts with one id, the one of smaller hash comes first; their lines stay apart (variant 0, 1, ...).
    """
    _, places, gone = _verdicts(docs, text, doc_id)
    return places.join(sorted_side(gone), ["doc", "variant", "k"], "left").select("doc", "variant", "k", F.coalesce("verdict", F.lit("keep")).alias("verdict"))


def _by_text(gone: DataFrame) -> DataFrame:
    """(doc, variant, n_copies, n_similar, gone): line numbers in order; no text has more than its lines."""
    return gone.groupBy("doc", "variant").agg(
        F.count_if(F.col("verdict") == "copy").alias("n_copies"), F.count_if(F.col("verdict") == "similar").alias("n_similar"), F.array_sort(F.collect_list("k")).alias("gone")
    )


def dedup_report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_lines, n_copies, n_similar, removed) for each row of docs; removed: line numbers, sorted, comma-joined.

    n_lines counts lines with a word. Null and empty texts have none. Rows of one id and equal texts are one document
    and get equal results; different texts of one id are judged each for itself. An empty table gives no rows. Other
    columns are ignored.
    """
    rows, places, gone = _verdicts(docs, text, doc_id)
    lines = places.groupBy("doc", "variant").agg(F.count(F.lit(1)).alias("n_lines"))
    by = rows.select("doc", "hash", "variant").join(sorted_side(lines), ["doc", "variant"], "left").join(sorted_side(_by_text(gone)), ["doc", "variant"], "left")
    ids = docs.select(F.col(doc_id).alias("doc_id"), row_id(doc_id, text).alias("doc"), F.xxhash64(text).alias("hash"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    removed = F.coalesce(F.concat_ws(",", F.col("gone").cast("array<string>")), F.lit("")).alias("removed")
    return ids.join(sorted_side(by), ["doc", "hash"], "left").select("doc_id", zero("n_lines"), zero("n_copies"), zero("n_similar"), removed)


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with the lines that line_verdicts() rejects cut from text; n_chars follows. All columns stay, whatever their names.

    Lines without a word stay as they are; a text of which every line goes is ''. Null and empty texts stay. Rows of one id and equal texts are one document and lose the same lines; different texts
    of one id are judged each for itself. An empty table gives no rows.
    """
    rows, _, gone = _verdicts(docs, "text", "doc_id")
    cut = rows.select("doc", "hash", "variant").join(sorted_side(_by_text(gone)), ["doc", "variant"]).select("doc", "hash", "gone")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_id().alias("doc"), F.xxhash64("text").alias("hash"))
    kept = F.filter(F.split("row.text", "\n", -1), lambda s, k: ~F.array_contains("gone", k))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.concat_ws("\n", kept))
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType))
    return whole.join(sorted_side(cut), ["doc", "hash"], "left").select(row.alias("row")).select("row.*")
