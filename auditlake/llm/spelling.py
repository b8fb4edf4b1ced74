"""Spelling variants by asymmetric q-chunks.

Words that differ by one inserted, deleted or replaced character: of the shorter word's two disjoint chunks, its halves,
one is intact in the other word, and of the half that holds the edit, one half is intact too. The shorter word (or, of
equal length, either) contributes these chunks, the other word its positional grams of the same sizes, taken where an
edit leaves them: in place before it, shifted by the difference in length, at most one, behind it. The two are joined
on equal chunks and verified by edit distance. A group of a chunk is as small as three quarters of a word are telling;
pairs that are no match never leave the join.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
LEAST_SIZE, LEAST_COUNT, RATIO = 5, 3, 2
HELD = 200_000  # words whose counts a task holds before it passes them on
PIECE = 1_000_000  # texts of more characters are read run by run


def as_it_is(doc_id: int | None, word: str) -> str:
    return word


def slipped(doc_id: int | None, word: str, one_in: int = 97) -> str:
    """word, or for one (document, word) in `one_in` the word without one of its characters; both by the CRC-32 of '<doc_id>:<word>'."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % one_in:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _runs(text: str) -> Counter:
    """Lower-cased runs of letters (A-Z only are lower-cased) and how often they stand in the text."""
    found = Counter(RUN.findall(text)) if len(text) <= PIECE else Counter(m[0] for m in RUN.finditer(text))
    low: Counter = Counter()
    for run, n in found.items():
        low[run.lower() if run.isascii() else run.translate(LOWER)] += n
    return low


def _count(read: Callable[[int | None, str], str], least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        held.clear()
        return made

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for run, n in _runs(text.as_py() or "").items():
                word = read(doc_id, run)
                if len(word) >= least:
                    held[word] += n
            if len(held) >= HELD:
                yield out()
    yield out()


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", read: Callable[[int | None, str], str] = as_it_is, least_size: int = LEAST_SIZE, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of all texts, of at least least_size code points and least_count occurrences.

    read(doc_id, run) says what a run of letters counts as. Null texts hold no words; rows that repeat count again.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counted = texts.mapInArrow(partial(_count, read, least_size), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _chunks(word: Column, size: Column, shift: int) -> Column:
    """What is left of each quarter's edit: the chunks of a word of `size` that an edit in quarter 0 to 3 leaves intact.

    shift 0: the word's own chunks. shift 1: the grams at the same places of a word that is longer by one.
    """
    half = F.floor(size / 2)
    cuts = [F.lit(0), F.floor(half / 2), half, half + F.floor((size - half) / 2), size]
    intact = lambda i: F.concat_ws("\n", F.substr(word, F.lit(1), cuts[i].cast("int")), F.substr(word, (cuts[i + 1] + shift + 1).cast("int")))
    return F.array(*[F.struct(F.lit(i).alias("edited"), F.xxhash64(intact(i)).alias("chunk")) for i in range(4)])


def near_words(words: DataFrame) -> DataFrame:
    """(x, nx, y, ny): the pairs of words (word, n) that differ by one edit, each pair once, in either order."""
    size = F.length("word")
    sized = words.select("word", "n", size.cast("int").alias("size"))
    own = sized.select("word", "n", "size", F.explode(_chunks(F.col("word"), F.col("size"), 0)).alias("c"))
    short = own.select("size", "c.edited", "c.chunk", F.col("word").alias("x"), F.col("n").alias("nx"))
    longer = sized.where("size > 1").select("word", "n", (F.col("size") - 1).alias("size"), F.explode(_chunks(F.col("word"), F.col("size") - 1, 1)).alias("c"))
    grams = own.withColumn("longer", F.lit(False)).unionByName(longer.withColumn("longer", F.lit(True)))
    grams = grams.select("size", "c.edited", "c.chunk", "longer", F.col("word").alias("y"), F.col("n").alias("ny"))
    met = short.join(grams, ["size", "edited", "chunk"]).where((F.col("longer") | (F.col("x") < F.col("y"))) & (F.levenshtein("x", "y", 1) == 1))
    # an edit within a run of equal letters may leave chunks of several quarters intact
    return met.select("x", "nx", "y", "ny").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each word's chain of forms, by pointer doubling.

    Counts at least double along a chain, so chains are as short as the logarithm of the largest count and the rounds as
    few as that one's logarithm. A round is a join and is written to the shared folder.
    """
    now = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not now.where("moved").isEmpty():
        up = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = written(now.join(up, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
    return now.select("word", "root")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", read: Callable[[int | None, str], str] = as_it_is) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row for each word of the texts; see word_counts().

    n_near: how many words are one edit away. form: the one of these with the largest n (ties: the smallest in
    code-point order) if that is at least RATIO times the word's own n, else null; form_n is its n. root: the last of
    the word's chain of forms, the word itself if it has none. Null and empty texts hold no words; an empty table gives
    no rows; a document without an id counts like any other. Other columns are ignored.
    """
    words = written(word_counts(docs, doc_id, text, read))
    near = near_words(words)
    both = near.select(F.col("x").alias("word"), F.col("y").alias("by"), F.col("ny").alias("by_n")).union(near.select("y", "x", "nx"))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("by_n")).alias("n"), F.col("by").alias("form"))).alias("best"))
    enough = -F.col("best.n") >= RATIO * F.col("n")
    judged = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n")
    )
    judged = written(judged)
    roots = _roots(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
