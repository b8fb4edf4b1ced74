"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every window of ten consecutive words of a benchmark item is a pattern (an item of fewer words is one pattern). The
search looks at the pair of words at the end of a position: the shift table tells how far no pattern can end, the
suffix table holds the patterns that end in that pair, and the words are compared directly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import plain_words, written

WINDOW = 10
#: benchmark text that one scan's tables are built from; a larger benchmark is scanned for in several blocks
BLOCK_CHARS = 16_000_000


class WuManber:
    """Patterns of one length: tuples of words, each with the items that contain it."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[str]]):
        self.length, self.block = length, min(2, length)
        self.default = length - self.block + 1
        self.shift: dict = {}
        self.suffixes: dict = {}
        for words, items in patterns.items():
            for end in range(self.block, length + 1):
                key = words[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.default), length - end)
            self.suffixes.setdefault(words[-self.block :], {})[words] = items

    def find(self, words: list[bytes], hit: np.ndarray, items: set[str]) -> None:
        n, block, length, default, shift = len(words), self.block, self.length, self.default, self.shift
        at = length
        while at <= n:
            key = tuple(words[at - block : at])
            skip = shift.get(key, default)
            if skip:
                at += skip
                continue
            found = self.suffixes[key].get(tuple(words[at - length : at]))
            if found is not None:
                hit[at - length : at] = True
                items.update(found)
            at += 1


def search_tables(rows: list[tuple[str, str | None]]) -> list[WuManber]:
    """rows (item id as text, text) to one searcher for each pattern length."""
    by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
    for item, text in rows:
        words = plain_words(text)
        size = min(WINDOW, len(words))
        for start in range(len(words) - size + 1 if size else 0):
            owners = by_length.setdefault(size, {}).setdefault(tuple(words[start : start + size]), [])
            if item not in owners:
                owners.append(item)
    return [WuManber(n, patterns) for n, patterns in sorted(by_length.items())]


FOUND = "n_words long, n_hit long, begins array<long>, ends array<long>, items array<string>"


def _scan(tables, text: Column, before: Column | None) -> Column:
    """What one block of the benchmark hits in each text, added to what earlier blocks hit."""

    def run(texts: pd.Series, earlier: pd.DataFrame | None = None) -> pd.DataFrame:
        out = []
        for row, t in enumerate(texts):
            words = plain_words(t)
            hit, items = np.zeros(len(words), bool), set()
            if earlier is not None:
                for begin, end in zip(earlier["begins"].iloc[row], earlier["ends"].iloc[row]):
                    hit[begin:end] = True
                items.update(earlier["items"].iloc[row])
            for searcher in tables.value:
                searcher.find(words, hit, items)
            edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
            out.append((len(words), int(hit.sum()), edges[::2], edges[1::2], sorted(items)))
        return pd.DataFrame(out, columns=["n_words", "n_hit", "begins", "ends", "items"])

    @F.pandas_udf(FOUND)
    def first(texts: pd.Series) -> pd.DataFrame:
        return run(texts)

    @F.pandas_udf(FOUND)
    def further(texts: pd.Series, earlier: pd.DataFrame) -> pd.DataFrame:
        return run(texts, earlier)

    return first(text) if before is None else further(text, before)


def contaminated_words(docs: DataFrame, benchmark: DataFrame, text: str = "text", block_chars: int = BLOCK_CHARS, into: str = "_found") -> DataFrame:
    """docs with a struct column `into`: n_words, n_hit, begins and ends (ranges of hit words), items (sorted ids as text).

    Null or empty texts have no words and no hits; items with null text or id, or without words, match nothing; an item
    id that occurs in several rows is one item. Repeated documents give repeated results. An empty benchmark hits
    nothing; an empty table gives no rows. Other columns stay; one named `into` is replaced. Only tables built from a block of at most about block_chars characters of the benchmark are broadcast;
    a larger benchmark means several scans, one after another, each written to the shared folder.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("text")).where("item is not null and text is not null")
    n = (items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars + 1
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()
        tables = spark.sparkContext.broadcast(search_tables([(r.item, r.text) for r in rows]))
        docs = docs.withColumn(into, _scan(tables, F.col(text), F.col(into) if k else None))
        if k < n - 1:  # one block's tables are on the executors at a time
            docs = written(docs)
            tables.unpersist()
    return docs


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark window. All columns stay, whatever their names.

    Null and empty texts hold none and stay; repeated rows go or stay together; an empty benchmark rejects nothing; an
    empty table gives no rows.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("_text"))
    return contaminated_words(whole, benchmark, "_text").where("_found.n_hit = 0").select("row.*")
