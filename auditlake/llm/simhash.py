"""SimHash near-duplicate groups by segment-popcount embedding.

Plan: one fingerprint a document (Arrow batches), collapsed to distinct fingerprints. A fingerprint is embedded as the
bit counts of its 32 two-bit segments, stored in unary, so that the Manhattan distance of two embeddings is the bit
count of one XOR. It never exceeds the Hamming distance. The 32 axes form eight bundles: if two embeddings are within
Manhattan distance 4, at least four bundles agree, so the two share a cell of one of the 70 grids that four bundles
span. Rows of cells with company are compared: first Manhattan, then the exact Hamming distance.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.common import real_id, row_id, sorted_side, written
from auditlake.llm.components import components

SHINGLE, SEED, RADIUS = 4, 42, 4
BUNDLES = 8
LOW = 0x5555555555555555


def fingerprint_of(text: str | None) -> int:
    """64-bit SimHash of one text, as an unsigned number."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-SHINGLE])).tolist()
    ends = (ends[SHINGLE - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends)], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint_of(t) for t in texts], dtype=np.uint64).view(np.int64))


def embed(fp: Column) -> Column:
    """Unary bit counts of the two-bit segments: 00, 01 or 11."""
    high = F.shiftrightunsigned(fp, 1)
    both, either = fp.bitwiseAND(high).bitwiseAND(F.lit(LOW)), fp.bitwiseOR(high).bitwiseAND(F.lit(LOW))
    return either.bitwiseOR(F.shiftleft(both, 1))


def _embed(fp: np.ndarray) -> np.ndarray:
    high = fp >> np.uint64(1)
    return ((fp | high) & np.uint64(LOW)) | ((fp & high & np.uint64(LOW)) << np.uint64(1))


def grid_masks(bundles: int = BUNDLES, radius: int = RADIUS) -> list[int]:
    """One mask of axes for each grid, as signed 64-bit numbers."""
    parts = np.array_split(np.arange(32), bundles)
    out = []
    for chosen in itertools.combinations(parts, bundles - radius):
        mask = sum(3 << (2 * int(axis)) for part in chosen for axis in part)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def _close(fp: np.ndarray, emb: np.ndarray, i, j) -> np.ndarray:
    near = np.bitwise_count(emb[i] ^ emb[j]) <= RADIUS
    return near & (np.bitwise_count(fp[i] ^ fp[j]) <= RADIUS)


def _spanning(fp: np.ndarray) -> np.ndarray:
    """(member, smallest member) of each group of linked fingerprints: a breadth-first walk over what isn't reached yet."""
    fp = np.sort(fp)
    emb, left, out = _embed(fp), np.arange(len(fp)), []
    while len(left):
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = _close(fp, emb, at, left)
            found, left = left[hit], left[~hit]
            queue.extend(found)
            out.extend((x, root) for x in found)
    return fp[np.array(out, dtype=np.int64).reshape(-1, 2)]


def _cell_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by cell. Yields links that connect, within each cell, all that are linked."""
    keys, small = ["grid", "cell", "i", "j"], 12
    rest = None
    for batch in itertools.chain(batches, [None]):
        if batch is None:
            if rest is None:
                return
            rows, rest = rest, None
        else:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            k = rows[keys].to_numpy()
            cut = int(np.argmin((k == k[-1]).all(axis=1)[::-1])) if (k != k[-1]).any() else len(k)
            rest, rows = rows.iloc[len(k) - cut :], rows.iloc[: len(k) - cut]
            if not len(rows):
                continue
        k, fp = rows[keys].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
        run = np.concatenate(([0], np.cumsum((k[1:] != k[:-1]).any(axis=1))))
        sizes, emb, found = np.bincount(run), _embed(fp), []
        for lag in range(1, min(small, int(sizes.max()))):
            i = np.flatnonzero((run[lag:] == run[:-lag]) & (sizes[run[lag:]] <= small))
            ok = _close(fp, emb, i, i + lag)
            found.append(np.stack([fp[i[ok]], fp[i[ok] + lag]], axis=1))
        begins = np.concatenate(([0], np.cumsum(sizes)))
        found += [_spanning(fp[begins[r] : begins[r + 1]]) for r in np.flatnonzero(sizes > small)]
        pairs = np.concatenate(found) if found else np.empty((0, 2), np.uint64)
        pairs = np.unique(np.sort(pairs, axis=1), axis=0)
        yield pd.DataFrame({"a": pairs[:, 0].view(np.int64) if len(pairs) else [], "b": np.ascontiguousarray(pairs[:, 1]).view(np.int64) if len(pairs) else []}, dtype=np.int64)


def fingerprint_links(fps: DataFrame, block: int = 2048) -> DataFrame:
    """Distinct fingerprints (fp long) to links (a, b) whose components are those of all pairs at Hamming distance 4 or less.

    A cell of more than `block` fingerprints is split into blocks by hash and every pair of blocks is compared in a task
    of its own, so no cell's rows meet in one task. Within a cell the links form a spanning forest, not all pairs.
    """
    emb = embed(F.col("fp"))
    # a small table's few files would make few tasks, each of which unfolds a row into one for each grid
    spread = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    cells = spread.select("fp", F.posexplode(F.array(*[emb.bitwiseAND(F.lit(m)) for m in grid_masks()])).alias("grid", "cell"))
    counts = cells.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")))
    met = (
        sorted_side(cells).join(counts, ["grid", "cell"]).withColumn("blocks", blocks).withColumn("own", own)
        .select("grid", "cell", "fp", F.explode(pairs).alias("p")).select("grid", "cell", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "fp")
        .repartition("grid", "cell", "i", "j").sortWithinPartitions("grid", "cell", "i", "j")
    )
    return met.mapInPandas(_cell_links, "a long, b long").distinct()


def _grouped(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, row, fp, component) of each row of docs; row is (row_id(), hash of the text), component the least row of its group."""
    row = F.struct(row_id(doc_id, text).alias("id"), F.xxhash64(text).alias("hash"))
    marked = written(docs.select(F.col(doc_id).cast("long").alias("doc_id"), row.alias("row"), fingerprint(F.col(text)).alias("fp")))
    fps = written(marked.groupBy("fp").agg(F.min("row").alias("first")))
    roots = components(fingerprint_links(fps.select("fp")))
    named = sorted_side(fps).join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    return sorted_side(marked).join(sorted_side(named).join(least, "root").select("fp", "component"), "fp")


def near_duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of docs.

    Null text: no words, fingerprint zero. Null ids: such rows group like others but never name a group; a group of
    nothing else has a null component_id. Repeated rows give repeated, equal results. Empty input: no rows. Other
    columns are ignored. fingerprint: 16 lower-case hex digits.
    """
    return _grouped(docs, doc_id, text).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), real_id(F.col("component.id")).alias("component_id")
    )


def keep_first_of_groups(docs: DataFrame) -> DataFrame:
    """docs with one document of each near-duplicate group: the one with the smallest doc_id. All columns stay, whatever their names.

    A document is an id with a text: repeated rows of both count as one, and of several texts of one id in one group the
    one of the smallest hash stays, while texts of one id in different groups all stay. Rows without an id stay only if
    no row of their group has one; then one of them stays. Null and empty texts are a group like any other. An empty
    table gives no rows.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_id().alias("id"), F.xxhash64("text").alias("hash"))
    first = _grouped(docs, "doc_id", "text").where("row = component").select("row.id", "row.hash").distinct()
    return whole.join(sorted_side(first), ["id", "hash"], "left_semi").dropDuplicates(["id", "hash"]).select("row.*")
