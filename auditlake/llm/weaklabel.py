"""Quality classifier from weak labels.

Nine overlapping heuristics vote good, bad or nothing on every document. The corpus is counted by vote pattern (a table
bounded by 3^9 rows), expectation-maximisation on those counts estimates each heuristic's accuracy without any label, and the
posteriors of all documents train a linear scorer on hashed features: votes and features are written once, and each step of
the training is a pass over them that sums the slope. Every document is then scored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.common import written
from auditlake.llm.rules import STATS, STATS_TYPE, stats_of

SAMPLE_CHARS = float("inf")  # characters of the longest text that is learned from: there is no bound
HEURISTICS = 9
BUCKETS = 1 << 12
UNIT = 1 << 30  # slopes, losses and scores become whole numbers of 1 / UNIT; sums don't depend on how rows are dealt to tasks
SHAPE = bytes(
    ord("a") if c >= 0x80 or chr(c).islower() else ord("A") if chr(c).isupper() else ord("0") if chr(c).isdigit() else c
    for c in range(256)
)
RUNS = re.compile(rb"(.)\1+", re.S)


def votes(s: Column) -> list[Column]:
    """The heuristics: 1 good, -1 bad, 0 no vote, from a struct of STATS."""
    n = F.greatest(s["n_words"], F.lit(1))
    share = lambda a, b=n: s[a] / F.greatest(b, F.lit(1))
    vote = lambda bad, good: F.when(bad, -1).when(good, 1).otherwise(0)
    length, upper = share("word_chars"), share("n_upper", s["word_chars"])
    return [
        vote(s["n_words"] < 5, s["n_words"] >= 50),
        vote(share("n_symbols") > 0.3, share("n_symbols") < 0.05),
        vote(upper > 0.4, upper < 0.1),
        vote(share("n_marks") > 0.5, share("n_marks") < 0.1),
        vote(share("n_repeat_words") > 0.3, share("n_repeat_words") < 0.05),
        vote(share("n_dup_lines", s["n_lines"]) > 0.3, share("n_dup_lines", s["n_lines"]) < 0.05),
        vote((length < 2.5) | (length > 12), length.between(3, 9)),
        vote(share("n_alone") > 0.3, share("n_alone") < 0.1),
        vote(share("n_digits", s["word_chars"]) > 0.3, share("n_digits", s["word_chars"]) < 0.05),
    ]


@dataclass
class VoteModel:
    """log odds of good for no votes, and what each heuristic's vote of -1, 0, 1 adds."""

    prior: float
    weight: np.ndarray

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        logit = self.prior + self.weight[np.arange(pattern.shape[1]), pattern + 1].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> VoteModel:
    """EM for two classes with independent votes. It starts from the belief that bad votes are rare among good texts."""
    good = np.select([(patterns == -1).sum(1) == 0, (patterns == -1).sum(1) == 1], [0.95, 0.4], 0.03)
    for _ in range(rounds):
        tables = []
        for w in (good * counts, (1 - good) * counts):
            t = np.stack([((patterns == v) * w[:, None]).sum(0) for v in (-1, 0, 1)], axis=1) + 0.1
            tables.append((t / t.sum(1, keepdims=True), w.sum() + 0.1))
        model = VoteModel(float(np.log(tables[0][1] / tables[1][1])), np.log(tables[0][0] / tables[1][0]))
        good = model.posterior(patterns)
    return model


def features(text: str | None, stats: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values: shares of word shapes and of last bytes, and coarse levels of the statistics stats_of(text)."""
    if not text:
        return np.array([0]), np.array([1.0])
    got: Counter = Counter()
    shapes = Counter(text.encode().translate(SHAPE).split())
    total = sum(shapes.values()) or 1
    for shape, n in shapes.items():
        short = RUNS.sub(rb"\1", shape)[:8]
        got[b"s" + short] += n / total
        got[b"e" + short[-1:]] += n / total
    row = dict(zip(STATS, stats))
    for name, bottom in (("n_repeat_words", "n_words"), ("n_dup_lines", "n_lines"), ("n_symbols", "n_words"), ("n_upper", "word_chars")):
        got[f"l{name}{min(9, int(10 * row[name] / max(1, row[bottom])))}".encode()] += 1
    got[f"w{min(12, int(np.log2(row['n_words'] + 1)))}".encode()] += 1
    return np.array([zlib.crc32(k) % BUCKETS for k in got]), np.array(list(got.values()))


@dataclass
class Scorer:
    weights: np.ndarray  # of the hashed features; the last is the bias
    cut: float  # texts that score less are rejected

    def score(self, text: str | None, stats: tuple[int, ...]) -> float:
        k, x = features(text, stats)
        return float(1 / (1 + np.exp(-np.clip(self.weights[k] @ x + self.weights[-1], -50, 50))))


def _logits(weights: np.ndarray, key: np.ndarray, value: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    return np.clip(np.bincount(row, weights[key] * value, rows) + weights[-1], -50, 50)


def slopes(weights: np.ndarray, key: np.ndarray, value: np.ndarray, row: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log loss of rows on soft labels and its slopes, summed in whole numbers of 1 / UNIT: by bucket, of the bias, the loss."""
    logit = _logits(weights, key, value, row, len(target))
    slope = 1 / (1 + np.exp(-logit)) - target
    loss = np.logaddexp(0, logit) - target * logit
    by_bucket = np.bincount(key, np.rint(slope[row] * value * UNIT), BUCKETS)
    return np.append(by_bucket, [np.rint(slope * UNIT).sum(), np.rint(loss * UNIT).sum()]).astype(np.int64)


def minimised(summed: Callable[[np.ndarray], np.ndarray], rows: int, passes: int = 40, memory: int = 8, shrink: float = 1e-5, enough: float = 1e-6) -> np.ndarray:
    """The weights of the logistic regression by L-BFGS; summed(weights) is slopes() over all rows, one pass over them."""

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        got = summed(w) / (UNIT * rows)
        return float(got[-1] + shrink / 2 * (w @ w)), got[:-1] + shrink * w

    w, past, rate = np.zeros(BUCKETS + 1), [], 1.0
    loss, g = at(w)
    step = -g
    for _ in range(passes - 1):
        if np.abs(g).max() < enough:
            break
        new = w + rate * step
        new_loss, new_g = at(new)
        if new_loss > loss + 1e-4 * rate * (g @ step):
            rate /= 4
            continue
        if (new - w) @ (new_g - g) > 0:
            past = [*past, (new - w, new_g - g)][-memory:]
        w, loss, g, rate = new, new_loss, new_g, 1.0
        step, told = -g, []
        for s, y in reversed(past):
            told.append(s @ step / (s @ y))
            step = step - told[-1] * y
        if past:
            step = step * (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y), a in zip(past, reversed(told)):
            step = step + (a - y @ step / (s @ y)) * s
    return w.round(9)


def _levels(weights: np.ndarray, key: np.ndarray, value: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Scores in whole numbers of 1 / UNIT, less than UNIT."""
    scores = 1 / (1 + np.exp(-_logits(weights, key, value, row, rows)))
    return np.minimum(np.floor(scores * UNIT), UNIT - 1).astype(np.int64)


def train(texts: list[str | None], target: np.ndarray) -> Scorer:
    """What quality_scores() learns from all rows of a table, learned from a list of texts and their posteriors."""
    if not len(texts):
        return Scorer(np.zeros(BUCKETS + 1), 0.5)
    parts = [features(t, stats_of(t)) for t in texts]
    row = np.repeat(np.arange(len(parts)), [len(k) for k, _ in parts])
    key, value = np.concatenate([k for k, _ in parts]), np.concatenate([v for _, v in parts])
    weights = minimised(lambda w: slopes(w, key, value, row, target), len(texts))
    kept = max(1, round(float(target.sum())))
    return Scorer(weights, float(np.sort(_levels(weights, key, value, row, len(texts)))[-kept] / UNIT))


@F.pandas_udf(T.StructType([*STATS_TYPE.fields, T.StructField("key", T.ArrayType(T.IntegerType())), T.StructField("value", T.ArrayType(T.DoubleType()))]))
def _featured(texts: pd.Series) -> pd.DataFrame:
    stats = [stats_of(t) for t in texts]
    made = [features(t, s) for t, s in zip(texts, stats)]
    out = pd.DataFrame(stats, columns=STATS, dtype="int64")
    return out.assign(key=pd.Series([k for k, _ in made], dtype=object), value=pd.Series([v for _, v in made], dtype=object))


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Patterns (a row each), keys, values and their rows of a batch of (v, key, value)."""
    v, key, value = (batch.column(c) for c in ("v", "key", "value"))
    sizes = np.diff(key.offsets.to_numpy())
    return v.flatten().to_numpy().reshape(-1, HEURISTICS), key.flatten().to_numpy(), value.flatten().to_numpy(), np.repeat(np.arange(len(v)), sizes)


def _summed(made: DataFrame, model: VoteModel, weights: np.ndarray) -> np.ndarray:
    """slopes() over all rows of made."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 2, np.int64)
        for pattern, key, value, row in map(_arrays, batches):
            total += slopes(weights, key, value, row, model.posterior(pattern))
        at = np.flatnonzero(total)
        yield pa.record_batch({"at": pa.array(at, pa.int32()), "total": pa.array(total[at], pa.int64())})

    out = np.zeros(BUCKETS + 2)
    sums = made.mapInArrow(add, "at int, total long").groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    for r in sums.collect():  # BUCKETS + 2 rows at most
        out[r["at"]] = float(r["total"])
    return out


def _cut(made: DataFrame, weights: np.ndarray, kept: int) -> float:
    """The score of the kept-th best of all rows, in whole numbers of 1 / UNIT, found by counting in ranges and then in one range."""

    def counted(low: int, width: int) -> Iterator[tuple[int, int]]:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for pattern, key, value, row in map(_arrays, batches):
                level = _levels(weights, key, value, row, len(pattern))
                at, n = np.unique((level[(level >= low) & (level < low + (width << 15))] - low) // width, return_counts=True)
                yield pa.record_batch({"at": pa.array(at, pa.int64()), "n": pa.array(n, pa.int64())})

        return ((r["at"], r["n"]) for r in made.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).orderBy(F.desc("at")).collect())

    low, left = 0, kept
    for width in (1 << 15, 1):
        for at, n in counted(low, width):  # 2^15 rows at most
            if left <= n:
                low += at * width
                break
            left -= n
    return low / UNIT


def quality_scores(docs: DataFrame, text: str = "text", into: str = "_quality") -> DataFrame:
    """docs with a struct column `into`: votes (array of int), posterior (of the votes), score (of the linear scorer, 0 to 1), kept.

    Uses no labels. The scorer is trained on all rows, whatever the length of their texts. Kept is a text that scores at
    least what leaves the share of rows that the posteriors hold for good, in steps of 1 / UNIT. Null and empty texts
    vote like texts of no words. Repeated rows get equal scores and count each in the estimate, the training and the
    share. On an empty table nothing is learned and the result is empty. Other columns stay; one named `into` is replaced.
    """
    spark = docs.sparkSession
    s = F.col("s")
    made = written(docs.select(_featured(F.col(text)).alias("s")).select(F.array(*votes(s)).alias("v"), "s.key", "s.value"))
    got = made.groupBy("v").count().orderBy("v").collect()  # at most 3^9 rows
    if got:
        patterns, counts = np.array([r["v"] for r in got]), np.array([r["count"] for r in got], float)
        model = estimate(patterns, counts)
        weights = minimised(lambda w: _summed(made, model, w), int(counts.sum()))
        scorer = Scorer(weights, _cut(made, weights, max(1, round(float(model.posterior(patterns) @ counts)))))
    else:
        model, scorer = VoteModel(0.0, np.zeros((HEURISTICS, 3))), train([], np.zeros(0))
    shared = spark.sparkContext.broadcast(scorer)

    @F.pandas_udf(T.StructType([*STATS_TYPE.fields, T.StructField("score", T.DoubleType())]))
    def judge(batch: pd.Series) -> pd.DataFrame:
        stats = [stats_of(t) for t in batch]
        out = pd.DataFrame(stats, columns=STATS, dtype="int64")
        return out.assign(score=np.array([shared.value.score(t, s) for t, s in zip(batch, stats)], float))

    made = docs.withColumn(into, judge(F.col(text))).withColumn(into, F.struct(F.array(*votes(F.col(into))).alias("votes"), F.col(into)["score"].alias("score")))
    logit = F.lit(model.prior)
    for i in range(model.weight.shape[0]):
        logit = logit + F.element_at(F.array(*[F.lit(float(x)) for x in model.weight[i]]), F.col(into)["votes"][i] + 2)
    q = F.col(into)
    return made.withColumn(into, F.struct(q["votes"].alias("votes"), (1 / (1 + F.exp(-logit))).alias("posterior"), q["score"].alias("score"), (q["score"] >= scorer.cut).alias("kept")))
