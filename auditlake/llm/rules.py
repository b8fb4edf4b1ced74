"""Quality rules as a learned decision list.

Sequential covering on statistics of labelled documents: each rule is a conjunction of thresholds, grown on two thirds
of the rows still uncovered and pruned on the rest; the list becomes one ordered Spark conditional expression.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.common import labelled_sample, space_words

SAMPLE_ROWS, SAMPLE_CHARS = 6000, 20_000
WINDOW = 5
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_alone"]
STATS_TYPE = T.StructType([T.StructField(s, T.LongType()) for s in STATS])
WHITE = b" \t\n\r\x0b\x0c"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a five-word window which occurs at least twice."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    seq = [ids.setdefault(w, len(ids)) for w in words]
    if len(ids) < 4096:  # five ids fit one number
        a = np.array(seq, np.int64)
        key = a[:n].copy()
        for k in range(1, WINDOW):
            key = (key << 12) | a[k : k + n]
        _, where, times = np.unique(key, return_inverse=True, return_counts=True)
        again = times[where] > 1
    else:
        grams = list(zip(*(seq[k : k + n] for k in range(WINDOW))))
        times_of = Counter(grams)
        again = np.fromiter((times_of[g] > 1 for g in grams), bool, n)
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + WINDOW, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def stats_of(text: str | None) -> tuple[int, ...]:
    """STATS of one text."""
    if not text:
        return (0,) * len(STATS)
    raw = text.encode()
    words = raw.split()
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    lines = [x for x in raw.split(b"\n") if x.strip(WHITE)]
    return (
        len(words),
        len(text) - count(WHITE),
        count(b"#*$%&|<>"),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        count(b"0123456789"),
        count(b"!?"),
        sum(len(w) == 1 for w in words),
    )


@F.pandas_udf(STATS_TYPE)
def text_stats(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([stats_of(t) for t in texts], columns=STATS, dtype="int64")


#: what a rule may test: a name, the numerator and the denominator
RATIOS = [
    ("symbols", "n_symbols", "n_words"), ("repeats", "n_repeat_words", "n_words"), ("dup_lines", "n_dup_lines", "n_lines"),
    ("word_length", "word_chars", "n_words"), ("upper", "n_upper", "word_chars"), ("digits", "n_digits", "word_chars"),
    ("marks", "n_marks", "n_words"), ("alone", "n_alone", "n_words"), ("words", "n_words", None),
]


@dataclass
class DecisionList:
    """Rules of (ratio, 'le' or 'gt', threshold) conjunctions; the first that holds rejects, else the text is kept."""

    rules: list[list[tuple[str, str, float]]] = field(default_factory=list)

    def keeps(self, stats: Column) -> Column:
        """The ordered conditional expression over a struct of STATS."""
        made = {name: _ratio(stats, a, b) for name, a, b in RATIOS}
        out = F.lit(True)
        for rule in reversed(self.rules):
            holds = F.lit(True)
            for name, op, limit in rule:
                holds = holds & (made[name] <= limit if op == "le" else made[name] > limit)
            out = F.when(holds, False).otherwise(out)
        return out


def _ratio(stats: Column, top: str, bottom: str | None) -> Column:
    value = stats[top].cast("double")
    return value if bottom is None else value / F.greatest(stats[bottom], F.lit(1))


def _covers(rule: list[tuple[str, str, float]], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for name, op, limit in rule:
        out &= x[name] <= limit if op == "le" else x[name] > limit
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> list[tuple[str, str, float]]:
    """Adds the threshold of most information gain (FOIL) until no good row is covered."""
    rule, left = [], np.ones(len(bad), bool)
    while (left & ~bad).any() and len(rule) < 4:
        p0, n0 = (left & bad).sum(), (left & ~bad).sum()
        best, gain = None, 1e-9
        for name, _, _ in RATIOS:
            values = np.unique(x[name][left])
            for limit in (((values[1:] + values[:-1]) / 2)[np.unique(np.linspace(0, len(values) - 2, 48).astype(int))] if len(values) > 1 else ()):
                for op in ("le", "gt"):
                    now = left & _covers([(name, op, limit)], x, len(bad))
                    p, n = (now & bad).sum(), (now & ~bad).sum()
                    g = p * (np.log2((p + 1e-12) / (p + n + 1e-12)) - np.log2(p0 / (p0 + n0))) if p else 0
                    if g > gain:
                        best, gain = (name, op, float(limit)), g
        if best is None:
            break
        rule.append(best)
        left &= _covers([best], x, len(bad))
    return rule


def learn(stats: np.ndarray, bad: np.ndarray, precision: float = 0.9, support: int = 3, seed: int = 11) -> DecisionList:
    """Covers the bad rows. A rule enters the list if, pruned, it is right for `precision` of at least `support` rows."""
    col = {s: stats[:, i].astype(float) for i, s in enumerate(STATS)}
    x = {name: col[a] / (1 if b is None else np.maximum(col[b], 1)) for name, a, b in RATIOS}
    rng, out = np.random.default_rng(seed), DecisionList()
    left = np.arange(len(bad))
    while bad[left].sum() >= support and len(out.rules) < 12:
        mixed = rng.permutation(left)
        grow, prune = mixed[: 2 * len(mixed) // 3], mixed[2 * len(mixed) // 3 :]
        if not bad[grow].any():
            break
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow])

        def worth(r: list) -> float:
            c = _covers(r, {k: v[prune] for k, v in x.items()}, len(prune))
            p, n = (c & bad[prune]).sum(), (c & ~bad[prune]).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        covered = _covers(rule, {k: v[left] for k, v in x.items()}, len(left)) if rule else np.zeros(len(left), bool)
        hits = bad[left][covered].sum()
        if hits < support or hits < precision * covered.sum():
            break
        out.rules.append(rule)
        left = left[~covered]
    return out


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, max_chars: int = SAMPLE_CHARS) -> DecisionList:
    """Learns labels.quality = 0 from at most `rows` labelled documents outside the held-out fold."""
    sample = labelled_sample(docs, labels, "quality", rows, max_chars)
    got = sample.select("_label", text_stats("_text").alias("s")).select("_label", "s.*").collect()
    if not got:
        return DecisionList()
    return learn(np.array([[r[s] for s in STATS] for r in got]), np.array([r["_label"] == 0 for r in got]))


def judged(docs: DataFrame, rules: DecisionList, text: str = "text", into: str = "_judged") -> DataFrame:
    """docs with a struct column `into`: stats (a struct of STATS), base_failed and kept.

    Base rule: fewer than 10 words, or more than 20 % of them in repeated windows. Null and empty texts have no words
    and fail it. Repeated rows get equal verdicts. Without labels the list is empty and only the base rule decides. An
    empty table gives no rows. Other columns stay; one named `into` is replaced.
    """
    s = F.col(into)
    failed = (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])
    return docs.withColumn(into, text_stats(F.col(text))).withColumn(into, F.struct(s.alias("stats"), failed.alias("base_failed"), (~failed & rules.keeps(s)).alias("kept")))
