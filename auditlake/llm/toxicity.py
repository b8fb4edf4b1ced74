"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (and itself), hashed into buckets with a small vector each; a run of eight
words is the average of its words' vectors, and a linear softmax gives it a logit. A document's odds are the sum of its
runs' odds, so one abusive run shows in a text of any length. Since all layers before the softmax are averages, a word
contributes one number at prediction time; words not seen in training get theirs from the n-grams they share.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import labelled_sample, plain_words

THRESHOLD = 0.3
RUN = 8
#: bounds of the sample that the model is trained on
SAMPLE_ROWS, SAMPLE_CHARS = 3500, 20_000
CACHE_WORDS, CHUNK_CHARS = 300_000, 500_000
GRAMS = (3, 4, 5, 6)
BASE, SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def _bucket(hashed: np.ndarray, buckets: int) -> np.ndarray:
    return (((hashed * SPREAD) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def subwords(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of every character n-gram of the words, and of the words themselves; word is an index into words.

    All words are hashed together: a polynomial in the bytes of an n-gram, one vector operation for each length.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    letters = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint64) if words else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    left = (ends[owner] - np.arange(len(letters))).astype(np.int32)  # letters from here to the end of the word
    hashed, found, owners = letters + np.uint64(1), [], []
    for n in range(2, max(GRAMS) + 1):
        hashed = hashed[: max(0, len(letters) - n + 1)] * BASE + letters[n - 1 :]
        if n in GRAMS:
            whole = np.flatnonzero(left[: len(hashed)] >= n)
            found.append(_bucket(hashed[whole] + np.uint64(n), buckets))
            owners.append(owner[whole])
    whole_words = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    found.append(_bucket(whole_words, buckets))
    owners.append(np.arange(len(words), dtype=np.int32))
    return np.concatenate(found), np.concatenate(owners)


def _chunks(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    """The texts in lists of at most about CHUNK_CHARS characters, so that few word lists are held at a time."""
    now, size = [], 0
    for t in texts:
        if now and size + len(t or "") > CHUNK_CHARS:
            yield now
            now, size = [], 0
        now.append(t)
        size += len(t or "")
    if now:
        yield now


@dataclass
class ToxicityModel:
    word_scores: np.ndarray  # of each bucket: its vector times the difference of the softmax rows
    bias: float

    def scorer(self):
        """A function from texts to their scores; it keeps the scores of words that it has met, up to a bound."""
        table, known = self.word_scores, {}

        def score(words: list[bytes]) -> float:
            if not words:
                return 0.0
            values = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
            starts = np.arange(0, len(values), RUN)
            sizes = np.minimum(RUN, len(values) - starts)
            logits = np.add.reduceat(values, starts) / sizes + self.bias
            top = logits.max()
            logit = top + np.log(np.exp(logits - top).sum())
            return float(1 / (1 + np.exp(-np.clip(logit, -60, 60))))

        def scores(texts: Iterable[str | None]) -> list[float]:
            out = []
            for some in _chunks(texts):
                words = [plain_words(t) for t in some]
                if len(known) > CACHE_WORDS:
                    known.clear()
                new = sorted(set().union(*words).difference(known))
                if new:
                    bucket, owner = subwords(new, len(table))
                    known.update(zip(new, (np.bincount(owner, table[bucket], len(new)) / np.bincount(owner, minlength=len(new))).tolist()))
                out += map(score, words)
            return out

        return scores


def train(texts: list[str | None], labels: list[int], buckets: int = 1 << 17, dim: int = 10, rounds: int = 100, rate: float = 0.3, min_docs: int = 4, shrink: float = 0.03, seed: int = 7) -> ToxicityModel:
    """Full-batch Adam on the documents' log loss, with one step size for each tensor, so that what many documents share is learned first. Without both labels the model is a constant score near 0.

    N-grams of fewer than min_docs documents keep a zero vector, and every step shrinks all vectors towards zero (a group
    lasso): what only tells single documents apart is not learned.
    """
    rng = np.random.default_rng(seed)
    ids: dict[bytes, int] = {}
    tokens, run_words, run_docs, truth = [], [], [], []
    for text, label in zip(texts, labels):
        words = plain_words(text)
        if not words:
            continue
        tokens.extend(ids.setdefault(w, len(ids)) for w in words)
        sizes = [RUN] * (len(words) // RUN) + ([len(words) % RUN] if len(words) % RUN else [])
        run_words += sizes
        run_docs += [len(truth)] * len(sizes)
        truth.append(label)
    if len(set(truth)) < 2:
        return ToxicityModel(np.zeros(buckets), -20.0)
    y, doc_of_run, size_of_run = np.array(truth, float), np.array(run_docs), np.array(run_words, float)
    token, run_of_token = np.array(tokens, np.int32), np.repeat(np.arange(len(run_words), dtype=np.int32), run_words)
    del tokens
    gram, word_of_gram = subwords(list(ids), buckets)
    order = np.argsort(word_of_gram, kind="stable")
    gram, word_of_gram = gram[order], word_of_gram[order]
    n_grams = np.bincount(word_of_gram, minlength=len(ids)).astype(float)
    grams = np.split(gram, np.cumsum(n_grams[:-1]).astype(int))
    in_docs, in_toxic = np.zeros(buckets), np.zeros(buckets)
    ends = np.searchsorted(doc_of_run[run_of_token], np.arange(len(y)), side="right")
    for d, (begin, end) in enumerate(zip(np.append(0, ends[:-1]), ends)):  # one document at a time: little memory
        own = np.unique(np.concatenate([grams[w] for w in np.unique(token[begin:end])]))
        in_docs[own] += 1
        in_toxic[own] += y[d]
    del grams
    del order
    n_kinds = len(n_grams)
    used = in_docs >= min_docs
    share, whole = in_docs / len(y), y.sum()
    # the vectors start from how far each n-gram's count in toxic documents is from chance, in standard deviations
    spread = np.sqrt(np.maximum(share * (1 - share) * len(y), 1) * (1 / whole + 1 / max(1, len(y) - whole)) / len(y))
    surprise = used * (in_toxic / whole - (in_docs - in_toxic) / max(1, len(y) - whole)) / spread
    n_docs, n_runs, weight = len(y), len(run_words), 1 / (size_of_run[run_of_token])

    embedding, direction, bias = rng.normal(0, 0.01, (buckets, dim)) * used[:, None], rng.normal(0, 0.1, dim), np.array([-6.0])
    direction[0] = 15.0
    embedding[:, 0] = 4 * np.maximum(0, surprise - 4) / max(1.0, surprise.max())
    params = [embedding, direction, bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros(1) for _ in params]
    for step in range(1, rounds + 1):
        bucket_scores = embedding @ direction
        word_scores = np.bincount(word_of_gram, bucket_scores[gram], n_kinds) / n_grams
        logits = np.bincount(run_of_token, word_scores[token] * weight, n_runs) + bias[0]
        odds = np.exp(np.clip(logits, -40, 40))
        total = np.bincount(doc_of_run, odds, n_docs)
        slope = (total / (1 + total) - y) / n_docs
        run_slope = slope[doc_of_run] * odds / total[doc_of_run]
        word_slope = np.bincount(token, run_slope[run_of_token] * weight, n_kinds) / n_grams
        bucket_slope = np.bincount(gram, word_slope[word_of_gram], buckets)
        bucket_slope *= used
        slopes = [np.outer(bucket_slope, direction), embedding.T @ bucket_slope, np.array([run_slope.sum()])]
        for p, g, m, v in zip(params, slopes, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * ((g * g).max() - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-12)
        embedding *= np.maximum(0, 1 - rate * shrink / (np.linalg.norm(embedding, axis=1, keepdims=True) + 1e-12))
    return ToxicityModel((embedding @ direction).round(9), float(bias[0]))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, max_chars: int = SAMPLE_CHARS) -> ToxicityModel:
    """Learns labels.toxic from at most `rows` labelled documents outside the held-out fold."""
    sample = labelled_sample(docs, labels, "toxic", rows, max_chars).collect()
    return train([r["_text"] for r in sample], [r["_label"] for r in sample])


def with_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", into: str = "score") -> DataFrame:
    """docs with the score of every text in the column `into`, of a model fitted on docs and labels.

    Null and empty texts score 0. Documents without a label are scored like others; labels without a document, null
    labels and null ids are not learned from; of several labels for one id the higher counts. Repeated rows get equal
    scores. With empty tables or labels of one kind only, every score is near 0. Other columns stay as they are; one
    named `into` is replaced.
    """
    return score_with(fit(docs, labels), docs, text, into)


def score_with(model: ToxicityModel, docs: DataFrame, text: str = "text", into: str = "score") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = shared.value.scorer()
        for texts in batches:
            yield pd.Series(one(texts), dtype=float)

    return docs.withColumn(into, score(F.col(text)))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score at least `threshold`. All columns stay, whatever their names.

    Null and empty texts score 0 and stay; repeated rows go or stay together; without labels of both kinds nothing is
    rejected; an empty table gives no rows.
    """
    model = fit(docs, labels)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("_text"))
    return score_with(model, whole, "_text", "_score").where(F.col("_score") < threshold).select("row.*")
