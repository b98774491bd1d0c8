"""Document quality by supervised subword embeddings.

A run of non-space characters, of any length, has the vectors of its hashed self, of all its character n-grams, and of its
shape (the changes between kinds of characters in it); a pair of neighbouring runs has a hashed vector too, and whether they
are equal. A document is the mean of its runs' and pairs' vectors; a softmax layer gives its classes. Trained by numpy
stochastic gradient descent on a bounded sample. As the output is linear in the mean, a worker keeps a run's share of the
output, one number, by run, in a bounded number of bytes, and makes those of many new runs at once.

Training takes about DOCS_PER_LABEL documents of each label outside the held-out fold, whole texts, at most twice as
many; the score is brought back to the labels' true shares. The score of a null, empty or blank text comes from the bias
and the vector of emptiness. Without labels every score is 0.5. A null doc_id is not held out. Repeated rows are scored
each; repeated labels count each. A score of exactly THRESHOLD is predicted 1. An empty table gives no rows. A column score is
replaced, others stay.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affilink.llm.samples import remainder, sampled
from affilink.llm.shared import table
from affilink.llm.subwords import Kept, Words, blocks, mixed

DOCS_PER_LABEL = 600
DIMENSIONS = 8
BUCKETS = 1 << 16
PAIR_BUCKETS = 1 << 14
SHORTEST, LONGEST = 2, 4
EPOCHS = 6
RATE = 4.0
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
BLOCK_CHARACTERS = 1 << 20
#: Buckets with a meaning of their own.
EMPTY, SAME = 0, 1
_FIRST = 2


def bucket(h: np.ndarray) -> np.ndarray:
    return _FIRST + (h % np.uint64(BUCKETS - _FIRST)).astype(np.int64)


_kinds = np.zeros(0x110000, dtype=np.uint32)


def kinds(codes: np.ndarray) -> np.ndarray:
    """Of characters: A for upper case, a for other letters, 9 for digits, others are a kind of their own."""
    found = _kinds[codes]
    for c in np.unique(codes[found == 0]).tolist():
        x = chr(c)
        _kinds[c] = ord("A" if x.isupper() else "a" if x.isalpha() else "9" if x.isdigit() else x if c else " ")
    return _kinds[codes]


def shapes(own: Words) -> np.ndarray:
    """A hash of each word's changes between kinds of characters."""
    total = np.zeros(len(own.sizes), dtype=np.uint64)
    for a, codes, owner in own.spans():
        before = kinds(own.codes[max(0, a - 1) : a + len(codes) - 1] if a else np.concatenate([own.codes[:1], own.codes[: len(codes) - 1]])).astype(np.uint64)
        here = kinds(own.codes[a : a + len(codes)]).astype(np.uint64)
        changed = np.flatnonzero((before != here) & (np.arange(a, a + len(codes)) > own.starts[owner]))
        if len(changed):
            cuts = np.flatnonzero(np.diff(owner[changed], prepend=-1))
            total[owner[changed][cuts]] += np.add.reduceat(mixed(before[changed] << np.uint64(32) | here[changed]), cuts)
    return mixed(total + np.uint64(0xD1B54A32D192ED03))


def run_features(runs: list[str]) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Hashes of runs, and buckets of their features with whose they are; a run's features have the same weight."""
    own = Words(runs)
    whole = own.whole()

    def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        everyone = np.arange(len(runs))
        yield bucket(whole), everyone
        yield bucket(shapes(own)), everyone
        for n in range(SHORTEST, LONGEST + 1):
            for h, owner in own.ngrams(n):
                yield bucket(h), owner

    return (whole >> np.uint64(32)).astype(np.int64), parts()


def pair_buckets(hashes: np.ndarray) -> np.ndarray:
    """Of each pair of neighbours; equal ones share one bucket."""
    a, b = hashes[:-1], hashes[1:]
    return np.where(a == b, SAME, BUCKETS + ((a * np.int64(0x9E3779B1) ^ b * np.int64(0x85EBCA77)) >> np.int64(7)) % PAIR_BUCKETS)


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights; the weights of runs add up to 1, and so do those of pairs."""
    runs = text.split() if text else []
    if not runs:
        return np.array([EMPTY]), np.ones(1, dtype=np.float32)
    counts = Counter(runs)
    hashes, parts = run_features(list(counts))
    parts = list(parts)
    buckets, owners = np.concatenate([b for b, _ in parts]), np.concatenate([o for _, o in parts])
    share = np.fromiter(counts.values(), dtype=np.float64, count=len(counts)) / len(runs) / np.bincount(owners)
    weights = share[owners]
    if len(runs) > 1:
        numbers = {run: k for k, run in enumerate(counts)}
        pairs = pair_buckets(hashes[[numbers[r] for r in runs]])
        buckets, weights = np.concatenate([buckets, pairs]), np.concatenate([weights, np.full(len(pairs), 1 / len(pairs))])
    found, spot = np.unique(buckets, return_inverse=True)
    return found, np.bincount(spot, weights).astype(np.float32)


class Model:
    """vectors, and output: two classes, a column each; shift corrects the sample's shares of labels."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.vectors = rng.normal(0, 0.1, (BUCKETS + PAIR_BUCKETS, DIMENSIONS)).astype(np.float32)
        self.output = rng.normal(0, 0.1, (DIMENSIONS, 2)).astype(np.float32)
        self.bias = np.zeros(2, dtype=np.float32)
        self.shift = 0.0

    def fit(self, docs: list[tuple[tuple[np.ndarray, np.ndarray], int]], seed: int = 0) -> Model:
        rng = np.random.default_rng(seed)
        counts = Counter(y for _, y in docs)
        share = {y: len(docs) / len(counts) / n for y, n in counts.items()}
        steps = EPOCHS * len(docs)
        done = 0
        for _ in range(EPOCHS):
            for k in rng.permutation(len(docs)).tolist():
                (buckets, weights), y = docs[k]
                rate = RATE * (1 - done / steps)
                done += 1
                rows = self.vectors[buckets]
                mean = weights @ rows
                z = mean @ self.output + self.bias
                p = np.exp(z - z.max())
                p /= p.sum()
                gap = -p
                gap[y] += 1
                gap *= share[y]
                to_rows = self.output @ gap
                self.output += 0.1 * rate * np.outer(mean, gap)
                self.bias += 0.02 * rate * gap
                self.vectors[buckets] = rows + rate * weights[:, None] * to_rows
        return self

    def lines(self) -> np.ndarray:
        """Each bucket's share of the log-odds of class 1."""
        return (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float64)

    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0]) + self.shift


class Scorer:
    """A worker's side of a model."""

    def __init__(self, lines: np.ndarray, offset: float):
        self.lines, self.offset = lines, offset
        self.kept = Kept(self.rows_of)

    def rows_of(self, runs: list[str]) -> list[np.ndarray]:
        """Each run's share of the output, and its hash."""
        hashes, parts = run_features(runs)
        total, n = np.zeros(len(runs)), np.zeros(len(runs))
        for buckets, owner in parts:
            if len(owner):
                first, last = int(owner[0]), int(owner[-1]) + 1
                total[first:last] += np.bincount(owner - first, self.lines[buckets], last - first)
                n[first:last] += np.bincount(owner - first, minlength=last - first)
        return [total / n, hashes]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for block in blocks([len(t) if t else 0 for t in texts], BLOCK_CHARACTERS):
            runs = [texts[i].split() if texts[i] else [] for i in block]
            counts = np.array([len(r) for r in runs])
            at = self.kept.numbers([r for own in runs for r in own])
            owner = np.repeat(np.arange(len(block)), counts)
            z = np.where(counts == 0, self.lines[EMPTY], 0.0)
            if len(at):
                z += np.bincount(owner, self.kept.columns[0][at], len(block)) / np.maximum(counts, 1)
                inside = owner[:-1] == owner[1:]
                pairs = self.lines[pair_buckets(self.kept.columns[1][at])[inside]]
                z += np.bincount(owner[:-1][inside], pairs, len(block)) / np.maximum(counts - 1, 1)
            out[block] = 1 / (1 + np.exp(-np.clip(z + self.offset, -500, 500)))
        return out

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


def train(docs: DataFrame, labels: DataFrame, docs_per_label: int = DOCS_PER_LABEL) -> Model | None:
    """Learns labels (doc_id, quality) of docs (doc_id, text) outside the held-out fold; None without labels."""
    marked = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)")
    marked = marked.filter(remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    shares = {r[0]: r[1] for r in marked.groupBy("quality").count().collect()}
    if len(shares) < 2:
        return None
    # the sample is drawn among the labels, so that the texts' join has its few rows on one side
    drawn_labels = sampled(marked.withColumn("text", F.lit("")), "quality", docs_per_label)
    chosen = docs.sparkSession.createDataFrame([(r.doc_id, r.quality) for r in drawn_labels], "doc_id long, quality int")
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # chosen has 4 * docs_per_label rows at most
    drawn = sorted(texts.limit(8 * docs_per_label).collect(), key=lambda r: (r.doc_id, r.text or ""))
    known = [(document_features(r.text), r.quality) for r in drawn]
    if len({y for _, y in known}) < 2:
        return None
    model = Model().fit(known)
    model.shift = float(np.log(shares[1] / shares[0]))
    return model


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with score (a column of this name is replaced)."""
    if model is None:
        return docs.withColumn("score", F.lit(0.5))
    held = docs.sparkSession.sparkContext.broadcast((model.lines(), model.offset()))  # of a size that the buckets fix

    @F.pandas_udf("double")
    def quality(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(*held.value)
        for texts in batches:
            yield pd.Series(scorer.scores(texts.tolist()), dtype="float64")

    return docs.withColumn("score", quality(docs["text"]))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
