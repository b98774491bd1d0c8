"""Language identification by a linear-chain conditional random field over words.

Each word is labelled with a language; emissions come from hashed features of the word (itself, prefixes and suffixes,
character n-grams, and a lexicon's votes), transitions are learned. Training sequences are windows of labelled
documents and code-switched mixtures of them, so that the transitions know both staying and switching. Forward-backward
gives each word's probabilities; a document's language is the one with the largest sum over its words, its score that
sum's share. Emissions of a word don't depend on its neighbours, so a worker keeps them by word, in a bounded number of
bytes, and makes those of many new words at once; the chain runs over all documents of a block at once, a step a word.

Words are runs of non-space characters, lower-cased, of any length, read whole; those without a letter (Unicode category
L) say nothing and are left out. und, with score 0, if the text is null or has no letter, or nothing could be learned. Of
languages with equal sums the first by name is taken. Training takes about DOCS_PER_LABEL documents of each label, whole
texts, at most twice as many; WINDOWS_PER_DOC windows are drawn anywhere in each. A null doc_id is not held out and is not
learned from. Repeated rows are labelled each. An empty table gives no rows. Columns lang_pred and score are replaced,
others stay.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affilink.llm.samples import remainder, sampled
from affilink.llm.shared import table
from affilink.llm.subwords import Kept, Words, blocks

DOCS_PER_LABEL = 250
WINDOWS_PER_DOC = 4
WINDOW = 24
EPOCHS = 4
BUCKETS = 1 << 15
BATCH = 32
RATE = 0.3
FOLDS, HELD_OUT = 3, 1
BLOCK_CHARACTERS = 1 << 20
UNKNOWN = "und"
_ASCII_LETTER = re.compile("[A-Za-z]")
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def plain(run: str) -> str:
    """A run of characters as a word: lower-cased, without what isn't a letter at its ends."""
    return _EDGES.sub("", run.lower())


def has_letter(run: str) -> bool:
    return bool(_ASCII_LETTER.search(run)) or any(map(str.isalpha, run))


def features(words: list[str], lexicon: dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of plain() words' features, and whose they are."""
    own = Words(words)
    everyone = np.arange(len(words))
    yield (own.whole() % np.uint64(BUCKETS)).astype(np.int64), everyone
    votes = np.fromiter((lexicon.get(w, -1) for w in words), dtype=np.int64, count=len(words))
    yield (votes + 1) * 7919 % BUCKETS, everyone
    for k in range(1, 5):
        for end in (False, True):
            h, owner = own.edges(k, end)
            yield (h % np.uint64(BUCKETS)).astype(np.int64), owner
    for n in (2, 3, 4):
        for h, owner in own.ngrams(n):
            yield (h % np.uint64(BUCKETS)).astype(np.int64), owner


def words_of(text: str | None) -> list[str]:
    return [w for w in text.split() if has_letter(w)] if text else []


def lexicon_of(docs: list[tuple[list[str], int]], n_labels: int) -> dict[str, int]:
    """Words that one language has far more often than the others."""
    seen = [Counter() for _ in range(n_labels)]
    for words, label in docs:
        seen[label].update({plain(w) for w in words})
    total = [max(1, sum(c.values())) for c in seen]
    out = {}
    for label, counts in enumerate(seen):
        for w, n in counts.items():
            if n >= 3 and all(n / total[label] > 4 * seen[k][w] / total[k] for k in range(n_labels) if k != label):
                out[w] = label
    return out


def chain(emissions: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of labels (sequence, step, label) and expected transitions of equally long sequences."""
    n, steps, labels = emissions.shape
    e = np.exp(emissions - emissions.max(axis=2, keepdims=True))
    t = np.exp(transitions)
    forward, backward = np.empty_like(e), np.empty_like(e)
    a = np.exp(start) * e[:, 0]
    forward[:, 0] = a = a / a.sum(1, keepdims=True)
    for k in range(1, steps):
        a = (a @ t) * e[:, k]
        forward[:, k] = a = a / a.sum(1, keepdims=True)
    backward[:, -1] = b = np.full((n, labels), 1.0 / labels)
    for k in range(steps - 1, 0, -1):
        b = (e[:, k] * b) @ t.T
        backward[:, k - 1] = b = b / b.sum(1, keepdims=True)
    p = forward * backward
    p /= p.sum(2, keepdims=True)
    pairs = forward[:, :-1, :, None] * t * (e[:, 1:] * backward[:, 1:])[:, :, None, :]
    pairs /= pairs.sum((2, 3), keepdims=True)
    return p, pairs.sum((0, 1))


class Model:
    def __init__(self, labels: list[str], lexicon: dict[str, int]):
        n = len(labels)
        self.labels, self.lexicon = labels, lexicon
        self.weights = np.zeros((BUCKETS, n), dtype=np.float32)
        self.transitions = np.zeros((n, n))
        self.start = np.zeros(n)

    def emissions(self, runs: list[str]) -> np.ndarray:
        """(run, label) of runs."""
        out = np.zeros((len(runs), len(self.labels)))
        for buckets, owner in features([plain(r) for r in runs], self.lexicon):
            first = int(owner[0]) if len(owner) else 0
            last = int(owner[-1]) + 1 if len(owner) else 0
            for label in range(len(self.labels)):
                out[first:last, label] += np.bincount(owner - first, self.weights[buckets, label], last - first)
        return out.astype(np.float32)

    def fit(self, docs: list[tuple[list[str], int]], seed: int = 0) -> Model:
        """Stochastic gradient ascent (with per-weight step sizes) of the chains' conditional log-likelihood."""
        rng = np.random.default_rng(seed)
        n = len(self.labels)
        windows = []
        for words, label in docs:
            for _ in range(WINDOWS_PER_DOC if len(words) > WINDOW else 1):
                at = int(rng.integers(0, max(1, len(words) - WINDOW + 1)))
                part = words[at : at + WINDOW]
                windows.append((([*part] * WINDOW)[:WINDOW], label))
        ids: dict[str, int] = {}
        for words, _ in windows:
            for w in words:
                ids.setdefault(w, len(ids))
        parts = list(features([plain(w) for w in ids], self.lexicon))
        owners = np.concatenate([o for _, o in parts])
        order = np.argsort(owners, kind="stable")
        flat, bounds = np.concatenate([b for b, _ in parts])[order], np.searchsorted(owners[order], np.arange(len(ids) + 1))
        x = np.array([[ids[w] for w in words] for words, _ in windows]).reshape(-1, WINDOW)
        y = np.array([[label] * WINDOW for _, label in windows]).reshape(-1, WINDOW)
        squares = np.full(self.weights.shape, 1e-2, dtype=np.float32)
        t_squares = np.full((n, n), 1e-2)
        for _ in range(EPOCHS):
            other = rng.permutation(len(x))
            cut = rng.integers(1, WINDOW, len(x))
            switched = np.arange(WINDOW)[None, :] >= np.where(rng.random(len(x)) < 0.25, cut, WINDOW)[:, None]
            xs, ys = np.where(switched, x[other], x), np.where(switched, y[other], y)
            order = rng.permutation(len(x))
            for k in range(0, len(order), BATCH):
                bx, by = xs[order[k : k + BATCH]], ys[order[k : k + BATCH]]
                words, back = np.unique(bx, return_inverse=True)
                counts = bounds[words + 1] - bounds[words]
                at = np.repeat(bounds[words] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
                buckets = flat[at]
                owner = np.repeat(np.arange(len(words)), counts)
                per_word = np.add.reduceat(self.weights[buckets], np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0)
                p, pairs = chain(per_word[back].reshape(*bx.shape, n).astype(np.float64), self.transitions, self.start)
                gap = -p
                gap[np.arange(len(bx))[:, None], np.arange(WINDOW)[None, :], by] += 1
                by_word = np.zeros((len(words), n))
                np.add.at(by_word, back.reshape(-1), gap.reshape(-1, n))
                by_word /= len(bx)
                used, spot = np.unique(buckets, return_inverse=True)
                grad = np.zeros((len(used), n))
                np.add.at(grad, spot, by_word[owner])
                grad -= 1e-4 * self.weights[used]
                squares[used] += grad**2
                self.weights[used] += (RATE * grad / np.sqrt(squares[used])).astype(np.float32)
                seen = np.zeros((n, n))
                np.add.at(seen, (by[:, :-1].reshape(-1), by[:, 1:].reshape(-1)), 1)
                t_grad = (seen - pairs) / len(bx)
                t_squares += t_grad**2
                self.transitions += RATE * t_grad / np.sqrt(t_squares)
        return self


class Labeller:
    """A worker's side: keeps emissions by run of characters, and whether it has a letter."""

    def __init__(self, model: Model):
        self.model = model
        self.kept = Kept(lambda runs: [model.emissions(runs), np.fromiter(map(has_letter, runs), dtype=bool, count=len(runs))])

    def chained(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' probabilities, longest texts first, where each such text starts, and the texts' order; texts without words come last."""
        runs = [t.split() if t else [] for t in texts]
        at = self.kept.numbers([r for own in runs for r in own])
        owner = np.repeat(np.arange(len(texts)), [len(r) for r in runs])
        labels = len(self.model.labels)
        if len(at):
            words = self.kept.columns[1][at]
            at, owner = at[words], owner[words]
        counts = np.bincount(owner, minlength=len(texts))
        order = np.argsort(-counts, kind="stable")
        n = int(np.count_nonzero(counts))
        lengths = counts[order[:n]]
        first = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        if not n:
            return np.zeros((0, labels), dtype=np.float32), first, order
        before = np.cumsum(counts) - counts
        e = self.kept.columns[0][at[np.repeat(before[order[:n]] - first[:n], lengths) + np.arange(first[-1])]]
        e = np.exp(e - e.max(1, keepdims=True))
        t = np.exp(self.model.transitions).astype(np.float32)
        steps = int(lengths[0])
        active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # texts longer than a step, longest first
        forward = np.empty_like(e)
        a = np.exp(self.model.start).astype(np.float32) * e[first[:n]]
        for k in range(steps):
            m = active[k]
            at = first[:m] + k
            if k:
                a = (a[:m] @ t) * e[at]
            a /= a.sum(1, keepdims=True)
            forward[at] = a
        b = np.full((n, labels), 1.0 / labels, dtype=np.float32)
        for k in range(steps - 1, -1, -1):
            m = active[k]
            at = first[:m] + k
            p = forward[at] * b[:m]
            forward[at] = p / p.sum(1, keepdims=True)
            back = (e[at] * b[:m]) @ t.T
            b[:m] = back / back.sum(1, keepdims=True)
        return forward, first, order

    def probabilities(self, texts: list[str | None]) -> list[np.ndarray]:
        """(words, labels) for each text."""
        p, first, order = self.chained(texts)
        out = [np.zeros((0, len(self.model.labels)), dtype=np.float32)] * len(texts)
        for k, i in enumerate(order[: len(first) - 1].tolist()):
            out[i] = p[first[k] : first[k + 1]]
        return out

    def document(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        for block in blocks([len(t) if t else 0 for t in texts], BLOCK_CHARACTERS):
            p, first, order = self.chained([texts[i] for i in block])
            if not len(p):
                continue
            mean = np.add.reduceat(p, first[:-1], axis=0, dtype=np.float64) / np.diff(first)[:, None]
            best = mean.argmax(1)
            for k, (i, label) in enumerate(zip(order.tolist(), best.tolist())):
                names[block[i]], scores[block[i]] = self.model.labels[label], float(min(1.0, mean[k, label]))
        return names, scores


def train(docs: DataFrame, docs_per_label: int = DOCS_PER_LABEL) -> Model | None:
    """Learns from docs (doc_id, text, lang) outside the held-out fold; None if there is nothing to learn from."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", "lang").filter("lang is not null and text is not null and doc_id is not null")
    drawn = sampled(rows.filter(remainder(F.col("doc_id"), FOLDS) != HELD_OUT), "lang", docs_per_label)
    drawn = [(words_of(r.text), r.lang) for r in drawn]
    labels = sorted({lang for words, lang in drawn if words})
    if not labels:
        return None
    known = [(words, labels.index(lang)) for words, lang in drawn if words]
    return Model(labels, lexicon_of(known, len(labels))).fit(known)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and score (columns of these names are replaced)."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    held = docs.sparkSession.sparkContext.broadcast(model)  # of a size that BUCKETS and the labels fix

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(held.value)
        for texts in batches:
            names, scores = labeller.document(texts.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    out = docs.withColumn("_language", predicted(docs["text"]))
    return out.withColumns({"lang_pred": F.col("_language.lang_pred"), "score": F.col("_language.score")}).drop("_language")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return identify(docs.select("doc_id", "text"), train(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
