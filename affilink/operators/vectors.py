"""Dense vectors: an encoder to plug in, a cache by text, exact nearest neighbours, cosines."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 64
QUERY_BLOCK = 4096
VECTOR = T.ArrayType(T.FloatType())


def hashed_trigrams(texts: list[str]) -> np.ndarray:
    """Unit vectors of signed counts of character trigrams: a deterministic stand-in for a sentence encoder."""
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    for row, text in zip(out, texts):
        padded = f"  {text.lower()}  "
        for i in range(len(padded) - 2):
            h = zlib.crc32(padded[i : i + 3].encode())
            row[h % DIMENSIONS] += 1 if h >> 31 else -1
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms == 0, 1, norms)


def encoded(c: Column | str, encoder: Callable[[list[str]], np.ndarray] = hashed_trigrams) -> Column:
    """Vectors of texts; null for null. encoder: texts to unit rows; it's loaded by the workers."""

    @F.pandas_udf(VECTOR)
    def column(texts: pd.Series) -> pd.Series:
        known = [t is not None for t in texts]
        rows = iter(encoder([t for t in texts if t is not None]) if any(known) else ())
        return pd.Series([next(rows).tolist() if k else None for k in known], dtype="object")

    return column(c)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """A zero vector has cosine 0 with all; null without a vector."""
    guarded = lambda v: F.when(F.sqrt(dot(v, v)) == 0, F.lit(1.0)).otherwise(F.sqrt(dot(v, v)))
    return F.when(F.size(a) * F.size(b) > 0, dot(a, b) / (guarded(a) * guarded(b)))


def unit(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: (x / F.when(norm == 0, F.lit(1.0)).otherwise(norm)).cast("float"))


def cached_vectors(docs: DataFrame, cache: DataFrame | None, encoder: Callable[[list[str]], np.ndarray] = hashed_trigrams) -> DataFrame:
    """doc_key, text_hash, vector of docs (doc_key, embed_text); only texts that the cache lacks are encoded."""
    asked = docs.select("doc_key", "embed_text", F.xxhash64("embed_text").alias("text_hash"))
    if cache is None:
        return asked.select("doc_key", "text_hash", encoded("embed_text", encoder).alias("vector"))
    known = asked.join(cache.select("doc_key", "text_hash", "vector"), ["doc_key", "text_hash"]).select("doc_key", "text_hash", "vector")
    missing = asked.join(cache.select("doc_key", "text_hash"), ["doc_key", "text_hash"], "left_anti")
    return known.unionByName(missing.select("doc_key", "text_hash", encoded("embed_text", encoder).alias("vector")))


def nearest(queries: DataFrame, vectors: DataFrame, size: int = 50, allowed: DataFrame | None = None) -> DataFrame:
    """query_id, rank, doc_key, cosine: the size nearest of vectors (doc_key, vector[, parent_id]) to queries (query_id, vector).

    Exact: blocks of queries, bounded in rows, meet batches of vectors in a matrix product that keeps the best of each
    batch. allowed (query_id, parent_id) is applied before the choice, by an equi-join. Ties go by doc_key.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "doc_key")
    usable = vectors.filter(F.size("vector") > 0)
    if allowed is not None:
        pairs = queries.select("query_id", F.col("vector").alias("q")).join(allowed, "query_id").join(usable, "parent_id")
        found = pairs.select("query_id", "doc_key", cosine(F.col("q"), F.col("vector")).alias("cosine"))
    else:
        spark = queries.sparkSession
        asked = queries.filter(F.size("vector") > 0).select("query_id", "vector")
        kind = asked.schema["query_id"].dataType.simpleString()
        found = spark.createDataFrame([], f"query_id {kind}, doc_key string, cosine double")
        blocks = -(-asked.count() // QUERY_BLOCK)
        for number in range(blocks):
            block = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).collect()
            if block:
                found = found.unionByName(_nearest_block(usable, block, size, kind))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size).select("query_id", "rank", "doc_key", "cosine")


def _nearest_block(vectors: DataFrame, block: list, size: int, kind: str) -> DataFrame:
    ids = [r.query_id for r in block]
    matrix = np.array([r.vector for r in block], dtype=np.float64)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    held = vectors.sparkSession.sparkContext.broadcast((ids, matrix / np.where(norms == 0, 1, norms)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_ids, own = held.value
        for batch in batches:
            if batch.empty:
                continue
            rows = np.stack(batch.vector.to_numpy()).astype(np.float64)
            lengths = np.linalg.norm(rows, axis=1)
            keys = batch.doc_key.to_numpy()
            scores = own @ (rows / np.where(lengths == 0, 1, lengths)[:, None]).T
            by_key = np.argsort(keys, kind="stable")
            best = by_key[np.argsort(-scores[:, by_key], axis=1, kind="stable")[:, :size]]
            yield pd.DataFrame({"query_id": np.repeat(np.array(own_ids, dtype=object), best.shape[1]), "doc_key": keys[best].ravel(), "cosine": np.take_along_axis(scores, best, 1).ravel()})

    return vectors.select("doc_key", "vector").mapInPandas(run, f"query_id {kind}, doc_key string, cosine double")
