"""From a query to scored parents and subunits: pools, hypothesis union, parent cascade, signals.

Nothing is selected by a threshold here: every candidate keeps its signals. A cosine that can't be computed is null, never 0.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affilink.functions.normalize import name_key
from affilink.functions.qualifiers import conflict, qualifiers
from affilink.functions.similarity import token_set
from affilink.operators import decompose, fusion, lexical, vectors

POOL_SIZE = 10
MOST_PARENTS = 6
#: New parents that each hypothesis but the first may add.
LATER_BUDGET = 3


class Corpus(NamedTuple):
    """What queries are resolved against. docs: doc_key, record_type, id, name, aliases, parent_id."""

    docs: DataFrame
    lexical: Callable[..., DataFrame]  # (queries, record_type, size, allowed) to query_id, rank, doc_key, score
    knn: Callable[..., DataFrame]  # (queries, record_type, size, allowed) to query_id, rank, doc_key, cosine
    cosines: Callable[[DataFrame], DataFrame]  # query_id, text, doc_key to query_id, doc_key, cosine


def corpus(docs: DataFrame, embedded: DataFrame | None = None, fuzzy: bool = True, encoder=vectors.hashed_trigrams, index: lexical.Index | None = None) -> Corpus:
    """Over documents() rows, their vectors (doc_key, vector) and their index; both are made here if not given."""
    index = index or lexical.build_index(docs)
    if embedded is None:
        from affilink.operators.documents import embed_text

        embedded = vectors.cached_vectors(embed_text(docs), None, encoder).select("doc_key", "vector")
    keyed = docs.select("doc_key", "record_type", "parent_id").join(embedded, "doc_key")

    def search(queries: DataFrame, record_type: str, size: int, allowed: DataFrame | None = None) -> DataFrame:
        return lexical.search(queries, index, record_type, size, fuzzy, allowed)

    def query_vectors(queries: DataFrame) -> DataFrame:
        from affilink.operators.documents import QUERY_PREFIX

        return queries.withColumn("vector", vectors.encoded(F.concat(F.lit(QUERY_PREFIX), F.col("text")), encoder))

    def knn(queries: DataFrame, record_type: str, size: int, allowed: DataFrame | None = None) -> DataFrame:
        return vectors.nearest(query_vectors(queries), keyed.filter(F.col("record_type") == record_type), size, allowed)

    def cosines(pairs: DataFrame) -> DataFrame:
        asked = query_vectors(pairs.select("query_id", "text").distinct()).withColumnRenamed("vector", "q").drop("text")
        rows = pairs.select("query_id", "doc_key").join(asked, "query_id").join(embedded, "doc_key")
        return rows.select("query_id", "doc_key", vectors.cosine(F.col("q"), F.col("vector")).alias("cosine"))

    return Corpus(docs, search, knn, cosines)


def pool(queries: DataFrame, own: Corpus, record_type: str, size: int = POOL_SIZE, allowed: DataFrame | None = None) -> DataFrame:
    """query_id, rank, doc_key, bm25 (raw, null if not found by it), max_bm25, cosine: both searches fused, raw scores kept."""
    # both feed several joins each; at most size rows a query, kept so that no search is planned and run anew
    words = own.lexical(queries, record_type, size, allowed).cache()
    near = own.knn(queries, record_type, size, allowed).cache()
    fused = fusion.fuse([words, near], size).select("query_id", "rank", "doc_key")
    most = words.groupBy("query_id").agg(F.max("score").alias("max_bm25"))
    rows = fused.join(words.select("query_id", "doc_key", F.col("score").alias("bm25")), ["query_id", "doc_key"], "left")
    rows = rows.join(near.select("query_id", "doc_key", F.col("cosine").alias("near")), ["query_id", "doc_key"], "left").join(most, "query_id", "left")
    missing = rows.filter("near is null").select("query_id", "doc_key").join(queries.select("query_id", "text"), "query_id")
    filled = own.cosines(missing).select("query_id", "doc_key", "cosine")
    rows = rows.join(filled, ["query_id", "doc_key"], "left")
    return rows.select("query_id", "rank", "doc_key", "bm25", F.coalesce(F.nullif("max_bm25", F.lit(0.0)), F.lit(1.0)).alias("max_bm25"), F.coalesce("near", "cosine").alias("cosine"))


def signals(rows: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidates (query_id, doc_key, bm25, max_bm25, cosine, ...) with name and signals against the whole query."""
    texts = queries.select("query_id", name_key(F.col("text")).alias("_key"), qualifiers(F.col("text")).alias("_q"))
    named = docs.select("doc_key", "id", "record_type", F.coalesce("name", F.lit("")).alias("name"))
    named = named.withColumns({"_name": name_key(F.col("name")), "_c": qualifiers(F.col("name"))})
    out = rows.join(texts, "query_id").join(named, "doc_key")
    return out.withColumns({"bm25_norm": F.coalesce(F.col("bm25") / F.col("max_bm25"), F.lit(0.0)), "token_set_ratio": token_set("_key", "_name"), "qualifier_conflict": conflict(F.col("_q"), F.col("_c"))}).drop("_key", "_q", "_name", "_c", "bm25", "max_bm25")


def budgeted(rows: DataFrame, size: int) -> DataFrame:
    """query_id, hypothesis, rank, doc_key: the first hypothesis adds up to size records, each later one up to LATER_BUDGET new ones.

    What one hypothesis leaves for want of budget a later one may add, so a query's few rows go through one function.
    """

    def chosen(own: pd.DataFrame) -> pd.DataFrame:
        seen: set[str] = set()
        keep = []
        for number, part in own.sort_values(["hypothesis", "rank"]).groupby("hypothesis", sort=True):
            budget = size if number == 1 else LATER_BUDGET
            for row in part.index:
                if budget and part.doc_key[row] not in seen:
                    seen.add(part.doc_key[row])
                    keep.append(row)
                    budget -= 1
        return own.loc[keep]

    narrow = rows.select("query_id", "hypothesis", "rank", "doc_key")
    return narrow.groupBy("query_id").applyInPandas(chosen, narrow.schema)


class Resolved(NamedTuple):
    hypotheses: DataFrame
    parents: DataFrame
    subunits: DataFrame


def parent_union(queries: DataFrame, found: DataFrame, own: Corpus, size: int = POOL_SIZE) -> DataFrame:
    """Scored parents by position: each hypothesis' pool within its budget, then parents that only a hypothesis names."""
    fallback = decompose.primary(queries, found).filter("parent_id is null").select("query_id", F.lit(1).alias("hypothesis"), "institution_part")
    parts = found.select("query_id", "hypothesis", "institution_part").unionByName(fallback).filter("institution_part <> ''")
    once = Window.partitionBy("query_id", "institution_part").orderBy("hypothesis")
    parts = parts.withColumn("n", F.row_number().over(once)).filter("n = 1").drop("n").cache()
    # a part is searched once for all queries that have it
    texts = parts.select(F.col("institution_part").alias("query_id"), F.col("institution_part").alias("text")).distinct()
    pools = pool(texts, own, "parent", size).withColumnRenamed("query_id", "institution_part")
    rows = parts.join(pools, "institution_part")
    kept = budgeted(rows, size).join(rows, ["query_id", "hypothesis", "rank", "doc_key"])
    kept = kept.select("query_id", "hypothesis", "rank", "doc_key", "bm25", "max_bm25", "cosine", F.lit(False).alias("from_hypothesis_only"))
    named = found.select("query_id", "hypothesis", "institution_part", F.concat(F.lit("parent:"), "parent_id").alias("doc_key"))
    extra = named.join(kept.select("query_id", "doc_key"), ["query_id", "doc_key"], "left_anti")
    first = Window.partitionBy("query_id", "doc_key").orderBy("hypothesis")
    extra = extra.withColumn("n", F.row_number().over(first)).filter("n = 1")
    pairs = extra.select(F.struct("query_id", "hypothesis").alias("query_id"), F.col("institution_part").alias("text"), "doc_key")
    cosines = own.cosines(pairs).select("query_id.query_id", "doc_key", "cosine")
    extra = extra.join(cosines, ["query_id", "doc_key"], "left")
    extra = extra.select("query_id", (F.col("hypothesis") + 1000).alias("hypothesis"), F.lit(0).alias("rank"), "doc_key", F.lit(0.0).alias("bm25"), F.lit(1.0).alias("max_bm25"), "cosine", F.lit(True).alias("from_hypothesis_only"))
    scored = signals(kept.unionByName(extra), queries, own.docs)
    order = Window.partitionBy("query_id").orderBy("hypothesis", "rank")
    return scored.withColumn("position", F.row_number().over(order)).drop("hypothesis", "rank")


def cascade_parents(parents: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, parent_id: the first parent and the hypotheses' parents, at most MOST_PARENTS."""
    listed = parents.filter("position = 1").select("query_id", F.col("id").alias("parent_id"), F.lit(0).alias("at"))
    listed = listed.unionByName(found.select("query_id", "parent_id", F.col("hypothesis").alias("at")))
    first = listed.groupBy("query_id", "parent_id").agg(F.min("at").alias("at"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("at"))).filter(F.col("n") <= MOST_PARENTS).select("query_id", "parent_id")


def filtered_first(filtered: DataFrame, unfiltered: DataFrame, size: int) -> DataFrame:
    """Pool rows under the found parents, then the others; passed_parent_filter tells which. Scores of the filtered search win."""
    a = filtered.select("query_id", "doc_key", F.col("rank").alias("a"), F.col("bm25").alias("bm25_a"), F.col("max_bm25").alias("max_a"), F.col("cosine").alias("cosine_a"))
    b = unfiltered.select("query_id", "doc_key", F.col("rank").alias("b"), F.col("bm25").alias("bm25_b"), F.col("max_bm25").alias("max_b"), F.col("cosine").alias("cosine_b"))
    rows = a.join(b, ["query_id", "doc_key"], "full")
    query = Window.partitionBy("query_id")
    order = query.orderBy(F.col("a").asc_nulls_last(), F.col("b").asc_nulls_last())
    rows = rows.withColumn("position", F.row_number().over(order)).withColumn("max_bm25", F.max(F.greatest("max_a", "max_b")).over(query))
    return rows.filter(F.col("position") <= size).select("query_id", "position", "doc_key", F.coalesce("bm25_a", "bm25_b").alias("bm25"), "max_bm25", F.coalesce("cosine_a", "cosine_b").alias("cosine"), F.col("a").isNotNull().alias("passed_parent_filter"))


def resolve(queries: DataFrame, own: Corpus, size: int = POOL_SIZE) -> Resolved:
    """Scored parents and subunits of queries (query_id, text, ids distinct)."""
    queries = queries.select("query_id", "text")
    parents = own.docs.filter("record_type = 'parent'").select("id", "name", "aliases")

    def search(texts: DataFrame, top: int) -> DataFrame:
        return own.lexical(texts, "parent", top).select("query_id", "rank", F.substring_index("doc_key", ":", -1).alias("id"))

    # both feed several searches each; small tables, kept so that none is planned and run anew
    found = decompose.hypotheses(queries, parents, search).cache()
    union = parent_union(queries, found, own, size).cache()
    allowed = cascade_parents(union, found)
    every = pool(queries, own, "subunit", size)
    under = pool(queries.join(allowed.select("query_id").distinct(), "query_id", "left_semi"), own, "subunit", size, allowed)
    return Resolved(found, union, signals(filtered_first(under, every, size), queries, own.docs))
