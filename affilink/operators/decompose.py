"""Query decomposition: which contiguous part of a query names the institution, as up to five hypotheses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affilink.functions.normalize import name_keys, query_text
from affilink.functions.similarity import indel_ratio

MOST_HYPOTHESES = 5
HITS_A_WINDOW = 10


def name_variants(name: Column, aliases: Column) -> Column:
    """The name, the aliases, and their comma-separated parts of two words or more; empty ones go."""
    whole = F.filter(F.concat(F.array(F.coalesce(name, F.lit(""))), F.coalesce(aliases, F.array().cast("array<string>"))), lambda v: F.coalesce(v != "", F.lit(False)))
    strip = lambda s: F.regexp_replace(s, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    parts = lambda v: F.when(F.contains(v, F.lit(",")), F.filter(F.transform(F.split(v, ","), strip), lambda s: F.size(F.split(s, r"(?U)[\s\x1c-\x1f]+")) >= 2)).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(whole, lambda v: F.concat(F.array(v), parts(v))))


def query_tokens(queries: DataFrame) -> DataFrame:
    """query_id, text, tokens (surface) and keys (each token's normal form alone)."""
    staged = queries.withColumn("tokens", F.filter(F.split(query_text(F.col("text")), " "), lambda t: t != ""))
    return staged.withColumn("keys", name_keys(F.col("tokens")))


def windows(tokens: DataFrame) -> DataFrame:
    """All contiguous parts: query_id, first, last (exclusive), surface, key."""
    n = F.size("tokens")
    starts = tokens.filter(n > 0).select("query_id", "tokens", "keys", F.explode(F.sequence(F.lit(0), n - 1)).alias("first"))
    spans = starts.select("*", F.explode(F.sequence(F.col("first") + 1, F.size("tokens"))).alias("last"))
    part = lambda c: F.array_join(F.slice(c, F.col("first") + 1, F.col("last") - F.col("first")), " ")
    return spans.select("query_id", "first", "last", part("tokens").alias("surface"), part("keys").alias("key"))


def hypotheses(queries: DataFrame, parents: DataFrame, search: Callable[[DataFrame, int], DataFrame], top_k: int = HITS_A_WINDOW) -> DataFrame:
    """query_id, hypothesis (from 1), institution_part, unit_part, boundary_score, parent_id, parent_name.

    queries: query_id, text. parents: id, name, aliases (array of text). search: (queries (query_id, text), size) to (query_id,
    rank, id), the parents found for a window; equal windows of all queries are searched once. A query without tokens or hits has
    no hypothesis; see primary().
    """
    tokens = query_tokens(queries)
    spans = windows(tokens)
    texts = spans.select("surface").distinct()
    hits = search(texts.select(F.col("surface").alias("query_id"), F.col("surface").alias("text")), top_k).filter(F.col("rank") <= top_k).select(F.col("query_id").alias("surface"), "id", "rank")
    variants = parents.select("id", "name", F.explode(F.array_distinct(name_keys(name_variants(F.col("name"), F.col("aliases"))))).alias("variant"))
    # a window's score for a parent depends on the window's texts alone
    keyed = spans.select("surface", "key").distinct().join(hits, "surface").join(variants, "id")
    scores = _best(keyed)
    rows = spans.join(scores, ["surface", "key"])
    length = F.col("last") - F.col("first")
    # the first in this order is what a scan that replaces only by a better score, or an equal one of a longer part, ends with
    of_parent = Window.partitionBy("query_id", "id").orderBy(F.desc("score"), F.desc(length), "first")
    of_query = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(length), "first", "rank", "id")
    best = rows.withColumn("n", F.row_number().over(of_parent)).filter("n = 1").withColumn("hypothesis", F.row_number().over(of_query)).filter(F.col("hypothesis") <= MOST_HYPOTHESES)
    whole = best.join(tokens.select("query_id", "tokens"), "query_id")
    before, after = F.slice("tokens", F.lit(1), F.col("first")), F.slice("tokens", F.col("last") + 1, F.size("tokens"))
    return whole.select("query_id", "hypothesis", F.col("surface").alias("institution_part"), F.array_join(F.concat(before, after), " ").alias("unit_part"), F.greatest("score", F.lit(0.0)).alias("boundary_score"), F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))


def _best(keyed: DataFrame) -> DataFrame:
    """The best variant's score for each window and parent."""
    scored = keyed.withColumn("score", indel_ratio("key", "variant"))
    return scored.groupBy("surface", "key", "id", "rank").agg(F.max("score").alias("score"), F.min("name").alias("name"))


def primary(queries: DataFrame, found: DataFrame) -> DataFrame:
    """One row a query: its first hypothesis; without one, all tokens (or, without tokens, the raw query) as institution_part, score 0."""
    first = found.filter("hypothesis = 1").drop("hypothesis")
    tokens = query_tokens(queries).select("query_id", F.when(F.size("tokens") > 0, F.array_join("tokens", " ")).otherwise(F.col("text")).alias("whole"))
    rows = tokens.join(first, "query_id", "left")
    return rows.select("query_id", F.coalesce("institution_part", "whole").alias("institution_part"), F.coalesce("unit_part", F.lit("")).alias("unit_part"), F.coalesce("boundary_score", F.lit(0.0)).alias("boundary_score"), "parent_id", "parent_name")
