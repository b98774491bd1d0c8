"""Reciprocal-rank fusion of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affilink.sources.registry import id_key

RANK_CONSTANT = 60


def fuse(lists: list[DataFrame], size: int = 50, constant: int = RANK_CONSTANT) -> DataFrame:
    """query_id, rank, doc_key, rrf_score, first_list of lists (query_id, rank, doc_key), ranks from 1.

    Ties go by the id as a number. first_list is the first list that has the record, whose payload counts.
    """
    rows = reduce(DataFrame.unionByName, (x.select("query_id", "rank", "doc_key", F.lit(k).alias("list")) for k, x in enumerate(lists)))
    # rounded, so that the order of a sum doesn't decide a tie
    scores = rows.groupBy("query_id", "doc_key").agg(F.round(F.sum(1 / (constant + F.col("rank"))), 12).alias("rrf_score"), F.min("list").alias("first_list"))
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), id_key(F.substring_index("doc_key", ":", -1)), "doc_key")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size).select("query_id", "rank", "doc_key", "rrf_score", "first_list")
