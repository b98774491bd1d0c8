"""Documents to packed training sequences: language, quality, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet to the shared folder and
reads it again as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affilink.llm import op01_jaccard_join, op05_packing, op06_language_id, op10_quality
from affilink.llm.shared import broadcast_if_few, table, written

#: A language's share of a document below which no language is taken as its own.
LEAST_LANGUAGE = 0.4
#: Near duplicates share LINK_NUM / LINK_DEN of their runs of LINK_WORDS words or more. op1's 3 words and 0.9 are its query's own.
LINK_WORDS, LINK_NUM, LINK_DEN = 5, 80, 100


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language: those without a letter, and those no language has LEAST_LANGUAGE of, go."""
    model = op06_language_id.train(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    told = op06_language_id.identify(docs.select("text", F.struct(*docs.columns).alias("_own")), model)
    return told.filter((F.col("lang_pred") != op06_language_id.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)).select("_own.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score op10_quality.THRESHOLD or more."""
    model = op10_quality.train(docs, table(spark, sf_dir, "labels"))
    if model is None:
        return docs
    told = op10_quality.scored(docs.select("text", F.struct(*docs.columns).alias("_own")), model)
    return told.filter(F.col("score") >= op10_quality.THRESHOLD).select("_own.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked ones: that of the smallest id, nulls last, then of the smallest text hash.

    Rows alike in id and text are one document. Rows that share an id but not a text, or have no id, are judged by their texts.
    Documents without a word are groups of their own, and so is each row without a word and an id.
    """
    keyed = docs.select("*", F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"))
    groups = op01_jaccard_join.link_components(keyed.drop("_id"), n=LINK_WORDS, num=LINK_NUM, den=LINK_DEN, more=("_hash",))
    own = F.when(F.col("n_shingles") > 0, F.col("component")).alias("component")
    alike, _ = written(spark, groups.select(own, "doc_id", "_hash").groupBy("component", "doc_id", "_hash").agg(F.count("*").alias("rows")), "pipeline-alike")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_hash")).alias("first")
    linked = alike.filter("component is not null").groupBy("component").agg(first, F.count("*").alias("n")).filter("n > 1").drop("n")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("_hash") == F.col("first._hash"))
    told = alike.join(broadcast_if_few(linked), "component", "left").withColumn("goes", F.col("first").isNotNull() & ~stays)
    # most documents stay as they are, so the others are named: no text is shuffled where these are few
    repeated = (F.col("rows") > 1) & (F.col("component").isNotNull() | F.col("doc_id").isNotNull())
    others, _ = written(spark, told.filter(F.col("goes") | repeated).select(F.col("doc_id").alias("_other_id"), F.col("_hash").alias("_other_hash"), "goes"), "pipeline-others")
    same = F.col("_id").eqNullSafe(F.col("_other_id")) & (F.col("_hash") == F.col("_other_hash"))
    kept = keyed.join(broadcast_if_few(others), same, "left_anti")
    again = others.filter("not goes")
    if again.limit(1).count():
        kept = kept.unionByName(keyed.join(broadcast_if_few(again), same, "left_semi").dropDuplicates(["_id", "_hash"]))
    return kept.select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence."""
    return op05_packing.pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: Trained models, a similarity join's components and a tokenizer aren't SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
