"""Search indexes as tables: written once, read by many searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from affilink.operators import cascade, documents, lexical, vectors


def write_index(parents: DataFrame, subunits: DataFrame, path: str, encoder=vectors.hashed_trigrams, recreate: bool = True) -> dict[str, int]:
    """Writes documents, postings, terms and vectors of canonical records under path; returns the number of documents.

    Without recreate, vectors of texts that the tables hold already are kept and only others are encoded.
    """
    spark = parents.sparkSession
    docs = documents.documents(parents, subunits)
    docs.write.mode("overwrite").parquet(f"{path}/documents")
    docs = spark.read.parquet(f"{path}/documents")
    index = lexical.build_index(docs)
    index.postings.write.mode("overwrite").partitionBy("record_type").parquet(f"{path}/postings")
    index.terms.write.mode("overwrite").parquet(f"{path}/terms")
    cache = None
    if not recreate:
        old = spark.read.parquet(f"{path}/vectors")
        old.write.mode("overwrite").parquet(f"{path}/vectors-before")
        cache = spark.read.parquet(f"{path}/vectors-before")
    vectors.cached_vectors(documents.embed_text(docs), cache, encoder).write.mode("overwrite").parquet(f"{path}/vectors")
    return {"documents": docs.count()}


def read_index(spark: SparkSession, path: str) -> tuple[lexical.Index, DataFrame]:
    """The lexical index and the vectors (doc_key, text_hash, vector) under path."""
    docs = spark.read.parquet(f"{path}/documents")
    return lexical.Index(docs, spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms")), spark.read.parquet(f"{path}/vectors")


def read_corpus(spark: SparkSession, path: str, fuzzy: bool = True, encoder=vectors.hashed_trigrams) -> cascade.Corpus:
    index, own = read_index(spark, path)
    return cascade.corpus(index.docs, own.select("doc_key", "vector"), fuzzy, encoder, index)
