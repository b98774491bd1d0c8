"""Search documents and embedding texts of canonical records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affilink.functions.normalize import name_keys

#: What goes before texts for the encoder.
PASSAGE_PREFIX, QUERY_PREFIX = "passage: ", "query: "


def alias_values(aliases: Column) -> Column:
    """Distinct alias values in the order they come."""
    return F.array_distinct(F.filter(F.transform(aliases, lambda a: a["value"]), lambda v: F.coalesce(v != "", F.lit(False))))


def enriched(subunits: DataFrame, parents: DataFrame) -> DataFrame:
    """Subunits with parent_name, empty where the parent is unknown. Ids of subunits never stand for parents."""
    names = parents.groupBy(F.col("id").alias("parent_id")).agg(F.min("name").alias("parent_name"))
    return subunits.join(names, "parent_id", "left").withColumn("parent_name", F.coalesce("parent_name", F.lit("")))


def documents(parents: DataFrame, subunits: DataFrame) -> DataFrame:
    """Search documents of both record types, keyed by doc_key, record_type:id."""
    texts = {"aliases": alias_values(F.coalesce("aliases", F.array().cast("array<struct<value string, locale string, source string>>")))}
    p = parents.withColumns(texts)
    s = enriched(subunits, parents).withColumns(texts)
    both = p.unionByName(s, allowMissingColumns=True)
    return both.withColumns({"aliases_text": F.array_join("aliases", " "), "doc_key": F.concat_ws(":", "record_type", "id")})


def embed_text(docs: DataFrame, prefix: str = PASSAGE_PREFIX) -> DataFrame:
    """docs with embed_text: own name, a subunit's parent name, aliases; each name once (by its normal form), joined by ' - '."""
    parent = F.when(F.col("record_type") == "subunit", F.coalesce("parent_name", F.lit("")))
    parts = F.filter(F.concat(F.array("name", parent), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: F.coalesce(x != "", F.lit(False)))
    pairs = F.arrays_zip(parts.alias("part"), name_keys(parts).alias("key"))
    none = F.array().cast("array<string>")

    def added(held, x):
        clean = F.regexp_replace(x["part"], r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
        more = F.struct(F.concat(held["keys"], F.array(x["key"])).alias("keys"), F.concat(held["parts"], F.array(clean)).alias("parts"))
        return F.when((x["key"] == "") | F.array_contains(held["keys"], x["key"]), held).otherwise(more)

    kept = F.aggregate(pairs, F.struct(none.alias("keys"), none.alias("parts")), added, lambda held: held["parts"])
    return docs.withColumn("embed_text", F.concat(F.lit(prefix), F.array_join(kept, " - ")))
