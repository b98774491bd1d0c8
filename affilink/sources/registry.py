"""Registry files: raw CSV with JSON aliases in, canonical JSON lines and a report out.

Ids are digits as text. They sort by number; other ids come behind, by text.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affilink.functions.normalize import is_true

ALIASES = "array<struct<value string, locale string, source string>>"
PARENT = f"id string, name string, country string, city string, canonical_ref string, active boolean, aliases {ALIASES}"
SUBUNIT = f"id string, parent_id string, name string, kind_label string, active boolean, aliases {ALIASES}"
PARENT_COLUMNS = ["id", "name", "country", "city", "canonical_ref", "active", "aliases"]
SUBUNIT_COLUMNS = ["id", "parent_id", "name", "kind_label", "active", "aliases"]
_CELL = "struct<items: array<struct<name: string, locale: string, source: string>>>"


def id_key(c: Column) -> Column:
    """A total order of ids: numbers by value, then the rest by text."""
    number = F.when(c.rlike(r"^\d{1,38}$"), c.cast("decimal(38,0)"))
    return F.struct(number.isNull().alias("text"), number.alias("number"), c.alias("id"))


def parse_aliases(cell: Column) -> Column:
    """The alias list of a JSON cell: named items only, an empty list for an empty cell. Malformed JSON fails."""
    items = F.from_json(F.when(F.trim(cell) != "", cell), _CELL, {"mode": "FAILFAST"})["items"]
    named = F.filter(items, lambda x: F.coalesce(x["name"] != "", F.lit(False)))
    renamed = F.transform(named, lambda x: F.struct(x["name"].alias("value"), x["locale"].alias("locale"), x["source"].alias("source")))
    return F.coalesce(renamed, F.array().cast(ALIASES))


def _csv(spark: SparkSession, path: str, needed: list[str]) -> DataFrame:
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"', encoding="UTF-8", inferSchema=False)
    missing = [c for c in needed if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return raw.select([F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string").alias(c) for c in needed])


def _filled(name: str) -> Column:
    return F.nullif(F.col(name), F.lit("")).alias(name)


def read_parents(spark: SparkSession, path: str) -> DataFrame:
    raw = _csv(spark, path, PARENT_COLUMNS)
    return raw.select("id", F.coalesce("name", F.lit("")).alias("name"), _filled("country"), _filled("city"), _filled("canonical_ref"), is_true(F.col("active")).alias("active"), parse_aliases(F.col("aliases")).alias("aliases"))


def read_subunits(spark: SparkSession, path: str) -> DataFrame:
    raw = _csv(spark, path, SUBUNIT_COLUMNS)
    return raw.select("id", "parent_id", F.coalesce("name", F.lit("")).alias("name"), "kind_label", is_true(F.col("active")).alias("active"), parse_aliases(F.col("aliases")).alias("aliases"))


def write_jsonl(rows: DataFrame, path: str, key: str = "id") -> None:
    """JSON lines in id order, nulls written out. The order is one of ranges, so files in name order are in id order."""
    rows.withColumn("_key", id_key(F.col(key))).orderBy("_key").drop("_key").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def report_text(steps: DataFrame, n_parents: int, n_subunits: int) -> str:
    """The transform report of a steps table (step, before, after, dropped, notes), the same bytes each time."""
    rows = [{"step": r.step, "before": r.before, "after": r.after, "dropped": r.dropped, "notes": json.loads(r.notes)} for r in steps.orderBy("step").collect()]
    totals = {"parent": n_parents, "subunit": n_subunits, "index_total": n_parents + n_subunits}
    return json.dumps({"steps": rows, "totals": totals}, ensure_ascii=False, indent=2)
