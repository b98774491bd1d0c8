"""Registry cleaning: active rows, orphaned parents, clone merge, kind labels. DataFrame in, DataFrame out.

Parents and subunits have the columns of affilink.sources.registry. No step collects rows; steps() counts them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affilink.functions.normalize import name_key, name_keys
from affilink.sources.registry import ALIASES, id_key

#: Label, unit type, programme type, interdisciplinary, child by an outside registry.
KIND_LABELS = [
    ("Anabilim Dalı", "anabilim_dali", None, False, False),
    ("Bölüm", "bolum", None, False, False),
    ("ror_child", "ror_child", None, False, True),
    ("Lisans", None, "lisans", False, False),
    ("Tezli Yüksek Lisans Programı", None, "tezli_yl", False, False),
    ("Önlisans", None, "onlisans", False, False),
    ("Bilim Dalı", "bilim_dali", None, False, False),
    ("Doktora Programı", None, "doktora", False, False),
    ("Uygulama ve Araştırma Merkezi", "uygar_merkezi", None, False, False),
    ("Tezsiz Yüksek Lisans Programı", None, "tezsiz_yl", False, False),
    ("Fakülte", "fakulte", None, False, False),
    ("Disiplinlerarası Anabilim Dalı", "anabilim_dali", None, True, False),
    ("Disiplinlerarası Tezli Yüksek Lisans Programı", None, "tezli_yl", True, False),
    ("Meslek Yüksekokulu", "myo", None, False, False),
    ("Anasanat Dalı", "anasanat_dali", None, False, False),
    ("Disiplinlerarası Tezsiz Yüksek Lisans Programı", None, "tezsiz_yl", True, False),
    ("Enstitü", "enstitu", None, False, False),
    ("Disiplinlerarası Doktora Programı", None, "doktora", True, False),
    ("Sanat Dalı", "sanat_dali", None, False, False),
    ("Yüksekokul", "yuksekokul", None, False, False),
    ("Rektörlük", "rektorluk", None, False, False),
    ("Sanatta Yeterlik Programı", None, "sanatta_yeterlik", False, False),
    ("Disiplinlerarası Sanatta Yeterlik Programı", None, "sanatta_yeterlik", True, False),
    ("Disiplinlerarası Anasanat Dalı", "anasanat_dali", None, True, False),
]
KIND_COLUMNS = "kind_label string, unit_type string, program_type string, is_interdisciplinary boolean, is_ror_child boolean"


def active_only(rows: DataFrame) -> DataFrame:
    """P1: rows whose active is true; null counts as not."""
    return rows.filter(F.col("active").eqNullSafe(F.lit(True)))


class Orphans(NamedTuple):
    parents: DataFrame  # kept, with active_override
    redirects: DataFrame  # id, target
    dropped: DataFrame  # id


def orphan_rule(parents: DataFrame, active_subunits: DataFrame) -> Orphans:
    """P2. An inactive parent without an active subunit goes. One whose name is an active parent's, or else stands in
    one at word bounds, hands its subunits to the smallest such id, which takes its name as an alias. Others stay, with active_override.
    """
    keyed = parents.withColumn("_name", name_key(F.col("name")))
    active = active_only(keyed)
    inactive = keyed.filter(~F.col("active").eqNullSafe(F.lit(True)))
    used = active_subunits.select(F.col("parent_id").alias("id")).distinct()
    needed = inactive.join(used, "id", "left_semi").select("id", "name", "_name")
    targets = active.select(F.col("id").alias("target"), F.col("_name").alias("target_name"))
    same = needed.join(targets, F.col("_name") == F.col("target_name")).select("id", "name", "_name", "target")
    rest = needed.join(same.select("id").distinct(), "id", "left_anti")
    # a name that stands in another shares its first word with it, so the search is an equi-join on words
    first = rest.withColumn("word", F.split("_name", " ")[0]).filter("word <> ''")
    words = targets.withColumn("word", F.explode(F.array_distinct(F.split("target_name", " "))))
    inside = first.join(words, "word").filter(F.contains(F.concat(F.lit(" "), "target_name", F.lit(" ")), F.concat(F.lit(" "), "_name", F.lit(" "))))
    found = same.unionByName(inside.select("id", "name", "_name", "target"))
    redirects = found.groupBy("id", "name", "_name").agg(F.min_by("target", id_key(F.col("target"))).alias("target"))
    stays = needed.join(redirects.select("id"), "id", "left_anti").select("id")
    overridden = inactive.join(stays, "id", "left_semi").withColumn("active_override", F.lit(True))
    kept = active.withColumn("active_override", F.lit(False)).unionByName(overridden)
    given = redirects.groupBy(F.col("target").alias("id")).agg(F.array_sort(F.collect_list(F.struct(id_key(F.col("id")).alias("k"), F.col("_name").alias("key"), "name"))).alias("_given"))
    kept = kept.join(given, "id", "left").withColumn("aliases", with_names(F.col("aliases"), F.col("_given")))
    dropped = inactive.join(used, "id", "left_anti").select("id")
    return Orphans(kept.drop("_name", "_given"), redirects.select("id", "target"), dropped)


def with_names(aliases: Column, given: Column) -> Column:
    """Aliases and those of given (k, key, name) whose key none before them has."""
    own = F.coalesce(aliases, F.array().cast(ALIASES))
    start = F.struct(name_keys(F.transform(own, lambda a: a["value"])).alias("keys"), own.alias("out"))

    def added(held: Column, g: Column) -> Column:
        alias = F.struct(g["name"].alias("value"), F.lit(None).cast("string").alias("locale"), F.lit("orphan_redirect").alias("source"))
        more = F.struct(F.concat(held["keys"], F.array(g["key"])).alias("keys"), F.concat(held["out"], F.array(alias)).alias("out"))
        return F.when(F.array_contains(held["keys"], g["key"]), held).otherwise(more)

    return F.when(given.isNull(), aliases).otherwise(F.aggregate(given, start, added, lambda held: held["out"]))


def redirect(subunits: DataFrame, redirects: DataFrame) -> DataFrame:
    """Subunits under their parents' targets. Before the clone merge, so that moved ones group under the new parent."""
    moved = redirects.select(F.col("id").alias("parent_id"), "target")
    return subunits.join(moved, "parent_id", "left").withColumn("parent_id", F.coalesce("target", "parent_id")).select(subunits.columns)


def merge_clones(subunits: DataFrame) -> DataFrame:
    """P3: one row, of the smallest id, for rows alike in parent, name, label and set of alias names; merged_ids has all ids.

    Nulls are alike. The aliases of a merged row are those of all, in id order, each (value, locale, source) once.
    """
    keys = {"_name": name_key(F.col("name")), "_names": F.array_sort(F.array_distinct(name_keys(F.transform("aliases", lambda a: a["value"]))))}
    rest = [c for c in subunits.columns if c not in ("id", "parent_id", "kind_label", "aliases")]
    member = F.struct(id_key(F.col("id")).alias("k"), F.col("id"), F.col("aliases"))
    grouped = subunits.withColumns(keys).groupBy("parent_id", "_name", "kind_label", "_names").agg(
        F.min_by(F.struct("id", *rest), id_key(F.col("id"))).alias("_first"),
        F.array_sort(F.collect_list(member), lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)).alias("_members"),
    )
    several = F.array_distinct(F.flatten(F.transform("_members", lambda m: m["aliases"])))
    merged = grouped.select(
        F.col("_first.id").alias("id"),
        "parent_id",
        *(F.col(f"_first.{c}").alias(c) for c in rest),
        "kind_label",
        F.when(F.size("_members") > 1, several).otherwise(F.col("_members")[0]["aliases"]).alias("aliases"),
        F.transform("_members", lambda m: m["id"]).alias("merged_ids"),
    )
    return merged.select(*subunits.columns, "merged_ids")


def parse_kinds(rows: DataFrame) -> DataFrame:
    """P4: kind_label_raw, unit_type, program_type and flags by the table of labels; unknown labels give nulls and false."""
    spark = rows.sparkSession
    labels = F.broadcast(spark.createDataFrame(KIND_LABELS, KIND_COLUMNS))  # a fixed table
    out = rows.join(labels, "kind_label", "left")
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("is_interdisciplinary", "is_ror_child")}
    return out.withColumns(flags).withColumn("kind_label_raw", F.col("kind_label")).select(*rows.columns, "kind_label_raw", "unit_type", "program_type", *flags)


def unknown_kinds(rows: DataFrame) -> DataFrame:
    """kind_label and how many rows have it, of labels that the table lacks."""
    known = F.broadcast(rows.sparkSession.createDataFrame(KIND_LABELS, KIND_COLUMNS).select("kind_label"))
    return rows.join(known, "kind_label", "left_anti").groupBy("kind_label").agg(F.count("*").alias("rows"))


class Canonical(NamedTuple):
    parents: DataFrame
    subunits: DataFrame
    steps: DataFrame  # step, before, after, dropped, notes (JSON)


def canonicalize(parents: DataFrame, subunits: DataFrame) -> Canonical:
    """P1 to P4 in order."""
    active = active_only(subunits)
    orphans = orphan_rule(parents, active)
    merged = merge_clones(redirect(active, orphans.redirects))
    parsed = parse_kinds(merged)
    return Canonical(orphans.parents, parsed, steps(parents.sparkSession, parents, subunits, active, orphans, merged))


def steps(spark: SparkSession, parents: DataFrame, subunits: DataFrame, active: DataFrame, orphans: Orphans, merged: DataFrame) -> DataFrame:
    """A row of counts for each step, as one plan of one-row aggregates."""
    rows = lambda df, name: df.agg(F.count("*").alias(name))
    ids = lambda df, *c: df.agg(F.array_sort(F.collect_list(F.struct(id_key(F.col("id")).alias("k"), *c))).alias("x"))
    p1 = rows(subunits, "before").crossJoin(rows(active, "after")).select(F.lit("P1_active_filter").alias("step"), "before", "after", (F.col("before") - F.col("after")).alias("dropped"), F.lit("{}").alias("notes"))
    moved = ids(orphans.redirects, F.col("id"), F.col("target")).select(F.transform("x", lambda x: F.array(x["id"], x["target"])).alias("redirect"))
    over = ids(orphans.parents.filter("active_override"), F.col("id")).select(F.transform("x", lambda x: x["id"]).alias("override"))
    # a sample of the dropped ids: ten in order, not all of them
    sample = orphans.dropped.orderBy(id_key(F.col("id"))).limit(10).agg(F.collect_list("id").alias("dropped_sample"))
    p2 = rows(parents, "before").crossJoin(rows(orphans.parents, "after")).crossJoin(rows(orphans.dropped, "dropped")).crossJoin(moved).crossJoin(over).crossJoin(sample)
    p2 = p2.select(F.lit("P2_parent_orphan_rule").alias("step"), "before", "after", "dropped", F.to_json(F.struct("redirect", "override", "dropped_sample")).alias("notes"))
    groups = merged.agg(F.count("*").alias("after"), F.coalesce(F.sum((F.size("merged_ids") > 1).cast("long")), F.lit(0)).alias("merged_groups"), F.coalesce(F.sum(F.size("merged_ids") - 1), F.lit(0)).alias("absorbed_rows"))
    p3 = groups.select(F.lit("P3_clone_merge").alias("step"), (F.col("after") + F.col("absorbed_rows")).alias("before"), "after", F.col("absorbed_rows").alias("dropped"), F.to_json(F.struct("merged_groups", "absorbed_rows")).alias("notes"))
    unknown = unknown_kinds(merged).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("kind_label", F.lit("null")).alias("kind_label"), "rows")))).alias("unknown_kind_labels"))
    p4 = rows(merged, "before").crossJoin(unknown).select(F.lit("P4_kind_label_parse").alias("step"), "before", F.col("before").alias("after"), F.lit(0).cast("long").alias("dropped"), F.to_json(F.struct("unknown_kind_labels")).alias("notes"))
    return p1.unionByName(p2).unionByName(p3).unionByName(p4)


def parent_records(parents: DataFrame) -> DataFrame:
    return parents.select("id", "name", name_key(F.col("name")).alias("normalized_name"), "country", "city", "canonical_ref", "aliases", F.coalesce("active_override", F.lit(False)).alias("active_override"), F.lit("parent").alias("record_type"))


def subunit_records(subunits: DataFrame) -> DataFrame:
    """Without qualifier stripping and chained names (see affilink.operators.extensions), whose columns hold their defaults."""
    name = name_key(F.col("name"))
    return subunits.select("id", "merged_ids", "parent_id", "name", name.alias("normalized_name"), name.alias("raw_normalized_name"), "kind_label_raw", "unit_type", "program_type", "is_interdisciplinary", F.lit(False).alias("is_evening"), "is_ror_child", F.array().cast("array<string>").alias("hierarchy_context"), "aliases", F.lit("subunit").alias("record_type"))
