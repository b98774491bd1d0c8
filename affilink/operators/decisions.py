"""After resolution: gate, validators, decision labels, evaluation, batch running, registry profile and checks."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affilink.functions.normalize import name_key
from affilink.functions.qualifiers import conflict, qualifiers
from affilink.sources.registry import id_key

#: Thresholds of the gate.
LEXICAL_FLOOR, CLEAR_TOKEN_SET, CLEAR_MARGIN = 0.55, 0.95, 0.15
AUTO, REVIEW, AMBIGUOUS, NO_MATCH = "auto_match", "review", "ambiguous", "no_match"
LONGEST_QUERY = 512
LONGEST_ACRONYM = 5


def short_acronym(text: Column) -> Column:
    """A single word of capitals, up to LONGEST_ACRONYM."""
    return F.trim(text).rlike(rf"^\p{{Lu}}{{1,{LONGEST_ACRONYM}}}$")


def gate(queries: DataFrame, parents: DataFrame, subunits: DataFrame | None = None) -> DataFrame:
    """query_id, decision, reason, id, confidence of queries (query_id, text) and scored parents.

    Empty pools and pools below the lexical floor are no_match; a clear win (token set, first in BM25, margin, no conflict,
    no short acronym) is auto_match; a near tie at the top is ambiguous; the rest is for review.
    """
    ordered = Window.partitionBy("query_id").orderBy(F.desc("token_set_ratio"), F.desc("bm25_norm"), "position")
    ranked = parents.withColumns({"n": F.row_number().over(ordered), "next": F.lead("token_set_ratio").over(ordered)})
    top = ranked.filter("n = 1").select("query_id", "id", "token_set_ratio", "bm25_norm", "qualifier_conflict", (F.col("token_set_ratio") - F.coalesce("next", F.lit(0.0))).alias("margin"))
    rows = queries.join(top, "query_id", "left")
    if subunits is not None:
        rows = rows.join(subunits.groupBy("query_id").agg(F.count("*").alias("n_subunits")), "query_id", "left")
    share, margin = F.col("token_set_ratio") / 100, F.col("margin") / 100
    clear = (share >= CLEAR_TOKEN_SET) & (F.col("bm25_norm") == 1.0) & (margin >= CLEAR_MARGIN) & ~F.col("qualifier_conflict") & ~short_acronym(F.col("text"))
    nothing = F.col("id").isNull() & (F.coalesce(F.col("n_subunits"), F.lit(0)) == 0 if subunits is not None else F.lit(True))
    reason = F.when(nothing, "empty_pools").when(F.coalesce(share, F.lit(0.0)) < LEXICAL_FLOOR, "below_floor").when(clear, "clear_win").when((share >= CLEAR_TOKEN_SET) & (margin < CLEAR_MARGIN), "near_tie").otherwise("undecided")
    return rows.withColumn("reason", reason).select("query_id", decision(F.col("reason")).alias("decision"), "reason", F.when(F.col("reason").isin("clear_win", "near_tie", "undecided"), F.col("id")).alias("id"), F.coalesce(share, F.lit(0.0)).alias("confidence"))


def decision(reason: Column) -> Column:
    return F.when(reason.isin("empty_pools", "below_floor"), NO_MATCH).when(reason == "clear_win", AUTO).when(reason == "near_tie", AMBIGUOUS).otherwise(REVIEW)


def validated(decisions: DataFrame, queries: DataFrame, candidates: DataFrame, docs: DataFrame, parent_of: DataFrame | None = None) -> DataFrame:
    """decisions (query_id, decision, id) with failed checks; an auto_match with one becomes review.

    Checks: the id is among the candidates; no qualifier of the query clashes with the record's name; the record lies under
    the chosen parent (parent_of: query_id, parent_id).
    """
    listed = candidates.select("query_id", "id", F.lit(True).alias("listed")).distinct()
    rows = decisions.join(listed, ["query_id", "id"], "left").join(queries.select("query_id", "text"), "query_id").join(docs.select("id", "name", "parent_id"), "id", "left")
    checks = [F.when(F.col("id").isNotNull() & F.col("listed").isNull(), F.lit("not_listed")), F.when(F.col("name").isNotNull() & conflict(qualifiers(F.col("text")), qualifiers(F.col("name"))), F.lit("qualifier_clash"))]
    if parent_of is not None:
        rows = rows.join(parent_of.select("query_id", F.col("parent_id").alias("chosen_parent")), "query_id", "left")
        checks.append(F.when(F.col("parent_id") != F.col("chosen_parent"), F.lit("other_parent")))
    rows = rows.withColumn("failed", F.filter(F.array(*checks), lambda x: x.isNotNull()))
    return rows.withColumn("decision", F.when((F.col("decision") == AUTO) & (F.size("failed") > 0), REVIEW).otherwise(F.col("decision"))).select(*decisions.columns, "failed")


def recall_at(candidates: DataFrame, expected: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """k, queries, hits, recall of candidates (query_id, position, merged_ids) against expected (query_id, expected_id).

    A candidate counts if the expected id is one of its merged ids.
    """
    hit = candidates.join(expected, "query_id").filter(F.array_contains("merged_ids", F.col("expected_id"))).groupBy("query_id").agg(F.min("position").alias("position"))
    each = expected.select("query_id").distinct().join(hit, "query_id", "left").withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    return each.groupBy("k").agg(F.count("*").alias("queries"), F.sum((F.coalesce(F.col("position") <= F.col("k"), F.lit(False))).cast("long")).alias("hits")).withColumn("recall", F.col("hits") / F.col("queries"))


def bootstrap(outcomes: DataFrame, rounds: int = 200, level: float = 0.95) -> DataFrame:
    """mean, low, high of outcomes (query_id, value): resampling by Poisson weights, which hash from query and round, in one aggregation."""
    # weight k has probability 1/(e k!); a uniform number of the hash chooses it
    u = F.pmod(F.xxhash64("query_id", "round"), F.lit(1 << 30)) / float(1 << 30)
    cuts = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676]
    weight = sum((u >= c).cast("int") for c in cuts)
    drawn = outcomes.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("w", weight)
    means = drawn.groupBy("round").agg((F.sum(F.col("w") * F.col("value")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    ends = means.agg(F.expr(f"percentile(m, {(1 - level) / 2})").alias("low"), F.expr(f"percentile(m, {(1 + level) / 2})").alias("high"))
    return outcomes.agg(F.avg("value").alias("mean")).crossJoin(ends)


def to_run(queries: DataFrame, finished: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Queries (query_id, text) to resolve, one for each normal form not finished (column key), and which key each query has.

    Texts are cut at LONGEST_QUERY characters; a leading character that a spreadsheet would run (= + - @ tab) gets an apostrophe.
    """
    safe = F.substring("text", 1, LONGEST_QUERY)
    safe = F.when(safe.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), safe)).otherwise(safe)
    keyed = queries.withColumn("text", safe).withColumn("key", name_key(F.col("text")))
    rest = keyed if finished is None else keyed.join(finished.select("key"), "key", "left_anti")
    return rest.groupBy("key").agg(F.min_by("text", "query_id").alias("text")).select(F.col("key").alias("query_id"), "text"), keyed.select("query_id", "key")


def without_qualifiers(name: Column) -> Column:
    """struct of name, without parenthesised qualifiers, and is_evening; the raw name stays with the caller."""
    bare = F.regexp_replace(name, r"(?iU)\s*\((?:[^()]*\b(?:tezli|tezsiz|dr|yl|[iİ]ö|[iİ]kinci öğretim|uzaktan öğretim|[iİ]ngilizce|türkçe|ücretli|burslu|english|with thesis|non-thesis)\b[^()]*)\)", "")
    evening = F.coalesce(qualifiers(name)["modality"] == "ikinci_ogretim", F.lit(False))
    return F.struct(F.when(F.trim(bare) == "", name).otherwise(F.trim(bare)).alias("name"), evening.alias("is_evening"))


def unchained(name: Column, parent_name: Column) -> Column:
    """struct of name, the last part of a comma chain, and hierarchy_context, the parts before it but a first one that is the parent."""
    parts = F.filter(F.transform(F.split(name, ","), lambda p: F.trim(p)), lambda p: p != "")
    middle = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    same = F.lower(F.coalesce(F.get(parts, F.lit(0)), F.lit(""))) == F.lower(F.coalesce(parent_name, F.lit("")))
    context = F.when(same & (F.size(middle) > 0), F.slice(middle, 2, F.greatest(F.size(middle) - 1, F.lit(0)))).otherwise(middle)
    return F.struct(F.coalesce(F.get(parts, F.size(parts) - 1), name).alias("name"), context.alias("hierarchy_context"))


def not_self_named(subunits: DataFrame) -> DataFrame:
    """Subunits (enriched with parent_name) whose name isn't their parent's."""
    return subunits.filter(~name_key(F.col("name")).eqNullSafe(name_key(F.col("parent_name"))))


def acronyms(aliases: Column, excluded_source: str | None = None, stop: tuple[str, ...] = ()) -> Column:
    """Acronyms among aliases: single capitals words, and lists of them if all parts look like one; no stop words, not of a source."""
    looks = lambda s: s.rlike(r"^(?U)\p{Lu}[\p{Lu}\p{N}&.-]{1,9}$")
    kept = F.filter(aliases, lambda a: F.lit(True) if excluded_source is None else ~a["source"].eqNullSafe(F.lit(excluded_source)))
    parts = F.transform(kept, lambda a: F.transform(F.split(a["value"], "[,;/]"), lambda p: F.trim(p)))
    whole = F.filter(parts, lambda p: F.forall(p, looks))
    flat = F.array_distinct(F.flatten(whole))
    return F.filter(flat, lambda s: ~s.isin(list(stop))) if stop else flat


def equivalent_parents(parents: DataFrame) -> DataFrame:
    """parent_id, canonical_id: parents of one country that share a name or alias key take the smallest id, over any number of steps."""
    keys = parents.select("id", "country", F.explode(F.array_distinct(F.concat(F.array("name"), F.transform("aliases", lambda a: a["value"])))).alias("text")).withColumn("key", name_key(F.col("text"))).filter("key <> '' and country is not null")
    spark = parents.sparkSession
    number = checkpointed(spark, keys.select("id", "country", "key").distinct())
    labels = checkpointed(spark, parents.select("id").distinct().withColumn("label", F.col("id")))
    changed = True
    while changed:
        low = number.join(labels, "id").groupBy("country", "key").agg(F.min_by("label", id_key(F.col("label"))).alias("low"))
        best = number.join(low, ["country", "key"]).groupBy("id").agg(F.min_by("low", id_key(F.col("low"))).alias("best"))
        near = labels.join(best, "id", "left").select("id", "label", F.coalesce("best", "label").alias("up"))
        # a label's own label: a chain's reach doubles each round
        jump = labels.select(F.col("id").alias("up"), F.col("label").alias("over"))
        step = checkpointed(spark, near.join(jump, "up").select("id", F.col("label").alias("old"), F.col("over").alias("label")))
        changed = not step.filter("old <> label").isEmpty()
        labels = step.drop("old")
    return labels.select(F.col("id").alias("parent_id"), F.col("label").alias("canonical_id"))


def checkpointed(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df, written to the cluster's checkpoint folder; where none is set and Spark is local, as in tests, to one of our own."""
    if spark.sparkContext.getCheckpointDir() is None:
        named, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
        if not named and master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is unset, and {master} shares no local folder")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="affilink-"))
    return df.checkpoint()


def profile(rows: DataFrame, name: str = "name", label: str | None = None) -> dict[str, DataFrame]:
    """Cardinality and name-sharing histogram, fill rates, and label distribution of a registry table."""
    shared = rows.groupBy(name_key(F.col(name)).alias("key")).agg(F.count("*").alias("rows")).groupBy("rows").agg(F.count("*").alias("names"))
    filled = [F.struct(F.lit(c).alias("column"), F.avg(F.col(c).isNotNull().cast("double")).alias("filled")) for c in rows.columns]
    rates = rows.agg(F.array(*filled).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    out = {"shared_names": shared, "fill_rate": rates}
    if label:
        out["labels"] = rows.groupBy(label).agg(F.count("*").alias("rows"))
    return out


def acceptance(raw_active: DataFrame, parents: DataFrame, subunits: DataFrame) -> DataFrame:
    """check, violations of a cleaned registry: clone keys unique, no orphans, merged ids are the input's ids, each once."""
    keys = subunits.withColumns({"_n": name_key(F.col("name")), "_a": F.array_sort(F.array_distinct(F.transform("aliases", lambda a: F.lower(a["value"]))))}).groupBy("parent_id", "_n", "kind_label_raw", "_a").count().filter("count > 1")
    orphans = subunits.join(parents.select(F.col("id").alias("parent_id")), "parent_id", "left_anti")
    merged = subunits.select(F.explode("merged_ids").alias("id"))
    lost = raw_active.select("id").join(merged, "id", "left_anti")
    twice = merged.groupBy("id").count().filter("count > 1")
    made = merged.join(raw_active.select("id"), "id", "left_anti")
    parts = {"clone_key_unique": keys, "no_orphan_subunit": orphans, "no_id_lost": lost, "no_id_twice": twice, "no_id_made_up": made}
    rows = [df.agg(F.count("*").alias("violations")).select(F.lit(k).alias("check"), "violations") for k, df in parts.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
