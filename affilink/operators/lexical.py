"""Lexical retrieval: analyzers, postings with statistics, BM25 over several fields, fuzzy expansion.

A query's text is split into terms per field; exact terms (and near ones, if fuzzy) meet postings in one equi-join on
(field, term). A posting carries its own BM25 value, so a search is that join, a sum and a top-k. Statistics are of all
records, whatever filter a search has.
"""

from __future__ import annotations

import unicodedata
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affilink.functions.normalize import query_text, turkish_lower
from affilink.functions.similarity import edit_distance

K1, B = 1.2, 0.75
#: Boosts of the searched fields by record type.
BOOSTS = {
    "parent": {"name": 2.2, "name.ascii": 1.5, "aliases_text": 2.0, "aliases_text.ascii": 1.3},
    "subunit": {"name": 3.0, "name.ascii": 2.0, "aliases_text": 1.5, "aliases_text.ascii": 1.0, "parent_name": 1.5, "parent_name.ascii": 1.0},
}
#: Common Turkish function words, not indexed by the turkish analyzer.
STOP_WORDS = (
    "acaba ama ancak arada aslında ayrıca bana bazı belki ben beni benim beri bile bir birçok biri biz bize bizi bizim böyle bu buna bunda bundan "
    "bunlar bunu bunun burada çok çünkü da daha dahi de defa değil diğer diye dolayı en eğer gibi göre hangi hatta hem henüz hep hepsi her herhangi "
    "hiç hiçbir için ile ilgili ise işte itibaren kadar karşın kendi kez ki kim kime kimi kimse mi mu mü mı nasıl ne neden nerede niye niçin o olan "
    "olarak oldu olduğu olmak olması olsa olup olur on ona ondan onlar onu onun oysa öyle pek rağmen sadece sanki sen seni senin siz sizi sizin şey "
    "şöyle şu şuna şunu tarafından tüm üzere var vardı ve veya ya yani yerine yine yoksa zaten"
).split()
SHORTEST_EDGE, LONGEST_EDGE = 2, 20
MOST_EXPANSIONS = 50
#: Rows of asked terms that may be broadcast, and bytes of files whose records make a partition of an index for them.
FEW_ASKED = 1 << 18
PARTITION_BYTES = 4 << 20


def _folding() -> tuple[str, str]:
    """Latin letters with marks, and their plain letters, by Unicode decomposition."""
    pairs = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, range(0xC0, 0x250)) if unicodedata.normalize("NFD", c) != c}
    pairs |= {"ı": "i", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L"}
    return "".join(pairs), "".join(pairs.values())


_MARKED, _UNMARKED = _folding()


def words(c: Column) -> Column:
    """Runs of letters, digits and _; an apostrophe inside one ends it, and what follows in it goes."""
    found = F.regexp_extract_all(c, F.lit(r"(?U)[\p{L}\p{N}_]+(?:['’][\p{L}\p{N}_]+)*"), F.lit(0))
    return F.transform(found, lambda w: F.regexp_replace(w, "['’].*$", ""))


def turkish(c: Column) -> Column:
    lower = F.transform(words(c), turkish_lower)
    return F.filter(lower, lambda w: ~w.isin(STOP_WORDS))


def ascii_folded(c: Column) -> Column:
    plain = lambda w: F.replace(F.replace(F.translate(turkish_lower(w), _MARKED, _UNMARKED), F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae"))
    return F.transform(words(c), plain)


def edges(c: Column, least: int = SHORTEST_EDGE, most: int = LONGEST_EDGE) -> Column:
    """Prefixes of the ascii terms, at index time; a query is taken as ascii_folded."""
    prefixes = lambda w: F.when(F.length(w) >= least, F.transform(F.sequence(F.lit(least), F.least(F.lit(most), F.length(w))), lambda n: F.left(w, n))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(ascii_folded(c), prefixes))


class Index(NamedTuple):
    docs: DataFrame  # doc_key, record_type, id, and what the records have
    postings: DataFrame  # doc_key, record_type, field, term, value (idf and tf part of BM25)
    terms: DataFrame  # field, term, df
    few: bool = False  # made for a few asked terms: a record's postings are in one partition, and the asked terms go to them


def field_terms(docs: DataFrame, fields: list[str], kept: list[str] | None = None) -> DataFrame:
    """doc_key, record_type, field, terms: both analyses of each field, or those kept, where it has any."""
    named = [(name, suffix, analyzer) for name in fields for suffix, analyzer in (("", turkish), (".ascii", ascii_folded)) if kept is None or name + suffix in kept]
    analyses = [F.struct(F.lit(name + suffix).alias("field"), analyzer(F.col(name)).alias("terms")) for name, suffix, analyzer in named]
    rows = docs.select("doc_key", "record_type", F.explode(F.array(*analyses)).alias("f"))
    return rows.select("doc_key", "record_type", "f.field", "f.terms").filter(F.size("terms") > 0)


def scored_postings(analysed: DataFrame, asked: DataFrame | None = None, few: bool = False) -> tuple[DataFrame, DataFrame]:
    """Postings with their BM25 values, and the terms' df, of field_terms() rows; of the asked (field, term) only, if given, which are broadcast if few."""
    near = F.broadcast if few else lambda rows: rows
    rows = analysed.withColumn("length", F.size("terms"))
    each = rows.select("doc_key", "record_type", "field", "length", F.explode("terms").alias("term"))
    if asked is not None:
        each = each.join(near(asked), ["field", "term"], "left_semi")
    tf = each.groupBy("doc_key", "record_type", "field", "length", "term").agg(F.count("*").alias("tf"))
    fields = rows.groupBy("field").agg(F.count("*").alias("n"), F.avg("length").alias("average"))  # a row a field
    terms = tf.groupBy("field", "term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average")))
    weighted = terms.join(F.broadcast(fields), "field").select("field", "term", "average", idf.alias("idf"))
    return tf.join(near(weighted), ["field", "term"]).select("doc_key", "record_type", "field", "term", (F.col("idf") * part).alias("value")), terms


def build_index(docs: DataFrame, fields: tuple[str, ...] = ("name", "aliases_text", "parent_name")) -> Index:
    """Of documents() rows. Cache or write the parts where several searches follow."""
    own = [f for f in fields if f in docs.columns]
    postings, terms = scored_postings(field_terms(docs, own))
    return Index(docs, postings, terms)


def index_for(queries: DataFrame, docs: DataFrame, fields: tuple[str, ...], boosts: dict[str, float]) -> Index:
    """An index of one search without fuzzy terms: postings of the queries' terms in the boosted fields only, statistics of all records.

    Records are dealt out once, by key, before they are analysed. Where the asked terms are few they are broadcast, so neither postings
    nor the sums over them are shuffled, and only each partition's best records of a query are.
    """
    asked = query_terms(queries.select("query_id", query_text(F.col("text")).alias("text")), list(boosts))
    few = asked.count() <= FEW_ASKED
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(100_000, -(-size // PARTITION_BYTES) if size < 1 << 60 else 0))
    own = [f for f in fields if f in docs.columns]
    dealt = docs.select("doc_key", "record_type", *own).repartition(parts, "doc_key")
    postings, terms = scored_postings(field_terms(dealt, own, list(boosts)), asked.select("field", "term").distinct(), few)
    return Index(docs, postings, terms, few)


def query_terms(queries: DataFrame, fields: list[str]) -> DataFrame:
    """query_id, field, term, times of queries (query_id, text)."""
    both = queries.select("query_id", F.array(F.struct(F.lit("").alias("suffix"), turkish(F.col("text")).alias("terms")), F.struct(F.lit(".ascii").alias("suffix"), ascii_folded(F.col("text")).alias("terms"))).alias("a"))
    rows = both.select("query_id", F.explode("a").alias("a")).select("query_id", "a.suffix", F.explode("a.terms").alias("term"))
    named = [F.struct(F.lit(f).alias("field"), F.lit(".ascii" if f.endswith(".ascii") else "").alias("suffix")) for f in fields]
    rows = rows.groupBy("query_id", "suffix", "term").agg(F.count("*").alias("times")).withColumn("f", F.explode(F.array(*named)))
    return rows.filter("suffix = f.suffix").select("query_id", F.col("f.field").alias("field"), "term", "times")


def edits_allowed(term: Column) -> Column:
    return F.when(F.length(term) <= 2, 0).when(F.length(term) <= 5, 1).otherwise(2)


@F.pandas_udf(T.ArrayType(T.StringType()))
def shortened(terms: pd.Series, most: pd.Series) -> pd.Series:
    """A term without up to most of its letters, in every way. Terms within so many edits have one of these in common."""

    def of(term: str, n: int) -> list[str]:
        level = found = {term}
        for _ in range(n):
            level = {t[:i] + t[i + 1 :] for t in level for i in range(len(t))}
            found = found | level
        return sorted(found)

    return pd.Series([of(t, int(n)) for t, n in zip(terms, most)], dtype="object")


def expansions(wanted: DataFrame, vocabulary: DataFrame, most: int = MOST_EXPANSIONS) -> DataFrame:
    """field, term, match, weight: the vocabulary's terms near each wanted (field, term), itself first with weight 1.

    Near ones are found by an equi-join on shortened forms and checked by edit distance; the best ones stay, by weight, df and term.
    """
    asked = wanted.select("field", "term").distinct().withColumn("most", edits_allowed(F.col("term")))
    near = asked.filter("most > 0").select("field", "term", "most", F.explode(shortened("term", "most")).alias("form"))
    forms = vocabulary.filter(F.length("term") >= 2).select("field", F.col("term").alias("match"), "df", F.explode(shortened("term", F.when(F.length("term") <= 3, 1).otherwise(2))).alias("form"))
    pairs = near.join(forms, ["field", "form"]).filter("term <> match").groupBy("field", "term", "match").agg(F.first("most").alias("most"), F.first("df").alias("df"))
    pairs = pairs.withColumn("edits", edit_distance("term", "match")).filter("edits <= most")
    weight = 1 - F.col("edits") / F.least(F.length("term"), F.length("match"))
    order = Window.partitionBy("field", "term").orderBy(F.desc("weight"), F.desc("df"), "match")
    best = pairs.withColumn("weight", weight).withColumn("n", F.row_number().over(order)).filter(f"n < {most} and weight > 0")
    own = asked.select("field", "term", F.col("term").alias("match"), F.lit(1.0).alias("weight"))
    return own.unionByName(best.select("field", "term", "match", "weight"))


def search(queries: DataFrame, index: Index, record_type: str, size: int = 50, fuzzy: bool = True, allowed: DataFrame | None = None, boosts: dict[str, float] | None = None) -> DataFrame:
    """query_id, rank, doc_key, score: the best size records of a type for queries (query_id, text).

    allowed (query_id, parent_id) narrows each query to records of these parents without a change of scores. Ties go by the id as text.
    """
    boosts = boosts or BOOSTS[record_type]
    prepared = queries.select("query_id", query_text(F.col("text")).alias("text"))
    asked = query_terms(prepared, list(boosts))
    if fuzzy:
        asked = asked.join(expansions(asked, index.terms), ["field", "term"]).select("query_id", "field", F.col("match").alias("term"), (F.col("times") * F.col("weight")).alias("times"))
        asked = asked.groupBy("query_id", "field", "term").agg(F.max("times").alias("times"))
    boost = F.element_at(F.create_map(*(F.lit(x) for kv in boosts.items() for x in kv)), F.col("field"))
    asked = asked.withColumn("times", F.col("times") * boost)
    if index.few:
        asked = F.broadcast(asked)
    found = index.postings.filter(F.col("record_type") == record_type)
    if allowed is not None:
        parents = index.docs.filter(F.col("record_type") == record_type).select("doc_key", "parent_id")
        hits = asked.join(found, ["field", "term"]).join(parents, "doc_key").join(allowed, ["query_id", "parent_id"], "left_semi")
    else:
        hits = asked.join(found, ["field", "term"])
    scores = hits.groupBy("query_id", "doc_key").agg(F.sum(F.col("times") * F.col("value")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.substring_index("doc_key", ":", -1))
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size).select("query_id", "rank", "doc_key", "score")
