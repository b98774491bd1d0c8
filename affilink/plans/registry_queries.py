"""Queries over the fixtures of base: normal forms, similarities, the registry's cleaning, decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from affilink.functions import normalize, similarity
from affilink.operators import canonical, decisions
from affilink.plans.base import CLEANED, PARENTS, QUERIES_OF_PARTS, SUBUNITS, aliased, fixture, indel, query, registry, staged, text_of

# --- text -------------------------------------------------------------------------------------------------------------


@query(f"WITH q AS ({QUERIES_OF_PARTS}), {staged('k', 'q', 'p_partkey', 'text')} SELECT p_partkey, text AS written, base, key FROM k")
def query_normal_form(spark, sf):
    rows = fixture(spark, sf, QUERIES_OF_PARTS)
    form = normalize.normalized(F.col("text"))
    return rows.select("p_partkey", normalize.query_text(F.col("text")).alias("written"), form["base"].alias("base"), form["base_no_accent"].alias("key"))


_NEXT = f"WITH q AS ({QUERIES_OF_PARTS}), {staged('k', 'q', 'p_partkey', 'text')}, pairs AS (SELECT a.p_partkey, a.key AS a, b.key AS b FROM k a JOIN k b ON b.p_partkey = a.p_partkey + 1)"


def _next(spark, sf):
    """The keys of each query and the next one's."""
    rows = fixture(spark, sf, QUERIES_OF_PARTS).select("p_partkey", normalize.name_key(F.col("text")).alias("a"))
    return rows.join(rows.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b")), "p_partkey")


@query(_NEXT + f" SELECT p_partkey, round({indel('a', 'b')}, 4) AS ratio FROM pairs")
def indel_ratio(spark, sf):
    return _next(spark, sf).select("p_partkey", F.round(similarity.indel_ratio("a", "b"), 4).alias("ratio"))


_SETS = (
    ", w AS (SELECT p_partkey, list_sort(list_distinct(list_filter(string_split(a, ' '), lambda x: x <> ''))) AS x, list_sort(list_distinct(list_filter(string_split(b, ' '), lambda x: x <> ''))) AS y FROM pairs), "
    "s AS (SELECT p_partkey, x, y, list_filter(x, lambda v: list_contains(y, v)) AS shared, list_filter(x, lambda v: NOT list_contains(y, v)) AS one, list_filter(y, lambda v: NOT list_contains(x, v)) AS two FROM w), "
    "j AS (SELECT p_partkey, len(x) AS nx, len(y) AS ny, len(shared) AS n, len(one) AS n1, len(two) AS n2, array_to_string(shared, ' ') AS sect, array_to_string(list_concat(shared, one), ' ') AS a, array_to_string(list_concat(shared, two), ' ') AS b FROM s) "
)


@query(_NEXT + _SETS + f"SELECT p_partkey, round(CASE WHEN nx = 0 OR ny = 0 THEN 0.0 WHEN n > 0 AND (n1 = 0 OR n2 = 0) THEN 100.0 WHEN n > 0 THEN greatest({indel('a', 'b')}, {indel('sect', 'a')}, {indel('sect', 'b')}) ELSE {indel('a', 'b')} END, 4) AS ratio FROM j")
def token_set_ratio(spark, sf):
    return _next(spark, sf).select("p_partkey", F.round(similarity.token_set("a", "b"), 4).alias("ratio"))


# --- cleaning ---------------------------------------------------------------------------------------------------------

_GIVEN = (
    f", {staged('x1', 'kept', 'id, n, raw_name, over, a1, a2', 'a1')}, {staged('x2', 'x1', 'id, n, raw_name, over, a1, a2, key AS key1', 'a2')}, "
    "given AS (SELECT hit.target AS id, p.key AS given_key, min(p.n) AS given_n, min_by(p.raw_name, p.n) AS given_name FROM hit JOIN p ON p.id = hit.id GROUP BY ALL), "
    "more AS (SELECT g.id, list(g.given_name ORDER BY g.given_n) AS given FROM given g JOIN x2 ON x2.id = g.id WHERE g.given_key IS DISTINCT FROM x2.key1 AND g.given_key IS DISTINCT FROM x2.key GROUP BY g.id) "
)


@query(CLEANED + _GIVEN + "SELECT id, raw_name AS name, over AS active_override, array_to_string(list_concat(list_filter([a1, a2], lambda x: x IS NOT NULL), coalesce(given, [])), '|') AS aliases FROM x2 LEFT JOIN more USING (id)")
def clean_parents(spark, sf):
    got = canonical.canonicalize(*registry(spark, sf)).parents
    return got.select("id", "name", "active_override", text_of(F.transform("aliases", lambda a: a["value"])).alias("aliases"))


@query("SELECT * FROM (" + CLEANED + "SELECT ids[1] AS id, array_to_string(ids, '|') AS merged, parent_id, name, name_key AS normalized_name, kind_label AS kind_label_raw, array_to_string(list_filter(alias_list, lambda x, i: list_position(alias_list, x) = i), '|') AS alias_values FROM groups)")
def build_data(spark, sf):
    got = canonical.subunit_records(canonical.canonicalize(*registry(spark, sf)).subunits)
    return got.select("id", text_of(F.col("merged_ids")).alias("merged"), "parent_id", "name", "normalized_name", "kind_label_raw", text_of(F.transform("aliases", lambda a: a["value"])).alias("alias_values"))


#: Labels of the fixture that the table of labels has.
_KNOWN = "('Bölüm', 'Lisans', 'Disiplinlerarası Doktora Programı', 'ror_child')"


@query(
    CLEANED
    + f""", sample AS (SELECT id, n FROM gone ORDER BY n LIMIT 10), unknown AS (SELECT coalesce(kind_label, 'null') AS k, count(*) AS c FROM groups WHERE kind_label IS NULL OR kind_label NOT IN {_KNOWN} GROUP BY ALL)
SELECT 'P1_active_filter' AS step, (SELECT count(*) FROM s0) AS before, (SELECT count(*) FROM act) AS after, (SELECT count(*) FROM s0 WHERE NOT active) AS dropped, '{{}}' AS notes
UNION ALL SELECT 'P2_parent_orphan_rule', (SELECT count(*) FROM p0), (SELECT count(*) FROM kept), (SELECT count(*) FROM gone),
  CAST(to_json({{'redirect': coalesce((SELECT list([id, target] ORDER BY n) FROM hit), []), 'override': coalesce((SELECT list(id ORDER BY n) FROM kept WHERE over), []), 'dropped_sample': coalesce((SELECT list(id ORDER BY n) FROM sample), [])}}) AS VARCHAR)
UNION ALL SELECT 'P3_clone_merge', (SELECT count(*) FROM act), (SELECT count(*) FROM groups), (SELECT count(*) FROM act) - (SELECT count(*) FROM groups),
  CAST(to_json({{'merged_groups': (SELECT count(*) FROM groups WHERE len(ids) > 1), 'absorbed_rows': (SELECT count(*) FROM act) - (SELECT count(*) FROM groups)}}) AS VARCHAR)
UNION ALL SELECT 'P4_kind_label_parse', (SELECT count(*) FROM groups), (SELECT count(*) FROM groups), 0, '{{"unknown_kind_labels":{{' || (SELECT string_agg('"' || k || '":' || c, ',' ORDER BY k) FROM unknown) || '}}}}'"""
)
def step_report(spark, sf):
    return canonical.canonicalize(*registry(spark, sf)).steps


#: Subunits as cleaning must not leave them: ids lost, listed twice and made up; inactive ones and orphans among them.
_FAULTY = "SELECT id, CASE WHEN CAST(id AS BIGINT) % 10 = 0 THEN NULL ELSE id END AS m1, CASE WHEN CAST(id AS BIGINT) % 11 = 0 THEN id WHEN CAST(id AS BIGINT) % 13 = 0 THEN concat('x', id) END AS m2 FROM s"


@query(
    f"WITH s AS ({SUBUNITS}), p AS ({PARENTS}), f AS ({_FAULTY}), m AS (SELECT m1 AS id FROM f WHERE m1 IS NOT NULL UNION ALL SELECT m2 FROM f WHERE m2 IS NOT NULL), r AS (SELECT id FROM s WHERE active), "
    f"{staged('k', 's', 'id, parent_id, kind_label, list_sort(list_distinct(list_filter([lower(a1), lower(a2)], lambda x: x IS NOT NULL))) AS names', 'name')}, c AS (SELECT parent_id, key, kind_label, names FROM k GROUP BY ALL HAVING count(*) > 1) "
    "SELECT 'clone_key_unique' AS \"check\", count(*) AS violations FROM c UNION ALL SELECT 'no_orphan_subunit', count(*) FROM s WHERE parent_id NOT IN (SELECT id FROM p WHERE active) UNION ALL SELECT 'no_id_lost', count(*) FROM r WHERE id NOT IN (SELECT id FROM m) "
    "UNION ALL SELECT 'no_id_twice', count(*) FROM (SELECT id FROM m GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'no_id_made_up', count(*) FROM m WHERE id NOT IN (SELECT id FROM r)"
)
def acceptance_checks(spark, sf):
    parents, subunits = registry(spark, sf)
    number = F.col("id").cast("long")
    merged = F.filter(F.array(F.when(number % 10 != 0, F.col("id")), F.when(number % 11 == 0, F.col("id")).when(number % 13 == 0, F.concat(F.lit("x"), "id"))), lambda x: x.isNotNull())
    faulty = subunits.withColumns({"kind_label_raw": F.col("kind_label"), "merged_ids": merged})
    return decisions.acceptance(canonical.active_only(subunits), canonical.active_only(parents), faulty)


_KEYS = f"{staged('k0', 'p0', 'id, country, a1, a2', 'name')}, {staged('k1', 'k0', 'id, country, a2, key AS key0', 'a1')}, {staged('k2', 'k1', 'id, country, key0, key AS key1', 'a2')}"


@query(
    f"WITH RECURSIVE p0 AS ({PARENTS}), {_KEYS}, n AS (SELECT DISTINCT CAST(id AS BIGINT) AS n, country, k FROM (SELECT id, country, unnest([key0, key1, key]) AS k FROM k2) WHERE k <> '' AND country IS NOT NULL), "
    "h AS (SELECT n, min(n) OVER (PARTITION BY country, k) AS hub FROM n), e AS (SELECT n AS a, hub AS b FROM h UNION SELECT hub, n FROM h), r AS (SELECT CAST(id AS BIGINT) AS a, CAST(id AS BIGINT) AS b FROM p0 UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) "
    "SELECT CAST(a AS VARCHAR) AS parent_id, CAST(min(b) AS VARCHAR) AS canonical_id FROM r GROUP BY a"
)
def parent_equivalence(spark, sf):
    return decisions.equivalent_parents(registry(spark, sf)[0])


# --- decisions --------------------------------------------------------------------------------------------------------

_ASKED = "SELECT s_suppkey AS query_id, CASE s_suppkey % 7 WHEN 0 THEN 'ABC' WHEN 1 THEN ' ODTÜ ' WHEN 2 THEN 'ABCDEF' ELSE s_name END AS text FROM supplier"
_SCORED = """
SELECT s_suppkey AS query_id, CAST(k AS STRING) AS id, k AS position, CAST(100 - ((s_suppkey * 7 + k * 13) % 19) * 3 AS DOUBLE) AS token_set_ratio,
  CAST(CASE WHEN (s_suppkey + k) % 3 = 0 THEN 1 ELSE 0.5 END AS DOUBLE) AS bm25_norm, (s_suppkey + k) % 5 = 0 AS qualifier_conflict
FROM supplier JOIN (SELECT n_nationkey AS k FROM nation) AS n ON k < s_suppkey % 4
"""
_WITH_SUBUNITS = "SELECT s_suppkey AS query_id FROM supplier WHERE s_suppkey % 8 = 0"
_GATE = f"""
WITH q AS ({_ASKED}), c AS ({_SCORED}), u AS ({_WITH_SUBUNITS}),
r AS (SELECT *, row_number() OVER w AS n, lead(token_set_ratio) OVER w AS following FROM c WINDOW w AS (PARTITION BY query_id ORDER BY token_set_ratio DESC, bm25_norm DESC, position)),
t AS (SELECT q.query_id, q.text, r.id, token_set_ratio / 100 AS share, (token_set_ratio - coalesce(following, 0)) / 100 AS margin, bm25_norm, qualifier_conflict FROM q LEFT JOIN r ON r.query_id = q.query_id AND r.n = 1),
z AS (SELECT *, CASE WHEN id IS NULL AND query_id NOT IN (SELECT query_id FROM u) THEN 'empty_pools' WHEN coalesce(share, 0) < 0.55 THEN 'below_floor'
  WHEN share >= 0.95 AND bm25_norm = 1 AND margin >= 0.15 AND NOT qualifier_conflict AND NOT regexp_full_match(trim(text), '[A-ZÇĞİÖŞÜ]{{1,5}}') THEN 'clear_win' WHEN share >= 0.95 AND margin < 0.15 THEN 'near_tie' ELSE 'undecided' END AS reason FROM t)
SELECT query_id, CASE WHEN reason IN ('empty_pools', 'below_floor') THEN 'no_match' WHEN reason = 'clear_win' THEN 'auto_match' WHEN reason = 'near_tie' THEN 'ambiguous' ELSE 'review' END AS decision, reason,
  CASE WHEN reason NOT IN ('empty_pools', 'below_floor') THEN id END AS id, coalesce(share, 0) AS confidence FROM z
"""


@query(_GATE)
def gate_decision(spark, sf):
    asked, scored, under = (fixture(spark, sf, sql) for sql in (_ASKED, _SCORED, _WITH_SUBUNITS))
    return decisions.gate(asked, scored, under)


_FORMULAS = f"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat('=', text) WHEN 1 THEN concat('-', text) ELSE text END AS text FROM ({QUERIES_OF_PARTS}) AS q"


@query(
    f"WITH a AS ({_FORMULAS}), b AS (SELECT p_partkey, CASE WHEN left(text, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) THEN '''' || left(text, 512) ELSE left(text, 512) END AS safe FROM a), {staged('k', 'b', 'p_partkey, safe', 'safe')}, "
    "done AS (SELECT key FROM k WHERE p_partkey % 10 = 0) SELECT key AS query_id, min_by(safe, p_partkey) AS text FROM k WHERE key NOT IN (SELECT key FROM done) GROUP BY key"
)
def batch_to_run(spark, sf):
    rows = fixture(spark, sf, _FORMULAS).select(F.col("p_partkey").alias("query_id"), "text")
    done = decisions.to_run(rows.filter("query_id % 10 = 0"))[1].select("key").distinct()
    return decisions.to_run(rows, done)[0]


_SELF = "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'Gazi Üni.' WHEN 1 THEN 'Gazi Üniversitesi' ELSE p_name END AS name, CASE p_partkey % 4 WHEN 0 THEN 'GAZİ  ÜNİVERSİTESİ' WHEN 1 THEN NULL ELSE 'Ankara' END AS parent_name FROM part"


@query(f"WITH a AS ({_SELF}), {staged('b', 'a', 'id, name, parent_name', 'name')}, {staged('c', 'b', 'id, name, key AS own', 'parent_name')} SELECT id, name FROM c WHERE own IS DISTINCT FROM key")
def self_named_filter(spark, sf):
    return decisions.not_self_named(fixture(spark, sf, _SELF)).select("id", "name")


#: Names with what is left without qualifiers and whether they say evening; chains under the parent Gazi Üniversitesi with
#: their last part and the parts before; aliases with their acronyms (a2's source is left out). § takes a part's name.
_NAMES = [("§ (İÖ)", "§", True), ("§ (Tezli) (İngilizce)", "§", False), ("(Tezsiz)", "(Tezsiz)", False), ("Tarih (Eski Çağ)", "Tarih (Eski Çağ)", False), ("§ (İkinci Öğretim)", "§", True), ("§", "§", False), ("§ ( non-thesis )", "§", False)]
_CHAINS = [("gazi üniversitesi, Fen Fakültesi, §", "§", "Fen Fakültesi"), ("Ankara , Fen Fakültesi,, § ", "§", "Ankara|Fen Fakültesi"), ("§", "§", ""), (", ,", ", ,", ""), ("Gazi Üniversitesi, §", "§", "")]
_SHORT = [("ODTÜ", None, "ODTÜ"), ("AB, CD; EF", None, "AB|CD|EF"), ("Abc", "IT", ""), ("X", None, ""), ("GSÜ/İTÜ", "KTU", "GSÜ|İTÜ"), ("AB, Cd", None, ""), ("A&B-2, AA", None, "A&B-2|AA")]


def _of(rows: list, at: int) -> str:
    """A CASE that gives part p_partkey the value of column at of its row."""
    quoted = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "replace('" + v + "', '§', p_name)"
    return f"CASE CAST(p_partkey % {len(rows)} AS INT) " + " ".join(f"WHEN {k} THEN {quoted(r[at])}" for k, r in enumerate(rows)) + " END"


@query(f"SELECT p_partkey, {_of(_NAMES, 1)} AS bare, {_of(_NAMES, 2)} AS is_evening, {_of(_CHAINS, 1)} AS last_part, {_of(_CHAINS, 2)} AS hierarchy, {_of(_SHORT, 2)} AS acronyms FROM part")
def name_parts(spark, sf):
    rows = aliased(fixture(spark, sf, f"SELECT p_partkey, {_of(_NAMES, 0)} AS named, {_of(_CHAINS, 0)} AS chain, {_of(_SHORT, 0)} AS a1, {_of(_SHORT, 1)} AS a2 FROM part"))
    bare, chain = decisions.without_qualifiers(F.col("named")), decisions.unchained(F.col("chain"), F.lit("Gazi Üniversitesi"))
    return rows.select("p_partkey", bare["name"].alias("bare"), bare["is_evening"].alias("is_evening"), chain["name"].alias("last_part"), text_of(chain["hierarchy_context"]).alias("hierarchy"), text_of(decisions.acronyms(F.col("aliases"), "a2")).alias("acronyms"))
