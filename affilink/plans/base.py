"""The table of queries, and SQL and fixtures that several of them share.

The SQL states its tables (letters, abbreviations, patterns) on its own, so that a wrong value in the library shows. Fixtures
are SELECTs over the driver's tables that both engines run: a registry of parents (suppliers) and subunits (parts) with names
that are alike, stand in one another, carry abbreviations, aliases and labels, and are active or not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_SPACES = "[\\u00A0\\u200B\\u200C\\u200D\\u2060\\uFEFF\\u2000-\\u200A\\u3000]".encode().decode("unicode_escape")


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- normal forms in SQL: fixed values, stated apart from the library's --------------------------------------------------


def _clean(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '{_SPACES}', ' ', 'g'), '\\s+', ' ', 'g'))"


def _lower(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '[çÇğĞıİöÖşŞüÜâÂîÎûÛ]') THEN lower(translate({x}, 'İIŞĞÜÖÇ', 'iışğüöç')) ELSE lower({x}) END"


def _bare(x: str) -> str:
    return f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')"


def _plain(x: str) -> str:
    return f"translate({x}, 'çğıöşüâîû', 'cgiosuaiu')"


_HEAD, _TAIL = r"(^|[^\p{L}\p{N}_])", r"(?:\.([\p{L}\p{N}_])|([^\p{L}\p{N}_]|$))"
#: Abbreviations in order; those of the second list end at a word's end, with a dot or without.
_DOTTED = [(r"SOS\.?\s*B[İIiı]L\.", "SOSYAL BİLİMLERİ"), (r"FEN\s+B[İIiı]L\.", "FEN BİLİMLERİ"), (r"SA[ĞGğg]L[Iıiİ]K\s+B[İIiı]L\.", "SAĞLIK BİLİMLERİ")]
_MIDDLE = [(r"A\.?B\.?D\.", "ANABİLİM DALI"), (r"ABD\.", "ANABİLİM DALI")]
_PROGRAMMES = [(r"PR\.", "PROGRAMI"), (r"PRG\.", "PROGRAMI")]
_RULES = [
    *((p, "", r) for p, r in _DOTTED),
    (r"M\.?Y\.?O", _TAIL, "MESLEK YÜKSEKOKULU"),
    *((p, "", r) for p, r in _MIDDLE),
    (r"Y\.?O", _TAIL, "YÜKSEKOKULU"),
    (r"Y[ÜUüu]K\.?\s*OKL", _TAIL, "YÜKSEKOKULU"),
    *((p, "", r) for p, r in _PROGRAMMES),
    (r"[ÜUüu]N[İIiı]V?", _TAIL, "ÜNİVERSİTESİ"),
    (r"[ÜUüu]NV", _TAIL, "ÜNİVERSİTESİ"),
    ("FAK", _TAIL, "FAKÜLTESİ"),
    ("ENST?", _TAIL, "ENSTİTÜSÜ"),
    (r"B[ÖOöo]L", _TAIL, "BÖLÜMÜ"),
    (r"M[ÜUüu]H", _TAIL, "MÜHENDİSLİĞİ"),
    ("MRKS?", _TAIL, "MERKEZİ"),
    (r"AR[ŞSşs]T?", _TAIL, "ARAŞTIRMA"),
    ("UYG", _TAIL, "UYGULAMA"),
    (r"E[ĞGğg]T", _TAIL, "EĞİTİMİ"),
    (r"Y[ÖOöo]N", _TAIL, "YÖNETİMİ"),
    ("HAST", _TAIL, "HASTANESİ"),
    ("FAC", _TAIL, "FACULTY"),
    ("DEPT", _TAIL, "DEPARTMENT"),
    ("INST", _TAIL, "INSTITUTE"),
    ("ENG", _TAIL, "ENGINEERING"),
]


def _expanded(x: str) -> str:
    for pattern, tail, word in _RULES:
        x = f"regexp_replace({x}, '{_HEAD}{pattern}{tail}', '\\1{word}{'\\2\\3' if tail else ''}', 'gi')"
    return x


#: Characters of the fixtures that compatibility composition changes.
COMPOSED = {"ﬁ": "fi", "²": "2", "Ａ": "A", "Ｂ": "B", "ｅ": "e", "™": "TM", "①": "1", "ü": "ü", "…": "..."}


def _nfkc(x: str) -> str:
    for a, b in COMPOSED.items():
        x = f"replace({x}, '{a}', '{b}')"
    return x


def staged(name: str, source: str, keep: str, column: str, nfkc: bool = True) -> str:
    """CTEs that end in {name}: keep, text (written out), base and key of source's column."""
    start = _nfkc(column) if nfkc else column
    return (
        f"{name}_1 AS (SELECT {keep}, {_clean(start)} AS t FROM {source}), {name}_2 AS (SELECT * EXCLUDE (t), {_clean(_expanded('t'))} AS text FROM {name}_1), "
        f"{name}_3 AS (SELECT *, {_lower('text')} AS l FROM {name}_2), {name} AS (SELECT * EXCLUDE (l), {_clean(_bare('l'))} AS base, {_plain(_clean(_bare('l')))} AS key FROM {name}_3)"
    )


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two texts, a of at most 120 characters, by bits."""
    full = f"(CAST(pow(2, len({a})) AS HUGEINT) - 1)"
    masks = f"list_transform(string_split({b}, ''), lambda c: coalesce(list_sum(list_transform(range(1, len({a}) + 1), lambda i: CASE WHEN {a}[i] = c THEN CAST(pow(2, i - 1) AS HUGEINT) ELSE CAST(0 AS HUGEINT) END)), CAST(0 AS HUGEINT)))"
    last = f"list_reduce(list_prepend({full}, CAST({masks} AS HUGEINT[])), lambda r, m: CAST(((r + (r & m)) | (r - (r & m))) & {full} AS HUGEINT))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE len({a}) - bit_count({last}) END"


def indel(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 100.0 ELSE 200.0 * ({lcs(a, b)}) / (len({a}) + len({b})) END"


# --- fixtures that both engines run ------------------------------------------------------------------------------------

PARENTS = """
SELECT CAST(s_suppkey AS STRING) AS id,
  CASE s_suppkey % 4 WHEN 0 THEN 'Üniversite ' || (s_suppkey % 12) WHEN 1 THEN 'Doğu Üniversite ' || ((s_suppkey * 5) % 24) || ' Kampüsü' WHEN 2 THEN 'ÜNİVERSİTE  ' || (s_suppkey % 12) ELSE 'Kuzey Enstitüsü ' || (s_suppkey % 48) END AS name,
  CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'DE' ELSE 'TR' END AS country,
  s_suppkey % 3 <> 0 AS active,
  CASE WHEN s_suppkey % 6 = 0 THEN 'Kısa ' || (s_suppkey % 30) END AS a1,
  CASE WHEN s_suppkey % 6 IN (0, 3, 4) THEN 'Univ' || (s_suppkey % 10) || ', Ankara Kampüsü' END AS a2
FROM supplier
"""
SUBUNITS = """
SELECT CAST(p_partkey AS STRING) AS id,
  CAST(CASE WHEN k % 9 = 3 THEN k - 1 ELSE k END AS STRING) AS parent_id,
  CASE p_partkey % 5 WHEN 0 THEN 'Bilgisayar Müh.' WHEN 1 THEN 'BİLGİSAYAR  MÜHENDİSLİĞİ' WHEN 2 THEN 'Fizik (İngilizce) (Tezli)' WHEN 3 THEN 'Fizik Böl. ' || (p_partkey % 2) ELSE 'Ｅ-öğretim…' || (p_partkey % 3) END AS name,
  CASE (p_partkey * 3) % 7 WHEN 0 THEN 'Bölüm' WHEN 1 THEN 'Lisans' WHEN 2 THEN 'Disiplinlerarası Doktora Programı' WHEN 3 THEN 'ror_child' WHEN 4 THEN 'bilinmeyen' WHEN 5 THEN 'başka' END AS kind_label,
  p_partkey % 7 <> 0 AS active,
  CASE p_partkey % 4 WHEN 0 THEN 'Comp Eng' WHEN 1 THEN 'COMP  ENG' END AS a1,
  CASE WHEN p_partkey % 8 < 2 THEN 'CS ' || (p_partkey % 2) END AS a2
FROM (SELECT p_partkey, 1 + (p_partkey * 7) % (SELECT count(*) FROM supplier) AS k FROM part) AS p
""".replace("Ｅ", "ｅ")
#: Phrases of queries, one for each abbreviation and then some; {} takes a part's name.
PHRASES = [
    "Gazi Üni. {} Fen Bil. Enst", "sos. bil. enst. {}", "Sağlık Bil. {} Böl.", "ankara ünv. tıp fak {}", "{} M.Y.O", "myo {} sivas", "{} A.B.D. Başk.", "Kimya ABD. {}",
    "Y.O. {}", "{} yo.", "Yük. Okl. {}", "pr. {} yazılım", "{} prg. ağ", "istanbul üniv {} müh.", "{} mrk. araş. uyg", "mrks {} ars.", "eğt. {} egt", "yön. {} hast.",
    "{} fac. dept", "INST. of {} eng.", "ÜNİ {}", "ＡＢ² {} oﬁs", "{} üniversite™", "①. {} bölüm…", "dış {} İŞLERİ", "IŞIK {} University of I", "{}", "  {}  x ", "şu {} O'nun ev’i", "{} (İö) Tezsiz YL",
]


def _phrased(n: str, name: str) -> str:
    parts = [tuple(p.split("{}")) for p in PHRASES]
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return f"CASE CAST({n} % {len(parts)} AS INT) " + " ".join(f"WHEN {k} THEN concat({quoted(a)}, {name}, {quoted(b)})" for k, (a, b) in enumerate(parts)) + " END"


QUERIES_OF_PARTS = f"SELECT p_partkey, {_phrased('p_partkey', 'p_name')} AS text FROM part"


def fixture(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    """A SELECT over the driver's tables."""
    names = {w for w in ("supplier", "part", "nation", "documents", "benchmark", "orders", "customer") if w in sql}
    for n in names:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}")
    # Spark takes O'' as two strings side by side, where SQL has one quotation mark
    return spark.sql(sql.replace("O''nun", "O\\'nun"), **{n: _t(spark, sf, n) for n in names})


def aliased(rows: DataFrame) -> DataFrame:
    """a1 and a2 as aliases."""
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(F.struct(F.col(c).alias("value"), F.lit("tr").alias("locale"), F.lit(c).alias("source")))).otherwise(F.array().cast("array<struct<value string, locale string, source string>>"))
    return rows.withColumn("aliases", F.concat(one("a1"), one("a2"))).drop("a1", "a2")


def registry(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    none = F.lit(None).cast("string")
    parents = aliased(fixture(spark, sf, PARENTS)).withColumns({"city": none, "canonical_ref": none})
    return parents.select("id", "name", "country", "city", "canonical_ref", "active", "aliases"), aliased(fixture(spark, sf, SUBUNITS)).select("id", "parent_id", "name", "kind_label", "active", "aliases")


#: The registry's cleaning in SQL, to be continued: parents p, subunits s, active ones act, hits of the orphan rule, moved and merged subunits.
CLEANED = f"""
WITH p0 AS ({PARENTS}), s0 AS ({SUBUNITS}),
{staged('pk', 'p0', 'id, name AS raw_name, country, active, a1, a2', 'name')},
p AS (SELECT *, CAST(id AS BIGINT) AS n FROM pk),
act AS (SELECT * FROM s0 WHERE active),
used AS (SELECT DISTINCT parent_id AS id FROM act),
inactive AS (SELECT * FROM p WHERE NOT active), needed AS (SELECT * FROM inactive WHERE id IN (SELECT id FROM used)),
same AS (SELECT i.n, i.id, min(a.n) AS target FROM needed i JOIN p a ON a.active AND a.key = i.key GROUP BY ALL),
inside AS (SELECT i.n, i.id, min(a.n) AS target FROM needed i JOIN p a ON a.active AND i.key <> '' AND contains(' ' || a.key || ' ', ' ' || i.key || ' ') WHERE i.id NOT IN (SELECT id FROM same) GROUP BY ALL),
hit AS (SELECT n, id, CAST(target AS VARCHAR) AS target FROM same UNION ALL SELECT n, id, CAST(target AS VARCHAR) FROM inside),
kept AS (SELECT *, NOT active AS over FROM p WHERE active OR (id IN (SELECT id FROM used) AND id NOT IN (SELECT id FROM hit))),
gone AS (SELECT id, n FROM inactive WHERE id NOT IN (SELECT id FROM used)),
moved AS (SELECT act.* EXCLUDE (parent_id), coalesce(hit.target, act.parent_id) AS parent_id FROM act LEFT JOIN hit ON hit.id = act.parent_id),
{staged('mk', 'moved', 'id, parent_id, name AS raw_name, kind_label, a1, a2', 'name')},
{staged('m1', 'mk', 'id, parent_id, raw_name, kind_label, a1, a2, key AS name_key', 'a1')},
{staged('m2', 'm1', 'id, parent_id, raw_name, kind_label, a1, a2, name_key, key AS key1', 'a2')},
groups AS (SELECT parent_id, name_key, kind_label, list_sort(list_distinct(list_filter([key1, key], lambda x: x IS NOT NULL))) AS names, list(id ORDER BY CAST(id AS BIGINT)) AS ids, min_by(raw_name, CAST(id AS BIGINT)) AS name,
  list_filter(flatten(list([a1, a2] ORDER BY CAST(id AS BIGINT))), lambda x: x IS NOT NULL) AS alias_list FROM m2 GROUP BY ALL)
"""
# groups are by the first four columns
CLEANED = CLEANED.replace("FROM m2 GROUP BY ALL)", "FROM m2 GROUP BY parent_id, name_key, kind_label, names)")


def text_of(c: Column, separator: str = "|") -> Column:
    return F.array_join(c, separator)
