import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from affilink.operators import cascade, decisions, decompose, documents, fusion, lexical, vectors

PARENTS = [("1", "Gazi Üniversitesi", ["Gazi University"]), ("2", "Ankara Üniversitesi", []), ("3", "Çanakkale Onsekiz Mart Üniversitesi", ["ÇOMÜ"]), ("4", "University of Münster", ["Universitaet Muenster, Westfälische Wilhelms-Universität Münster"]), ("10", "Ankara Gazi Koleji", [])]
SUBUNITS = [("1", "1", "İstatistik Bölümü"), ("2", "2", "İstatistik Bölümü"), ("3", "1", "Kimya Bölümü (Tezli)"), ("4", "3", "Tarih Bölümü")]


@pytest.fixture(scope="module")
def docs(spark):
    alias = "array<struct<value string, locale string, source string>>"
    p = spark.createDataFrame([(i, n, n.lower(), None, None, None, [(a, None, None) for a in al], False, "parent") for i, n, al in PARENTS], f"id string, name string, normalized_name string, country string, city string, canonical_ref string, aliases {alias}, active_override boolean, record_type string")
    s = spark.createDataFrame([(i, [i], q, n, [], "subunit") for i, q, n in SUBUNITS], f"id string, merged_ids array<string>, parent_id string, name string, aliases {alias}, record_type string")
    return documents.documents(p, s).cache()


def test_analyzers(spark):
    row = spark.createDataFrame([("Türkiye'nin IĞDIR ve Straße ÉCOLE 3D",)], "x string")
    a, b, c = row.select(lexical.turkish(F.col("x")), lexical.ascii_folded(F.col("x")), lexical.edges(F.lit("Gazi x"))).first()
    assert a == ["türkiye", "ığdır", "straße", "école", "3d"] and b == ["turkiye", "igdir", "ve", "strasse", "ecole", "3d"] and c == ["ga", "gaz", "gazi"]


def test_bm25_is_the_formula(spark):
    rng = random.Random(0)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "eps"], k=rng.randrange(1, 9))) for _ in range(40)]
    df = spark.createDataFrame([(f"d:{i}", "d", str(i), t) for i, t in enumerate(texts)], "doc_key string, record_type string, id string, name string")
    index = lexical.build_index(df, ("name",))
    got = lexical.search(spark.createDataFrame([("q", "beta gamma beta")], "query_id string, text string"), index, "d", 40, False, None, {"name": 2.0}).collect()
    bags = [Counter(t.split()) for t in texts]
    dfs = Counter(w for b in bags for w in b)
    average = sum(map(len, map(str.split, texts))) / len(texts)
    scores = {}
    for i, b in enumerate(bags):
        s = sum(2 * n * math.log(1 + (40 - dfs[w] + 0.5) / (dfs[w] + 0.5)) * b[w] / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / average)) for w, n in (("beta", 2), ("gamma", 1)) if b[w])
        if s:
            scores[f"d:{i}"] = s
    assert {r.doc_key: pytest.approx(r.score) for r in got} == scores
    assert [r.doc_key for r in sorted(got, key=lambda r: r["rank"])] == sorted(scores, key=lambda k: (-round(scores[k], 9), k[2:]))


def test_fuzzy_terms(spark):
    vocabulary = spark.createDataFrame([("name", t, 1) for t in ("gazi", "gzai", "gaziler", "ankara", "ankra", "anakra", "akra", "ab")], "field string, term string, df long")
    wanted = spark.createDataFrame([("name", "gazi"), ("name", "ankara"), ("name", "ac")], "field string, term string")
    rows = lexical.expansions(wanted, vocabulary).collect()
    by = {t: {r.match for r in rows if r.term == t} for t in ("gazi", "ankara", "ac")}
    assert by == {"gazi": {"gazi", "gzai"}, "ankara": {"ankara", "ankra", "anakra", "akra"}, "ac": {"ac"}}


def test_search_filters_without_changing_scores(spark, docs):
    index = lexical.build_index(docs)
    q = spark.createDataFrame([("a", "istatistik bölümü"), ("b", "gazi istatistik"), ("c", "")], "query_id string, text string")
    free = {(r.query_id, r.doc_key): r.score for r in lexical.search(q, index, "subunit", fuzzy=False).collect()}
    allowed = spark.createDataFrame([("a", "1"), ("b", "2")], "query_id string, parent_id string")
    under = {(r.query_id, r.doc_key): r.score for r in lexical.search(q, index, "subunit", fuzzy=False, allowed=allowed).collect()}
    assert {k for k in under} == {("a", "subunit:1"), ("a", "subunit:3"), ("b", "subunit:2")} and all(free[k] == pytest.approx(v) for k, v in under.items())
    best = lexical.search(q, index, "subunit", fuzzy=False).filter("query_id = 'b' and rank = 1").first()
    assert best.doc_key == "subunit:1"


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(60, 8)).astype("float32")
    table = spark.createDataFrame([(f"v:{i}", r.tolist(), str(i % 3)) for i, r in enumerate(rows)] + [("v:null", None, "0")], "doc_key string, vector array<float>, parent_id string")
    queries = table.filter("doc_key in ('v:3', 'v:7')").select(F.col("doc_key").alias("query_id"), "vector")
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    for allowed in (None, spark.createDataFrame([("v:3", "1"), ("v:7", "2")], "query_id string, parent_id string")):
        got = vectors.nearest(queries, table, 5, allowed).collect()
        for q, p in ((3, 1), (7, 2)):
            order = [f"v:{i}" for i in np.argsort(-(unit @ unit[q])) if allowed is None or i % 3 == p][:5]
            assert [r.doc_key for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == f"v:{q}"] == order


def test_vectors_of_odd_texts_and_the_cache(spark):
    rows = spark.createDataFrame([("a", "Gazi"), ("b", None), ("c", "")], "doc_key string, embed_text string")
    first = vectors.cached_vectors(rows, None).cache()
    again = vectors.cached_vectors(rows, first.filter("doc_key = 'a'"), lambda texts: np.full((len(texts), 2), 7.0))
    got = {r.doc_key: r.vector for r in again.collect()}
    assert len(got["a"]) == vectors.DIMENSIONS and got["c"] == [7.0, 7.0] and got["b"] is None
    cos = first.alias("x").crossJoin(first.alias("y")).select(vectors.cosine(F.col("x.vector"), F.col("y.vector")).alias("c")).collect()
    assert sum(r.c is None for r in cos) == 5
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>").select(vectors.unit(F.col("v")).alias("u")).collect()
    assert v[0].u == pytest.approx([0.6, 0.8]) and v[1].u == [0.0, 0.0]


def test_fusion(spark):
    make = lambda names: spark.createDataFrame([("q", k, f"x:{n}") for k, n in enumerate(names, 1)], "query_id string, rank int, doc_key string")
    rows = sorted(fusion.fuse([make(["9", "10", "c"]), make(["10", "9", "d"])]).collect(), key=lambda r: r["rank"])
    assert [r.doc_key for r in rows] == ["x:9", "x:10", "x:c", "x:d"]
    assert rows[0].rrf_score == pytest.approx(1 / 61 + 1 / 62) and [r.first_list for r in rows] == [0, 0, 0, 1]


def fake_search(spark):
    def search(texts, size):
        from affilink.functions.normalize import name_key

        words = spark.createDataFrame([(i, " ".join([n, *al])) for i, n, al in PARENTS], "id string, names string")
        words = words.select("id", F.explode(F.split(name_key(F.col("names")), " ")).alias("w")).distinct()
        asked = texts.select("query_id", F.explode(F.split(name_key(F.col("text")), " ")).alias("w")).distinct()
        return asked.join(words, "w").groupBy("query_id", "id").count().select("query_id", "id", F.lit(1).alias("rank"))

    return search


@pytest.mark.parametrize(
    "text, part, unit, parent",
    [
        ("gazi üni. istatistik böl.", "gazi ÜNİVERSİTESİ.", "istatistik BÖLÜMÜ.", "1"),
        ("istatistik bölümü gazi üniversitesi", "gazi üniversitesi", "istatistik bölümü", "1"),
        ("Department of Chemistry University of Münster", "University of Münster", "Department of Chemistry", "4"),
        ("çanakkale onsekiz mart üniversitesi tarih", "çanakkale onsekiz mart üniversitesi", "tarih", "3"),
        ("tarih ÇOMÜ", "ÇOMÜ", "tarih", "3"),
        ("Westfälische Wilhelms-Universität Münster kimya", "Westfälische Wilhelms-Universität Münster", "kimya", "4"),
    ],
)
def test_boundaries(spark, text, part, unit, parent):
    queries = spark.createDataFrame([("q", text), ("none", ""), ("unknown", "zzz yyy")], "query_id string, text string")
    parents = spark.createDataFrame(PARENTS, "id string, name string, aliases array<string>")
    found = decompose.hypotheses(queries, parents, fake_search(spark)).cache()
    rows = sorted(found.collect(), key=lambda r: r.hypothesis)
    assert (rows[0].institution_part, rows[0].unit_part, rows[0].parent_id) == (part, unit, parent) and {r.query_id for r in rows} == {"q"}
    assert [r.boundary_score for r in rows] == sorted((r.boundary_score for r in rows), reverse=True) and len({r.parent_id for r in rows}) == len(rows) <= 5
    first = {r.query_id: r for r in decompose.primary(queries, found).collect()}
    assert first["q"].institution_part == part and (first["none"].institution_part, first["unknown"].institution_part, first["unknown"].boundary_score) == ("", "zzz yyy", 0.0)


def test_budgets_count_new_records_only(spark):
    rows = [("q", 1, r, d) for r, d in enumerate("abcde", 1)] + [("q", 2, r, d) for r, d in enumerate("abfghij", 1)] + [("q", 3, r, d) for r, d in enumerate("jik", 1)]
    kept = cascade.budgeted(spark.createDataFrame(rows, "query_id string, hypothesis int, rank int, doc_key string"), 3).collect()
    assert sorted((r.hypothesis, r.doc_key) for r in kept) == [(1, "a"), (1, "b"), (1, "c"), (2, "f"), (2, "g"), (2, "h"), (3, "i"), (3, "j"), (3, "k")]


def test_gate_and_validators(spark):
    queries = spark.createDataFrame([(k, "Gazi Üniversitesi") for k in "abcd"] + [("e", "GAZI")], "query_id string, text string")
    rows = [("a", "1", 100.0, 1.0, False, 1), ("a", "2", 60.0, 0.5, False, 2), ("b", "1", 40.0, 1.0, False, 1), ("c", "1", 100.0, 1.0, False, 1), ("c", "2", 99.0, 0.9, False, 2), ("e", "1", 100.0, 1.0, False, 1)]
    parents = spark.createDataFrame(rows, "query_id string, id string, token_set_ratio double, bm25_norm double, qualifier_conflict boolean, position int")
    got = decisions.gate(queries, parents)
    assert {r.query_id: r.decision for r in got.collect()} == {"a": "auto_match", "b": "no_match", "c": "ambiguous", "d": "no_match", "e": "review"}
    docs = spark.createDataFrame([("1", "Gazi Üniversitesi", "9")], "id string, name string, parent_id string")
    checked = decisions.validated(got, queries, parents.filter("query_id <> 'a'"), docs, spark.createDataFrame([("a", "8")], "query_id string, parent_id string"))
    row = checked.filter("query_id = 'a'").first()
    assert row.decision == "review" and row.failed == ["not_listed", "other_parent"]


def test_evaluation(spark):
    candidates = spark.createDataFrame([("a", 1, ["5", "6"]), ("a", 2, ["7"]), ("b", 1, ["1"])], "query_id string, position int, merged_ids array<string>")
    expected = spark.createDataFrame([("a", "6"), ("b", "2"), ("c", "9")], "query_id string, expected_id string")
    assert {r.k: (r.queries, r.hits) for r in decisions.recall_at(candidates, expected, (1, 5)).collect()} == {1: (3, 1), 5: (3, 1)}
    row = decisions.bootstrap(spark.range(400).select(F.col("id").alias("query_id"), (F.col("id") % 4 == 0).cast("double").alias("value"))).first()
    assert row["mean"] == 0.25 and 0.18 < row.low < 0.25 < row.high < 0.32


def test_batches_and_names(spark):
    queries = spark.createDataFrame([(1, "Gazi Üni."), (2, "gazi üniversitesi"), (3, "=1+1"), (4, "x" * 600), (5, "done")], "query_id long, text string")
    todo, keys = decisions.to_run(queries, spark.createDataFrame([("done",)], "key string"))
    rows = todo.collect()
    assert len(rows) == 3 and max(len(r.text) for r in rows) == 512 and any(r.text == "'=1+1" for r in rows) and keys.count() == 5
    row = spark.createDataFrame([("Hukuk (İÖ)", "Gazi, Fen Fakültesi, Fizik", "Gazi")], "a string, b string, p string").select(decisions.without_qualifiers(F.col("a")).alias("q"), decisions.unchained(F.col("b"), F.col("p")).alias("c")).first()
    assert (row.q.name, row.q.is_evening, row.c.name, row.c.hierarchy_context) == ("Hukuk", True, "Fizik", ["Fen Fakültesi"])
    kind = "id string, name string, country string, aliases array<struct<value string, locale string, source string>>"
    parents = spark.createDataFrame([("9", "A Inst.", "TR", [("AI", None, "x")]), ("10", "B", "TR", [("A INSTITUTE", None, None), ("BB, CC", None, None)]), ("11", "B", "DE", []), ("12", "C", "TR", [("b", None, None)])], kind)
    assert {r.parent_id: r.canonical_id for r in decisions.equivalent_parents(parents).collect()} == {"9": "9", "10": "9", "11": "11", "12": "9"}
    assert {r.id: r.a for r in parents.select("id", decisions.acronyms(F.col("aliases"), "x").alias("a")).collect()}["10"] == ["BB", "CC"]
    got = decisions.profile(parents, label="country")
    assert {r["rows"]: r.names for r in got["shared_names"].collect()} == {1: 2, 2: 1} and {r.country: r["rows"] for r in got["labels"].collect()} == {"TR": 3, "DE": 1}


def test_part_queries_are_all_pairs_of_the_table(spark):
    from affilink.plans import queries

    sf = "/root/testdata/sf0.001"
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_brand", "p_name").distinct().collect()
    rows = queries._part_queries(spark, sf).collect()
    assert len({r.query_id for r in rows}) == len(rows)
    assert sorted(r.text for r in rows) == sorted(f"{p.p_brand.replace('#', ' ')} {p.p_name}" for p in part)


def test_equivalent_parents_follow_long_chains(spark):
    kind = "id string, name string, country string, aliases array<struct<value string, locale string, source string>>"
    chain = spark.createDataFrame([(str(i), f"name {i}", "TR", [(f"name {i + 1}", None, None)]) for i in range(1, 21)], kind)
    assert {r.canonical_id for r in decisions.equivalent_parents(chain).collect()} == {"1"}
