import random

import pytest

from affilink.operators import lexical


@pytest.mark.parametrize("few", [1 << 18, 0])
def test_postings_of_asked_terms_give_the_same_search(spark, monkeypatch, few):
    monkeypatch.setattr(lexical, "FEW_ASKED", few)
    rng = random.Random(3)
    words = [f"söz{i}" for i in range(40)] + ["ve", "Kapı’nın"]
    rows = [(f"d:{i}", "d", str(i), " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for i in range(80)]
    # a repeated record, another of its key, and texts without a term
    rows += [rows[3], ("d:4", "d", "4", "söz1 söz2 söz2"), ("d:90", "d", "90", ""), ("d:91", "d", "91", None), ("d:92", "d", "92", "ve ve")]
    docs = spark.createDataFrame(rows, "doc_key string, record_type string, id string, name string")
    queries = spark.createDataFrame([("a", "söz1 söz2 söz1 kapı"), ("b", "söz7"), ("c", "ve"), ("e", "unknown")], "query_id string, text string")
    boosts = {"name": 1.0}
    index = lexical.index_for(queries, docs, ("name",), boosts)
    assert {(r.field, r.term) for r in index.postings.select("field", "term").distinct().collect()} == {("name", t) for t in ("söz1", "söz2", "söz7", "kapı")}
    told = lambda own: sorted((r.query_id, r["rank"], r.doc_key, round(r.score, 9)) for r in lexical.search(queries, own, "d", 10, False, None, boosts).collect())
    assert told(index) == told(lexical.build_index(docs, ("name",))) != []


def test_postings_of_asked_terms_are_not_shuffled(spark):
    docs = spark.createDataFrame([("d:1", "d", "1", "one two")], "doc_key string, record_type string, id string, name string")
    queries = spark.createDataFrame([("a", "two")], "query_id string, text string")
    index = lexical.index_for(queries, docs, ("name",), {"name": 1.0})
    found = lexical.search(queries, index, "d", 10, False, None, {"name": 1.0})
    plan = found._jdf.queryExecution().executedPlan().toString()
    keys = {line.split("hashpartitioning(")[1].split("), ")[0] for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "doc_key" in line}
    # by key once, before the analysis; never by query and key, or by key and term
    assert keys and all(k.split(", ")[0].startswith("doc_key") and len(k.split(", ")) == 2 for k in keys), keys
