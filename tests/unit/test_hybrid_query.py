import builtins
import dis
import types

import numpy as np
import pytest

from affilink.operators import vectors
from affilink.plans import all_queries


def _globals_of(code: types.CodeType) -> set[str]:
    own = {i.argval for i in dis.get_instructions(code) if i.opname == "LOAD_GLOBAL"}
    return own.union(*(_globals_of(c) for c in code.co_consts if isinstance(c, types.CodeType)))


@pytest.mark.parametrize("name", sorted(all_queries.QUERIES))
def test_a_query_names_nothing_unknown(name):
    f = all_queries.QUERIES[name]
    assert not [g for g in _globals_of(f.__code__) if g not in f.__globals__ and not hasattr(builtins, g)]


def test_hybrid_search_takes_every_pair(spark, tmp_path):
    rows = [(1, "red bolt", "Brand#1", "SMALL"), (2, "blue ring", "Brand#1", "SMALL"), (3, "red bolt", "Brand#2", "LARGE"), (4, "old gear", "Brand#2", "SMALL"), (5, "red bolt", "Brand#1", "LARGE"), (6, "red bolt", "Brand#1", "SMALL")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    found = all_queries.QUERIES["hybrid_search"](spark, str(tmp_path)).collect()
    subunits = {"subunit:1": "red bolt - Brand#1", "subunit:2": "blue ring - Brand#1", "subunit:3": "red bolt - Brand#2", "subunit:4": "old gear - Brand#2", "subunit:5": "red bolt - Brand#1"}
    queries = {"1": "Brand 1 red bolt", "2": "Brand 1 blue ring", "3": "Brand 2 red bolt", "4": "Brand 2 old gear"}
    # fewer records than places: each query has all of them, in some order, each with its own cosine
    assert sorted((r.query_id, r["rank"]) for r in found) == sorted((q, k) for q in queries for k in range(1, len(subunits) + 1))
    assert {(r.query_id, r.doc_key) for r in found} == {(q, d) for q in queries for d in subunits}
    unit = lambda text: vectors.hashed_trigrams([text])[0].astype(np.float64)
    for r in found:
        assert r.cosine == pytest.approx(float(unit("query: " + queries[r.query_id]) @ unit("passage: " + subunits[r.doc_key])), abs=2e-5)
    # the record of the query's own name and brand leads
    own = {"1": {"subunit:1", "subunit:5"}, "2": {"subunit:2"}, "3": {"subunit:3"}, "4": {"subunit:4"}}
    assert all(r.doc_key in own[r.query_id] for r in found if r["rank"] == 1)
