import json

import pytest

from affilink.operators import canonical, documents
from affilink.sources import registry


def parents(spark, *rows):
    """(id, name, active[, alias values])"""
    return spark.createDataFrame([(i, n, None, None, None, a, [(v, None, None) for v in (x[0] if x else [])]) for i, n, a, *x in rows], registry.PARENT)


def subunits(spark, *rows):
    """(id, parent_id, name, kind_label, active[, aliases])"""
    return spark.createDataFrame([(i, p, n, k, a, x[0] if x else []) for i, p, n, k, a, *x in rows], registry.SUBUNIT)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_only_active_rows_stay(spark):
    assert ids(canonical.active_only(subunits(spark, ("1", "9", "a", None, True), ("2", "9", "b", None, False), ("3", "9", "c", None, None)))) == ["1"]


def rule(spark, ps, used):
    return canonical.orphan_rule(parents(spark, *ps), subunits(spark, *((str(k), u, "x", None, True) for k, u in enumerate(used))))


def test_an_inactive_parent_without_active_subunits_goes(spark):
    got = rule(spark, [("99", "Gone", False), ("1", "Here", True)], [])
    assert ids(got.parents) == ["1"] and ids(got.dropped) == ["99"] and got.redirects.count() == 0


def test_subunits_go_to_the_parent_whose_name_holds_the_old_one(spark):
    got = rule(spark, [("305", "Bilkent Üni.", False), ("150", "İhsan Doğramacı Bilkent Üniversitesi", True, ["Bilkent"]), ("1050", "Bilkent Üniversitesi Vakfı", True)], ["305"])
    assert [tuple(r) for r in got.redirects.collect()] == [("305", "150")]
    (target,) = [r for r in got.parents.collect() if r.id == "150"]
    assert [(a.value, a.source) for a in target.aliases] == [("Bilkent", None), ("Bilkent Üni.", "orphan_redirect")]


def test_the_same_name_goes_before_a_longer_one_and_aliases_come_once(spark):
    got = rule(spark, [("7", "Gazi Üni", False), ("8", "GAZİ ÜNİVERSİTESİ", False), ("20", "Gazi Üniversitesi", True, ["gazi üniversitesi"]), ("3", "Büyük Gazi Üniversitesi", True)], ["7", "8"])
    assert sorted(map(tuple, got.redirects.collect())) == [("7", "20"), ("8", "20")]
    assert [len(r.aliases) for r in got.parents.collect() if r.id == "20"] == [1]


def test_parents_without_a_match_stay_and_words_are_whole(spark):
    got = rule(spark, [("239", "GEM", False), ("118", "Other", False), ("5", "EGEM Enstitüsü", True)], ["239", "118"])
    assert ids(got.parents) == ["118", "239", "5"] and ids(got.parents.filter("active_override")) == ["118", "239"]
    assert got.redirects.count() == 0


def test_redirect(spark):
    moved = canonical.redirect(subunits(spark, ("1", "305", "a", None, True), ("2", "42", "b", None, True)), spark.createDataFrame([("305", "150")], "id string, target string"))
    assert sorted((r.id, r.parent_id) for r in moved.collect()) == [("1", "150"), ("2", "42")]


def test_clones_become_one(spark):
    rows = [(i, "10", "İstatistik Böl.", "Bölüm", True) for i in ("300", "100", "200", "1000")]
    (row,) = canonical.merge_clones(subunits(spark, *rows)).collect()
    assert row.id == "100" and row.merged_ids == ["100", "200", "300", "1000"]


def test_kind_and_alias_values_set_rows_apart(spark):
    rows = [("1", "10", "x", "Bölüm", True), ("2", "10", "x", "Lisans", True), ("3", "10", "x", None, True), ("4", "10", "x", None, True, [("y", None, None)])]
    assert sorted(r.merged_ids for r in canonical.merge_clones(subunits(spark, *rows)).collect()) == [["1"], ["2"], ["3"], ["4"]]


def test_alias_sources_do_not(spark):
    rows = [("2", "10", "x", None, True, [("y", "tr", "a"), ("Y", "tr", "a")]), ("1", "10", "x", None, True, [("y", "tr", "b")]), ("3", "10", "x", None, True, [("y", "tr", "b")])]
    (row,) = canonical.merge_clones(subunits(spark, *rows)).collect()
    assert row.merged_ids == ["1", "2", "3"] and [tuple(a) for a in row.aliases] == [("y", "tr", "b"), ("y", "tr", "a"), ("Y", "tr", "a")]


@pytest.mark.parametrize(
    "label, expected",
    [
        ("Bölüm", ("bolum", None, False, False)),
        ("Disiplinlerarası Doktora Programı", (None, "doktora", True, False)),
        ("ror_child", ("ror_child", None, False, True)),
        ("new one", (None, None, False, False)),
        (None, (None, None, False, False)),
    ],
)
def test_kinds(spark, label, expected):
    rows = subunits(spark, ("1", "2", "x", label, True))
    assert len(canonical.KIND_LABELS) == 24
    row = canonical.parse_kinds(rows).first()
    assert (row.unit_type, row.program_type, row.is_interdisciplinary, row.is_ror_child, row.kind_label_raw) == (*expected, label)
    unknown = canonical.unknown_kinds(rows).collect()
    assert [r.rows for r in unknown] == ([1] if label in ("new one", None) else [])


def test_the_whole_run(spark, tmp_path):
    ps = parents(spark, ("150", "İhsan Doğramacı Bilkent Üniversitesi", True), ("305", "Bilkent Üniversitesi", False), ("49", "Gazi Üniversitesi", True), ("99", "Old", False))
    ss = subunits(spark, ("1", "305", "Fizik", "Bölüm", True), ("2", "150", "fizik", "Bölüm", True), ("3", "49", "Kimya", "yeni", True), ("4", "49", "Kimya", "Bölüm", False))
    got = canonical.canonicalize(ps, ss)
    assert ids(got.parents) == ["150", "49"] and sorted(r.merged_ids for r in got.subunits.collect()) == [["1", "2"], ["3"]]
    report = json.loads(registry.report_text(got.steps, 2, 2))
    assert [(s["before"], s["after"], s["dropped"]) for s in report["steps"]] == [(4, 3, 1), (4, 2, 1), (3, 2, 1), (2, 2, 0)]
    assert report["steps"][1]["notes"] == {"redirect": [["305", "150"]], "override": [], "dropped_sample": ["99"]}
    assert report["steps"][2]["notes"] == {"merged_groups": 1, "absorbed_rows": 1}
    assert report["steps"][3]["notes"] == {"unknown_kind_labels": {"yeni": 1}} and report["totals"]["index_total"] == 4
    docs = documents.documents(canonical.parent_records(got.parents), canonical.subunit_records(got.subunits))
    rows = {r.doc_key: r for r in documents.embed_text(docs).collect()}
    assert rows["subunit:1"].parent_name.startswith("İhsan") and rows["parent:150"].aliases_text == "Bilkent Üniversitesi"
    assert rows["subunit:3"].embed_text == "passage: Kimya - Gazi Üniversitesi"
    registry.write_jsonl(docs.select("id", "country"), str(tmp_path / "d"))
    lines = "".join(f.read_text() for f in sorted((tmp_path / "d").glob("part*"))).splitlines()
    assert [json.loads(x)["id"] for x in lines] == ["1", "3", "49", "150"] and '"country":null' in lines[0]
    assert registry.read_jsonl(spark, str(tmp_path / "d"), "id string").count() == 4


CELL = '{"#type": "a\\\\B", "items": [{"iz": 1, "name": "Gazi Univ", "locale": "en", "source": "x"}, {"name": "", "locale": "tr"}], "anyName": null}'


def test_csv_readers(spark, tmp_path):
    quoted = CELL.replace('"', '""')
    (tmp_path / "p.csv").write_text(f'#,id,name,country,city,canonical_ref,active,aliases,extra\n1,10,"Gazi\nÜniversitesi",Türkiye,,,true,"{quoted}",z\n2,11,X,,,,false,,z\n')
    a, b = sorted(registry.read_parents(spark, str(tmp_path / "p.csv")).collect(), key=lambda r: r.id)
    assert (a.name, a.country, a.city, a.active) == ("Gazi\nÜniversitesi", "Türkiye", None, True) and [tuple(x) for x in a.aliases] == [("Gazi Univ", "en", "x")]
    assert (b.active, b.aliases) == (False, []) and "extra" not in a.asDict()
    (tmp_path / "s.csv").write_text("id,parent_id,name,kind_label,active,aliases\n5,10,Fizik,Bölüm,TRUE,\n")
    assert registry.read_subunits(spark, str(tmp_path / "s.csv")).first().active is True
    (tmp_path / "bad.csv").write_text("id,name\n1,2\n")
    with pytest.raises(ValueError):
        registry.read_parents(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "broken.csv").write_text('id,name,country,city,canonical_ref,active,aliases\n1,x,,,,true,{oops\n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        registry.read_parents(spark, str(tmp_path / "broken.csv")).collect()


def test_mixed_ids_have_an_order(spark):
    rows = spark.createDataFrame([(x,) for x in ("b", "10", "9", "a", "09")], "id string")
    assert [r.id for r in rows.orderBy(registry.id_key(rows["id"])).collect()] == ["09", "9", "10", "a", "b"]
