from pyspark.sql import functions as F

from affilink import cli
from affilink.sources import index


def test_from_files_to_matches(spark, tmp_path, capsys):
    raw, out, tables = tmp_path / "raw", tmp_path / "out", tmp_path / "tables"
    raw.mkdir()
    (raw / "institution_parent.csv").write_text("id,name,country,city,canonical_ref,active,aliases\n1,Gazi Üniversitesi,TR,,,true,\n2,Ankara Üniversitesi,TR,,,true,\n")
    (raw / "institution_subunit.csv").write_text("id,parent_id,name,kind_label,active,aliases\n1,1,İstatistik Bölümü,Bölüm,true,\n2,2,İstatistik Bölümü,Bölüm,true,\n")
    assert cli.main(["version"]) == 0
    cli.main(["build-data", str(raw), str(out)])
    assert '"index_total": 4' in capsys.readouterr().out
    cli.main(["index", str(out), str(tables)])
    assert "'documents': 4" in capsys.readouterr().out
    lexical_index, vectors = index.read_index(spark, str(tables))
    before = sorted((r.doc_key, r.vector) for r in vectors.collect())
    docs = lexical_index.docs
    alias = "array<struct<value string, locale string, source string>>"
    records = spark.read.schema(f"id string, name string, country string, city string, canonical_ref string, aliases {alias}, active_override boolean, record_type string").json(str(out / "parent_canonical"))
    none = docs.filter("1 = 0").drop("parent_name", "aliases_text", "doc_key").withColumn("aliases", F.array().cast(alias))
    assert docs.count() == 4 and index.write_index(records, none, str(tables), recreate=False) == {"documents": 2}
    after = sorted((r.doc_key, r.vector) for r in index.read_index(spark, str(tables))[1].collect())
    assert after == [b for b in before if b[0].startswith("parent:")]
