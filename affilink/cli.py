"""Command line: version, build-data, index, match."""

from __future__ import annotations

import argparse
import sys

VERSION = "0.1.0"


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("affilink").getOrCreate()


def build_data(raw: str, out: str) -> None:
    from affilink.operators import canonical
    from affilink.sources import registry

    spark = _session()
    got = canonical.canonicalize(registry.read_parents(spark, f"{raw}/institution_parent.csv"), registry.read_subunits(spark, f"{raw}/institution_subunit.csv"))
    parents, subunits = canonical.parent_records(got.parents), canonical.subunit_records(got.subunits)
    registry.write_jsonl(parents, f"{out}/parent_canonical")
    registry.write_jsonl(subunits, f"{out}/subunit_canonical")
    text = registry.report_text(got.steps, parents.count(), subunits.count())
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/transform_report")
    print(text)


def index(data: str, out: str) -> None:
    from affilink.sources import index as tables

    spark = _session()
    alias = "array<struct<value string, locale string, source string>>"
    parents = spark.read.schema(f"id string, name string, normalized_name string, country string, city string, canonical_ref string, aliases {alias}, active_override boolean, record_type string").json(f"{data}/parent_canonical")
    subunits = spark.read.schema(f"id string, merged_ids array<string>, parent_id string, name string, normalized_name string, kind_label_raw string, unit_type string, program_type string, is_interdisciplinary boolean, is_evening boolean, is_ror_child boolean, aliases {alias}, record_type string").json(f"{data}/subunit_canonical")
    print(tables.write_index(parents, subunits, out))


def match(text: str, tables: str, size: int = 10) -> None:
    from affilink.operators import cascade
    from affilink.sources.index import read_corpus

    spark = _session()
    got = cascade.resolve(spark.createDataFrame([("q", text)], "query_id string, text string"), read_corpus(spark, tables), size)
    shown = lambda c: "-" if c is None else f"{c:.3f}"
    for title, rows in (("hypotheses", got.hypotheses.orderBy("hypothesis")), ("parents", got.parents.orderBy("position")), ("subunits", got.subunits.orderBy("position"))):
        print(title)
        for r in rows.collect():
            if title == "hypotheses":
                print(f"  {r.boundary_score:6.1f}  {r.institution_part} | {r.unit_part}  -> {r.parent_name} ({r.parent_id})")
            else:
                print(f"  {r.id:>8}  bm25 {r.bm25_norm:.3f}  cos {shown(r.cosine)}  set {r.token_set_ratio:5.1f}  {'conflict ' if r.qualifier_conflict else ''}{r['name']}")


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="affilink")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("version")
    for name, own in (("build-data", ("raw", "out")), ("index", ("data", "out")), ("match", ("text", "tables"))):
        sub = commands.add_parser(name)
        for x in own:
            sub.add_argument(x)
    commands.choices["match"].add_argument("--size", type=int, default=10)
    own = vars(parser.parse_args(args))
    command = own.pop("command")
    if command == "version":
        print(VERSION)
    else:
        {"build-data": build_data, "index": index, "match": match}[command](**own)
    return 0


if __name__ == "__main__":
    sys.exit(main())
