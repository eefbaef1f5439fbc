"""python -m tracery {req_to_spec|spec_to_req} --entries PATH --requirements PATH --out PATH [--subscribers PATH] [--ruleset PATH]

Entries and requirements are tables in Parquet or JSON lines (a cached parse), or workbooks and documents with --office: then --entries has the publishers' workbooks, --subscribers the subscribers', and of several
rulesets in a folder the first counts whose rule the requirements fit."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import sheets
from .plans import runs
from .sources import office, rulesets


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tracery", description=__doc__)
    p.add_argument("kind", choices=["req_to_spec", "spec_to_req"])
    for name in ("entries", "requirements", "out"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--subscribers", help="the subscribers' workbooks")
    p.add_argument("--ruleset", help="a file of words, or a folder of such files")
    p.add_argument("--office", action="store_true", help="read workbooks and documents")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("tracery").getOrCreate()
    found = rulesets.load(spark, a.ruleset) if a.ruleset else {"default": rulesets.Ruleset("default")}
    alias = spark.createDataFrame([("id", "id"), ("identifier", "id"), ("text", "content"), ("content", "content")], "alias string, field string")
    rules = rulesets.chosen(found, office.read_cells(spark, a.requirements)) if a.office and len(found) > 1 else next(iter(found.values()))
    entries = None if a.office else office.facts(spark, a.entries)
    reqs = None if a.office else office.facts(spark, a.requirements)
    if entries is None:
        received = office.read_cells(spark, a.subscribers) if a.subscribers else None
        entries = sheets.interface_entries(office.read_cells(spark, a.entries), received, sheets.Layout(frames=tuple(rules.extra.get("frames", ()))))
        # parsed once: a run reads its entries many times
        entries.write.mode("overwrite").parquet(f"{a.out}/entries")
        entries = spark.read.parquet(f"{a.out}/entries")
    reqs = office.requirements(spark, a.requirements, alias) if reqs is None else reqs
    if a.kind == "req_to_spec":
        out = runs.req_to_spec(spark, entries, reqs, rules.words(), a.out)
    else:
        out = runs.spec_to_req(spark, entries, reqs, a.out, noise=rules.noise, words=rules.words())
    out.groupBy("status" if a.kind == "req_to_spec" else "coverage_status").count().show()


if __name__ == "__main__":
    main()
