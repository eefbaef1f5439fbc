"""The tables behind the reports, and stage output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def write_stage(df: DataFrame, folder: str, stage: str, form: str = "parquet") -> str:
    """A stage's result as a folder of its own under the run's folder; a new run replaces it as a whole."""
    path = f"{folder}/{stage}"
    df.write.mode("overwrite").format(form).save(path)
    return path


def itemised(entries: DataFrame) -> DataFrame:
    """(seq, entry_id, description) for a list of facts."""
    return entries.select("seq", "entry_id", "description")


def forward_detail(results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Results with counts, and their missing and matched ids one a row."""
    base = results.select("block_key", "coverage_status", F.size("matched").alias("n_matched"), F.size("missing").alias("n_missing"))
    return base, results.select("block_key", F.explode("missing").alias("req_id")), results.select("block_key", F.explode("matched").alias("req_id"))


def sections(results: DataFrame) -> DataFrame:
    """(section, blocks): each block in exactly one section."""
    s = F.when(F.col("coverage_status") == "covered", "covered").when(F.size("missing") > 0, "missing requirements").when(F.col("coverage_status") == "possible", "to be looked at").otherwise("uncovered")
    return results.groupBy(s.alias("section")).agg(F.count("*").alias("blocks"))


def distinct_missing(results: DataFrame) -> DataFrame:
    return results.select(F.explode("missing").alias("req_id")).agg(F.countDistinct("req_id").alias("missing"))


def status_shares(verdicts: DataFrame, provider: str) -> DataFrame:
    """(status, n, share) of one rater's verdicts, every status that occurs."""
    own = verdicts.where(F.col("provider") == provider)
    total = own.agg(F.count("*").alias("total"))
    return own.groupBy("status").agg(F.count("*").alias("n")).crossJoin(total).select("status", "n", F.bround(F.col("n") / F.col("total"), 4).alias("share"))


def consensus_rows(consensus: DataFrame, matches: DataFrame, shown: int = 5) -> DataFrame:
    """(case_id, group, stars, blocks): consensus with its match by case id, the first block keys and how many more there are; matches without a case as `no match`."""
    keys = F.concat_ws(", ", F.slice("block_keys", 1, shown), F.when(F.size("block_keys") > shown, F.concat(F.lit("+"), F.size("block_keys") - shown)))
    j = consensus.join(matches, "case_id").select("case_id", F.col("status").alias("group"), T.stars(F.col("stars")).alias("stars"), keys.alias("blocks"))
    rest = matches.join(consensus, "case_id", "left_anti").select("case_id", F.lit("no match").alias("group"), F.lit("").alias("stars"), F.lit("").alias("blocks"))
    return j.union(rest)


def by_category(results: DataFrame) -> DataFrame:
    """(category, status, n) with subtotals: status null for a category, both null for all."""
    return results.rollup("category", "status").agg(F.count("*").alias("n"))


def match_counts(matches: DataFrame) -> DataFrame:
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return matches.agg(of("matched"), of("uncertain"), of("unmatched"), F.count("*").alias("total"))


def unmatched_blocks(blocks: DataFrame, matches: DataFrame) -> DataFrame:
    return blocks.select("block_key").join(matches.select("block_key").distinct(), "block_key", "left_anti")
