"""A corpus pipeline of five stages, each on all that its predecessor kept.

toxicity -> n-gram Jaccard join -> benchmark decontamination -> secret scan -> best-fit packing.  All but the last return the columns of
documents.  An error of a stage is an error of the pipeline.

Odd input, the same for every stage: null and empty texts are clean (toxicity 0, no shingles, no windows, no secrets) and stay, as do rows with a null
doc_id; the last stage packs them as the end id alone.  Very long texts are judged whole.  Repeated rows are judged alike; the Jaccard join keeps one of
them.  An empty table gives an empty one with the same columns.  Further columns go through whatever their names are, those of an operator's own columns too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracery.llm import decontam, jaccard, packing, secrets, toxicity
from tracery.llm.common import saved, table


USED = ("doc_id", "text", "source", "n_chars")


def _named(docs: DataFrame) -> DataFrame:
    """`docs` with every column that no stage reads under a name that no operator gives."""
    return docs.toDF(*[c if c in USED else f"other_{i}" for i, c in enumerate(docs.columns)])


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below 0.3; the labels of the input teach the model, on the texts of this stage."""
    rows = _named(docs)
    scored = toxicity.toxicity(rows, table(spark, sf_dir, "labels"))
    return scored.where("toxic_score < 0.3").select(*rows.columns).toDF(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.75 or more) the document with the smallest doc_id.

    Repeated rows (doc_id and text) stay once; rows without a doc_id can't be told apart and all stay.
    """
    rows = _named(docs)
    groups = jaccard.near_duplicates(rows)
    ids = groups.where("doc_id is not null").groupBy("doc_id").agg((F.count("*") > 1).alias("repeated"), F.max(F.col("component_id") == F.col("doc_id")).alias("first"))
    other = saved(ids.where("repeated or not first"), "not-once")
    n, repeated = other.agg(F.count("*"), F.max(F.col("repeated") & F.col("first"))).first()
    small = lambda df: F.broadcast(df) if n <= jaccard.BROADCAST_ROWS else df
    # ids alone go to the rows, whose texts stay where they are
    kept = rows.where("doc_id is null").union(rows.where("doc_id is not null").join(small(other.select("doc_id")), "doc_id", "left_anti").select(*rows.columns))
    if repeated:
        again = rows.join(small(other.where("repeated and first").select("doc_id")), "doc_id", "left_semi").select(*rows.columns)
        kept = kept.union(again.dropDuplicates(["doc_id", "text"]))
    return kept.toDF(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any occurrence of a benchmark window."""
    rows = _named(docs)
    found = decontam.contamination(rows, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("spans") == 0).select(*rows.columns).toDF(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with each live-looking credential replaced by [SECRET]; widely copied examples stay."""
    rows = _named(docs)
    scanned = secrets.scan(rows, keep_text=True)
    live = F.exists("spans", lambda s: s["kind"] == secrets.NAMES.index("live"))
    clean = F.when(live, secrets.redact(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    out = scanned.withColumn("text", clean)
    if "n_chars" in rows.columns:
        out = out.withColumn("n_chars", F.when(live, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*rows.columns).toDF(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", non_toxic),
    ("jaccard_join", one_of_each_group),
    ("decontamination", decontaminated),
    ("secret_scan", without_secrets),
    ("best_fit_packing", packed),
]

#: SQL can't express a fitted classifier or a tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
