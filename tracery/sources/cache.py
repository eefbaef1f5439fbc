"""The cache of answers as a table in buckets by key (K8, J20).

New answers are appended as a generation; a key that is there again is overridden by its `ord`.  As the table is dealt into buckets by key, looking up shuffles the requests alone, however large the
cache has grown.  Compaction keeps the last answer of each key in a new table and puts it in the place of the old one.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("key", "payload", "ord", "generation")
BUCKETS = 64


def append(rows: DataFrame, table: str, buckets: int = BUCKETS) -> None:
    """Rows (key, payload, ord) as a generation of `table`.  Null keys and empty payloads are no answers and left out."""
    good = rows.where("key is not null and payload <> ''").select("key", "payload", F.col("ord").cast("double").alias("ord"), F.lit(time.time()).alias("generation"))
    # each task would write a file for each bucket; dealt by the buckets' key, a bucket has one a generation
    good.repartition(buckets, "key").write.bucketBy(buckets, "key").sortBy("key").mode("append").format("parquet").saveAsTable(table)


def last_answers(spark: SparkSession, table: str) -> DataFrame:
    """(key, payload): of each key the answer with the greatest `ord`, ties to the later generation, then to the greater payload."""
    return spark.table(table).groupBy("key").agg(F.max_by("payload", F.struct("ord", "generation", "payload")).alias("payload"))


def lookup(requests: DataFrame, table: str) -> DataFrame:
    """The requests (key, ...) that the cache answers, with `payload`."""
    return requests.join(last_answers(requests.sparkSession, table), "key")


def to_do(requests: DataFrame, table: str) -> DataFrame:
    return requests.join(requests.sparkSession.table(table).select("key"), "key", "left_anti")


def compact(spark: SparkSession, table: str, buckets: int = BUCKETS) -> None:
    """One answer for each key, in one generation.  The new table is whole before it takes the old one's name, and a run that was stopped between is picked up."""
    fresh, old = f"{table}_compacted", f"{table}_before"
    if not spark.catalog.tableExists(table) and spark.catalog.tableExists(fresh):
        spark.sql(f"ALTER TABLE {fresh} RENAME TO {table}")  # stopped between the two names
    spark.sql(f"DROP TABLE IF EXISTS {fresh}")
    last = spark.table(table).groupBy("key").agg(F.max(F.struct("ord", "generation", "payload")).alias("m")).select("key", "m.payload", "m.ord", "m.generation")
    last.repartition(buckets, "key").write.bucketBy(buckets, "key").sortBy("key").format("parquet").saveAsTable(fresh)
    spark.sql(f"DROP TABLE IF EXISTS {old}")
    spark.sql(f"ALTER TABLE {table} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {fresh} RENAME TO {table}")
    spark.sql(f"DROP TABLE {old}")
