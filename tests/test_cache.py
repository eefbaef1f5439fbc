"""The bucketed cache against a dictionary, and its plan."""

import random

import pytest

from tracery.sources import cache

ROWS = "key string, payload string, ord double"


@pytest.fixture
def table(spark):
    name = f"answers_{random.randrange(10**9)}"
    yield name
    for t in (name, f"{name}_compacted", f"{name}_before"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_generations_and_compaction(spark, table):
    rng, last = random.Random(1), {}
    for g in range(4):
        rows = [(f"k{rng.randrange(40)}", f"p{g}-{i}", float(100 * g + i)) for i in range(30)]
        cache.append(spark.createDataFrame([*rows, (None, "x", 1.0), ("empty", "", 1.0)], ROWS), table, buckets=4)
        last |= {k: p for k, p, _ in rows}
    asked = spark.createDataFrame([(f"k{i}", i) for i in range(50)] + [("k1", 99), (None, 5)], "key string, id int")

    def look():
        hits = sorted((r["key"], r["id"], r["payload"]) for r in cache.lookup(asked, table).collect())
        assert hits == sorted((f"k{i % 98 if i < 99 else 1}", i, last[f"k{i % 98 if i < 99 else 1}"]) for i in [*range(50), 99] if f"k{i % 98 if i < 99 else 1}" in last)
        todo = {(r["key"], r["id"]) for r in cache.to_do(asked, table).collect()}
        assert todo == {(f"k{i}", i) for i in range(50) if f"k{i}" not in last} | {(None, 5)}

    look()
    cache.compact(spark, table, buckets=4)
    assert spark.table(table).count() == len(last)
    look()


def test_a_stopped_compaction_is_picked_up(spark, table):
    cache.append(spark.createDataFrame([("a", "1", 1.0), ("a", "2", 2.0)], ROWS), table, buckets=2)
    cache.compact(spark, table, buckets=2)
    spark.sql(f"ALTER TABLE {table} RENAME TO {table}_compacted")  # as if it had stopped there
    cache.compact(spark, table, buckets=2)
    assert [(r["key"], r["payload"]) for r in spark.table(table).collect()] == [("a", "2")]


def test_looking_up_shuffles_the_requests_alone(spark, table):
    cache.append(spark.range(200).selectExpr("concat('k', id) key", "'p' payload", "1.0 ord"), table, buckets=4)
    asked = spark.range(50).selectExpr("concat('k', id) key", "id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (cache.lookup(asked, table), cache.to_do(asked, table)):
            assert df.count() in (0, 50)
            plan = df._jdf.queryExecution().sparkPlan().toString() and df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
