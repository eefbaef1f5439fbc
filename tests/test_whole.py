"""Reports over ids that the smallest tables don't have."""

from tests.test_oracle import SF
from tracery.plans import catalogue


def test_reports_cover_ids_beyond_the_first(spark, tmp_path):
    """k3 beyond 9,999 parts and k7 beyond 400 users; the smallest tables have neither."""
    spark.range(9_998, 10_003).selectExpr("id AS p_partkey", "'name' AS p_name").write.parquet(str(tmp_path / "part.parquet"))
    assert {r["entry_id"] for r in catalogue.queries()["k3_itemised"](spark, str(tmp_path)).collect()} == {"IRD-9998", "IRD-9999", "IRD-10000", "IRD-10001", "IRD-10002"}
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.union(e.withColumn("user_id", (e["user_id"] + 1000).cast(e.schema["user_id"].dataType)).withColumn("event_id", (e["event_id"] + 100_000).cast(e.schema["event_id"].dataType))).write.parquet(str(tmp_path / "events.parquet"))
    users = {r[0] for r in e.select("user_id").distinct().collect()}
    got = {r["case_id"]: r["group"] for r in catalogue.queries()["k7_consensus_rows"](spark, str(tmp_path)).collect()}
    assert set(got) == {f"C{k}" for k in range(400)} | {f"C{u + 1000}" for u in users}
    assert all(got[f"C{u + 1000}"] != "no match" for u in users)
