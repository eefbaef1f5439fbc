"""Late verdicts and breakers: the stream equals the table, in whatever files the events come."""

import datetime as dt
import random

import pytest

from tracery.operators.verdict import Breaker
from tracery.streaming import late

EVENT = "case_id string, provider string, status string, ts timestamp, event_id long"
START = dt.datetime(2024, 1, 1)


def events(n=120):
    rng = random.Random(3)
    return [(f"c{rng.randrange(12)}", f"r{rng.randrange(2)}", rng.choice(["covered", "inconsistent", "error", "error", "error"]), START + dt.timedelta(minutes=2 * i), i) for i in range(n)]


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, late.PROVIDER)
    yield
    spark.conf.set(key, old)


def streamed(spark, tmp_path, rows, make, files=4):
    """The rows of a stream over files that come one after the other, by time."""
    size = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * size : (i + 1) * size], EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = make(stream).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]


def test_patched_stream_equals_the_table(spark, store, tmp_path):
    rows = events()
    end = ("end", "end", "covered", START + dt.timedelta(days=9), 10**6)  # moves the watermark past all timers
    table = {tuple(r) for r in late.patched_table(spark.createDataFrame(rows, EVENT), 1200).collect()}
    got = streamed(spark, tmp_path, [*rows, end, ("end2", "end", "covered", START + dt.timedelta(days=9), 10**6 + 1)], lambda s: late.patched_stream(s, 1200), files=5)
    got = [r for r in got if not r[0].startswith("end")]
    assert len(got) == len(set(got)) and set(got) == table
    assert {r[3] for r in table} == {True, False} and {r[2] for r in table} >= {"covered", "error"}


def test_breaker_stream_equals_the_breaker(spark, store, tmp_path):
    rows = events()
    got = {r[0]: r[2] for r in streamed(spark, tmp_path, rows, lambda s: late.breaker_stream(s, 3, 1500), files=3)}
    expected = {}
    for provider in ("r0", "r1"):
        clock = [0.0]
        b = Breaker(3, 1500, lambda clock=clock: clock[0])
        for _, p, status, ts, i in rows:
            if p == provider:
                clock[0] = (ts - START).total_seconds()
                expected[i] = not b.open()
                if expected[i]:
                    b.record("other" if status == "error" else None)
    assert got == expected and set(expected.values()) == {True, False}
