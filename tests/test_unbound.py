"""Candidates without label and bus against the scores of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tracery.operators import match, unbound

BLOCK = "block_key string, block_ord int, b_tokens array<string>, b_family string, b_direction string, b_fields array<struct<offset: int, size: int>>, b_sdi array<string>, b_format string, b_devices array<string>, b_channels array<string>"
REQ = "req_id string, r_tokens array<string>, r_keywords array<string>, r_components array<string>, r_direction string, r_fields array<struct<offset: int, size: int>>, r_sdi array<string>, r_category string, r_devices array<string>, r_channels array<string>"
NAMES = ["pump", "fan1", "fan2", "valve", "temp", "flow", "edp_034", "hydraulic", "ab"]


def some(r, items, most):
    return r.sample(items, r.randrange(most + 1))


def tables(seed, n_blocks, n_reqs):
    r = random.Random(seed)
    field = lambda: (r.randrange(4), r.randrange(1, 3))
    blocks = []
    for i in range(n_blocks):
        own = some(r, NAMES, 3)
        blocks.append((f"B{i}", r.randrange(n_blocks), own, "_".join(own + some(r, ["cmd", "raw"], 1)), r.choice(["send", "receive", "bidirectional", ""]), [field() for _ in range(r.randrange(3))], some(r, ["0", "1", "2"], 2), r.choice(["DIS", "BNR", "BNR2", "FLOAT", "CHAR", ""]), some(r, ["D1", "D2", "D3"], 3), some(r, ["A1", "B2"], 2)))
    reqs = [(f"R{i}", some(r, NAMES, 3), some(r, [*NAMES, "fan1_cmd", "the_pump_raw", "lic"], 2), some(r, ["FAN1", "PUMP"], 1), r.choice(["send", "receive", ""]), [field() for _ in range(r.randrange(3))], some(r, ["0", "1", "2"], 1), r.choice(["analog", "discrete"]), some(r, ["D1", "D2", "D3", "D9"], 3), some(r, ["A1", "C3"], 1)) for i in range(n_reqs)]
    return blocks, reqs


def best(pairs, k):
    none = F.array().cast("array<string>")
    channel = F.coalesce(F.get(F.array_intersect("r_channels", "b_channels"), F.lit(0)), F.lit(""))
    scored = match.score(pairs.withColumns({"r_buses": none, "b_buses": none, "r_channel": channel, "b_channel": channel}))
    return {(r["req_id"], r["rn"], r["block_key"], r["total"]) for r in match.top_k(match.gated(scored), k).collect()}


@pytest.mark.parametrize(("seed", "k", "rare"), [(1, 1, 0), (2, 3, 5), (3, 20, 64)])
def test_the_best_of_all_pairs(spark, seed, k, rare):
    b, r = tables(seed, 120, 50)
    blocks, reqs = spark.createDataFrame(b, BLOCK), spark.createDataFrame(r, REQ)
    found = unbound.candidates(reqs, blocks, k=k, rare=rare)
    assert found.count() == found.distinct().count()
    ours = best(found.join(reqs, "req_id").join(blocks, "block_key"), k)
    theirs = best(reqs.crossJoin(blocks), k)
    assert ours == theirs and theirs


def test_look_ups_follow_k_and_not_the_blocks(spark):
    """Ten times the blocks of one kind: each requirement is still paired with as many."""
    _, r = tables(7, 1, 40)
    b, _ = tables(8, 60, 0)
    reqs = spark.createDataFrame(r, REQ)
    pairs = []
    for times in (1, 10):
        many = [(f"{x[0]}-{t}", x[1] + 1000 * t, *x[2:]) for t in range(times) for x in b]
        pairs.append(unbound.candidates(reqs, spark.createDataFrame(many, BLOCK), k=2, rare=3).count())
    assert pairs[1] <= 1.5 * pairs[0]


def test_no_rows(spark):
    b, r = tables(9, 5, 5)
    for blocks, reqs in (([], r), (b, [])):
        assert unbound.candidates(spark.createDataFrame(reqs, REQ), spark.createDataFrame(blocks, BLOCK)).count() == 0


def test_look_ups_are_shared_and_do_not_go_through_the_driver(spark, monkeypatch):
    """Ten requirements of each kind take the look-ups of one; lists are larger than their files, so that none is broadcast for a small file."""
    b, r = tables(11, 60, 30)
    blocks, plans, rows, save = spark.createDataFrame(b, BLOCK), {}, [], unbound.saved

    def noted(df, tag):
        plans.setdefault(tag, df._jdf.queryExecution().executedPlan().toString())
        out = save(df, tag)
        rows[-1] += out.count() if "worth" in out.columns or "bound" in out.columns else 0
        return out

    monkeypatch.setattr(unbound, "saved", noted)
    found = []
    for times in (1, 10):
        rows.append(0)
        many = spark.createDataFrame([(f"{x[0]}-{t}", *x[1:]) for t in range(times) for x in r], REQ)
        found.append({(p["req_id"], p["block_key"]) for p in unbound.candidates(many, blocks, k=3, rare=3).collect()})
    assert rows[0] == rows[1] > 0
    assert {(f"{q.split('-')[0]}-0", x) for q, x in found[1]} == found[0] and len(found[1]) == 10 * len(found[0])
    assert not any("BroadcastExchange" in plans.get(tag, "") for tag in ("plain", "hits", "bound", "bar"))
