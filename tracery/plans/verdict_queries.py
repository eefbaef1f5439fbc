"""A9-A15, L4-L14, J17-J20, K1-K7 and the stream extension, with events as verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import report as R
from ..operators import verdict as V
from ..streaming import verdicts as S
from . import inputs as I
from .match_queries import TIERS_SQL, blocks, scored, tiers
from .registry import query

VER = "WITH " + I.VERDICT_CTE
CONSENSUS_SQL = f"""{VER}, n AS (SELECT case_id, status, count(*) AS n FROM verdict WHERE status <> 'error' GROUP BY ALL), m AS (SELECT case_id, max(n) AS most, CAST(sum(n) AS BIGINT) AS alive FROM n GROUP BY case_id),
  ag AS (SELECT case_id, CASE WHEN most = alive THEN 'full' WHEN 2 * most > alive THEN 'majority' ELSE 'split' END AS agreement, coalesce(alive, 0) AS alive FROM (SELECT DISTINCT case_id FROM verdict) LEFT JOIN m USING (case_id)),
  st AS (SELECT *, CAST(substr(case_id, 2) AS INTEGER) % 3 AS k FROM ag),
  st2 AS (SELECT case_id, agreement, alive, CASE WHEN agreement = 'full' THEN CASE WHEN k = 0 THEN 5 ELSE 4 END WHEN agreement = 'majority' THEN CASE WHEN k = 1 THEN 2 ELSE 3 END ELSE 1 END AS stars FROM st),
  cap AS (SELECT case_id, alive, least(stars, CASE WHEN alive <= 1 THEN 1 WHEN alive = 2 THEN 2 ELSE 5 END) AS stars, CASE alive WHEN 0 THEN 'no_consensus' WHEN 1 THEN 'single_source' ELSE agreement END AS agreement, alive = 0 AS review FROM st2)"""


def _consensus(spark, sf_dir):
    a = V.agreement(I.verdicts(spark, sf_dir))
    k = F.substring("case_id", 2, 9).cast("int") % 3
    found = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("key"))).otherwise(F.array(F.lit("vague")))
    return a.withColumn("stars", V.stars(F.col("agreement"), found))


def _capped(spark, sf_dir):
    return V.capped(_consensus(spark, sf_dir))


@query("a13_majority", f"{VER} SELECT case_id, status, votes FROM (SELECT case_id, status, count(*) AS votes, row_number() OVER (PARTITION BY case_id ORDER BY count(*) DESC, min(provider_ord)) AS rn FROM verdict GROUP BY case_id, status) WHERE rn = 1")
def a13(spark, sf_dir):
    return V.majority(I.verdicts(spark, sf_dir))


@query("l8_consensus_stars", f"{CONSENSUS_SQL} SELECT case_id, agreement, alive, stars FROM st2")
def l8(spark, sf_dir):
    return _consensus(spark, sf_dir)


@query("l9_capped_stars", f"{CONSENSUS_SQL} SELECT * FROM cap")
def l9(spark, sf_dir):
    return _capped(spark, sf_dir)


@query("l10_second_round", f"{CONSENSUS_SQL} SELECT a.case_id, a.provider, string_agg(concat(b.provider, '=', b.status), ';' ORDER BY b.provider_ord) AS peers FROM verdict a JOIN cap ON a.case_id = cap.case_id AND stars <= 2 JOIN verdict b ON a.case_id = b.case_id AND a.provider <> b.provider AND b.status <> 'error' GROUP BY ALL")
def l10(spark, sf_dir):
    return V.second_round(_capped(spark, sf_dir), I.verdicts(spark, sf_dir))


@query("l10_partial_consensus", f"{CONSENSUS_SQL} SELECT case_id, CASE WHEN stars <= 2 THEN 3 ELSE stars END AS stars FROM cap")
def l10b(spark, sf_dir):
    c = _capped(spark, sf_dir).select("case_id", "stars")
    return V.replaced(c, c.where("stars <= 2").withColumn("stars", F.lit(3)))


@query("l7_late_results", f"{VER} SELECT case_id, provider, CASE WHEN status = 'error' AND CAST(substr(case_id, 2) AS INTEGER) % 2 = 0 THEN 'covered' ELSE status END AS status FROM verdict")
def l7(spark, sf_dir):
    v = I.verdicts(spark, sf_dir)
    return V.patched(v, v.where("cast(substr(case_id, 2) as int) % 2 = 0").withColumn("status", F.lit("covered"))).select("case_id", "provider", "status")


@query("alive_providers", f"{VER} SELECT DISTINCT provider FROM verdict WHERE status <> 'error'")
def alive(spark, sf_dir):
    return V.alive_providers(I.verdicts(spark, sf_dir))


@query("a11_star_distribution", f"{CONSENSUS_SQL} SELECT CAST(s AS STRING) AS value, count(case_id) AS n FROM (SELECT unnest(range(1, 6)) AS s) LEFT JOIN cap ON stars = s GROUP BY s")
def a11(spark, sf_dir):
    return V.distribution(_capped(spark, sf_dir), "stars", [1, 2, 3, 4, 5])


@query("a11_average_stars", f"{CONSENSUS_SQL} SELECT round_even(avg(stars), 2) AS average FROM cap")
def a11b(spark, sf_dir):
    return V.average_stars(_capped(spark, sf_dir))


#: The stub's checksum, from the crc's table, which a rule makes.
@query("l4_judged", """WITH crc AS (SELECT list(list_reduce(range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
  p AS (SELECT CAST(p_partkey AS VARCHAR) AS case_id, provider, CAST(o AS INTEGER) AS provider_ord, hex(encode(concat(provider, '|', p_name, ' ', p_size))) AS b FROM part, (VALUES ('alpha', 0), ('beta', 1), ('gamma', 2)) v(provider, o)),
  h AS (SELECT case_id, provider, provider_ord, xor(4294967295, list_reduce(list_transform(range(1, len(b), 2), lambda i: CAST('0x' || b[i:i + 1] AS BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295)) AS n FROM p, crc)
  SELECT case_id, provider, provider_ord, CASE n % 3 WHEN 0 THEN 'covered' WHEN 1 THEN 'inconsistent' ELSE 'needs_review' END AS status, concat('checksum ', n) AS analysis, CAST(n % 100 AS DOUBLE) / 100 AS confidence FROM h""")
def l4(spark, sf_dir):
    cases = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("cast(p_partkey as string) AS case_id", "concat(p_name, ' ', p_size) AS prompt")
    return V.judged(cases, spark.createDataFrame([("alpha", 0), ("beta", 1), ("gamma", 2)], "provider string, provider_ord int"))


KEY_SQL = """sha256(concat('{"version":"1","kind":"judge","provider":"alpha","model":"m1","params":"t=0","prompt":"', p_name, ' ', p_size, '"}'))"""
REQUESTS_SQL = f"req AS (SELECT DISTINCT {KEY_SQL} AS key FROM part), cache AS (SELECT {KEY_SQL} AS key, p_partkey AS ord FROM part WHERE p_size % 3 = 0)"


def _requests(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    key = V.cache_key(F.lit("judge"), F.lit("alpha"), F.lit("m1"), F.lit("t=0"), F.expr("concat(p_name, ' ', p_size)"))
    return p.select(key.alias("key")).distinct(), p.where("p_size % 3 = 0").select(key.alias("key"), F.col("p_partkey").alias("ord"), F.col("p_partkey").cast("string").alias("payload"))


@query("l13_cache_keys", f"WITH {REQUESTS_SQL} SELECT key FROM req")
def l13(spark, sf_dir):
    return _requests(spark, sf_dir)[0]


@query("l14_reuse_counts", f"WITH {REQUESTS_SQL} SELECT count(*) FILTER (WHERE key IN (SELECT key FROM cache)) AS reused, count(*) FILTER (WHERE key NOT IN (SELECT key FROM cache)) AS rerun FROM req")
def l14(spark, sf_dir):
    return V.reuse_counts(*_requests(spark, sf_dir))


@query("j20_cache_lookup", f"WITH {REQUESTS_SQL} SELECT key, CAST(max(ord) AS STRING) AS payload FROM req JOIN cache USING (key) GROUP BY key UNION ALL SELECT key, 'to do' FROM req ANTI JOIN cache USING (key)")
def j20(spark, sf_dir):
    req, cache = _requests(spark, sf_dir)
    return V.reused(req, cache).union(V.to_do(req, cache).withColumn("payload", F.lit("to do")))


@query("j19_keyed_update", f"{VER} SELECT case_id, provider, CASE WHEN status = 'error' AND provider = 'rater1' THEN 'needs_review' ELSE status END AS status FROM verdict")
def j19(spark, sf_dir):
    v = I.verdicts(spark, sf_dir)
    return V.patched(v, v.where("provider = 'rater1'").withColumn("status", F.lit("needs_review"))).select("case_id", "provider", "status")


@query("a9_match_counts", f"WITH {TIERS_SQL} SELECT count(*) FILTER (WHERE status = 'matched') AS matched, count(*) FILTER (WHERE status = 'uncertain') AS uncertain, count(*) FILTER (WHERE status = 'unmatched') AS unmatched, count(*) AS total FROM tiers")
def a9(spark, sf_dir):
    return R.match_counts(tiers(spark, sf_dir))


@query("a10_by_category", f"WITH {TIERS_SQL} SELECT category, status, count(*) AS n FROM tiers GROUP BY ROLLUP (category, status)")
def a10(spark, sf_dir):
    from .match_queries import requirements

    return R.by_category(tiers(spark, sf_dir).join(requirements(spark, sf_dir).select("req_id", "category"), "req_id"))


@query("a15_unmatched_blocks", f"WITH {TIERS_SQL} SELECT block_key FROM b ANTI JOIN gated USING (block_key)")
def a15(spark, sf_dir):
    from ..operators.match import gated

    return R.unmatched_blocks(blocks(spark, sf_dir), gated(scored(spark, sf_dir)))


RESULTS_SQL = "res AS (SELECT concat('B', p_partkey) AS block_key, CASE p_size % 3 WHEN 0 THEN 'covered' WHEN 1 THEN 'possible' ELSE 'uncovered' END AS coverage_status, CASE WHEN p_size % 4 = 0 THEN [concat('R', p_size), concat('R', p_partkey % 7)] ELSE [] END AS missing, CASE WHEN p_size % 3 = 0 THEN [concat('R', p_partkey)] ELSE [] END AS matched FROM part)"


def _results(spark, sf_dir):
    none = "cast(array() as array<string>)"
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("concat('B', p_partkey) AS block_key", "CASE p_size % 3 WHEN 0 THEN 'covered' WHEN 1 THEN 'possible' ELSE 'uncovered' END AS coverage_status",
        f"CASE WHEN p_size % 4 = 0 THEN array(concat('R', p_size), concat('R', p_partkey % 7)) ELSE {none} END AS missing", f"CASE WHEN p_size % 3 = 0 THEN array(concat('R', p_partkey)) ELSE {none} END AS matched")


@query("k4_forward_detail", f"WITH {RESULTS_SQL} SELECT block_key, coverage_status AS kind, CAST(len(matched) AS STRING) AS v FROM res UNION ALL SELECT block_key, 'missing', unnest(missing) FROM res UNION ALL SELECT block_key, 'matched', unnest(matched) FROM res")
def k4(spark, sf_dir):
    base, missing, matched = R.forward_detail(_results(spark, sf_dir))
    out = base.select("block_key", F.col("coverage_status").alias("kind"), F.col("n_matched").cast("string").alias("v"))
    return out.union(missing.select("block_key", F.lit("missing"), "req_id")).union(matched.select("block_key", F.lit("matched"), "req_id"))


@query("k5_sections", f"WITH {RESULTS_SQL} SELECT CASE WHEN coverage_status = 'covered' THEN 'covered' WHEN len(missing) > 0 THEN 'missing requirements' WHEN coverage_status = 'possible' THEN 'to be looked at' ELSE 'uncovered' END AS section, count(*) AS blocks FROM res GROUP BY 1")
def k5(spark, sf_dir):
    return R.sections(_results(spark, sf_dir))


@query("a14_distinct_missing", f"WITH {RESULTS_SQL} SELECT count(DISTINCT m) AS missing FROM (SELECT unnest(missing) AS m FROM res)")
def a14(spark, sf_dir):
    return R.distinct_missing(_results(spark, sf_dir))


@query("k6_status_shares", f"{VER}, o AS (SELECT * FROM verdict WHERE provider = 'rater0') SELECT status, count(*) AS n, round_even(count(*) / (SELECT count(*) FROM o), 4) AS share FROM o GROUP BY status")
def k6(spark, sf_dir):
    return R.status_shares(I.verdicts(spark, sf_dir), "rater0")


@query("k7_consensus_rows", f"""{CONSENSUS_SQL}, ms AS (SELECT concat('C', k) AS case_id, k % 9 AS n FROM (SELECT unnest(range(0, 400)) AS k UNION SELECT CAST(substr(case_id, 2) AS BIGINT) FROM cap))
  SELECT ms.case_id, CASE WHEN cap.case_id IS NULL THEN 'no match' ELSE agreement END AS "group", CASE WHEN cap.case_id IS NULL THEN '' ELSE concat(repeat('*', stars), repeat('.', 5 - stars)) END AS stars,
    CASE WHEN cap.case_id IS NULL THEN '' ELSE concat(array_to_string(list_transform(range(1, least(n, 5) + 1), lambda i: concat('b', i)), ', '), CASE WHEN n > 5 THEN concat(', +', n - 5) ELSE '' END) END AS blocks FROM ms LEFT JOIN cap USING (case_id)""")
def k7(spark, sf_dir):
    capped = _capped(spark, sf_dir)
    ids = spark.range(400).select("id").union(capped.select(F.substring("case_id", 2, 20).cast("long"))).distinct()  # all cases, and some ids that are none
    m = ids.selectExpr("concat('C', id) AS case_id", "CASE WHEN id % 9 = 0 THEN cast(array() as array<string>) ELSE transform(sequence(1, cast(id % 9 as int)), i -> concat('b', i)) END AS block_keys")
    return R.consensus_rows(capped.withColumn("status", F.col("agreement")), m)


@query("k3_itemised", """SELECT p_partkey AS seq, concat('IRD-', CASE WHEN p_partkey < 10000 THEN lpad(CAST(p_partkey AS STRING), 4, '0') ELSE CAST(p_partkey AS STRING) END) AS entry_id, p_name AS description FROM part""")
def k3(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return R.itemised(p.select(F.col("p_partkey").alias("seq"), F.format_string("IRD-%04d", "p_partkey").alias("entry_id"), F.col("p_name").alias("description")))


@query("x1_windowed_verdicts", "SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS start, event_type AS status, count(*) AS n FROM events GROUP BY ALL")
def x1(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return S.counted(e.withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("x2_latest_verdicts", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id")
def x2(spark, sf_dir):
    return S.latest(spark.read.parquet(f"{sf_dir}/events.parquet"))
