"""J8-J16, R1-R8 and P13-P14: parts are blocks, orders are requirements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import match as M
from ..operators import unbound as U
from ..stored import saved
from .registry import query

BLOCK = {
    "block_key": "concat('B', p_partkey)", "block_ord": "p_partkey", "label": "CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('L', CAST(floor(p_partkey / 20) AS BIGINT)) END", "leaf": "concat(CASE WHEN p_partkey % 3 = 0 THEN 'rx_' ELSE '' END, replace(p_name, ' ', '_'), p_partkey % 25)",
    "b_family": "concat(replace(p_name, ' ', '_'), '_unit', p_partkey % 7)", "w1": "split_part(p_name, ' ', 1)", "w2": "split_part(p_name, ' ', 2)", "b_direction": "CASE p_size % 3 WHEN 0 THEN 'send' WHEN 1 THEN 'receive' ELSE 'bidirectional' END",
    "o": "p_size % 16", "n": "p_size % 3 + 1", "sdi": "CAST(p_partkey % 3 AS STRING)", "b_format": "CASE p_partkey % 4 WHEN 0 THEN 'DIS' WHEN 1 THEN 'BNR' WHEN 2 THEN 'FLOAT' ELSE '' END",
    "dev": "p_brand", "b_channel": "CAST(p_partkey % 4 AS STRING)", "bus": "concat(p_type, '-', CAST(floor(p_partkey / 200) AS BIGINT))", "is_protocol": "p_size % 10 = 0", "is_spare": "p_partkey % 11 = 0",
}
REQ = {
    "req_id": "concat('R', o_orderkey)", "category": "CASE o_orderkey % 5 WHEN 0 THEN 'analog' WHEN 1 THEN 'discrete' WHEN 2 THEN 'bus' ELSE 'label' END", "rlabel": "concat('L', CAST(floor(o_custkey / 15) AS BIGINT))",
    "v1": "CASE o_custkey % 5 WHEN 0 THEN 'red' WHEN 1 THEN 'blue' WHEN 2 THEN 'small' WHEN 3 THEN 'large' ELSE 'hot' END", "v2": "CASE o_orderkey % 4 WHEN 0 THEN 'bolt' WHEN 1 THEN 'ring' WHEN 2 THEN 'widget' ELSE 'none' END",
    "kw": "concat(CASE o_custkey % 5 WHEN 0 THEN 'red' WHEN 1 THEN 'blue' WHEN 2 THEN 'small' WHEN 3 THEN 'large' ELSE 'hot' END, '_', CASE o_orderkey % 3 WHEN 0 THEN 'bolt' WHEN 1 THEN 'ring' ELSE 'gear' END)", "unit": "concat('unit', o_orderkey % 7)",
    "r_direction": "CASE o_orderkey % 3 WHEN 0 THEN 'send' WHEN 1 THEN 'receive' ELSE '' END", "ro": "o_custkey % 16", "rn_": "o_orderkey % 3 + 1", "rsdi": "CASE WHEN o_custkey % 2 = 0 THEN CAST(o_orderkey % 3 AS STRING) END",
    "rdev": "concat('Brand#', o_custkey % 25 + 1)", "r_channel": "CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE CAST(o_custkey % 4 AS STRING) END", "rbus": "CASE o_orderkey % 3 WHEN 0 THEN concat('ECONOMY-', CAST(floor(o_custkey / 150) AS BIGINT)) WHEN 1 THEN concat('SMALL-', CAST(floor(o_custkey / 150) AS BIGINT)) END",
}


#: The label after a requirement's own.
_NEXT = "concat('L', CAST(floor(o_custkey / 15) AS BIGINT) + 1)"


def _sql(exprs, table):
    return "SELECT " + ", ".join(f"{v} AS {k}" for k, v in exprs.items()) + f" FROM {table}"


REQ["next"] = _NEXT
SIDES_SQL = f"b AS ({_sql(BLOCK, 'part')}), r AS ({_sql(REQ, 'orders')})"
PAIRS_SQL = f"{SIDES_SQL}, pairs AS (SELECT * FROM r JOIN b ON r.rlabel = b.label)"
_SCORED = """, dims AS (SELECT *, least(30, 8 * (CAST(v1 = w1 OR v1 = w2 AS INTEGER) + CAST(v1 <> v2 AND (v2 = w1 OR v2 = w2) AS INTEGER) + CAST(contains(b_family, kw) AS INTEGER) + CAST(suffix(b_family, concat('_', unit)) AS INTEGER))) AS d_name,
    CASE WHEN r_direction = '' THEN 0 WHEN r_direction = b_direction THEN 15 WHEN b_direction = 'bidirectional' THEN 8 ELSE 0 END AS d_direction,
    CASE WHEN ro = o AND rn_ = n THEN 20 WHEN ro = o THEN 12 WHEN rn_ = n THEN 8 ELSE 0 END AS d_bit, CASE WHEN rsdi = sdi THEN 15 ELSE 0 END AS d_sdi,
    CASE WHEN category = 'discrete' AND b_format = 'DIS' OR category = 'analog' AND b_format IN ('BNR', 'FLOAT') THEN 10 WHEN category IN ('discrete', 'analog') AND b_format <> '' THEN 5 ELSE 0 END AS d_type,
    5 * CAST(coalesce(rbus = bus, FALSE) AS INTEGER) + 2 * CAST(rdev = dev AS INTEGER) AS d_device, CASE WHEN r_channel <> '' AND r_channel = b_channel THEN 10 ELSE 0 END AS d_channel FROM pairs),
  scored AS (SELECT *, d_name + d_direction + d_bit + d_sdi + d_type + d_device + d_channel AS total,
    r_direction IN ('send', 'receive') AND b_direction IN ('send', 'receive') AND r_direction <> b_direction OR coalesce(rsdi <> sdi, FALSE) OR coalesce(rbus <> bus, FALSE) AS conflict FROM dims),
  gated AS (SELECT * FROM scored WHERE total >= 12 AND NOT conflict), ranked AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY total DESC, block_ord, block_key) AS rn FROM gated)"""
SCORE_SQL = PAIRS_SQL + _SCORED
#: Two labels for each requirement, and blocks without a label.
WIDE_SQL = f"{SIDES_SQL}, pairs AS (SELECT * FROM r JOIN b ON label IN (rlabel, next) UNION ALL SELECT * FROM r JOIN b ON rbus = bus AND label = '')" + _SCORED


def blocks(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(*(f"{v} AS {k}" for k, v in BLOCK.items()))


def requirements(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*(f"{v} AS {k}" for k, v in REQ.items()))


def _asked(spark, sf_dir):
    """Requirements with the words that the score looks for, made once for all their pairs."""
    return requirements(spark, sf_dir).withColumn("r_words", M.name_words(F.array("kw", "unit")))


def scored(spark, sf_dir):
    return _scored(M.label_pairs(_asked(spark, sf_dir).withColumn("labels", F.array("rlabel")), blocks(spark, sf_dir)))


def scored_wide(spark, sf_dir):
    r, b = _asked(spark, sf_dir), blocks(spark, sf_dir)
    by_label = M.label_pairs(r.withColumn("labels", F.array("rlabel", "next")), b)
    by_bus = r.join(b.where("label = ''"), F.col("rbus") == F.col("bus"))
    return _scored(by_label.unionByName(by_bus, allowMissingColumns=True))


def _sides(df):
    """The columns that the score reads, of requirements, blocks or both."""
    some = lambda c: F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(F.array(c))
    field = lambda a, n: F.array(F.struct(F.col(a).cast("int").alias("offset"), F.col(n).cast("int").alias("size")))
    r = {"r_tokens": lambda: F.array_distinct(F.array("v1", "v2")), "r_keywords": lambda: F.array("kw", "unit"), "r_fields": lambda: field("ro", "rn_"), "r_sdi": lambda: some("rsdi"), "r_category": lambda: F.col("category"), "r_devices": lambda: some("rdev"), "r_buses": lambda: some("rbus")}
    b = {"b_tokens": lambda: F.array_distinct(F.array("w1", "w2")), "b_fields": lambda: field("o", "n"), "b_sdi": lambda: some("sdi"), "b_devices": lambda: some("dev"), "b_buses": lambda: some("bus")}
    return df.withColumns({k: f() for k, f in ((r if "req_id" in df.columns else {}) | (b if "block_key" in df.columns else {})).items()})


def _scored(j):
    return M.score(_sides(j))


def _slim(df, *more):
    return df.select("req_id", "block_key", *more)


@query("j8_label_candidates", f"WITH {PAIRS_SQL} SELECT DISTINCT req_id, block_key FROM pairs")
def j8(spark, sf_dir):
    return M.label_candidates(requirements(spark, sf_dir).withColumn("labels", F.array("rlabel")), blocks(spark, sf_dir))


@query("j9_bus_candidates", f"WITH {SIDES_SQL} SELECT req_id, block_key FROM r JOIN b ON rbus = bus AND label = ''")
def j9(spark, sf_dir):
    r = requirements(spark, sf_dir).withColumns({"labels": F.array().cast("array<string>"), "bus_types": F.array_compact(F.array("rbus"))})
    return M.bus_candidates(r, blocks(spark, sf_dir).withColumn("buses", F.array("bus")))


BARE_SQL = f"{SIDES_SQL}, pairs AS (SELECT r.* REPLACE (CAST(NULL AS VARCHAR) AS rbus), b.* FROM r JOIN b ON category IN ('analog', 'discrete') AND label = '')" + _SCORED


@query("j9_without_bus", f"WITH {BARE_SQL} SELECT req_id, block_key, rn, total FROM ranked WHERE rn <= 20")
def j9_without_bus(spark, sf_dir):
    """The 20 best of all blocks without a label, for analog and discrete requirements as if they named no bus."""
    r = _sides(requirements(spark, sf_dir).where("category in ('analog', 'discrete')").withColumn("rbus", F.lit(None).cast("string")))
    b = _sides(blocks(spark, sf_dir).where("label = ''"))
    none = F.array().cast("array<string>")
    some = lambda c: F.when(F.col(c) == "", none).otherwise(F.array(c))
    read = ["r_tokens", "r_keywords", "r_direction", "r_fields", "r_sdi", "r_category", "r_devices", "r_channel", "r_buses"]
    kinds = saved(U.kinds(r, read), "kinds")
    # one requirement of each kind is asked, and its best are those of its kind
    one = r.select("req_id", *read).join(kinds.where("req_id = kind").select("req_id").hint("merge"), "req_id")
    asked = one.withColumns({"r_components": none, "r_channels": some("r_channel")})
    pairs = saved(U.candidates(asked, b.withColumn("b_channels", some("b_channel"))), "pairs")
    words = one.withColumn("r_words", M.name_words(F.col("r_keywords")))
    best = M.top_k(M.gated(M.score(pairs.join(words.hint("merge"), "req_id").join(b.hint("merge"), "block_key"))), 20)
    best = saved(best.select(F.col("req_id").alias("kind"), "block_key", "rn", "total"), "best")
    return kinds.join(best.hint("merge"), "kind").select("req_id", "block_key", "rn", "total")


@query("j10_range_candidates", f"WITH {SIDES_SQL} SELECT req_id, count(*) AS blocks, min(block_key) AS first, max(block_key) AS last FROM r JOIN b ON ro < o + n AND o < ro + rn_ GROUP BY req_id")
def j10(spark, sf_dir):
    r = requirements(spark, sf_dir).selectExpr("req_id", "ro AS offset", "rn_ AS size")
    return M.range_counts(r, blocks(spark, sf_dir).selectExpr("block_key", "o AS offset", "n AS size"))


@query("j11_sdi_match", f"WITH {PAIRS_SQL} SELECT req_id, block_key FROM pairs WHERE rsdi = sdi")
def j11(spark, sf_dir):
    return _slim(scored(spark, sf_dir).where(F.arrays_overlap("r_sdi", "b_sdi")))


@query("r1_score", f"WITH {SCORE_SQL} SELECT req_id, block_key, {', '.join(M.DIMENSIONS)}, total FROM scored")
def r1(spark, sf_dir):
    return _slim(scored(spark, sf_dir), *M.DIMENSIONS, "total")


@query("r2_gates", f"WITH {SCORE_SQL} SELECT req_id, block_key, total FROM gated")
def r2(spark, sf_dir):
    return _slim(M.gated(scored(spark, sf_dir)), "total")


@query("r3_ranking", f"WITH {SCORE_SQL} SELECT req_id, block_key, rn FROM ranked")
def r3(spark, sf_dir):
    return _slim(M.ranked(M.gated(scored(spark, sf_dir))), "rn")


@query("r4_top_k", f"WITH {SCORE_SQL} SELECT req_id, block_key, rn FROM ranked WHERE rn <= 4 OR is_protocol")
def r4(spark, sf_dir):
    return _slim(M.best_and_exempt(M.gated(scored(spark, sf_dir)), 4, F.col("is_protocol")), "rn")


_HIT = "max(CASE WHEN d_name > 0 AND NOT is_protocol{} THEN 1 ELSE 0 END) OVER (PARTITION BY req_id, CASE WHEN label = '' THEN block_key ELSE label END)"


@query("r5_prune_nameless", f"WITH {WIDE_SQL}, h AS (SELECT *, {_HIT.format('')} AS hit FROM gated) SELECT req_id, block_key FROM h WHERE hit = 0 OR d_name > 0 OR is_protocol")
def r5(spark, sf_dir):
    return _slim(M.prune_nameless(M.gated(scored_wide(spark, sf_dir))))


@query("r6_prune_spare", f"WITH {WIDE_SQL}, h AS (SELECT *, {_HIT.format(' AND NOT is_spare')} AS hit FROM gated) SELECT req_id, block_key FROM h WHERE hit = 0 OR NOT is_spare")
def r6(spark, sf_dir):
    return _slim(M.prune_spare(M.gated(scored_wide(spark, sf_dir))))


TIERS_SQL = f"""{SCORE_SQL}, best AS (SELECT req_id, total, d_name, CAST(d_name > 0 AS INTEGER) + CAST(d_direction > 0 AS INTEGER) + CAST(d_bit > 0 AS INTEGER) + CAST(d_sdi > 0 AS INTEGER) + CAST(d_type > 0 AS INTEGER) + CAST(d_device > 0 AS INTEGER) + CAST(d_channel > 0 AS INTEGER) AS active FROM ranked WHERE rn = 1),
  seen AS (SELECT req_id, max(total) AS ungated FROM scored GROUP BY req_id),
  tiers AS (SELECT r.req_id, r.category, CASE WHEN total IS NULL THEN CASE WHEN ungated IS NULL OR r.category <> 'label' THEN 'unmatched' ELSE 'uncertain' END WHEN r.category IN ('analog', 'discrete') AND d_name = 0 THEN 'unmatched' WHEN total >= 25 AND active >= 2 AND d_name > 0 THEN 'matched' ELSE 'uncertain' END AS status, coalesce(total, CASE WHEN r.category = 'label' THEN ungated END, 0) AS top
    FROM r LEFT JOIN best USING (req_id) LEFT JOIN seen USING (req_id))"""


def tiers(spark, sf_dir):
    # pairs in conflict count for labelled requirements alone, so that the others' are dropped before they are scored
    judged = M.gates(scored(spark, sf_dir)).where("category = 'label' OR NOT conflict")
    return M.tiers(requirements(spark, sf_dir), judged, numbered=True)


@query("r7_tiers", f"WITH {TIERS_SQL} SELECT req_id, status, top FROM tiers")
def r7(spark, sf_dir):
    return tiers(spark, sf_dir)


@query("r8_evidence", f"WITH {SCORE_SQL} SELECT req_id, string_agg(concat(block_key, '=', total), ',' ORDER BY rn) AS evidence FROM ranked WHERE rn <= 3 GROUP BY req_id")
def r8(spark, sf_dir):
    e = M.evidence(M.top_k(M.gated(scored(spark, sf_dir)), 3))
    return e.select("req_id", F.array_join(F.transform("evidence", lambda x: F.concat_ws("=", x["block_key"], x["total"])), ",").alias("evidence"))


_PLAIN = "regexp_replace(upper({0}), '^(RX_|TX_|DS[0-9]*_)+', '')"


@query("j15_refined", f"""WITH {SCORE_SQL}, m AS (SELECT req_id, block_key, {_PLAIN.format('leaf')} AS name FROM ranked WHERE rn <= 3), names AS (SELECT req_id, {_PLAIN.format("concat('tx_', v1, '_', v2, CAST(substr(req_id, 2) AS INTEGER) % 25)")} AS name FROM r), idx AS (SELECT block_key, {_PLAIN.format('leaf')} AS name FROM b),
  exact AS (SELECT m.req_id, block_key, 'exact' AS how FROM m JOIN names USING (req_id, name)), hits AS (SELECT req_id, block_key FROM names JOIN idx USING (name)),
  found AS (SELECT * FROM exact UNION ALL SELECT req_id, block_key, 'recovered' FROM hits ANTI JOIN exact USING (req_id, block_key)),
  syn AS (SELECT DISTINCT m.req_id, block_key, 'synonym' AS how FROM m ANTI JOIN found USING (req_id) JOIN names ON m.req_id = names.req_id WHERE names.name LIKE 'RED_BOLT%' AND regexp_full_match(names.name, 'RED_BOLT1?[0-9]') AND m.name LIKE '%RING%')
  SELECT DISTINCT * FROM found UNION SELECT * FROM syn""")
def j15(spark, sf_dir):
    m = M.top_k(M.gated(scored(spark, sf_dir)), 3).select("req_id", "block_key", "leaf")
    names = requirements(spark, sf_dir).selectExpr("req_id", "concat('tx_', v1, '_', v2, cast(substr(req_id, 2) as int) % 25) AS name")
    syn = spark.range(20).selectExpr("concat('red_bolt', id) AS name", "'ring' AS alias")
    return M.refined(m, names, blocks(spark, sf_dir).select("block_key", "leaf"), syn)


@query("j16_cases", f"""WITH {TIERS_SQL}, k AS (SELECT ranked.req_id, block_key, label, rn FROM ranked JOIN tiers USING (req_id) WHERE rn <= 3 AND status <> 'unmatched')
  SELECT req_id, block_key, CASE WHEN row_number() OVER (PARTITION BY req_id, label ORDER BY rn, block_key) = 1 THEN concat('fields of ', label) END AS anchors FROM k""")
def j16(spark, sf_dir):
    b = blocks(spark, sf_dir)
    top = M.top_k(M.gated(scored(spark, sf_dir)), 3).select("req_id", "block_key", "rn").join(tiers(spark, sf_dir), "req_id")
    anchors = b.where("label <> ''").select("label").distinct().withColumn("anchors", F.concat(F.lit("fields of "), F.col("label")))
    return M.cases(top, b, anchors).select("req_id", "block_key", "anchors")


@query("p13_visible_attributes", "SELECT p_partkey, concat('Label=', p_size, ';Units=', p_type) AS attrs FROM part")
def p13(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey", "map('Label', cast(p_size as string), 'Guid', p_brand, 'Units', p_type) AS attrs")
    return p.select("p_partkey", F.array_join(F.array_sort(F.transform(F.map_entries(M.visible_attributes(F.col("attrs"), ["Label", "Units"])), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";").alias("attrs"))


@query("p14_relocated_states", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Units' ELSE 'OneState,Units,ZeroState' END AS attrs FROM part")
def p14(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey", "map('OneState', 'on', 'ZeroState', 'off', 'Units', p_type) AS attrs", "CASE WHEN p_size % 2 = 0 THEN array(map('OneState', 'a'), map('ZeroState', 'b')) ELSE array(map('OneState', 'a')) END AS sub_attrs")
    return M.relocated_states(b).select("p_partkey", F.array_join(F.array_sort(F.map_keys("attrs")), ",").alias("attrs"))
