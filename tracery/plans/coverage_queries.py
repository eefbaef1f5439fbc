"""A8, J12-J14, R9-R12, J17, L11-L12, A12 and the slice that is the flagship: benchmark items are blocks, documents are requirements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage as V
from ..stored import saved
from .registry import query

#: Tokens of the slice: words of six letters or more.
_WORDS_SQL = "regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{6,}}')"
TOKENS_SQL = f"t AS (SELECT DISTINCT doc_id, unnest({_WORDS_SQL.format()}) AS token FROM documents), b AS (SELECT DISTINCT item_id, unnest({_WORDS_SQL.format()}) AS token FROM benchmark), n AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id)"
RECALL_SQL = f"{TOKENS_SQL}, o AS (SELECT item_id, doc_id, count(*) AS overlap FROM b JOIN t USING (token) GROUP BY ALL), rec AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) AS rank FROM o)"
LEVEL_SQL = f"""{RECALL_SQL}, lv AS (SELECT r.*, CASE WHEN overlap = n AND n >= 3 THEN 'exact_fullname' WHEN overlap >= 2 THEN 'exact_signal' WHEN overlap = 1 THEN 'weak_signal' ELSE 'none' END AS level, CASE WHEN overlap = n AND n >= 3 THEN 5 WHEN overlap >= 2 THEN 4 ELSE 1 END AS lr FROM rec r JOIN n USING (item_id)),
  top AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY item_id ORDER BY lr DESC) AS rk FROM lv) WHERE rk = 1), best AS (SELECT item_id, any_value(level) AS level, count(*) AS n_matched, min(doc_id) AS first FROM top GROUP BY item_id)"""


def _words():
    return F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]{6,})"), F.lit(1))


def _blocks(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("block_key"), F.array_distinct(_words()).alias("tokens"))


def _index(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("req_id"), "text")
    return V.token_index(docs, _words())


@query("a8_token_index", f"WITH {TOKENS_SQL} SELECT token, count(*) AS requirements, CAST(sum(doc_id) AS BIGINT) AS ids FROM t GROUP BY token")
def a8(spark, sf_dir):
    return _index(spark, sf_dir).groupBy("token").agg(F.count("*").alias("requirements"), F.sum("req_id").alias("ids"))


@query("j12_recall", f"WITH {RECALL_SQL} SELECT item_id, doc_id, overlap, rank FROM rec WHERE rank <= 5")
def j12(spark, sf_dir):
    return V.recall(_blocks(spark, sf_dir), _index(spark, sf_dir), 5).select(F.col("block_key").alias("item_id"), F.col("req_id").alias("doc_id"), "overlap", "rank")


def _levels(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    pairs = V.recall(b, _index(spark, sf_dir)).join(b.select("block_key", F.size("tokens").alias("n")), "block_key")
    no = F.lit(False)
    full = (F.col("overlap") == F.col("n")) & (F.col("n") >= 3)
    return pairs.withColumn("level", V.level(no, full, no, F.col("overlap"), no, no, F.lit(0), no))


@query("r9_levels", f"WITH {LEVEL_SQL} SELECT item_id, level, count(*) AS pairs FROM lv GROUP BY ALL")
def r9(spark, sf_dir):
    return _levels(spark, sf_dir).groupBy(F.col("block_key").alias("item_id"), "level").agg(F.count("*").alias("pairs"))


@query("r10_best_level", f"WITH {LEVEL_SQL} SELECT item_id, level, n_matched, first FROM best")
def r10(spark, sf_dir):
    return V.best_level(_levels(spark, sf_dir)).select(F.col("block_key").alias("item_id"), "level", F.size("matched").cast("long").alias("n_matched"), F.array_min("matched").alias("first"))


@query("q_spec_to_req_coverage", f"""WITH {LEVEL_SQL}, c AS (SELECT item_id, count(*) > 5 AS truncated FROM rec GROUP BY item_id)
  SELECT item_id, coalesce(level, 'no_evidence') AS rule_level, CASE WHEN level IN ('exact_fullname', 'exact_signal') THEN 'covered_direct' WHEN level = 'weak_signal' THEN 'possible' ELSE 'uncovered' END AS analysis_status, coalesce(level = 'weak_signal', FALSE) AS needs_ai, coalesce(n_matched, 0) AS n_matched, coalesce(truncated, FALSE) AS truncated
  FROM benchmark LEFT JOIN best USING (item_id) LEFT JOIN c USING (item_id)""")
def spec_to_req(spark, sf_dir):
    b = _blocks(spark, sf_dir).withColumn("missing", F.array().cast("array<string>"))
    pairs = saved(_levels(spark, sf_dir).withColumn("req_id", F.col("req_id").cast("string")), "levels")  # read three times
    out = V.deterministic(b, pairs)
    return out.select(F.col("block_key").alias("item_id"), "rule_level", "analysis_status", "needs_ai", F.size("matched").cast("long").alias("n_matched"), "truncated")


# ---- the full ladder, on pairs of parts and orders
PAIR = {
    "block_key": "concat('B', o_custkey)", "req_id": "concat('R', o_orderkey)", "rank": "o_orderkey", "b_label": "CASE WHEN o_custkey % 3 = 0 THEN '' ELSE concat('L', o_custkey % 7) END",
    "rl": "CASE WHEN o_orderkey % 4 > 0 THEN concat('L', o_orderkey % 7) END", "b_protocol": "CASE o_custkey % 5 WHEN 0 THEN 'analog' WHEN 1 THEN 'discrete' WHEN 2 THEN 'frame' ELSE 'labelled_word' END", "r_category": "CASE o_orderkey % 11 WHEN 0 THEN 'analog' WHEN 1 THEN 'discrete' WHEN 2 THEN 'label' ELSE 'bus' END",
    "bd": "CAST(o_custkey % 9 AS STRING)", "rd": "CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey % 9 AS STRING) END", "bs": "CAST(o_custkey % 2 AS STRING)", "rs": "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 2 AS STRING) END",
    "bo": "o_custkey % 16", "bn": "3", "ro": "CASE WHEN o_orderkey % 8 = 0 THEN o_orderkey % 16 END", "specific": "CASE o_orderkey % 7 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END", "fullname": "o_orderkey % 37 = 0", "generic": "o_orderkey % 2", "distinctive": "o_orderkey % 13 < 6", "context": "o_orderkey % 5 = 0", "parent": "o_orderkey % 19 = 0",
}
LADDER_SQL = "p AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in PAIR.items()) + """ FROM orders), c AS (SELECT *, coalesce(b_label <> '' AND rl <> b_label, FALSE) OR CASE b_protocol WHEN 'labelled_word' THEN r_category IN ('analog', 'discrete') WHEN 'frame' THEN r_category IN ('label', 'analog', 'discrete') WHEN 'analog' THEN r_category IN ('label', 'discrete') ELSE r_category IN ('label', 'analog') END
    OR b_protocol <> 'labelled_word' AND coalesce(bd <> rd, FALSE) OR b_protocol = 'labelled_word' AND (coalesce(bs <> rs, FALSE) OR specific = 0 AND NOT fullname AND coalesce(NOT (bo < ro + 2 AND ro < bo + bn), FALSE)) AS conflict,
    b_protocol = 'labelled_word' AND (coalesce(bs = rs, FALSE) OR coalesce(bo < ro + 2 AND ro < bo + bn, FALSE)) AS identity, coalesce(b_label = rl, FALSE) AS label_hit FROM p),
  lv AS (SELECT *, CASE WHEN conflict THEN 'not_same_object' WHEN fullname THEN 'exact_fullname' WHEN label_hit AND (specific > 0 OR identity) THEN 'exact_label' WHEN specific >= 2 OR specific = 1 AND distinctive AND context THEN 'exact_signal' WHEN specific = 1 THEN 'weak_signal' WHEN label_hit OR parent THEN 'parent_referenced' WHEN generic > 0 THEN 'generic_signal' ELSE 'none' END AS level FROM c),
  r AS (SELECT *, CASE level WHEN 'exact_label' THEN 6 WHEN 'exact_fullname' THEN 5 WHEN 'exact_signal' THEN 4 WHEN 'parent_referenced' THEN 3 WHEN 'generic_signal' THEN 2 ELSE 1 END AS lr FROM lv WHERE level NOT IN ('not_same_object', 'none')),
  best AS (SELECT block_key, any_value(level) AS level, string_agg(req_id, ',' ORDER BY rank) AS matched, count(*) AS nm FROM (SELECT *, rank() OVER (PARTITION BY block_key ORDER BY lr DESC) AS rk FROM r) WHERE rk = 1 GROUP BY block_key),
  cnt AS (SELECT block_key, count(*) AS n, count(*) FILTER (WHERE level = 'not_same_object') AS nc FROM lv GROUP BY block_key), blk AS (SELECT concat('B', k) AS block_key, k % 9 = 0 AS lost FROM (SELECT c_custkey AS k FROM customer UNION SELECT unnest(range(1000000, 1000020)))),
  nam AS (SELECT blk.*, matched, n, CASE WHEN n IS NULL THEN CASE WHEN lost THEN 'input_error' ELSE 'no_evidence' END WHEN n = nc THEN 'not_same_object' ELSE coalesce(level, 'trace_only') END AS rule_level FROM blk LEFT JOIN best USING (block_key) LEFT JOIN cnt USING (block_key)),
  det AS (SELECT block_key, lost, rule_level, CASE WHEN rule_level IN ('exact_label', 'exact_fullname', 'exact_signal') THEN 'covered_direct' WHEN rule_level IN ('parent_referenced', 'input_error') THEN rule_level WHEN rule_level IN ('generic_signal', 'weak_signal', 'trace_only') OR rule_level = 'not_same_object' AND lost THEN 'possible' ELSE 'uncovered' END AS analysis_status,
    rule_level IN ('parent_referenced', 'generic_signal', 'weak_signal', 'trace_only') AS needs_ai, coalesce(matched, '') AS matched, coalesce(n > 5, FALSE) AS truncated FROM nam),
  rev AS (SELECT block_key, CASE CAST(substr(block_key, 2) AS INTEGER) % 4 WHEN 0 THEN 'covered' WHEN 1 THEN 'not_same_object' WHEN 2 THEN 'unconfirmed' END AS verdict FROM blk WHERE CAST(substr(block_key, 2) AS INTEGER) % 4 < 3),
  fin AS (SELECT block_key, rule_level, analysis_status, CASE WHEN needs_ai THEN CASE verdict WHEN 'covered' THEN 'covered' WHEN 'not_same_object' THEN CASE WHEN lost OR truncated OR CAST(substr(block_key, 2) AS INTEGER) % 3 > 0 THEN 'possible' ELSE 'uncovered' END ELSE analysis_status END WHEN analysis_status = 'covered_direct' THEN 'covered' WHEN analysis_status = 'input_error' THEN '' ELSE analysis_status END AS coverage_status,
    CASE WHEN needs_ai AND verdict IS NOT NULL THEN 'rater' ELSE 'rule' END AS source FROM det LEFT JOIN rev USING (block_key))"""


def _ladder(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*(f"{v} AS {k}" for k, v in PAIR.items()))
    one = lambda c: F.array_compact(F.array(c))
    field = lambda o, n: F.when(F.col(o).isNull(), F.array().cast("array<struct<offset: bigint, size: int>>")).otherwise(F.array(F.struct(F.col(o).cast("long").alias("offset"), n.alias("size"))))
    p = p.withColumns({"r_labels": one("rl"), "b_devices": one("bd"), "r_devices": one("rd"), "b_sdi": one("bs"), "r_sdi": one("rs"), "b_fields": field("bo", F.col("bn")), "r_fields": field("ro", F.lit(2))})
    p = V.conflict(p.withColumn("meant", (F.col("specific") > 0) | F.col("fullname")))
    hit = (F.col("b_label") != "") & F.array_contains("r_labels", F.col("b_label"))
    return p.withColumn("level", V.level(F.col("conflict"), F.col("fullname"), hit, F.col("specific"), F.col("distinctive"), F.col("context"), F.col("generic"), F.col("parent"), F.col("identity")))


def _rules(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS id").union(spark.range(1_000_000, 1_000_020))  # and some that no pair has
    b = ids.selectExpr("concat('B', id) AS block_key", "CASE WHEN id % 9 = 0 THEN array('gone') ELSE cast(array() as array<string>) END AS missing")
    return b, V.deterministic(b, _ladder(spark, sf_dir))


@query("j14_conflicts", f"WITH {LADDER_SQL} SELECT req_id, conflict FROM c")
def j14(spark, sf_dir):
    return _ladder(spark, sf_dir).select("req_id", "conflict")


@query("r9_full_ladder", f"WITH {LADDER_SQL} SELECT req_id, level FROM lv")
def r9b(spark, sf_dir):
    return _ladder(spark, sf_dir).select("req_id", "level")


@query("r11_deterministic", f"WITH {LADDER_SQL} SELECT block_key, rule_level, analysis_status, needs_ai, matched, truncated FROM det")
def r11(spark, sf_dir):
    return _rules(spark, sf_dir)[1].select("block_key", "rule_level", "analysis_status", "needs_ai", F.array_join("matched", ",").alias("matched"), "truncated")


def _final(spark, sf_dir):
    b, rules = _rules(spark, sf_dir)
    n = F.substring("block_key", 2, 9).cast("int")
    reviews = rules.where(n % 4 < 3).select("block_key", F.element_at(F.array(F.lit("covered"), F.lit("not_same_object"), F.lit("unconfirmed")), n % 4 + 1).alias("verdict"), F.col("shown").alias("matched_ids"), F.when(n % 3 == 0, F.col("shown")).otherwise(F.array().cast("array<string>")).alias("rejected_ids"))
    return V.consolidated(b, rules, reviews)


@query("l12_consolidated", f"WITH {LADDER_SQL} SELECT block_key, coverage_status, source, rule_level FROM fin")
def l12(spark, sf_dir):
    return _final(spark, sf_dir).select("block_key", "coverage_status", "source", "rule_level")


@query("a12_statistics", f"WITH {LADDER_SQL} SELECT CASE WHEN coverage_status <> '' THEN coverage_status ELSE analysis_status END AS status, count(*) AS blocks FROM fin GROUP BY 1")
def a12(spark, sf_dir):
    return V.statistics(_final(spark, sf_dir))


@query("j13_trace_recall", "SELECT p_partkey AS block_key, CASE WHEN p_size % 2 = 0 THEN 'a,c' ELSE 'a,b,c' END AS candidates FROM part")
def j13(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS block_key", "array('a', 'b', 'c') AS candidates", "CASE WHEN p_size % 2 = 0 THEN array('b') ELSE cast(array() as array<string>) END AS missing")
    return V.trace_recall(s).select("block_key", F.array_join("candidates", ",").alias("candidates"))


@query("r12_matched_tokens", "SELECT p_partkey, concat(CASE WHEN p_size % 3 = 0 THEN '' ELSE 'L1,' END, CASE WHEN split_part(p_name, ' ', 2) = 'bolt' THEN 'bolt,' ELSE '' END, 'x') AS tokens FROM part")
def r12(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    label = F.when(F.col("p_size") % 3 == 0, "").otherwise("L1")
    t = V.matched_tokens(F.array(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("x")), F.array(F.lit("x"), F.lit("bolt")), label)
    return p.select("p_partkey", F.array_join(t, ",").alias("tokens"))
