"""The benchmark tables in the roles of the analysis.  Every expression is plain SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

REQUIREMENT = {
    "req_id": "concat('R', o_orderkey)",
    "ord": "o_orderkey",
    "content": """concat('The unit ', CASE o_custkey % 7 WHEN 0 THEN 'shall not' ELSE 'shall' END, ' ', CASE o_orderkey % 4 WHEN 0 THEN 'transmit' WHEN 1 THEN 'acquire' WHEN 2 THEN 'send' ELSE 'use' END,
      CASE WHEN o_custkey % 3 = 0 THEN concat(' l', o_custkey % 20 + 100, ' L', o_custkey % 20 + 100, ' L', o_orderkey % 13 + 90) ELSE '' END,
      CASE o_orderkey % 5 WHEN 0 THEN ' analog' WHEN 1 THEN ' discrete' WHEN 2 THEN ' bus' ELSE '' END, ' PUMP', o_orderkey % 9, '_', CASE o_custkey % 4 WHEN 0 THEN 'FLOW_RATE' WHEN 1 THEN 'SPEED' WHEN 2 THEN 'TEMP_A1' ELSE 'StatusWord2' END,
      ' on A', o_orderkey % 6, ' and B', o_custkey % 5, ', SDI ', o_custkey % 4, ', bits ', o_orderkey % 5 + 9, '-', o_orderkey % 11 + 8, ', limit ', o_custkey)""",
    "bus": "CASE o_orderkey % 3 WHEN 0 THEN 'CAN' WHEN 1 THEN 'A429' ELSE 'discrete' END",
    "name": """concat(CASE o_orderkey % 3 WHEN 0 THEN 'RX_' WHEN 1 THEN 'TX_RX_' ELSE '' END, CASE o_custkey % 6 WHEN 0 THEN 'PUMP_FLOW' WHEN 1 THEN 'fan1' WHEN 2 THEN 'fan12_cmd' WHEN 3 THEN 'valvePos' WHEN 4 THEN 'x/y' ELSE 'PUMP_A_FLOW_R2b' END)""",
}
ENTRY = {
    "ord": "event_id",
    "sheet": "event_type",
    "side": "CASE WHEN event_id % 3 = 0 THEN 'DP' ELSE 'RP' END",
    "layer": "CASE WHEN event_id % 10 = 9 THEN 'LogicalPort' WHEN event_id % 3 = 0 THEN 'DP' ELSE 'RP' END",
    "bus": "CASE user_id % 3 WHEN 0 THEN 'CAN1' WHEN 1 THEN 'A429' ELSE 'discrete' END",
    "device": "concat('Dev', user_id % 4)",
    "path": """concat('Dev', user_id % 4, '.Port.', CASE WHEN user_id % 2 = 0 THEN concat('L', user_id % 30 + 100, '_W.L', user_id % 30 + 100, '_1_A', event_id % 2 + 1, '_') ELSE '' END,
      CASE event_id % 7 WHEN 0 THEN 'PUMP_FLOW' WHEN 1 THEN 'FAN1_CMD' WHEN 2 THEN 'VALVE_POS' WHEN 3 THEN 'LABEL' WHEN 4 THEN 'TEMP' ELSE 'PUMP_SPEED' END)""",
    "attr": "CASE event_id % 6 WHEN 0 THEN 'Label' WHEN 1 THEN 'DataFormatType' WHEN 2 THEN 'BitOffset' WHEN 3 THEN 'CodedSet' WHEN 4 THEN 'Units' ELSE 'OneState' END",
    "value": "CASE WHEN event_id % 11 = 0 THEN ' ' WHEN event_id % 13 = 0 THEN NULL ELSE CAST(CAST(floor(value) AS BIGINT) % 5 AS STRING) END",
    "ref_name": "CASE WHEN event_id % 4 = 0 THEN concat('REF', user_id % 2) END",
}
VERDICT = {
    "case_id": "concat('C', user_id)",
    "provider": "concat('rater', event_id % 3)",
    "provider_ord": "CAST(event_id % 3 AS INT)",
    "status": "CASE event_type WHEN 'view' THEN 'covered' WHEN 'click' THEN 'covered' WHEN 'signup' THEN 'inconsistent' WHEN 'purchase' THEN 'needs_review' ELSE 'error' END",
    "event_id": "event_id",
}


def _cte(exprs: dict[str, str], table: str) -> str:
    return "SELECT " + ", ".join(f"{v} AS {k}" for k, v in exprs.items()) + f" FROM {table}"


#: CTEs of the oracles.
REQ_CTE, ENTRY_CTE = f"req AS ({_cte(REQUIREMENT, 'orders')})", f"entry AS ({_cte(ENTRY, 'events')})"
VERDICT_CTE = f"verdict AS (SELECT * EXCLUDE (event_id, rn) FROM (SELECT *, row_number() OVER (PARTITION BY case_id, provider ORDER BY event_id) AS rn FROM ({_cte(VERDICT, 'events')})) WHERE rn = 1)"


def _read(spark: SparkSession, sf_dir: str, table: str, exprs: dict[str, str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*(f"{v} AS {k}" for k, v in exprs.items()))


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders", REQUIREMENT)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events", ENTRY)


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first verdict of each case and rater."""
    from ..operators.entries import first_of

    return first_of(_read(spark, sf_dir, "events", VERDICT), ["case_id", "provider"], ["event_id"]).drop("event_id")
