"""S1 with F7-F9, P6 and P7 over workbooks of orders, and S18 over tables of line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sheets as S
from .registry import query

#: The columns of every sheet: side, layer and attribute of its three header rows, and the cell of an order.
_COLUMNS = (
    ("Publisher", "Port", "Name", "CASE WHEN o_orderkey % 11 > 0 THEN concat('P', o_custkey % 50) END"),
    (None, None, "Period", "CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_custkey % 7 AS STRING) END"),
    (None, "DP", "Name", "CASE WHEN o_orderkey % 13 > 0 THEN concat('D', o_custkey) END"),
    (None, None, "DataFormatType", "CASE WHEN o_orderkey % 3 > 0 THEN 'BNR' END"),
    (None, None, "ParameterSize", "CASE WHEN o_orderkey % 10 < 3 THEN CAST(o_custkey % 9 AS STRING) END"),
    (None, "DP", "Name", "CASE WHEN o_orderkey % 17 = 0 THEN 'Label_word' WHEN o_orderkey % 7 > 0 THEN concat('E', o_orderkey % 100) END"),
    (None, None, "DataFormatType", "CASE WHEN o_orderkey % 10 < 5 THEN 'DIS' END"),
    (None, None, "BitOffsetWithinDS", "CASE WHEN o_orderkey % 10 < 4 THEN CAST(o_orderkey % 32 AS STRING) END"),
    ("Subscriber", "LogicalPort", "Name", "CASE WHEN o_orderkey % 5 > 0 THEN concat('Q', o_custkey % 40) END"),
    (None, None, "Tag", "CASE o_custkey % 5 WHEN 0 THEN 'A429Port' WHEN 1 THEN 'xCANx' WHEN 2 THEN 'my discrete' WHEN 3 THEN 'CAN port' END"),
    (None, "RP", "Name", "CASE WHEN o_orderkey % 19 > 0 THEN concat('R', o_orderkey % 1000) END"),
    (None, None, "Label", "CASE WHEN o_orderkey % 6 > 0 THEN concat('L', o_orderkey % 60) END"),
    (None, None, "DataFormatType", "CASE WHEN o_orderkey % 8 > 1 THEN 'OPAQUE' END"),
    (None, None, "FullName", "CASE o_orderkey % 3 WHEN 0 THEN 'canary.x' WHEN 1 THEN 'a.A664.can' END"),
)
_NAMES = ("pn", "period", "d1", "f1", "z1", "d2", "f2", "o2", "qn", "tag", "rn", "lab", "rf", "full_")
_FILE, _SHEET = "concat('f', o_custkey % 2, '-', CAST(floor(o_orderkey / 200000) AS BIGINT))", "concat(CASE WHEN o_custkey % 3 = 0 THEN 'CAN' ELSE concat('B', o_custkey % 3) END, '-', o_custkey % 20)"


def _path(*names: str) -> str:
    return f"concat_ws('.', {', '.join(names)})"


_W = f"w AS (SELECT {_FILE} AS file, {_SHEET} AS sheet, o_custkey % 2 AS role, o_orderkey + 4 AS row, {', '.join(f'{e} AS {n}' for (*_, e), n in zip(_COLUMNS, _NAMES, strict=True))} FROM orders)"
_NONE = "CAST(NULL AS VARCHAR)"


def _part(table: str, side: str, layer: str, path: str, attr: str, value: str, ref: str = _NONE, where: str = "TRUE") -> str:
    return f"SELECT file, sheet, row, '{side}' AS side, '{layer}' AS layer, {path} AS path, bus, '{attr}' AS attr, {value} AS value, {ref} AS ref_name FROM {table} WHERE {value} IS NOT NULL AND ({where})"


_FULL_P, _FULL_S, _LEAF = _path("pn", "d1", "d2"), _path("qn", "rn"), "(f1 IS NOT NULL OR z1 IS NOT NULL OR f2 IS NOT NULL OR o2 IS NOT NULL)"
_S1_SQL = " UNION ALL ".join([
    # publishers' workbooks
    _part("p", "DP", "Port", "pn", "Period", "period", where="pn IS NOT NULL"),
    *(_part("p", "DP", "DP", _path("pn", "d1"), a, v, where="d1 IS NOT NULL") for a, v in (("DataFormatType", "f1"), ("ParameterSize", "z1"))),
    *(_part("p", "DP", "DP", _FULL_P, a, v) for a, v in (("DataFormatType", "f2"), ("BitOffset", "o2"))),
    # the subscriber's own, with the leaf's format
    _part("s", "RP", "RP", _FULL_S, "Label", "lab"),
    _part("s", "RP", "RP", _FULL_S, "DataFormatType", "coalesce(f2, f1, rf)", where=f"rf IS NOT NULL AND {_LEAF}"),
    # what it takes over
    *(_part("s", "RP", "RP", _FULL_S, a, v, f"coalesce({n}, '')") for a, v, n in (("DataFormatType", "f1", "d1"), ("ParameterSize", "z1", "d1"), ("DataFormatType", "f2", "d2"), ("BitOffset", "o2", "d2"))),
    # given again as the publisher's
    _part("s", "DP", "Port", _FULL_P, "Period", "period", where="pn IS NOT NULL AND d2 IS NOT NULL"),
    *(_part("s", "DP", "DP", _FULL_P, a, v, where="d1 IS NOT NULL AND d2 IS NOT NULL") for a, v in (("DataFormatType", "f1"), ("ParameterSize", "z1"))),
    *(_part("s", "DP", "DP", _FULL_P, a, v, where="d2 IS NOT NULL") for a, v in (("DataFormatType", "f2"), ("BitOffset", "o2"))),
    _part("s", "DP", "DP", _FULL_P, "BitOffset", "o2", where="d2 IS NULL AND (pn IS NOT NULL OR d1 IS NOT NULL)"),
])


@query("s1_interface_entries", f"""WITH {_W}, v AS (SELECT *, split_part(sheet, '-', 1) AS own, CASE WHEN tag = 'A429Port' THEN 'A429' WHEN tag = 'my discrete' THEN 'Discrete' WHEN tag = 'CAN port' THEN 'CAN' END AS by_tag,
    CASE WHEN full_ = 'canary.x' THEN 'CAN' WHEN full_ = 'a.A664.can' THEN 'A664' END AS by_name FROM w),
  p AS (SELECT *, own AS bus FROM v WHERE role = 0 AND d2 IS NOT NULL), s AS (SELECT *, coalesce(CASE WHEN by_tag <> own THEN by_tag END, by_name, own) AS bus FROM v WHERE role = 1 AND rn IS NOT NULL AND coalesce(d2, '') <> 'Label_word') {_S1_SQL}""")
def s1(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(
        f"{_FILE} AS file", f"{_SHEET} AS sheet", "cast(o_custkey % 20 AS int) AS table_ord", "o_custkey % 2 AS role", "o_orderkey + 4 AS row",
        f"posexplode(array({', '.join(e for *_, e in _COLUMNS)})) AS (col, value)").where("value is not null")
    heads = [(r, c, v) for c, (*three, _) in enumerate(_COLUMNS) for r, v in enumerate(three, 1) if v]
    sheets = o.select("file", "sheet", "table_ord", "role").distinct()
    head = sheets.withColumn("h", F.explode(F.array(*(F.struct(F.lit(r).cast("long").alias("row"), F.lit(c).alias("col"), F.lit(v).alias("value")) for r, c, v in heads)))).select("file", "sheet", "table_ord", "role", "h.*")
    cells = o.select(head.columns).union(head)
    of = lambda role: cells.where(F.col("role") == role).drop("role")
    return S.interface_entries(of(0), of(1), S.Layout(frames=("label",))).drop("ord")


_RULES = (("beta", None, None, 2, [(1, 0, "1", None), (3, 1, None, "A")]), ("alpha", 4, None, None, [(2, 1, "N", None), (4, 0, None, "7")]), ("gamma", None, 5, 2, [(1, 1, "R", None), (5, 1, None, "N")]))


@query("s18_tables", """WITH c AS (SELECT o_custkey AS file, o_orderkey AS table_ord, l_linenumber AS row, CAST(l_partkey AS VARCHAR) AS c0, concat(l_returnflag, l_linestatus) AS c1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  t AS (SELECT file, CASE WHEN max(row) = 4 AND bool_or(row = 2 AND starts_with(c1, 'N')) AND bool_or(row = 4 AND contains(c0, '7')) THEN 'alpha' WHEN bool_or(row = 1 AND starts_with(c0, '1')) AND bool_or(row = 3 AND contains(c1, 'A')) THEN 'beta'
    WHEN max(row) >= 5 AND bool_or(row = 1 AND starts_with(c1, 'R')) AND bool_or(row = 5 AND contains(c1, 'N')) THEN 'gamma' END AS ruleset FROM c GROUP BY file, table_ord)
  SELECT file, min(ruleset) AS ruleset FROM t GROUP BY file HAVING count(ruleset) > 0""")
def s18_tables(spark, sf_dir):
    """A customer's orders as the tables of a file, line items as their rows."""
    files = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_custkey AS file", "o_orderkey AS table_ord")
    cells = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey AS table_ord", "l_linenumber AS row", "posexplode(array(cast(l_partkey AS string), concat(l_returnflag, l_linestatus))) AS (col, value)")
    return S.ruleset_of_tables(cells, spark.createDataFrame(_RULES, S.RULES), files)
