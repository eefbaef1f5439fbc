"""J1-J7, S10-S18 and the trace parts of the pipelines, over region - nation - customer - orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import trace as X
from . import inputs as I
from .registry import query
from .text_queries import BLOCK_SQL

ENT = "WITH " + I.ENTRY_CTE
# a parent is a customer's group; requirements are orders, names are paths of entries of a device group
REQS_SQL = "r AS (SELECT DISTINCT concat('E-', o_custkey) AS parent_id, concat('R', o_orderkey) AS req_id FROM orders)"
NAMES_SQL = "n AS (SELECT DISTINCT concat('E-', CAST(floor(ord * 3 / 20) AS BIGINT)) AS parent_id, path AS spec_name FROM entry)"


def _reqs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("concat('E-', o_custkey) AS parent_id", "concat('R', o_orderkey) AS req_id").distinct()


def _names(spark, sf_dir):
    return I.entries(spark, sf_dir).selectExpr("concat('E-', CAST(floor(ord * 3 / 20) AS BIGINT)) AS parent_id", "path AS spec_name").distinct()


@query("j1_trace_chain", f"{ENT}, {REQS_SQL}, {NAMES_SQL} SELECT DISTINCT req_id, spec_name, {BLOCK_SQL.replace('path', 'spec_name')} AS block_key FROM r JOIN n USING (parent_id)")
def j1(spark, sf_dir):
    return X.chain(_reqs(spark, sf_dir), _names(spark, sf_dir))


@query("j2_bridge", """WITH r AS (SELECT DISTINCT concat('X', c_custkey) AS parent_id, concat('R', c_custkey % 300) AS req_id FROM customer), n AS (SELECT DISTINCT concat('Y', s_suppkey) AS parent_id FROM supplier),
  b AS (SELECT concat('X', c_custkey) AS parent_id, concat('Y', c_custkey % 200) AS other_id FROM customer WHERE c_custkey % 2 = 0) SELECT parent_id, req_id FROM r UNION SELECT other_id, req_id FROM r JOIN b USING (parent_id)""")
def j2(spark, sf_dir):
    c, s = spark.read.parquet(f"{sf_dir}/customer.parquet"), spark.read.parquet(f"{sf_dir}/supplier.parquet")
    r = c.selectExpr("concat('X', c_custkey) AS parent_id", "concat('R', c_custkey % 300) AS req_id").distinct()
    b = c.where("c_custkey % 2 = 0").selectExpr("concat('X', c_custkey) AS parent_id", "concat('Y', c_custkey % 200) AS other_id")
    return X.bridged(r, s.selectExpr("concat('Y', s_suppkey) AS parent_id"), b)


SCOPE_SQL = f"""{ENT}, {NAMES_SQL}, r AS (SELECT concat('E-', o_custkey) AS parent_id, concat('R', o_orderkey) AS req_id, min(o_orderkey) AS ord FROM orders GROUP BY ALL),
  c AS (SELECT parent_id, string_agg(req_id, ',' ORDER BY ord) AS candidates, string_agg(CASE WHEN CAST(substr(req_id, 2) AS INTEGER) % 8 = 7 THEN req_id END, ',' ORDER BY ord) AS missing FROM r GROUP BY parent_id)"""


def _scope(spark, sf_dir):
    r = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("concat('E-', o_custkey) AS parent_id", "concat('R', o_orderkey) AS req_id", "o_orderkey AS ord")
    known = r.where("ord % 8 <> 7").select("req_id")
    return X.scope(_names(spark, sf_dir), r, known)


@query("j3_scope", f"{SCOPE_SQL} SELECT parent_id, spec_name, coalesce(candidates, '') AS candidates, coalesce(missing, '') AS missing FROM n LEFT JOIN c USING (parent_id)")
def j3(spark, sf_dir):
    return _scope(spark, sf_dir).select("parent_id", "spec_name", F.array_join("candidates", ",").alias("candidates"), F.array_join("missing", ",").alias("missing"))


@query("j4_located", f"{ENT}, {NAMES_SQL}, k AS (SELECT {BLOCK_SQL} AS block_key, string_agg(DISTINCT path, ',' ORDER BY path) AS paths FROM entry GROUP BY 1) SELECT parent_id, spec_name, coalesce(paths, '') AS paths FROM (SELECT *, {BLOCK_SQL.replace('path', 'spec_name')} AS block_key FROM n) LEFT JOIN k USING (block_key)")
def j4(spark, sf_dir):
    return X.located(_names(spark, sf_dir), I.entries(spark, sf_dir)).select("parent_id", "spec_name", F.array_join("paths", ",").alias("paths"))


@query("j5_traced_pool", f"{ENT}, k AS (SELECT ord, {BLOCK_SQL} AS block_key FROM entry) SELECT ord FROM k WHERE block_key IN (SELECT block_key FROM k WHERE ord % 400 = 0)")
def j5(spark, sf_dir):
    e = I.entries(spark, sf_dir).withColumn("block_key", T.block_key(F.col("path")))
    return X.traced_pool(e, e.where("ord % 400 = 0")).select("ord")


@query("j5_requirement_pools", f"{ENT}, {REQS_SQL}, {NAMES_SQL}, k AS (SELECT DISTINCT {BLOCK_SQL} AS block_key FROM entry WHERE ord % 3 > 0) SELECT DISTINCT req_id, block_key FROM (SELECT req_id, {BLOCK_SQL.replace('path', 'spec_name')} AS block_key FROM r JOIN n USING (parent_id)) JOIN k USING (block_key)")
def j5b(spark, sf_dir):
    blocks = I.entries(spark, sf_dir).where("ord % 3 > 0").select(T.block_key(F.col("path")).alias("block_key"))
    return X.requirement_pools(blocks, X.chain(_reqs(spark, sf_dir), _names(spark, sf_dir)))


@query("j6_fallback", "SELECT c_custkey AS req_id, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'matched' WHEN c_custkey % 3 = 0 THEN 'unmatched' ELSE 'uncertain' END AS status FROM customer")
def j6(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    first = c.selectExpr("c_custkey AS req_id", "CASE WHEN c_custkey % 3 = 0 THEN 'unmatched' ELSE 'uncertain' END AS status")
    return X.with_fallback(first, c.where("c_custkey % 2 = 0").selectExpr("c_custkey AS req_id", "'matched' AS status"))


@query("j7_group_union", "SELECT c_custkey AS req_id, CASE WHEN c_custkey % 4 = 0 THEN 'traced' ELSE 'full' END AS pool FROM customer")
def j7(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS req_id")
    traced = c.where("req_id % 4 = 0")
    return X.group_union(traced, c)


TRACE_SQL = """t AS (SELECT 'f' || (o_orderkey % 3) AS file, 's' || (o_orderkey % 5) AS sheet, CAST(o_orderkey // 15 + 1 AS INTEGER) AS row, CASE WHEN o_orderkey % 4 = 0 THEN concat('P-', o_custkey % 50) WHEN o_orderkey % 4 = 1 THEN 'None' END AS parent,
    CASE WHEN o_orderkey % 7 > 0 THEN concat('Q-', o_orderkey % 600) END AS other, CASE o_orderkey % 6 WHEN 0 THEN ' Skip ' ELSE 'core' END AS module FROM orders),
  f AS (SELECT *, last_value(CASE WHEN trim(parent) NOT IN ('', 'None') THEN parent END IGNORE NULLS) OVER (PARTITION BY file, sheet ORDER BY row ROWS UNBOUNDED PRECEDING) AS filled FROM t WHERE row >= 2 AND (parent IS NOT NULL OR other IS NOT NULL))"""


def trace_cells(spark, sf_dir, parent, other, module=None):
    t = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("concat('f', o_orderkey % 3) AS file", "concat('s', o_orderkey % 5) AS sheet", "cast(o_orderkey div 15 + 1 as int) AS row",
        "CASE WHEN o_orderkey % 4 = 0 THEN concat('P-', o_custkey % 50) WHEN o_orderkey % 4 = 1 THEN 'None' END AS parent", "CASE WHEN o_orderkey % 7 > 0 THEN concat('Q-', o_orderkey % 600) END AS other", "CASE o_orderkey % 6 WHEN 0 THEN ' Skip ' ELSE 'core' END AS module")
    cells = [t.select("file", "sheet", "row", F.lit(col).alias("col"), F.col(c).alias("value")) for c, col in (("parent", parent), ("other", other), ("module", module)) if col is not None]
    out = cells[0]
    for c in cells[1:]:
        out = out.union(c)
    return out.where("value is not null")


@query("s10_parent_names", f"WITH {TRACE_SQL} SELECT DISTINCT filled AS parent_id, other AS spec_name FROM f WHERE filled IS NOT NULL AND other IS NOT NULL")
def s10(spark, sf_dir):
    return X.parent_names(trace_cells(spark, sf_dir, 3, 7))


@query("s11_parent_requirements", f"WITH {TRACE_SQL} SELECT DISTINCT filled AS parent_id, other AS req_id FROM f WHERE filled IS NOT NULL AND other IS NOT NULL AND module = 'core'")
def s11(spark, sf_dir):
    return X.parent_requirements(trace_cells(spark, sf_dir, 0, 3, 4), spark.createDataFrame([("SKIP",)], "module string"))


@query("s12_adaptive", f"""WITH {TRACE_SQL}, g AS (
    SELECT file, sheet, row, last_value(CASE WHEN trim(parent) NOT IN ('', 'None', '#N/A') THEN parent END IGNORE NULLS) OVER (PARTITION BY file, sheet ORDER BY row ROWS UNBOUNDED PRECEDING) AS parent_id, other FROM t WHERE row >= 4 AND (parent IS NOT NULL OR other IS NOT NULL)),
  d AS (SELECT * FROM g WHERE parent_id IS NOT NULL AND other IS NOT NULL), b AS (SELECT file, sheet, row_number() OVER (PARTITION BY file ORDER BY count(DISTINCT parent_id) DESC, sheet) AS rn FROM d GROUP BY file, sheet)
  SELECT DISTINCT parent_id, other FROM d JOIN b USING (file, sheet) WHERE rn = 1""")
def s12(spark, sf_dir):
    cells = trace_cells(spark, sf_dir, 2, 5).where("row >= 4")
    sheets = cells.select("file", "sheet").distinct()
    head = lambda row, col, value: sheets.select("file", "sheet", F.lit(row).alias("row"), F.lit(col).alias("col"), F.lit(value).alias("value"))
    cells = cells.union(head(1, 0, "A title")).union(head(3, 2, "Parent id")).union(head(3, 5, "Other NAME"))
    return X.adaptive_pairs(cells, ["parent"], ["name"])


#: A file for each nation: its customers' ids in two columns, one in seven in another namespace, and other words around them.
_BRIDGE = """CASE WHEN col = file % 3 THEN concat(CASE WHEN c_custkey % 7 = 0 THEN 'X-' ELSE 'A-' END, c_custkey) WHEN col = file % 3 + 4 THEN concat('B-', c_custkey) WHEN c_custkey % 9 = 0 THEN 'A-1' WHEN c_custkey % 10 = 0 THEN 'B-1' ELSE c_mktsegment END"""


@query("s13_bridge_columns", f"""WITH t AS (SELECT c_nationkey AS file, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + 2 AS row, c_custkey, c_mktsegment, unnest(range(0, 9)) AS col FROM customer),
  look AS (SELECT file, col, split_part({_BRIDGE}, '-', 1) AS prefix FROM t WHERE row BETWEEN 3 AND 100 AND col < 8),
  best AS (SELECT file, col, prefix, row_number() OVER (PARTITION BY file, prefix ORDER BY count(*) DESC, col) AS r FROM look WHERE prefix IN ('A', 'B') GROUP BY file, col, prefix)
  SELECT CAST(a.file AS BIGINT) AS file, a.col AS left_col, b.col AS right_col FROM best a JOIN best b USING (file) WHERE a.r = 1 AND b.r = 1 AND a.prefix = 'A' AND b.prefix = 'B' AND a.col <> b.col""")
def s13(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_nationkey AS file", "row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + 2 AS row", "c_custkey", "c_mktsegment")
    cells = c.selectExpr("*", "explode(sequence(0, 8)) AS col").selectExpr("file", "row", "col", f"{_BRIDGE} AS value")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    ids = lambda kind: orders.select(F.concat(F.lit(kind), "o_custkey").alias("id"))
    return X.bridge_columns(cells, ids("A-"), ids("B-")).selectExpr("cast(file as long) file", "cast(left_col as long) left_col", "cast(right_col as long) right_col")


@query("s15_sheet_choice", "SELECT concat(p_brand, p_size) AS file, coalesce(min(CASE WHEN p_name LIKE '%bolt%' THEN p_partkey END), list_sort(list(p_partkey))[3], min(p_partkey)) AS sheet FROM part GROUP BY 1")
def s15(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return X.chosen_sheets(p.selectExpr("concat(p_brand, p_size) AS file", "p_partkey AS ord", "p_name AS name"), ["Bolt"], 2).withColumnRenamed("ord", "sheet")


@query("s16_input_errors", "SELECT p_partkey AS file, CASE WHEN p_size % 5 = 0 THEN 'missing_sheet' WHEN p_size % 3 = 0 THEN 'missing_columns:b' ELSE 'missing_columns:a,b' END AS error FROM part WHERE p_size % 5 = 0 OR p_size % 3 < 2")
def s16(spark, sf_dir):
    f = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS file", "CASE WHEN p_size % 5 <> 0 THEN 's' END AS sheet", "CASE p_size % 3 WHEN 0 THEN array('a') WHEN 2 THEN array('b', 'a') END AS columns")
    return X.input_errors(f, ["a", "b"])


@query("s18_ruleset", "SELECT p_partkey AS file, CASE WHEN p_size >= 20 AND p_brand LIKE 'Brand#1%' THEN 'alpha' ELSE 'beta' END AS ruleset FROM part WHERE p_size >= 20 AND p_brand LIKE 'Brand#1%' OR p_size >= 5 AND p_brand LIKE 'Brand#%'")
def s18(spark, sf_dir):
    shapes = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS file", "p_size AS columns", "p_brand AS first_cell")
    return X.detected_ruleset(shapes, spark.createDataFrame([("beta", 5, "Brand#"), ("alpha", 20, "Brand#1")], "ruleset string, min_columns int, prefix string"))


@query("s19_catalogue", """WITH r AS (SELECT p_partkey % 7 AS file, p_partkey // 100 AS table_ord, p_partkey AS row, unnest(CASE WHEN p_partkey % 2 = 0 THEN [concat('LBL_', p_size), concat('LBL_', p_size, '_R1')] ELSE [concat('LBL_', p_size)] END) AS name, CAST(p_partkey % 64 AS STRING) AS o, CASE WHEN p_partkey % 3 = 0 THEN concat('S', p_partkey % 5) END AS sdi FROM part),
  k AS (SELECT * FROM r WHERE regexp_full_match(o, '[0-7]{2,}')) SELECT name, lpad(arg_max(o, (table_ord, row)), 3, '0') AS octal, arg_max(sdi, (table_ord, row)) FILTER (WHERE sdi IS NOT NULL) AS sdi FROM k GROUP BY name""")
def s19(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    c = p.selectExpr("p_partkey % 7 AS file", "p_partkey div 100 AS table_ord", "p_partkey AS row", "explode(map(0, concat('LBL_', p_size, CASE WHEN p_partkey % 2 = 0 THEN '_R1' ELSE '' END), 1, cast(p_partkey % 64 as string), 2, CASE WHEN p_partkey % 3 = 0 THEN concat('S', p_partkey % 5) END, 4, 'x', 5, 'y')) AS (col, value)")
    return X.catalogue(c)
