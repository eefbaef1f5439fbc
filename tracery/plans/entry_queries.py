"""F1-F10, P1-P14, S2-S4 and A1-A7 over the entry role."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cluster as K
from ..operators import entries as E
from . import inputs as I
from .registry import query
from .text_queries import BLOCK_SQL, IDENTITY_SQL, PROFILE_SQL, PROTOCOL_SQL

ENT = "WITH " + I.ENTRY_CTE
VALUED = "v AS (SELECT * FROM entry WHERE length(trim(coalesce(value, ''))) > 0)"
WIN_SQL = f"{ENT}, {VALUED}, w AS (SELECT *, min(ord) OVER (PARTITION BY path, attr) AS first, max(CASE WHEN side = 'DP' THEN 1 ELSE 0 END) OVER (PARTITION BY path, attr) AS p FROM v), win AS (SELECT * FROM w WHERE p = 0 OR side = 'DP')"
LAYOUT = ["BitOffset", "OneState"]
FINAL_SQL = f"""{WIN_SQL}, d AS (SELECT *, row_number() OVER (PARTITION BY path, attr, value, CASE WHEN attr IN ('BitOffset', 'OneState') THEN ref_name END ORDER BY first, ord) AS rn FROM win),
  final AS (SELECT *, row_number() OVER (ORDER BY first, ord) AS seq FROM d WHERE rn = 1)"""


def _valued(spark, sf_dir):
    return E.with_value(I.entries(spark, sf_dir))


def _final(spark, sf_dir):
    return E.numbered(E.dedup_all(E.publisher_wins(_valued(spark, sf_dir)), LAYOUT))


@query("f1_fill_forward", """WITH t AS (SELECT event_id, event_type, CASE event_id % 5 WHEN 0 THEN concat('E', user_id) WHEN 1 THEN 'None' WHEN 2 THEN ' ' END AS parent FROM events)
  SELECT event_id, last_value(CASE WHEN trim(parent) NOT IN ('', 'None') THEN parent END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS parent FROM t""")
def f1(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "event_type", "CASE event_id % 5 WHEN 0 THEN concat('E', user_id) WHEN 1 THEN 'None' WHEN 2 THEN ' ' END AS parent")
    return E.fill_forward(e, "parent", ["event_type"], ["event_id"]).select("event_id", "parent")


@query("f2_sheet_dedup", f"{ENT} SELECT ord FROM (SELECT ord, row_number() OVER (PARTITION BY sheet, side, layer, path, attr, value, ref_name ORDER BY ord) AS rn FROM entry) WHERE rn = 1")
def f2(spark, sf_dir):
    return E.dedup_in_sheet(I.entries(spark, sf_dir)).select("ord")


@query("f2_layer_counts", f"{ENT} SELECT sheet, layer, count(*) AS entries FROM entry GROUP BY ALL")
def f2b(spark, sf_dir):
    return E.layer_counts(I.entries(spark, sf_dir))


@query("f3_publisher_wins", f"{WIN_SQL} SELECT ord, first FROM win")
def f3(spark, sf_dir):
    return E.publisher_wins(_valued(spark, sf_dir)).select("ord", F.col("ord2.first").alias("first"))


@query("f4_global_dedup", f"{FINAL_SQL} SELECT ord FROM final")
def f4(spark, sf_dir):
    return E.dedup_all(E.publisher_wins(_valued(spark, sf_dir)), LAYOUT).select("ord")


@query("f5_entry_ids", f"{FINAL_SQL} SELECT ord, seq, concat('IRD-', bus, '-', substr(layer, 1, 6), '-', CASE WHEN seq < 10000 THEN lpad(CAST(seq AS STRING), 4, '0') ELSE CAST(seq AS STRING) END) AS entry_id FROM final")
def f5(spark, sf_dir):
    return _final(spark, sf_dir).select("ord", F.col("seq").cast("long").alias("seq"), "entry_id")


@query("f6_counters", f"{FINAL_SQL} SELECT (SELECT count(*) FROM entry) AS generated, (SELECT count(*) FROM v) AS raw, (SELECT count(*) FROM final) AS after_dedup, (SELECT count(*) FROM entry) - (SELECT count(*) FROM final) AS removed")
def f6(spark, sf_dir):
    return E.counters(I.entries(spark, sf_dir), _valued(spark, sf_dir), E.dedup_all(E.publisher_wins(_valued(spark, sf_dir)), LAYOUT))


ROWS_SQL = f"{ENT}, r AS (SELECT sheet, ord // 8 AS row, side, attr, max(value) AS value FROM entry GROUP BY ALL)"


def _rows(spark, sf_dir):
    return I.entries(spark, sf_dir).groupBy("sheet", F.expr("ord div 8").alias("row"), "side", "attr").agg(F.max("value").alias("value"))


@query("f7_subscriber_override", f"""{ROWS_SQL}, pub AS (SELECT * FROM r WHERE side = 'DP'), sub AS (SELECT * FROM r WHERE side = 'RP'), has AS (SELECT DISTINCT sheet, row FROM pub),
  every AS (SELECT sheet, row, attr FROM sub UNION SELECT p.sheet, p.row, p.attr FROM pub p SEMI JOIN sub USING (sheet, row) UNION SELECT s.sheet, s.row, a FROM sub s JOIN has USING (sheet, row), (VALUES ('DataFormatType'), ('Size')) x(a))
  SELECT e.sheet, e.row, e.attr, CASE WHEN e.attr IN ('Label') THEN coalesce(sub.value, pub.value) ELSE coalesce(pub.value, sub.value) END AS value
  FROM every e LEFT JOIN sub ON (e.sheet, e.row, e.attr) = (sub.sheet, sub.row, sub.attr) LEFT JOIN pub ON (e.sheet, e.row, e.attr) = (pub.sheet, pub.row, pub.attr)
  WHERE e.attr = 'Label' OR EXISTS (SELECT 1 FROM has WHERE has.sheet = e.sheet AND has.row = e.row)""")
def f7(spark, sf_dir):
    return E.subscriber_override(_rows(spark, sf_dir), ["Label"], ["DataFormatType", "Size"])


@query("f8_publisher_reissue", f"{ENT} SELECT ord, 'DP' AS side, path, attr, value FROM entry WHERE side = 'RP' AND attr IN ('CodedSet', 'Units') UNION ALL SELECT ord, side, path, attr, value FROM entry WHERE side = 'DP'")
def f8(spark, sf_dir):
    e = I.entries(spark, sf_dir).select("ord", "side", "path", "attr", "value")
    return E.publisher_reissue(e, ["CodedSet", "Units"])


@query("f9_reference_rows", f"{ENT} SELECT ord, path, attr, value, ref_name FROM entry WHERE ref_name IS NOT NULL AND attr IN ('BitOffset', 'DataFormatType')")
def f9(spark, sf_dir):
    return E.reference_rows(I.entries(spark, sf_dir), ["BitOffset", "DataFormatType"]).select("ord", "path", "attr", "value", "ref_name")


@query("f10_ordered_distinct", f"{ENT}, f AS (SELECT path, attr, min(ord) AS o FROM entry GROUP BY ALL) SELECT path, string_agg(attr, ',' ORDER BY o) AS attrs FROM f GROUP BY path")
def f10(spark, sf_dir):
    return E.ordered_distinct(I.entries(spark, sf_dir), "path", "attr").select("path", F.array_join("values", ",").alias("attrs"))


@query("p1_excluded_attributes", f"{ENT} SELECT ord FROM entry WHERE attr NOT IN ('Label', 'Units')")
def p1(spark, sf_dir):
    return E.without_attributes(I.entries(spark, sf_dir), spark.createDataFrame([("Label",), ("Units",)], "attr string")).select("ord")


@query("p2_empty_values", f"{ENT}, {VALUED} SELECT ord FROM v")
def p2(spark, sf_dir):
    return _valued(spark, sf_dir).select("ord")


@query("p4_unpivot", """WITH l AS (SELECT p_partkey, 0 AS depth, 'Port' AS layer, split_part(p_name, ' ', 1) AS path, p_brand AS name FROM part UNION ALL
    SELECT p_partkey, 1, 'DP', CASE WHEN split_part(p_name, ' ', 1) = split_part(p_name, ' ', 2) THEN split_part(p_name, ' ', 1) ELSE concat(split_part(p_name, ' ', 1), '.', split_part(p_name, ' ', 2)) END, p_type FROM part)
  SELECT p_partkey AS id, layer, path, 'kind' AS attr, name AS value FROM l UNION ALL SELECT p_partkey, layer, path, 'size', CAST(p_size AS STRING) FROM l JOIN part USING (p_partkey) WHERE layer = 'DP'""")
def p4(spark, sf_dir):
    layers = F.expr("""array(named_struct('name', split_part(p_name, ' ', 1), 'kind', 'Port', 'attrs', map('kind', p_brand, 'skip', 'x', 'none', ' ')),
      named_struct('name', split_part(p_name, ' ', 2), 'kind', 'DP', 'attrs', map('kind', p_type, 'size', cast(p_size as string))))""")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), layers.alias("layers"))
    out = E.unpivot_layers(rows, ["skip"])
    return out.select("id", F.when(F.col("depth") == 0, "Port").otherwise("DP").alias("layer"), "path", "attr", "value")


NAMES, UNITS = [("Label", "label word"), ("CodedSet", "coded set")], [("BitOffset", "bits")]


@query("p5_descriptions", f"""{ENT}, {VALUED} SELECT ord, concat(CASE attr WHEN 'Label' THEN 'label word' WHEN 'CodedSet' THEN 'coded set' ELSE attr END, ' of ', path, ' is ', value, CASE WHEN attr = 'BitOffset' THEN ' bits' ELSE '' END, CASE WHEN ref_name IS NOT NULL THEN concat(' (by ', ref_name, ')') ELSE '' END) AS description FROM v""")
def p5(spark, sf_dir):
    return E.described(_valued(spark, sf_dir), spark.createDataFrame(NAMES, "attr string, display string"), spark.createDataFrame(UNITS, "attr string, unit string")).select("ord", "description")


@query("p8_overhead", f"{ENT} SELECT ord FROM entry WHERE NOT coalesce(attr = 'DataFormatType' AND value IN ('0', '1'), FALSE)")
def p8(spark, sf_dir):
    return E.without_overhead(I.entries(spark, sf_dir), ["0", "1"]).select("ord")


@query("p9_leaves", f"{ENT} SELECT ord FROM entry WHERE layer IN ('DP', 'RP')")
def p9(spark, sf_dir):
    return E.leaves(I.entries(spark, sf_dir)).select("ord")


CATALOGUE = [("PUMP1", "first pump"), ("PUMP7", "spare pump")]


@query("p10_annotated_content", f"""WITH {I.REQ_CTE} SELECT req_id, concat(content, CASE WHEN content LIKE '%PUMP1%' THEN ' [PUMP1 = first pump]' WHEN content LIKE '%PUMP7%' THEN ' [PUMP7 = spare pump]' ELSE '' END) AS content FROM req""")
def p10(spark, sf_dir):
    reqs = I.requirements(spark, sf_dir).select("req_id", "content")
    return E.annotated_content(reqs, spark.createDataFrame(CATALOGUE, "token string, meaning string"), "(PUMP[0-9]+)")


LEAVES_SQL = f"{ENT}, l AS (SELECT *, {PROFILE_SQL} AS profile_key, {BLOCK_SQL} AS block_key FROM entry WHERE layer IN ('DP', 'RP') AND length(trim(coalesce(value, ''))) > 0)"
_FIRST = "first_v AS (SELECT profile_key, attr, value FROM (SELECT *, row_number() OVER (PARTITION BY profile_key, attr ORDER BY CASE side WHEN 'DP' THEN 0 ELSE 1 END, ord) AS rn FROM l) WHERE rn = 1 AND attr <> 'CodedSet')"
_MANY = "many AS (SELECT profile_key, 'CodedSet' AS attr, string_agg(value, '/' ORDER BY s, o) AS value FROM (SELECT profile_key, value, s, o FROM (SELECT profile_key, value, CASE side WHEN 'DP' THEN 0 ELSE 1 END AS s, ord AS o, row_number() OVER (PARTITION BY profile_key, value ORDER BY CASE side WHEN 'DP' THEN 0 ELSE 1 END, ord) AS k FROM l WHERE attr = 'CodedSet') WHERE k = 1) GROUP BY profile_key)"
PROFILES_SQL = f"{LEAVES_SQL}, {_FIRST}, {_MANY}, attrs AS (SELECT * FROM first_v UNION ALL SELECT * FROM many)"


def leaf_profiles(spark, sf_dir):
    return K.profiles(E.leaves(_valued(spark, sf_dir)))


def _attrs():
    return F.array_join(F.array_sort(F.transform(F.map_entries("attrs"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";").alias("attrs")


@query("a1_profiles", f"""{PROFILES_SQL}, a AS (SELECT profile_key, string_agg(attr || '=' || value, ';' ORDER BY attr || '=' || value) AS attrs FROM attrs GROUP BY profile_key)
  SELECT profile_key, any_value(block_key) AS block_key, CASE WHEN count(DISTINCT side) > 1 THEN 'bidirectional' WHEN min(side) = 'DP' THEN 'send' ELSE 'receive' END AS direction, string_agg(DISTINCT bus, ',' ORDER BY bus) AS buses, count(*) AS n_entries, any_value(attrs) AS attrs
  FROM l JOIN a USING (profile_key) GROUP BY profile_key""")
def a1(spark, sf_dir):
    return leaf_profiles(spark, sf_dir).select("profile_key", "block_key", "direction", F.array_join("buses", ",").alias("buses"), "n_entries", _attrs())


@query("a2_blocks", f"""{PROFILES_SQL}, p AS (SELECT profile_key, any_value(block_key) AS block_key, min(ord) AS ord, CASE WHEN count(DISTINCT side) > 1 THEN 'bidirectional' WHEN min(side) = 'DP' THEN 'send' ELSE 'receive' END AS direction FROM l GROUP BY profile_key),
  p2 AS (SELECT * FROM p WHERE regexp_replace(block_key, '^.*/', '') <> 'LABEL'), pa AS (SELECT block_key, attr, value, ord, profile_key FROM p2 JOIN attrs USING (profile_key)),
  f AS (SELECT block_key, attr, value FROM (SELECT *, row_number() OVER (PARTITION BY block_key, attr ORDER BY ord, profile_key) AS rn FROM pa) WHERE rn = 1 AND attr <> 'CodedSet'),
  m AS (SELECT block_key, 'CodedSet' AS attr, string_agg(value, '/' ORDER BY ord, profile_key) AS value FROM (SELECT *, row_number() OVER (PARTITION BY block_key, value ORDER BY ord, profile_key) AS k FROM pa WHERE attr = 'CodedSet') WHERE k = 1 GROUP BY block_key),
  a AS (SELECT block_key, string_agg(attr || '=' || value, ';' ORDER BY attr || '=' || value) AS attrs FROM (SELECT * FROM f UNION ALL SELECT * FROM m) GROUP BY block_key)
  SELECT block_key, regexp_extract(block_key, '^(L[0-9]+)/', 1) AS label, CASE WHEN count(DISTINCT direction) > 1 THEN 'bidirectional' ELSE min(direction) END AS direction, count(*) AS channel_count, any_value(attrs) AS attrs FROM p2 JOIN a USING (block_key) GROUP BY block_key""")
def a2(spark, sf_dir):
    return K.blocks(leaf_profiles(spark, sf_dir), ["LABEL"]).select("block_key", "label", "direction", "channel_count", _attrs())


@query("a3_anchors", f"""{LEAVES_SQL}, f AS (SELECT DISTINCT regexp_extract(block_key, '^(L[0-9]+)/', 1) AS label, attr AS name, coalesce(TRY_CAST(value AS INTEGER), 999) AS place FROM l WHERE block_key LIKE 'L1%')
  SELECT label, string_agg(concat(place, ':', name), ',' ORDER BY place, name) AS anchors FROM f GROUP BY label""")
def a3(spark, sf_dir):
    e = E.leaves(_valued(spark, sf_dir)).withColumn("label", F.regexp_extract(T.block_key(F.col("path")), "^(L[0-9]+)/", 1)).where("label like 'L1%'")
    out = K.anchors(e.select("label", F.col("attr").alias("name"), F.col("value").alias("offset")))
    return out.select("label", F.array_join(F.transform("anchors", lambda a: F.concat_ws(":", a["at"], a["name"])), ",").alias("anchors"))


@query("a4_sub_signals", """WITH b AS (SELECT DISTINCT concat('B', p_partkey % 300) AS block_key, concat('F', p_partkey % 300) AS family, p_size % 8 AS o FROM part), m AS (SELECT block_key FROM b GROUP BY 1 HAVING count(DISTINCT o) > 1)
  SELECT block_key, o AS "offset", CASE WHEN o % 2 = 0 THEN concat('ref', o) WHEN o % 3 = 0 THEN concat('pub', o) WHEN o = 5 THEN 'sib' ELSE family END AS name, CASE WHEN o % 2 = 0 THEN 2 ELSE 1 END AS size FROM b JOIN m USING (block_key)""")
def a4(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("concat('B', p_partkey % 300) AS block_key", "concat('F', p_partkey % 300) AS family", "p_size % 8 AS offset").distinct()
    look = lambda where, name, size: b.where(where).selectExpr("block_key", "offset", f"{name} AS name", f"{size} AS size", "'BNR' AS dtype")
    return K.sub_signals(b, look("offset % 2 = 0", "concat('ref', offset)", 2), look("offset % 3 = 0", "concat('pub', offset)", 1), look("offset = 5", "'sib'", 1)).select("block_key", "offset", "name", "size")


@query("a5_forward_blocks", f"""{ENT}, i AS (SELECT *, {PROTOCOL_SQL} AS protocol, {IDENTITY_SQL} AS identity FROM entry)
  SELECT identity, protocol, count(DISTINCT CASE WHEN side = 'DP' THEN path END) AS publishers, count(DISTINCT CASE WHEN side = 'RP' THEN path END) AS subscribers, md5(string_agg(CAST(ord AS STRING), ',' ORDER BY ord)) AS ids, string_agg(DISTINCT device, ',' ORDER BY device) AS devices FROM i GROUP BY identity, protocol""")
def a5(spark, sf_dir):
    out = K.forward_blocks(I.entries(spark, sf_dir).withColumn("entry_id", F.col("ord").cast("string")))
    return out.select("identity", "protocol", F.size("publisher_names").cast("long").alias("publishers"), F.size("subscriber_names").cast("long").alias("subscribers"), F.md5(F.array_join("entry_ids", ",")).alias("ids"), F.array_join("devices", ",").alias("devices"))


@query("a6_sdi", """WITH e AS (SELECT concat('L', p_size) AS label, concat('L', p_size, '/', p_partkey % 3) AS block_key, CASE p_partkey % 5 WHEN 0 THEN 'NA' WHEN 1 THEN '' ELSE CAST(p_partkey % 2 AS STRING) END AS sdi FROM part),
  k AS (SELECT *, CASE WHEN sdi NOT IN ('NA', '') THEN sdi END AS s FROM e), l AS (SELECT label, count(DISTINCT s) > 1 AS discriminates FROM k GROUP BY label)
  SELECT label, block_key, CASE WHEN count(DISTINCT s) = 1 THEN min(s) END AS sdi, any_value(discriminates) AS discriminates FROM k JOIN l USING (label) GROUP BY label, block_key""")
def a6(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("concat('L', p_size) AS label", "concat('L', p_size, '/', p_partkey % 3) AS block_key", "CASE p_partkey % 5 WHEN 0 THEN 'NA' WHEN 1 THEN '' ELSE CAST(p_partkey % 2 AS STRING) END AS sdi")
    return K.sdi_discriminates(e)


@query("a7_own_bit_range", """WITH f AS (SELECT p_partkey AS ord, concat('B', p_partkey % 700) AS block_key, p_partkey % 4 <> 0 AS is_ref, p_name, p_size % 16 AS o, p_size % 3 + 1 AS size FROM part),
  own AS (SELECT block_key, arg_min(o, ord) AS o, arg_min(size, ord) AS size FROM f WHERE NOT is_ref GROUP BY block_key),
  refs AS (SELECT block_key, count(*) AS n, min(o) AS o, min(size) AS size FROM f WHERE is_ref AND p_name LIKE '%bolt%' GROUP BY block_key)
  SELECT block_key, o AS "offset", size FROM own UNION ALL SELECT block_key, o, size FROM refs ANTI JOIN own USING (block_key) WHERE n = 1""")
def a7(spark, sf_dir):
    f = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS ord", "concat('B', p_partkey % 700) AS block_key", "'BOLT_STATE' AS family", "p_partkey % 4 <> 0 AS is_ref", "p_name AS ref_name", "p_size % 16 AS offset", "p_size % 3 + 1 AS size")
    return K.own_bit_range(f)


CELLS_SQL = """cells AS (SELECT concat('CAN-', p_partkey) AS sheet, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col,
    CASE WHEN row = 1 THEN CASE WHEN col = 0 THEN 'Publisher' WHEN col = 4 AND p_partkey % 2 = 0 THEN 'Subscriber' END WHEN row = 2 THEN CASE col WHEN 0 THEN 'Port' WHEN 2 THEN 'DP' WHEN 4 THEN 'RP' END
      WHEN row = 3 THEN CASE col WHEN 1 THEN 'Size' WHEN 3 THEN 'Unit' WHEN 5 THEN ' ' ELSE 'Name' END WHEN (row + col) % 5 > 0 THEN concat(p_brand, row, col) END AS value
  FROM part, (SELECT unnest(range(1, 8)) AS row), (SELECT unnest(range(0, 6)) AS col))"""


def sheet_cells(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("*", "explode(sequence(1, 7)) AS row").selectExpr("*", "explode(sequence(0, 5)) AS col")
    return p.selectExpr("concat('CAN-', p_partkey) AS sheet", "row", "col", """CASE WHEN row = 1 THEN CASE WHEN col = 0 THEN 'Publisher' WHEN col = 4 AND p_partkey % 2 = 0 THEN 'Subscriber' END WHEN row = 2 THEN CASE col WHEN 0 THEN 'Port' WHEN 2 THEN 'DP' WHEN 4 THEN 'RP' END
      WHEN row = 3 THEN CASE col WHEN 1 THEN 'Size' WHEN 3 THEN 'Unit' WHEN 5 THEN ' ' ELSE 'Name' END WHEN (row + col) % 5 > 0 THEN concat(p_brand, row, col) END AS value""")


@query("s2_side_starts", f"WITH {CELLS_SQL}, s AS (SELECT sheet, value AS side, min(col) AS start FROM cells WHERE row = 1 AND value IN ('Publisher', 'Subscriber') GROUP BY ALL) SELECT *, CAST(lead(start) OVER (PARTITION BY sheet ORDER BY start) AS STRING) AS stop FROM s")
def s2(spark, sf_dir):
    return E.side_starts(sheet_cells(spark, sf_dir), ["Publisher", "Subscriber"]).withColumn("stop", F.col("stop").cast("string"))


_S3 = """s AS (SELECT sheet, value AS side, col AS s0, lead(col) OVER (PARTITION BY sheet ORDER BY col) AS s1 FROM cells WHERE row = 1 AND value IS NOT NULL),
  h AS (SELECT c.sheet, side, c.value AS layer, c.col AS start, s1 FROM cells c JOIN s ON c.sheet = s.sheet AND c.col >= s0 AND (s1 IS NULL OR c.col < s1) WHERE c.row = 2 AND c.value IS NOT NULL),
  ranges AS (SELECT sheet, side, layer, start, coalesce(lead(start) OVER (PARTITION BY sheet, side ORDER BY start), s1) AS stop FROM h)"""


@query("s3_layer_ranges", f"WITH {CELLS_SQL}, {_S3} SELECT * REPLACE (CAST(stop AS STRING) AS stop) FROM ranges")
def s3(spark, sf_dir):
    c = sheet_cells(spark, sf_dir)
    return E.layer_ranges(c, E.side_starts(c, ["Publisher", "Subscriber"])).withColumn("stop", F.col("stop").cast("string"))


@query("s4_layer_values", f"""WITH {CELLS_SQL}, {_S3}, a AS (SELECT c.sheet, c.col, side, layer, start, c.value AS attr FROM cells c JOIN ranges r ON c.sheet = r.sheet AND c.col >= start AND (stop IS NULL OR c.col < stop) WHERE c.row = 3 AND trim(c.value) <> '')
  SELECT c.sheet, c.row, side, layer, start, attr, arg_max(c.value, c.col) AS value FROM cells c JOIN a USING (sheet, col) WHERE c.row > 3 AND c.value IS NOT NULL GROUP BY ALL""")
def s4(spark, sf_dir):
    c = sheet_cells(spark, sf_dir)
    return E.layer_values(c, E.layer_ranges(c, E.side_starts(c, ["Publisher", "Subscriber"])))
