"""T1-T32 and P3-P12 over the requirement and entry roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import text as T
from . import inputs as I
from .registry import query

ANALOG, DISCRETE, BUS = ["analog"], ["discrete"], ["bus"]
STRONG_SEND, STRONG_RECEIVE, SEND, RECEIVE = ["transmit"], ["acquire"], ["send"], ["use"]
NOISE = ["SDI", "THE", "UNIT", "SHALL"]
REQ = "WITH " + I.REQ_CTE


def content():
    return F.col("content")


def path():
    return F.col("path")


def _req(spark, sf_dir, **columns):
    return I.requirements(spark, sf_dir).select("req_id", *(c.alias(k) for k, c in columns.items()))


def _labels(c: str) -> str:
    return f"list_transform(regexp_extract_all({c}, '[Ll][0-9]+'), lambda x: upper(x))"


def _distinct(c: str) -> str:
    """First-seen distinct in DuckDB."""
    return f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"


@query("t1_labels", f"{REQ} SELECT req_id, array_to_string({_distinct(_labels('content'))}, ',') AS labels FROM req")
def t1(spark, sf_dir):
    return _req(spark, sf_dir, labels=F.array_join(T.labels(content()), ","))


@query("t2_category", f"""{REQ} SELECT req_id, CASE WHEN regexp_matches(content, '[Ll][0-9]+') THEN 'label' WHEN content ILIKE '%analog%' THEN 'analog' WHEN content ILIKE '%discrete%' THEN 'discrete' WHEN content ILIKE '%bus%' THEN 'bus' ELSE 'other' END AS category FROM req""")
def t2(spark, sf_dir):
    return _req(spark, sf_dir, category=T.category(content(), ANALOG, DISCRETE, BUS))


@query("t3_direction", f"""{REQ} SELECT req_id, CASE WHEN s AND NOT r THEN 'send' WHEN r AND NOT s THEN 'receive' WHEN (s OR a) AND NOT (r OR b) THEN 'send' WHEN (r OR b) AND NOT (s OR a) THEN 'receive' ELSE '' END AS direction
  FROM (SELECT req_id, content ILIKE '%transmit%' AS s, content ILIKE '%acquire%' AS r, content ILIKE '%send%' AS a, content ILIKE '%use%' AS b FROM req)""")
def t3(spark, sf_dir):
    return _req(spark, sf_dir, direction=T.direction(content(), STRONG_SEND, STRONG_RECEIVE, SEND, RECEIVE))


@query("t4_sdi", f"{REQ} SELECT req_id, regexp_extract(content, '(?:^|[^A-Za-z0-9_])SDI[ :=]*([0-9]+)', 1) AS first, array_to_string(regexp_extract_all(content, '(?:^|[^A-Za-z0-9_])SDI[ :=]*([0-9]+)', 1), ',') AS every FROM req")
def t4(spark, sf_dir):
    return _req(spark, sf_dir, first=T.sdi_first(content()), every=F.array_join(T.sdi_all(content()), ","))


@query("t5_bit_fields", f"""{REQ}, p AS (SELECT req_id, ord, CAST(regexp_extract(content, 'bits ([0-9]+)-([0-9]+)', 1) AS INTEGER) AS a, CAST(regexp_extract(content, 'bits ([0-9]+)-([0-9]+)', 2) AS INTEGER) AS b FROM req)
  SELECT req_id, concat(least(a, b), ':', abs(a - b) + 1, CASE ord % 6 WHEN 0 THEN ',2:5,20:1' WHEN 1 THEN ',2:2' WHEN 2 THEN ',2:1,4:1' WHEN 3 THEN ',30:1' WHEN 4 THEN ',2:2,6:1' ELSE '' END) AS fields FROM p""")
def t5(spark, sf_dir):
    r = I.requirements(spark, sf_dir)
    more = F.expr("CASE ord % 6 WHEN 0 THEN '，第3到7位，第5位，第21位' WHEN 1 THEN '，第3和4位' WHEN 2 THEN '，第3和5位' WHEN 3 THEN ', bit 30 and bit 30' WHEN 4 THEN '，第3和4位，第4位，第7位' ELSE '' END")
    fields = F.transform(B.bit_fields(F.col("text")), lambda x: F.concat_ws(":", x["offset"], x["size"]))
    return r.select("req_id", F.concat("content", more).alias("text")).select("req_id", F.array_join(fields, ",").alias("fields"))


@query("t6_bit_values", f"""WITH t AS (SELECT event_id, event_id % 20 AS a, event_id % 20 + 1 + CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END AS b, event_id % 2 AS x, event_id // 2 % 2 AS y, event_id % 5 = 0 AS neg, event_id % 11 AS form FROM events)
  SELECT event_id, CASE WHEN form = 5 AND b - a > 1 AND NOT neg THEN concat(b, ':', 2 + y) WHEN b - a > 1 OR neg OR form IN (4, 5) THEN '' WHEN form IN (6, 7, 8) THEN concat(a - 1, ':', 2 * y + x) WHEN form = 3 THEN concat(a, ':', 2 * x + y) ELSE concat(a, ':', 2 * y + x) END AS assigned FROM t""")
def t6(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id", "event_id % 20 AS a", "event_id % 20 + 1 + CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END AS b", "event_id % 2 AS x", "event_id div 2 % 2 AS y", "CASE WHEN event_id % 5 = 0 THEN ' never' ELSE '' END AS neg", "CASE WHEN event_id % 5 = 0 THEN '不得将' ELSE '' END AS zh_neg")
    # a pair, single ones in either order, in two sentences, three in a row, Chinese positions, values in quotes, and a denial after the assertion
    text = F.expr("""concat(CASE event_id % 11 WHEN 2 THEN concat('It', neg, ' has bit', a, '=', x, ', bit', b, '=', y) WHEN 3 THEN concat('It', neg, ' has bit', b, '=', x, ', bit', a, '=', y)
      WHEN 4 THEN concat('It', neg, ' has bit', a, '=', x, '. bit', b, '=', y) WHEN 5 THEN concat('It', neg, ' has bit', a, '=', x, ', bit', b, '=', y, ', bit', b + 1, '=1') WHEN 6 THEN concat('It', neg, ' 第', a, '位置为', x, '，第', b, '位置为', y)
      WHEN 7 THEN concat(zh_neg, '第', a, '和', b, '位分别设置为“', x, '”和“', y, '”') WHEN 8 THEN concat(zh_neg, '第', a, '与第', b, '位为"', x, '"，"', y, '"') WHEN 9 THEN concat('It', neg, ' has bit', a, '=', x, ', bit', b, '=', y, ', not used otherwise')
      ELSE concat('Bits ', a, ' and ', b, ' are', neg, ' set to ', x, ' and ', y) END, '. Other text')""")
    values = F.transform(B.bit_values(F.col("text")), lambda v: F.concat_ws(":", v["offset"], v["value"]))
    return e.select("event_id", text.alias("text")).select("event_id", F.array_join(values, ",").alias("assigned"))


@query("t7_ranges", f"""{REQ}, p AS (SELECT req_id, CAST(regexp_extract(content, 'bits ([0-9]+)-([0-9]+)', 1) AS INTEGER) AS a, CAST(regexp_extract(content, 'bits ([0-9]+)-([0-9]+)', 2) AS INTEGER) AS b FROM req)
  SELECT req_id, CASE WHEN a < b THEN concat(a, '-', b) ELSE '' END AS ranges FROM p""")
def t7(spark, sf_dir):
    pairs = F.arrays_zip(F.regexp_extract_all(content(), F.lit("bits? ([0-9]+)-([0-9]+)"), F.lit(1)).alias("a"), F.regexp_extract_all(content(), F.lit("bits? ([0-9]+)-([0-9]+)"), F.lit(2)).alias("b"))
    ok = F.filter(pairs, lambda p: p["a"].cast("int") < p["b"].cast("int"))
    return _req(spark, sf_dir, ranges=F.array_join(F.array_distinct(F.transform(ok, lambda p: F.concat_ws("-", p["a"], p["b"]))), ","))


_PARTS = _distinct("list_transform(regexp_extract_all(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[A-Za-z]+'), lambda x: lower(x))")


@query("t8_name_parts", f"{REQ} SELECT req_id, array_to_string({_PARTS}, ',') AS parts FROM req")
def t8(spark, sf_dir):
    return _req(spark, sf_dir, parts=F.array_join(T.name_parts(F.col("name")), ","))


_IDS = "list_concat([upper(name)], list_filter(regexp_split_to_array(upper(name), '[_/]'), lambda x: length(x) >= 3))"


@query("t9_identifier_parts", f"{REQ} SELECT req_id, CASE WHEN regexp_full_match(name, '[A-Za-z][A-Za-z0-9_]{{2,}}') THEN array_to_string({_distinct(_IDS)}, ',') ELSE '' END AS parts FROM req")
def t9(spark, sf_dir):
    return _req(spark, sf_dir, parts=F.array_join(T.identifier_parts(F.col("name")), ","))


PHRASES = {"shall not": "PROHIBITED", "and B1": "SIDE_B1", "nowhere": "NEVER"}


@query("t10_text_tokens", f"""{REQ}, n AS (SELECT req_id, unnest(regexp_extract_all(content, '[A-Za-z][A-Za-z0-9_]{{2,}}')) AS name FROM req), p AS (SELECT req_id, unnest({_IDS}) AS t FROM n),
  d AS (SELECT req_id, t FROM p WHERE t NOT IN ('SDI', 'THE', 'UNIT', 'SHALL') UNION SELECT req_id, 'PROHIBITED' FROM req WHERE contains(content, 'shall not') UNION SELECT req_id, 'SIDE_B1' FROM req WHERE contains(content, 'and B1'))
  SELECT req_id, string_agg(DISTINCT t, ',' ORDER BY t) AS tokens FROM d GROUP BY req_id""")
def t10(spark, sf_dir):
    return _req(spark, sf_dir, tokens=F.array_join(F.array_sort(T.text_tokens(content(), NOISE, PHRASES)), ","))


SYNONYMS = [(0, "pump", "flow"), (0, "pump", "feed"), (1, "fan", "blower"), (2, "valve", "pos"), (3, "flow", "rate")]


@query("t11_synonyms", f"""{REQ}, s(g, canonical, alias) AS (VALUES {', '.join(map(str, SYNONYMS))}), m AS (SELECT g, canonical AS word FROM s UNION SELECT g, alias FROM s),
  t AS (SELECT DISTINCT req_id, unnest({_PARTS}) AS word FROM req), f AS (SELECT req_id, t.word, min(g) AS g FROM t JOIN m USING (word) GROUP BY ALL),
  e AS (SELECT req_id, word FROM t UNION SELECT f.req_id, m.word FROM f JOIN m USING (g)) SELECT req_id, string_agg(word, ',' ORDER BY word) AS words FROM e GROUP BY req_id""")
def t11(spark, sf_dir):
    s = spark.createDataFrame(SYNONYMS, "g int, canonical string, alias string")
    every = T.lists_with_synonyms(_req(spark, sf_dir, words=T.name_parts(F.col("name"))), s)
    return every.select("req_id", F.array_join("words", ",").alias("words"))


ENT = "WITH " + I.ENTRY_CTE
_SEG = "string_split(path, '.')"
_LAB = f"regexp_extract(list_filter({_SEG}, lambda s: regexp_matches(s, '^L[0-9]+'))[1], '^(L[0-9]+)', 1)"
_LEAF = f"{_SEG}[-1]"
PROFILE_SQL = f"CASE WHEN regexp_matches({_LEAF}, '^L[0-9]+') AND len(list_filter({_SEG}, lambda s: regexp_matches(s, '^L[0-9]+'))) = 1 THEN concat({_LAB}, '/__label__') WHEN len(list_filter({_SEG}, lambda s: regexp_matches(s, '^L[0-9]+'))) > 0 THEN concat({_LAB}, '/', {_LEAF}) ELSE concat({_SEG}[-2], '/', {_LEAF}) END"
BLOCK_SQL = f"CASE WHEN len(list_filter({_SEG}, lambda s: regexp_matches(s, '^L[0-9]+'))) > 0 THEN concat({_LAB}, '/', regexp_replace({_LEAF}, '^L[0-9]+_(?:[0-9]+_)?[A-Z]+[0-9]+_', '')) ELSE concat({_SEG}[-2], '/', {_LEAF}) END"
FAMILY_SQL = f"regexp_replace({_LEAF}, '^L[0-9]+_(?:[0-9]+_)?[A-Z]+[0-9]+_', '')"
PROTOCOL_SQL = "CASE WHEN regexp_matches(path, '(^|\\.)L[0-9]+') THEN 'labelled_word' WHEN upper(bus) LIKE 'CAN%' THEN 'frame' WHEN lower(bus) LIKE '%discrete%' THEN 'discrete' WHEN lower(bus) LIKE '%analog%' THEN 'analog' ELSE 'unsupported' END"
IDENTITY_SQL = f"CASE {PROTOCOL_SQL} WHEN 'labelled_word' THEN {BLOCK_SQL} WHEN 'discrete' THEN {FAMILY_SQL} WHEN 'analog' THEN {FAMILY_SQL} ELSE concat(device, '/', {FAMILY_SQL}) END"


def _ent(spark, sf_dir, **columns):
    return I.entries(spark, sf_dir).select("ord", *(c.alias(k) for k, c in columns.items()))




@query("t12_profile_key", f"{ENT} SELECT ord, {PROFILE_SQL} AS profile_key FROM entry")
def t12(spark, sf_dir):
    return _ent(spark, sf_dir, profile_key=T.profile_key(path()))


@query("t13_family", f"{ENT} SELECT ord, {FAMILY_SQL} AS family FROM entry")
def t13(spark, sf_dir):
    return _ent(spark, sf_dir, family=T.family(F.element_at(F.split("path", "\\."), -1)))


@query("t14_block_key", f"{ENT} SELECT ord, {BLOCK_SQL} AS block_key FROM entry")
def t14(spark, sf_dir):
    return _ent(spark, sf_dir, block_key=T.block_key(path()))


@query("t15_protocol", f"{ENT} SELECT ord, {PROTOCOL_SQL} AS protocol FROM entry")
def t15(spark, sf_dir):
    return _ent(spark, sf_dir, protocol=T.protocol(F.col("bus"), path()))


@query("t16_identity", f"{ENT} SELECT ord, {IDENTITY_SQL} AS identity FROM entry")
def t16(spark, sf_dir):
    return _ent(spark, sf_dir, identity=T.identity_key(T.protocol(F.col("bus"), path()), F.col("device"), path()))


@query("t17_channels", f"{REQ} SELECT req_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(content, '[^A-Za-z0-9]+'), lambda c: regexp_full_match(c, '[AB][1-4]')))), ',') AS channels FROM req")
def t17(spark, sf_dir):
    return _req(spark, sf_dir, channels=F.array_join(T.channels(content()), ","))


@query("t18_specificity", f"""{REQ}, l AS (SELECT req_id, length(regexp_extract(name, '^([A-Za-z]+)', 1)) AS a, length(regexp_extract(name, '([0-9]+)$', 1)) AS d FROM req)
  SELECT req_id, CASE WHEN a >= 3 AND d > 0 OR a >= 8 THEN 'precise' WHEN a >= 5 THEN 'moderate' ELSE 'generic' END AS specificity FROM l""")
def t18(spark, sf_dir):
    return _req(spark, sf_dir, specificity=T.specificity(F.col("name")))


@query("t19_boundary_match", f"""{REQ}, w AS (SELECT req_id, lower(name) AS n, CASE ord % 3 WHEN 0 THEN 'fan1' WHEN 1 THEN 'flow' ELSE 'pump_a' END AS w FROM req), a AS (SELECT *, instr(n, w) AS i FROM w)
  SELECT req_id, w = n OR starts_with(n, w || '_') OR ends_with(n, '_' || w) OR (i > 1 AND substr(n, i - 1, 1) = '_' AND (substr(n, i + length(w), 1) = '_' OR (regexp_full_match(substr(n, i + length(w), 1), '[0-9]') AND NOT regexp_matches(w, '[0-9]$')))) AS hit FROM a""")
def t19(spark, sf_dir):
    word = F.expr("CASE ord % 3 WHEN 0 THEN 'fan1' WHEN 1 THEN 'flow' ELSE 'pump_a' END")
    return _req(spark, sf_dir, hit=T.boundary_match(word, F.col("name")))


@query("t20_suffix", f"{REQ} SELECT req_id, regexp_replace(name, '(.)(_cmd|_FLOW|Pos)$', '\\1') AS stem FROM req")
def t20(spark, sf_dir):
    return _req(spark, sf_dir, stem=T.strip_suffix(F.col("name"), ["Pos", "_cmd", "_FLOW"]))


@query("t21_named_component", f"{REQ} SELECT req_id, regexp_matches(content, '(^|[^A-Za-z0-9])[A-Za-z]{{2,}}[0-9]+([^A-Za-z0-9]|$)') AS named FROM req")
def t21(spark, sf_dir):
    return _req(spark, sf_dir, named=T.has_named_component(content()))


@query("t22_channel_suffix", f"{REQ} SELECT req_id, regexp_extract(name, '_R([0-9]+[a-z]?)$', 1) AS suffix FROM req")
def t22(spark, sf_dir):
    return _req(spark, sf_dir, suffix=T.channel_suffix(F.col("name")))


@query("t23_numbers", f"""{REQ} SELECT req_id, array_to_string(list_filter({_distinct("regexp_extract_all(content, '[0-9]{3,}')")}, lambda x: x NOT IN ('100', '101')), ',') AS numbers FROM req""")
def t23(spark, sf_dir):
    return _req(spark, sf_dir, numbers=F.array_join(T.signal_numbers(content(), ["100", "101"]), ","))


@query("t24_listed_names", f"""{REQ} SELECT req_id, array_to_string({_distinct("regexp_extract_all(content, '[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+')")}, ',') AS names FROM req""")
def t24(spark, sf_dir):
    return _req(spark, sf_dir, names=F.array_join(T.listed_names(content()), ","))


@query("t25_protocol_hint", f"{REQ} SELECT req_id, content ILIKE '%limit 1%' OR regexp_matches(content, '(?i)bits? *[1-8]([^0-9]|$)') AS hint FROM req")
def t25(spark, sf_dir):
    return _req(spark, sf_dir, hint=T.protocol_hint(content(), ["limit 1"]))


@query("t26_plain_name", f"{REQ} SELECT req_id, regexp_replace(upper(name), '^(RX_|TX_|DS[0-9]*_)+', '') AS plain FROM req")
def t26(spark, sf_dir):
    return _req(spark, sf_dir, plain=T.plain_name(F.col("name")))


@query("t27_json_repair", """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE json_extract_string(props, '$.k') END AS k FROM events""")
def t27(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    answer = F.expr("CASE event_id % 4 WHEN 0 THEN concat('<think>{no}</think>', props) WHEN 1 THEN concat('```json ', substring(props, 1, length(props) - 1)) WHEN 2 THEN concat('Answer: ', props, ' done') ELSE 'none' END")
    return e.select("event_id", F.get_json_object(B.repaired_json(answer), "$.k").alias("k"))


@query("t28_sign", """SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 AND p_size % 2 = 0 AND p_size % 7 > 0 THEN concat('bits ', p_size % 20 + 1, ' to ', p_size % 20 + p_size % 9 + 2, ' begin at -', p_size, '.5 and so hold a two''s complement number: bit ', p_size % 20 + p_size % 9 + 2, ' (offset ', p_size % 20 + p_size % 9 + 1, ') is its sign, one of the ', p_size % 9 + 2) ELSE '' END AS sign FROM part""")
def t28(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", T.sign_text(F.expr("CASE WHEN p_partkey % 3 = 0 THEN 'DIS' ELSE 'BNR ' END"), F.expr("concat(CASE WHEN p_size % 2 = 0 THEN '-' ELSE '' END, p_size, '.5')"), F.expr("CASE WHEN p_size % 7 > 0 THEN p_size % 20 END"), F.expr("p_size % 9 + 2")).alias("sign"))


@query("t29_pair_value", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size % 2 + 2 * (p_size % 3 % 2) ELSE p_size % 3 % 2 + 2 * (p_size % 2) END AS code FROM part")
def t29(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    places = F.expr("CASE WHEN p_size % 2 = 0 THEN array(9, 10) ELSE array(10, 9) END")
    return p.select("p_partkey", T.pair_value(places, F.expr("array(p_size % 2, p_size % 3 % 2)")).alias("code"))


@query("t29_coded_set", """SELECT p_partkey, concat(p_size % 4, CASE WHEN p_size % 5 = 0 THEN '' ELSE concat('|', CASE WHEN p_size % 2 = 0 THEN 'first' ELSE 'second' END, CASE WHEN p_size % 3 = 0 THEN '' ELSE concat('|set', p_size % 6) END) END) AS meaning FROM part""")
def t29b(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    v = p.selectExpr("p_partkey AS case_id", "p_size % 8 AS offset", "2 AS size", "p_size % 4 AS value")
    # three fields: the first without a set for odd sizes, another set for every third, and one at other bits
    f = p.selectExpr("p_partkey AS case_id", "p_size", "explode(array(0, 1, 2, 3)) AS ord").selectExpr(
        "case_id", "ord", "p_size % 8 + CASE WHEN ord = 3 THEN 1 ELSE 0 END AS offset", "2 AS size", "CASE ord WHEN 0 THEN 'first' WHEN 1 THEN 'second' ELSE 'third' END AS name",
        "CASE WHEN p_size % 5 = 0 AND ord < 3 THEN ' ' WHEN ord = 0 AND p_size % 2 = 1 THEN NULL WHEN ord = 2 AND p_size % 3 = 0 THEN 'other' ELSE concat('set', p_size % 6, ' ') END AS coded")
    return T.coded_meanings(v, f).select(F.col("case_id").alias("p_partkey"), F.concat_ws("|", "value", "field", "coded").alias("meaning"))


@query("t30_span_text", "SELECT p_partkey, CASE WHEN p_size % 4 + 1 = 1 THEN concat('bit ', p_size) ELSE concat('bits ', p_size, '-', p_size + p_size % 4) END AS span FROM part")
def t30(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", T.span_text(F.col("p_size"), F.expr("p_size % 4 + 1")).alias("span"))


@query("t31_octal", "SELECT p_partkey, CASE WHEN length(CAST(p_partkey AS STRING)) < 3 THEN lpad(CAST(p_partkey AS STRING), 3, '0') ELSE CAST(p_partkey AS STRING) END AS octal FROM part")
def t31(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", T.octal(F.col("p_partkey").cast("string")).alias("octal"))


@query("t32_stars", "SELECT p_partkey, concat(repeat('*', p_size % 5 + 1), repeat('.', 4 - p_size % 5)) AS stars, ['no consensus', 'key disagreement', 'majority', 'agreement in substance', 'full agreement'][p_size % 5 + 1] AS label FROM part")
def t32(spark, sf_dir):
    n = F.expr("p_size % 5 + 1")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", T.stars(n).alias("stars"), T.star_label(n).alias("label"))


@query("p3_display_path", """WITH n AS (SELECT p_partkey, list_filter([trim(split_part(p_name, ' ', 1)), trim(split_part(p_name, ' ', 1)), '', trim(split_part(p_name, ' ', 2)), trim(split_part(p_name, ' ', 1))], lambda x: x <> '') AS l FROM part)
  SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]), '.') AS path FROM n""")
def p3(spark, sf_dir):
    names = F.expr("array(split_part(p_name, ' ', 1), split_part(p_name, ' ', 1), null, split_part(p_name, ' ', 2), split_part(p_name, ' ', 1))")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", T.display_path(names).alias("path"))


@query("p6_frame_words", f"{ENT} SELECT ord, len(list_filter(regexp_split_to_array(lower(path), '[._ -]'), lambda x: x IN ('label', 'w'))) > 0 AS frame FROM entry")
def p6(spark, sf_dir):
    return _ent(spark, sf_dir, frame=T.has_frame_word(path(), ["label", "w"]))


@query("p7_bus_type", f"""{ENT} SELECT ord, CASE WHEN upper(sheet) LIKE 'VI%' THEN 'VI' WHEN upper(sheet) LIKE 'CAN%' THEN 'CAN' WHEN upper(sheet) LIKE '%ROR%' THEN 'ROR' WHEN upper(bus) LIKE 'VI%' THEN 'VI' WHEN upper(bus) LIKE 'CAN%' THEN 'CAN' WHEN upper(bus) LIKE '%ROR%' THEN 'ROR' ELSE '' END AS bus_type FROM entry""")
def p7(spark, sf_dir):
    return _ent(spark, sf_dir, bus_type=T.bus_type(F.col("sheet"), F.col("bus"), ["VI", "CAN"], ["ROR"]))


@query("p11_name_repair", "SELECT p_partkey, regexp_replace(concat('A_ ', p_name, ' x_  y'), '_\\s+', '_', 'g') AS fixed FROM part")
def p11(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", T.repaired_names(F.expr("concat('A_ ', p_name, ' x_  y')")).alias("fixed"))


@query("p12_category_names", f"{REQ} SELECT req_id, CASE bus WHEN 'CAN' THEN 'frames' WHEN 'A429' THEN 'labelled words' ELSE bus END AS shown FROM req")
def p12(spark, sf_dir):
    return _req(spark, sf_dir, shown=T.category_name(F.col("bus"), {"CAN": "frames", "A429": "labelled words"}))


@query("first_number", "SELECT p_partkey, TRY_CAST(regexp_extract(concat(p_brand, ' ', p_size, ' Bits'), '(-?[0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE) AS n FROM part")
def numbers(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", T.first_number(F.expr("concat(p_brand, ' ', p_size, ' Bits')")).alias("n"))
