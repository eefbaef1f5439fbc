"""Micro-fixtures worked out by hand, and properties."""

import io
import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracery.functions import bits as B
from tracery.functions import text as T
from tracery.operators import cluster, coverage, entries, match, trace, verdict
from tracery.plans import runs
from tracery.sources import office


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_fill_forward(spark):
    rows = [(1, "E1"), (2, None), (3, ""), (4, "None"), (5, "E2"), (6, None)]
    df = spark.createDataFrame([(1, r, v) for r, v in rows] + [(2, 1, None)], "sheet int, row int, p string")
    out = entries.fill_forward(df, "p", ["sheet"], ["row"]).orderBy("sheet", "row").collect()
    assert [r["p"] for r in out] == ["E1"] * 4 + ["E2"] * 2 + [None]


@pytest.mark.parametrize("rows", [1, 2, 5, 1000])
def test_fill_forward_in_ranges(spark, rows):
    """Ranges that hold nothing but blanks, keys that are null, and values that are carried over several ranges."""
    cells = [(s, r, v) for s in ("a", None) for r, v in enumerate(["", "E1", None, "None", " ", "", "E2", None, "", "", "", "", "E3"])] + [("b", 40, "x"), ("b", 7, None)]
    df = spark.createDataFrame(cells, "sheet string, row int, p string").repartition(3)
    as_text = df.withColumn("row", F.format_string("%04d", "row"))  # not a whole number: one window
    plain = {(r["sheet"], int(r["row"]), r["p"]) for r in entries.fill_forward(as_text, "p", ["sheet"], ["row"]).collect()}
    out = entries.fill_forward(df, "p", ["sheet"], ["row"], rows=rows)
    assert out.columns == df.columns and {tuple(r) for r in out.collect()} == plain and out.count() == df.count()


def test_one_sheet_is_many_tasks(spark):
    """A sheet of all orders: no window sees more than a range of it."""
    n, rows = 1500, 100
    df = spark.range(n).selectExpr("'one' AS sheet", "cast(id as int) AS row", "case when id % 337 = 5 then concat('E', id) end AS p")
    out = entries.fill_forward(df, "p", ["sheet"], ["row"], rows=rows)
    assert [r["p"] for r in out.orderBy("row").collect()] == [None if i < 5 else f"E{(i - 5) // 337 * 337 + 5}" for i in range(n)]
    windows = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Window" in line and "windowspecdefinition" in line]
    assert any("_range" in w.split("windowspecdefinition")[1].split("ASC")[0] for w in windows)


@pytest.mark.parametrize(("frequent", "parts"), [(0, 3), (2, 2), (5, 4), (10_000, 16)])
def test_token_join_loses_no_pair(spark, frequent, parts):
    left = spark.createDataFrame([(f"t{min(i % 7, i % 3)}", i) for i in range(40)] + [(None, 99)], "token string, a int")
    right = spark.createDataFrame([(f"t{i % 4}", i) for i in range(30)] + [("t0", 3), (None, 98)], "token string, b int")
    out = coverage.token_join(left, right, frequent, parts)
    assert sorted(map(tuple, out.select("token", "a", "b").collect())) == sorted(map(tuple, left.join(right, "token").select("token", "a", "b").collect()))


def test_ranges_by_sets(spark):
    r = spark.createDataFrame([(f"R{i}", i % 11, i % 3 + 1) for i in range(40)] + [("R0", 30, 9), ("R9", None, 1)], "req_id string, offset int, size int")
    b = spark.createDataFrame([(f"B{i}", i % 13, i % 4 + 1) for i in range(30)] + [("B1", 33, 1), ("B2", 0, 1), ("B2", 0, 1)], "block_key string, offset int, size int")
    meet = {(x["req_id"], y["block_key"]) for x in r.collect() for y in b.collect() if x["offset"] is not None and x["offset"] < y["offset"] + y["size"] and y["offset"] < x["offset"] + x["size"]}
    got = [tuple(p) for p in match.range_candidates(r, b).collect()]
    assert set(got) == meet and len(got) == len(meet)
    per = {q: sorted(k for p, k in meet if p == q) for q in {p for p, _ in meet}}
    assert {tuple(x) for x in match.range_counts(r, b).collect()} == {(q, len(k), k[0], k[-1]) for q, k in per.items()}


def test_display_path(spark):
    assert value(spark, T.display_path(F.array(*map(F.lit, ["A", "A", "", "B", "A"])))) == "A.B.A"


def test_publisher_wins_and_order(spark):
    df = spark.createDataFrame([("p", "x", "RP", "1", 1), ("p", "y", "RP", "2", 2), ("p", "x", "DP", "3", 3)], "path string, attr string, side string, value string, ord long").withColumns({"bus": F.lit("CAN"), "layer": F.lit("LogicalPort"), "ref_name": F.lit(None).cast("string")})
    out = entries.numbered(entries.dedup_all(entries.publisher_wins(df), [])).orderBy("seq").collect()
    assert [(r["attr"], r["side"], r["entry_id"]) for r in out] == [("x", "DP", "IRD-CAN-Logica-0001"), ("y", "RP", "IRD-CAN-Logica-0002")]


def test_long_numbers_are_not_cut(spark):
    assert value(spark, F.format_string("IRD-%s-%04d", F.lit("CAN"), F.lit(12345))) == "IRD-CAN-12345"


def test_labels(spark):
    assert value(spark, T.labels(F.lit("L145 l32 L145"))) == ["L145", "L32"]


@pytest.mark.parametrize(("text", "fields"), [("bit17至bit28", [(17, 12)]), ("第9和10位", [(8, 2)]), ("第3和5位", [(2, 1), (4, 1)]), ("第18到28位、第29位", [(17, 11), (28, 1)]), (None, []), ("", [])])
def test_bit_fields(text, fields):
    assert [f[:2] for f in B.fields_of(text)] == fields


def test_bit_values():
    assert B.values_of("第9和10位置为1和0") == [(8, 2, 1)]
    assert B.values_of("bits 9 and 10 shall not be set to 1 and 0") == []
    assert B.values_of("bits 9 and 12 are set to 1 and 0") == []


@pytest.mark.parametrize(("text", "values"), [
    ("第9和10位分别设置为“1”和“0”", [(8, 2, 1)]), ("第9与第10位为'0'，\"1\"", [(8, 2, 2)]), ("bit8=0，bit9=0", [(8, 2, 0)]), ("bit8=0, bit9=0, not used otherwise", [(8, 2, 0)]), ("It is so. bit8=0, bit9=1。不用", [(8, 2, 2)]),
    ("不得将第9和10位设置为1和0", []), ("第9和10位不应设置为1和0", []), ("The unit shall not set bit8=0, bit9=0", []), ("bit8=0。bit9=0", []), ("bit8=0, bit9=1, bit10=0", []), ("第9位为1，bit10=0", []), ("第9位设为‘1’，第10位设为‘1’", [(8, 2, 3)]),
    ("bit8 is set to \"1\", bit9 is \"0\"", [(8, 2, 1)]), ("bits 9 and 10 are set to \"1\" and \"0\"; bits 11 and 12 are 1, 1", [(9, 2, 1), (11, 2, 3)]), ("bit8=10, bit9=0", []), ("第9和11位为1和0", []), ("", []), (None, []),
])
def test_bit_values_in_quotes_and_denied(text, values):
    assert B.values_of(text) == values


def test_identifiers(spark):
    assert value(spark, T.identifier_parts(F.lit("PUMP_A_FLOW"))) == ["PUMP_A_FLOW", "PUMP", "FLOW"]
    assert value(spark, T.identifier_parts(F.lit("pi1/SPEED"))) == []


def test_keys(spark):
    path = F.lit("Dev.Port.L051_W.L051_1_A1_PUMP_FAULT")
    assert value(spark, T.profile_key(path)) == "L051/L051_1_A1_PUMP_FAULT"
    assert value(spark, T.block_key(path)) == "L051/PUMP_FAULT"
    assert value(spark, T.family(F.lit("L51_PUMP1_FAULT"))) == "FAULT"
    assert value(spark, T.profile_key(F.lit("Dev.pi1.SPEED"))) == "pi1/SPEED"
    assert value(spark, T.profile_key(F.lit("Dev.L12"))) == "L12/__label__"


@pytest.mark.parametrize(("word", "name", "hit"), [("fan1", "fan1_cmd", True), ("fan1", "xfan1_cmd", False), ("fan1", "fan12_cmd", False), ("fan", "a_fan2", True), ("fan", "fan", True)])
def test_boundary_match(spark, word, name, hit):
    assert value(spark, T.boundary_match(F.lit(word), F.lit(name))) == hit


def test_levels(spark):
    def level(clash=False, full=False, label=False, specific=0, traced=False):
        return value(spark, coverage.level(F.lit(clash), F.lit(full), F.lit(label), F.lit(specific), F.lit(False), F.lit(False), F.lit(0), F.lit(traced)))

    assert level(label=True, specific=1) == "exact_label"
    assert level(clash=True) == "not_same_object"
    assert level(specific=1) == "weak_signal"
    assert level(label=True) == "parent_referenced"
    assert level(full=True, specific=1) == "exact_fullname"


def test_best_level_keeps_ties(spark):
    df = spark.createDataFrame([("b", "r2", 2, "exact_signal"), ("b", "r1", 1, "exact_signal"), ("b", "r3", 3, "weak_signal")], "block_key string, req_id string, rank int, level string")
    assert coverage.best_level(df).first()["matched"] == ["r1", "r2"]


def test_consolidation(spark):
    def status(n, rejected, missing=0):
        ids = [f"r{i}" for i in range(n)]
        blocks = spark.createDataFrame([("b", ["m"] * missing)], "block_key string, missing array<string>")
        pairs = spark.createDataFrame([("b", r, i, "weak_signal") for i, r in enumerate(ids)], "block_key string, req_id string, rank int, level string")
        review = spark.createDataFrame([("b", "not_same_object", [], ids[:rejected])], "block_key string, verdict string, matched_ids array<string>, rejected_ids array<string>")
        return coverage.consolidated(blocks, coverage.deterministic(blocks, pairs), review).first()["coverage_status"]

    assert [status(3, 3), status(3, 2), status(6, 6), status(3, 3, 1)] == ["uncovered", "possible", "possible", "possible"]


def test_stars(spark):
    cases = [("full", [], 5), ("full", ["vague"], 4), ("majority", ["vague"], 3), ("majority", ["key"], 2), ("split", [], 1), ("unknown", [], 1)]
    assert [value(spark, verdict.stars(F.lit(a), F.array(*map(F.lit, d)).cast("array<string>"))) for a, d, _ in cases] == [s for *_, s in cases]
    df = spark.createDataFrame([(n, 5, "full") for n in range(4)], "alive int, stars int, agreement string")
    assert [(r["stars"], r["agreement"], r["review"]) for r in verdict.capped(df).orderBy("alive").collect()] == [(1, "no_consensus", True), (1, "single_source", False), (2, "full", False), (5, "full", False)]


def test_majority_tie(spark):
    df = spark.createDataFrame([("c", i, s) for i, s in enumerate("baba")], "case_id string, provider_ord int, status string")
    assert verdict.majority(df).first()["status"] == "b"


def test_bridge_only_without_shared_parents(spark):
    r = spark.createDataFrame([("Y1", "r1")], "parent_id string, req_id string")
    bridge = spark.createDataFrame([("Y1", "X2")], "parent_id string, other_id string")
    names = spark.createDataFrame([("X1", "a"), ("X2", "b")], "parent_id string, spec_name string")
    assert {tuple(x) for x in trace.bridged(r, names, bridge).collect()} == {("Y1", "r1"), ("X2", "r1")}
    shared = names.union(spark.createDataFrame([("Y9", "c")], names.schema))
    assert trace.bridged(r.union(spark.createDataFrame([("Y9", "r2")], r.schema)), shared, bridge).count() == 2


def test_tiers(spark):
    dims = {d: F.lit(0) for d in match.DIMENSIONS}
    base = spark.createDataFrame([("r1", "bus", 30, 8, 22), ("r2", "bus", 24, 8, 16), ("r3", "analog", 40, 0, 40)], "req_id string, category string, total int, d_name int, rest int")
    pairs = base.withColumns(dims | {"d_name": F.col("d_name"), "d_bit": F.col("rest"), "block_ord": F.lit(1), "block_key": F.lit("b")})
    got = {r["req_id"]: r["status"] for r in match.tiers(base.select("req_id", "category"), pairs, pairs).collect()}
    assert got == {"r1": "matched", "r2": "uncertain", "r3": "unmatched"}


def test_tiers_by_number_are_those_by_key_and_sort_no_pair(spark):
    rnd = random.Random(3)
    ords = [-(2**63), -5, 0, 7, 10, 2**53 + 1, 2**63 - 1]
    rows = [(f"r{i}", rnd.choice(["bus", "label", "analog"]), rnd.choice([0, 8]), rnd.choice([15, 16, 17, 104]), rnd.choice([0, 1]), rnd.random() < 0.4, o, f"b{o}") for i in range(60) for o in rnd.sample(ords, rnd.randint(0, 7))]
    pairs = spark.createDataFrame(rows, "req_id string, category string, d_name int, d_bit int, d_sdi int, passed boolean, block_ord long, block_key string")
    pairs = pairs.withColumns({d: F.lit(0) for d in match.DIMENSIONS if d not in pairs.columns}).withColumn("total", F.col("d_name") + F.col("d_bit") + F.col("d_sdi"))
    reqs = spark.range(61).selectExpr("concat('r', id) AS req_id", "'label' AS category")
    by_number = match.tiers(reqs, pairs, numbered=True)
    assert sorted(by_number.collect()) == sorted(match.tiers(reqs, pairs).collect())
    assert {r["status"] for r in by_number.collect()} == {"matched", "uncertain", "unmatched"}
    assert "SortAggregate" not in by_number._jdf.queryExecution().executedPlan().toString()


def test_synonyms_of_lists(spark):
    """A list that many requirements have is looked up once; a requirement given twice has the words of both rows."""
    lists = spark.createDataFrame([(1, ["pump", "x"]), (1, ["fan"]), (2, []), (3, None), (4, ["rate"]), (5, ["rate"]), (6, [None, "y"])], "req_id int, words array<string>")
    syn = spark.createDataFrame([(0, "pump", "flow"), (1, "fan", "blower"), (3, "flow", "rate")], "g int, canonical string, alias string")
    got = T.lists_with_synonyms(lists.where("req_id < 6"), syn)
    assert {r["req_id"]: r["words"] for r in got.collect()} == {1: ["blower", "fan", "flow", "pump", "x"], 4: ["flow", "rate"], 5: ["flow", "rate"]}
    plain = T.with_synonyms(lists.select("req_id", F.explode("words").alias("word")).distinct(), syn).groupBy("req_id").agg(F.array_sort(F.collect_list("word")).alias("words"))
    assert {tuple(map(str, r)) for r in T.lists_with_synonyms(lists.where("req_id <> 6"), syn).collect()} == {tuple(map(str, r)) for r in plain.where("req_id <> 6").collect()}


def test_recall_makes_the_index_once(spark):
    """Texts are cut into tokens once, however often the pairs are read; tokens of two sources, repeated blocks and requirements count once."""
    seen = spark.sparkContext.accumulator(0)

    def cut(text):
        seen.add(1)
        return text.split()

    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "b x"), (3, "y")], "req_id int, text string").repartition(1)
    words = F.udf(cut, "array<string>")(F.col("text"))
    index = coverage.token_index(docs, words)
    index = index.union(spark.createDataFrame([("b", 1, "model"), ("z", 3, "model")], index.schema))
    blocks = spark.createDataFrame([("B1", ["a", "b", "a"]), ("B1", ["b"]), ("B2", ["b", "z", None])], "block_key string, tokens array<string>")
    pairs = coverage.recall(blocks, index)
    for _ in range(2):
        got = {(r["block_key"], r["req_id"], r["overlap"], r["source"], r["rank"]) for r in pairs.collect()}
    assert got == {("B1", 1, 2, "deterministic", 1), ("B1", 2, 1, "deterministic", 2), ("B2", 1, 1, "deterministic", 1), ("B2", 2, 1, "deterministic", 2), ("B2", 3, 1, "model", 3)}
    assert seen.value == 4


def test_token_index_compares_repeated_requirements_alone(spark):
    once = spark.createDataFrame([(1, "a b a"), (2, "b"), (None, "c c")], "req_id int, text string")
    index = coverage.token_index(once, F.split("text", " "))
    assert sorted(map(str, index.collect())) == sorted(map(str, coverage.token_index(once, F.split("text", " ")).distinct().collect())) and index.count() == 4
    assert "Aggregate" not in index._jdf.queryExecution().executedPlan().toString()
    more = once.union(spark.createDataFrame([(1, "a d"), (None, "c e"), (None, None)], once.schema))
    got = coverage.token_index(more, F.split("text", " ")).collect()
    assert sorted((r["token"], str(r["req_id"])) for r in got) == [("a", "1"), ("b", "1"), ("b", "2"), ("c", "None"), ("d", "1"), ("e", "None")]


def test_score_takes_words_that_were_made_before(spark):
    """What a requirement's words are is found out once for it, not for each of its pairs; fields are compared as one by one."""
    b = spark.sql("select array('x') b_tokens, 'send' b_direction, array(struct(3 as offset, 2 as size)) b_fields, array('1') b_sdi, 'DIS' b_format, array('d') b_devices, '' b_channel, array('c') b_buses, 'PUMP_flow1' b_family")
    r = spark.sql("select array('y') r_tokens, '' r_direction, array(struct(3 as offset, 1 as size), struct(4 as offset, 2 as size)) r_fields, array('2') r_sdi, 'bus' r_category, array('e') r_devices, '' r_channel, array('g') r_buses, array('Flow1', 'low', 'um', 'mp_fl') made_of")
    words = r.withColumn("r_words", match.name_words(F.col("made_of")))
    got = match.score(b.crossJoin(words)).first()
    assert (got["d_name"], got["d_bit"]) == (24, 12)
    assert match.score(b.crossJoin(r.withColumnRenamed("made_of", "r_keywords"))).first()["d_name"] == 24
    some = "array<struct<offset: int, size: int>>"
    rows = [([(1, 2)], [(1, 2)], 20), ([(1, 2)], [(1, 3), (2, 2)], 12), ([(1, 2)], [(3, 2)], 8), ([(1, 2)], [(3, 4)], 0), ([], [(1, 2)], 0), (None, [(1, 2)], 0), ([(1, None)], [(1, None)], 12), ([(None, 2)], [(None, 2), (5, 1)], 8)]
    df = spark.createDataFrame(rows, f"r {some}, b {some}, s int")
    assert df.where(match.field_score(F.col("r"), F.col("b")) != F.col("s")).count() == 0


def test_top_k_plan_keeps_the_group_limit(spark):
    df = spark.range(100).selectExpr("id % 3 AS req_id", "id AS total", "id AS block_ord", "id AS block_key", "id % 7 = 0 AS p")
    plan = match.top_k(df, 5, F.col("p"))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_json_repair():
    assert B.repaired('<think>x</think>```json {"a": 1, "b": [1, "x') == '{"a": 1, "b": [1, "x"]}'
    assert B.repaired('{"a": {"c": "}"}} tail') == '{"a": {"c": "}"}}'
    assert B.repaired("none") is None and B.repaired(None) is None


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet='{}[]",:\\ab1 ', max_size=40))
def test_json_repair_never_raises(text):
    B.repaired(text)


def test_breaker():
    now = [0.0]
    b = verdict.Breaker(3, 10, lambda: now[0])
    for _ in range(3):
        b.record("timeout")
    assert b.open()
    now[0] = 11
    assert not b.open()
    b.record("auth")
    assert b.open()


def test_failing_rater_gives_errors(spark):
    def rater(provider, prompt):
        raise TimeoutError("timed out")

    cases = spark.createDataFrame([("c1", "p"), ("c2", "p")], "case_id string, prompt string")
    out = verdict.judged(cases, spark.createDataFrame([("a", 0)], "provider string, provider_ord int"), rater).collect()
    assert {r["status"] for r in out} == {"error"}


def _xlsx(sheets):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            cells = "".join(f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(65 + c)}{r}"><v>{v}</v></c>' for r, row in enumerate(rows, 1) for c, v in enumerate(row) if v is not None)
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


def _docx(tables):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join("<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{v}</w:t></w:r></w:p></w:tc>" for v in row) + "</w:tr>" for row in t) + "</w:tbl>" for t in tables)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


SPEC = {"CAN-1": [["Publisher", None, None, None, "Subscriber"], ["Port", None, "DP", None, "RP"], ["Name", "Size", "Name", "Unit", "Name"], ["P1", 8.0, "L051_1_A1_PUMP_FAULT", "V", "X"], ["P1", 2.5, "SPEED", None, None]], "short": [["Publisher"]]}


def test_workbook(spark, tmp_path):
    (tmp_path / "spec.xlsx").write_bytes(_xlsx(SPEC))
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    cells = office.read_cells(spark, str(tmp_path))
    assert [r["value"] for r in cells.where("sheet is null").collect()] == ["error: BadZipFile"]
    got = {(r["row"], r["side"], r["layer"], r["path"], r["attr"], r["value"]) for r in office.spec_entries(cells.where("sheet is not null")).collect()}
    assert (4, "DP", "Port", "P1", "Size", "8") in got and (5, "DP", "Port", "P1", "Size", "2.5") in got
    assert (4, "DP", "DP", "P1.L051_1_A1_PUMP_FAULT", "Unit", "V") in got and (4, "RP", "RP", "X", "Name", "X") in got
    assert not any(r[0] == 1 for r in got)


def _with_shared(cells_by_sheet, strings, packed=zipfile.ZIP_DEFLATED, breaks=()):
    """A workbook with shared strings; a cell is a number of one of them."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", packed) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" r:id="Id{i}"/>' for i, n in enumerate(cells_by_sheet)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="Id{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(cells_by_sheet))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r></si>" for s in strings) + "</sst>")
        for i, (name, rows) in enumerate(cells_by_sheet.items()):
            body = "".join(f'<row r="{r}">' + "".join(f'<c r="{chr(65 + c)}{r}" t="s"><v>{v}</v></c>' for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}' + ("" if name in breaks else "</sheetData></worksheet>"))
    return out.getvalue()


@pytest.mark.parametrize("packed", [zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED])
def test_shared_strings_and_wanted_sheets(spark, tmp_path, packed):
    strings = ["alpha", "beta", "g"]
    (tmp_path / "a.xlsx").write_bytes(_with_shared({"one": [[0, 1], [2, 9]], "two": [[1]], "broken": [[2]]}, strings, packed, breaks=("broken",)))
    got = {tuple(r)[1:] for r in office.read_cells(spark, str(tmp_path)).collect()}
    expected = {("one", 0, 1, 0, "alpha"), ("one", 0, 1, 1, "beta"), ("one", 0, 2, 0, "g"), ("one", 0, 2, 1, ""), ("two", 1, 1, 0, "beta"), ("broken", 2, 1, 0, "g"), (None, None, None, None, "error: ParseError")}
    assert got == expected
    assert {r["sheet"] for r in office.read_cells(spark, str(tmp_path), ["two", "none"]).collect()} == {"two"}


def test_a_million_cells_in_bounded_memory(spark, tmp_path):
    """Sheets are parsed piece by piece: the cells of a task are never all there at once."""
    import tracemalloc

    rows = 50_000
    data = _with_shared({"big": [[i % 3] * 20 for i in range(rows)], "small": [[0]]}, ["x", "y", "z"])
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        method, body = office._member(data, z, "xl/worksheets/s0.xml")
    tracemalloc.start()
    n = sum(1 for _ in office.sheet_cells(method, body))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 20 * rows and peak < 40_000_000
    (tmp_path / "a.xlsx").write_bytes(data)
    got = office.read_cells(spark, str(tmp_path)).groupBy("sheet", "value").count().collect()
    assert {(r["sheet"], r["value"]): r["count"] for r in got} == {("big", v): 20 * len(range(i, rows, 3)) for i, v in enumerate("xyz")} | {("small", "x"): 1}


def test_documents(spark, tmp_path):
    glossary = [["abbr", "en", "what"], ["SDI", "source", "x"], ["", "no", "y"]]
    req = [["Identifier", "R-1"], ["Text", "old"], ["Text", "The pump"], *[["other", "x"]] * 5]
    none = [["Identifier", ""], *[["other", "x"]] * 7]
    (tmp_path / "a.docx").write_bytes(_docx([glossary, req, none, [["Identifier", "R-2"]]]))
    (tmp_path / "b.xlsx").write_bytes(_xlsx({"s": [["id"], [None], ["R-9", "mod", "A text"], ["R-10", "mod", None]]}))
    alias = spark.createDataFrame([("identifier", "id"), ("text", "content")], "alias string, field string")
    assert {tuple(r) for r in office.requirements(spark, str(tmp_path), alias).collect()} == {("R-1", "The pump"), ("R-9", "A text")}
    assert [tuple(r) for r in office.glossary_rows(office.read_cells(spark, str(tmp_path)).where("file like '%docx'")).collect()] == [("SDI", "source", "x")]


WORDS = {"analog": ["analog"], "discrete": ["discrete"], "bus": ["bus"], "strong_send": ["transmit"], "strong_receive": ["acquire"], "send": [], "receive": []}


def _facts(spark):
    rows = [(i, "DP", "DP", "CAN", f"Dev.Port.L05{i}_W.L05{i}_1_A1_PUMP_{n}", "BitOffset", str(i)) for i, n in enumerate(["FLOW", "FAULT", "SPEED"])]
    return spark.createDataFrame(rows, "ord long, side string, layer string, bus string, path string, attr string, value string")


def test_both_analyses_and_resume(spark, tmp_path):
    reqs = spark.createDataFrame([("R1", "The unit shall transmit L050 PUMP_FLOW bit 0"), ("R2", "Other text"), ("R3", "Label L051 only")], "req_id string, content string")
    calls = []

    def review(asked):
        calls.append(1)
        return asked.select("block_key", F.lit("covered").alias("verdict"), F.col("matched").alias("matched_ids"), F.array().cast("array<string>").alias("rejected_ids"))

    out = {r["block_key"]: r["coverage_status"] for r in runs.spec_to_req(spark, _facts(spark), reqs, str(tmp_path / "f"), review=review).collect()}
    assert out == {"L050/PUMP_FLOW": "covered", "L051/PUMP_FAULT": "covered", "L052/PUMP_SPEED": "uncovered"}
    first = {tuple(r) for r in runs.req_to_spec(spark, _facts(spark), reqs, WORDS, str(tmp_path / "r")).collect()}
    assert {r[:2] for r in first} == {("R1", "matched"), ("R2", "unmatched"), ("R3", "uncertain")}

    def broken(provider, prompt):
        raise AssertionError("a finished stage must not call raters")

    assert {tuple(r) for r in runs.req_to_spec(spark, _facts(spark), reqs, WORDS, str(tmp_path / "r"), rater=broken).collect()} == first


def test_result_does_not_depend_on_partitions(spark):
    facts = _facts(spark)
    one = sorted(map(str, cluster.profiles(facts.coalesce(1)).collect()))
    assert one == sorted(map(str, cluster.profiles(facts.repartition(7)).collect()))


def test_windowed_stream_matches_the_table(spark, tmp_path):
    from tracery.streaming import verdicts

    e = spark.createDataFrame([(i % 6, f"2024-01-01 00:0{i}:00", "view" if i % 2 else "click") for i in range(8)], "event_id long, ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = verdicts.counted(stream).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sum(r["n"] for r in spark.table("counts").collect()) == 6


def test_rulesets(spark, tmp_path):
    from tracery.sources import rulesets

    (tmp_path / "alpha.json").write_text('{"analog": ["volt"], "thresholds": {"k": 5}}')
    r = rulesets.load(spark, str(tmp_path))["alpha"]
    assert r.analog == ("volt",) and r.discrete == ("discrete",) and r.extra == {"thresholds": {"k": 5}}
    with pytest.raises(ValueError, match="."):
        rulesets.parse("x", "no ruleset at all: [") if not _yaml() else int("x")


def _yaml():
    import importlib.util

    return importlib.util.find_spec("yaml") is not None


def test_trace_files(spark):
    from tracery.sources import rulesets

    cells = spark.createDataFrame([("a/Names.xlsx",), ("a/reqs.xlsx",), ("a/other.xlsx",)], "file string")
    got = {r["file"]: r["role"] for r in rulesets.trace_files(cells, "names", "reqs").collect()}
    assert got == {"a/Names.xlsx": "names", "a/reqs.xlsx": "requirements", "a/other.xlsx": "bridge"}


def test_annotations_are_cached_and_resumed(spark, tmp_path):
    reqs = spark.createDataFrame([(f"k{i}", f"text {i}") for i in range(16)], "key string, content string")
    none = spark.createDataFrame([], "key string, payload string, ord long")

    def annotator(text):
        if text.endswith("3"):
            raise ConnectionError
        return text.upper()

    first = verdict.worth_keeping(verdict.annotated(reqs, none, annotator))
    verdict.append_cache(first.withColumn("ord", F.lit(1)), str(tmp_path / "cache"))
    cache = spark.read.json(str(tmp_path / "cache"))
    assert cache.count() == 14  # texts 3 and 13 failed
    part = cache.where("key < 'k14'")
    counts = verdict.reuse_counts(reqs, part).first()
    again = {tuple(r) for r in verdict.annotated(reqs, part, str.upper).collect()}
    assert counts["reused"] + counts["rerun"] == 16 and counts["reused"] == part.count()
    assert again == {(f"k{i}", f"TEXT {i}") for i in range(16)}


def test_reviews(spark):
    blocks = spark.createDataFrame([("b1", ["r1"]), ("b2", ["r2"])], "block_key string, matched array<string>")

    def reviewer(key, ids):
        if key == "b2":
            raise TimeoutError
        return "covered", ids, []

    assert {r["block_key"]: r["verdict"] for r in verdict.reviewed(blocks, reviewer).collect()} == {"b1": "covered", "b2": "unconfirmed"}


def test_command_line(spark, tmp_path, capsys):
    from tracery import __main__

    _facts(spark).write.parquet(str(tmp_path / "e"))
    spark.createDataFrame([("R1", "The unit shall transmit L050 PUMP_FLOW bit 0")], "req_id string, content string").write.parquet(str(tmp_path / "q"))
    for kind in ("req_to_spec", "spec_to_req"):
        __main__.main([kind, "--entries", str(tmp_path / "e"), "--requirements", str(tmp_path / "q"), "--out", str(tmp_path / kind)])
    assert runs.stage_table(spark, str(tmp_path / "spec_to_req"), "coverage").count() == 3


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["", "None", "E1", "E2", None])), max_size=12))
def test_fill_forward_never_crosses_a_sheet(spark, cells):
    df = spark.createDataFrame([(s, i, v) for i, (s, v) in enumerate(cells)], "sheet int, row int, p string")
    got = {r["row"]: r["p"] for r in entries.fill_forward(df, "p", ["sheet"], ["row"]).collect()}
    last = {}
    for i, (s, v) in enumerate(cells):
        last[s] = v if v not in (None, "", "None") else last.get(s)
        assert got[i] == last[s]


def test_scores_are_the_sum_of_their_dimensions(spark):
    from tracery.plans import match_queries

    s = match_queries.scored(spark, "/root/testdata/sf0.001")
    total = sum((F.col(d) for d in match.DIMENSIONS), F.lit(0))
    assert s.where((F.col("total") != total) | (F.col("total") < 0) | (F.col("total") > 110)).isEmpty()


def test_dedup_is_idempotent(spark):
    from tracery.plans import inputs

    e = inputs.entries(spark, "/root/testdata/sf0.001")
    once = entries.dedup_in_sheet(e)
    assert entries.dedup_in_sheet(once).count() == once.count()
