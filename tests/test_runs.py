"""Both analyses over cases that need all of their evidence."""

import pytest
from pyspark.sql import functions as F

from tests.test_micro import WORDS
from tracery.plans import runs

ENTRY = "ord long, side string, layer string, bus string, path string, attr string, value string"


def _leaf(i, path, attr="BitOffset", value="1", bus="CAN1"):
    return (i, "DP", "DP", bus, path, attr, value)


def test_every_block_in_doubt_is_reviewed(spark, tmp_path):
    """Nine requirements share one word with a block: more than a rater is shown."""
    facts = spark.createDataFrame([_leaf(0, "Dev.Port.PUMP_FLOW")], ENTRY)
    reqs = spark.createDataFrame([(f"R{i}", "The pump runs") for i in range(9)], "req_id string, content string")
    seen = []

    def review(asked):
        seen.extend(asked.collect())
        return asked.select("block_key", F.lit("covered").alias("verdict"), F.slice("matched", 1, 1).alias("matched_ids"), F.array().cast("array<string>").alias("rejected_ids"))

    out = runs.spec_to_req(spark, facts, reqs, str(tmp_path / "a"), review=review).first()
    assert [r["matched"] for r in seen] == [["R0", "R1", "R2", "R3", "R4"]]
    assert (out["coverage_status"], out["source"], out["matched"]) == ("covered", "rater", ["R0"])

    def reject(asked):
        return asked.select("block_key", F.lit("not_same_object").alias("verdict"), F.array().cast("array<string>").alias("matched_ids"), F.col("matched").alias("rejected_ids"))

    assert runs.spec_to_req(spark, facts, reqs, str(tmp_path / "b"), review=reject).first()["coverage_status"] == "possible"


def test_levels_take_all_evidence(spark, tmp_path):
    facts = spark.createDataFrame([
        _leaf(0, "PUMP1.Port.ALTITUDE"), _leaf(1, "Dev.Port.PRESSURE_X", bus="analog"), _leaf(2, "Dev.Port.STATUS_Y"), _leaf(3, "TANK1.Port.QUANTITY_Z"), _leaf(4, "Dev.Port.OTHER_W"), _leaf(5, "Tank9.Bay.LONGWORD_V"),
    ], ENTRY)
    reqs = spark.createDataFrame([("R1", "ALTITUDE"), ("R2", "the discrete PRESSURE"), ("R3", "STATUS"), ("R4", "TANK2 QUANTITY"), ("R5", "nothing"), ("R6", "LONGWORD of Tank9")], "req_id string, content string")
    words = WORDS | {"generic": ["STATUS"]}
    traced = spark.createDataFrame([(f"E{i}", p, r, 0) for i, (p, r) in enumerate([("PUMP1.Port.ALTITUDE", "R1"), ("Dev.Port.PRESSURE_X", "R2"), ("Dev.Port.STATUS_Y", "R3"), ("TANK1.Port.QUANTITY_Z", "R4"), ("Dev.Port.OTHER_W", "R5"), ("Tank9.Bay.LONGWORD_V", "R6")])], "parent_id string, spec_name string, req_id string, ord int")
    level = lambda t, name: {r["block_key"].split("/")[1]: r["rule_level"] for r in runs.spec_to_req(spark, facts, reqs, str(tmp_path / name), t, words=words).collect()}
    plain = level(None, "a")
    assert plain == {"ALTITUDE": "exact_fullname", "PRESSURE_X": "not_same_object", "STATUS_Y": "generic_signal", "QUANTITY_Z": "not_same_object", "OTHER_W": "no_evidence", "LONGWORD_V": "exact_signal"}
    assert level(traced, "b") == plain | {"OTHER_W": "trace_only"}


def test_unlabelled_requirements_find_blocks(spark, tmp_path):
    """By bus, device and channel, and protocol families by name or bits; other buses are gated."""
    facts = spark.createDataFrame([
        _leaf(0, "PumpUnit.Port.B2_PRESSURE_VALUE", "BitOffset", "3", "CAN1"), _leaf(1, "PumpUnit.Port.PRESSURE_OTHER", "BitOffset", "3", "CAN2"),
        _leaf(2, "Dev.Port.L050_W.L050_1_A1_SDI", "BitOffset", "9"), _leaf(3, "Dev.Port.L050_W.L050_1_A1_SSM", "BitOffset", "30"),
    ], ENTRY)
    reqs = spark.createDataFrame([("R1", "The PumpUnit shall transmit PRESSURE_VALUE on CAN1, channel B2"), ("R2", "Other text"), ("R3", "The unit shall set the SDI"), ("R4", "Label L050 of PumpUnit")], "req_id string, content string")
    out = {r["req_id"]: r["status"] for r in runs.req_to_spec(spark, facts, reqs, WORDS, str(tmp_path)).collect()}
    assert out["R1"] == "matched" and out["R2"] == "unmatched" and out["R3"] == "uncertain"
    s = {(r["req_id"], r["block_key"]): r for r in runs.stage_table(spark, str(tmp_path), "scored").collect()}
    assert {k for k, r in s.items() if r["eligible"]} == {("R1", "Port/B2_PRESSURE_VALUE"), ("R3", "L050/SDI")} and out["R4"] == "uncertain"
    one = s["R1", "Port/B2_PRESSURE_VALUE"]
    assert (one["d_device"], one["d_channel"]) == (7, 10)


def test_protocol_families_by_bits(spark, tmp_path):
    at = lambda n: f"Dev.Port.L050_W.L050_1_A1_{n}"
    facts = spark.createDataFrame([_leaf(0, at("SDI"), "BitOffset", "8"), _leaf(1, at("SDI"), "ParameterSize", "2"), _leaf(2, at("SSM"), "BitOffset", "29"), _leaf(3, at("SSM"), "ParameterSize", "2")], ENTRY)
    reqs = spark.createDataFrame([("R1", "bit9"), ("R2", "L050 has an SSM"), ("R3", "L050 bit30")], "req_id string, content string")
    runs.req_to_spec(spark, facts, reqs, WORDS, str(tmp_path))
    got = {(r["req_id"], r["block_key"]) for r in runs.stage_table(spark, str(tmp_path), "scored").where("eligible").collect()}
    assert got == {("R1", "L050/SDI"), ("R2", "L050/SSM"), ("R3", "L050/SSM")}


def test_requirements_without_label_and_bus_find_blocks(spark, tmp_path):
    """An analog requirement that names a block and nothing else, one that only its direction speaks for, and labelled blocks, which it can't mean."""
    facts = spark.createDataFrame([_leaf(0, "Dev.Port.PUMP_FLOW0", "BitOffset", "3"), _leaf(1, "Dev.Port.L050_W.L050_1_A1_PUMP_FLOW0", "BitOffset", "3"), _leaf(2, "Dev.Port.VALVE_POS")], ENTRY)
    reqs = spark.createDataFrame([("R1", "The unit shall transmit the analog PUMP_FLOW0, bit 3"), ("R2", "shall transmit an analog value")], "req_id string, content string")
    out = {r["req_id"]: (r["status"], r["top"]) for r in runs.req_to_spec(spark, facts, reqs, WORDS, str(tmp_path)).collect()}
    assert out["R1"][0] == "matched" and out["R2"][0] == "unmatched"
    pairs = {(r["req_id"], r["block_key"]) for r in runs.stage_table(spark, str(tmp_path), "scored").collect()}
    assert ("R1", "Port/PUMP_FLOW0") in pairs and not any("L050" in k for _, k in pairs)


def test_raters_see_blocks_that_failed_the_gates(spark, tmp_path):
    """None of the label's blocks reaches the least total: the raters see them all the same; one in conflict they don't."""
    at = lambda n, side="DP": (0, side, side, "CAN1", f"Dev.Port.L050_W.L050_1_A1_{n}", "BitOffset", "3")
    facts = spark.createDataFrame([at("PUMP_FLOW"), at("VALVE_POS", "RP")], ENTRY)
    reqs = spark.createDataFrame([("R1", "L050 and L051 only"), ("R2", "The unit shall acquire L050 nothing")], "req_id string, content string")
    prompts = {}
    out = {r["req_id"]: r["status"] for r in runs.req_to_spec(spark, facts, reqs, WORDS, str(tmp_path)).collect()}
    assert out == {"R1": "uncertain", "R2": "uncertain"} or out["R1"] == "uncertain"
    prompts = {r["case_id"]: r["prompt"] for r in runs.stage_table(spark, str(tmp_path), "cases").collect()}
    assert "L050/PUMP_FLOW" in prompts["R1"] and "L050/VALVE_POS" in prompts["R1"]
    assert "L050/PUMP_FLOW" not in prompts["R2"] and "L050/VALVE_POS" in prompts["R2"]


def test_traced_requirements_meet_their_own_blocks_first(spark, tmp_path):
    """R1's trace leads to the lesser of two blocks, R2's to none that fits, and R3 has no trace."""
    at = lambda n: f"Dev.Port.L050_W.L050_1_A1_{n}"
    facts = spark.createDataFrame([_leaf(0, at("PUMP_FLOW"), "BitOffset", "3"), _leaf(1, at("PUMP_SPEED"), "BitOffset", "9"), _leaf(2, "Dev.Port.OTHER_W", bus="CAN2")], ENTRY)
    text = "The unit shall transmit L050 pump PUMP_FLOW, bit3"
    reqs = spark.createDataFrame([("R1", text), ("R2", text), ("R3", text)], "req_id string, content string")
    traced = spark.createDataFrame([("E1", at("PUMP_SPEED"), "R1"), ("E2", "Dev.Port.OTHER_W", "R2")], "parent_id string, spec_name string, req_id string")
    runs.req_to_spec(spark, facts, reqs, WORDS, str(tmp_path / "t"), traced=traced)
    tiers = {r["req_id"]: (r["status"], r["pool"]) for r in runs.stage_table(spark, str(tmp_path / "t"), "tiers").collect()}
    assert tiers["R1"][1] == "traced" and tiers["R2"] == ("matched", "full") and tiers["R3"] == ("matched", "full")
    prompts = {r["case_id"]: r["prompt"] for r in runs.stage_table(spark, str(tmp_path / "t"), "cases").collect()}
    assert "L050/PUMP_FLOW" in prompts["R3"] and "L050/PUMP_FLOW" in prompts["R2"]


def test_numbers_hints_parts_synonyms_and_soft_directions(spark, tmp_path):
    """What a run of plain words lacks, and the words that bring it."""
    at = lambda n: f"Dev.Port.L050_W.L050_1_A1_{n}"
    facts = spark.createDataFrame([_leaf(0, at("EDP_034"), "BitOffset", "3"), _leaf(1, at("EDP_034"), "DataFormatType", "BNR"), _leaf(2, at("FAN_CMD"), "BitOffset", "5")], ENTRY)
    reqs = spark.createDataFrame([("R1", "L050 bit3 of 034 in volts"), ("R2", "L050 ventilator bit5"), ("R3", "shall acquire L050 EDP_034 fan")], "req_id string, content string")

    def dims(name, words):
        runs.req_to_spec(spark, facts, reqs, words, str(tmp_path / name))
        return {(r["req_id"], r["block_key"]): r for r in runs.stage_table(spark, str(tmp_path / name), "scored").collect()}

    plain = dims("a", WORDS)
    more = dims("b", WORDS | {"numbers": ["on"], "hint_analog": ["volts"], "synonyms": {"fan": ["ventilator"]}, "soften": ["on"]})
    assert (plain["R1", "L050/EDP_034"]["d_name"], more["R1", "L050/EDP_034"]["d_name"]) == (0, 10)
    assert (plain["R1", "L050/EDP_034"]["d_type"], more["R1", "L050/EDP_034"]["d_type"]) == (5, 10)
    assert (plain["R2", "L050/FAN_CMD"]["d_name"], more["R2", "L050/FAN_CMD"]["d_name"]) == (0, 8)


def test_answers_are_taken_from_the_cache(spark, tmp_path):
    facts = spark.createDataFrame([_leaf(0, "Dev.Port.L050_W.L050_1_A1_PUMP_FLOW")], ENTRY)
    reqs = spark.createDataFrame([("R1", "L050 PUMP_FLOW"), ("R2", "shall transmit L050 PUMP_FLOW")], "req_id string, content string")
    cache = str(tmp_path / "cache")

    def agrees(provider, prompt):
        return "covered", "yes", 1.0

    def broken(provider, prompt):
        raise AssertionError("what is in the cache must not be asked")

    first = sorted(map(str, runs.req_to_spec(spark, facts, reqs, WORDS, str(tmp_path / "a"), rater=agrees, cache=cache).collect()))
    n = spark.read.json(cache).count()
    assert n == 6
    assert sorted(map(str, runs.req_to_spec(spark, facts, reqs, WORDS, str(tmp_path / "b"), rater=broken, cache=cache).collect())) == first
    assert spark.read.json(cache).count() == n


@pytest.mark.parametrize("crash", ["before", "within", "after writing"])
def test_a_crash_at_any_point_resumes_right(spark, tmp_path, monkeypatch, crash):
    """Stages a -> b -> c; the second run, on other parameters of b, crashes there; the first run's tables are untouched, and only what changed is made again."""
    df = spark.range(5)
    made = []

    def go(x, broken=None):
        run = runs.Run(spark, str(tmp_path), {"in": df})

        def make(name, source, f):
            def inner():
                made.append(name)
                if name == broken and crash == "before":
                    raise RuntimeError("before")
                out = f(source)
                return out.withColumn("z", F.raise_error(F.lit("within"))) if name == broken and crash == "within" else out
            return inner

        if broken and crash == "after writing":
            note = run.note
            monkeypatch.setattr(run, "note", lambda status, stage=None, run=None: (_ for _ in ()).throw(RuntimeError("after")) if stage == broken else note(status, stage, run))
        a = run.stage("a", make("a", df, lambda d: d.withColumn("a", F.col("id") + 1)), ["in"])
        b = run.stage("b", make("b", a, lambda d: d.withColumn("b", F.col("a") * x)), ["a"], x=x)
        c = run.stage("c", make("c", b, lambda d: d.agg(F.sum("b").alias("s"))), ["b"])
        run.note("done")
        return c.first()["s"]

    assert go(1) == 15 and made == ["a", "b", "c"]
    with pytest.raises(Exception, match=".*"):
        go(2, broken="b")
    made.clear()
    assert go(1) == 15 and made == []  # what was committed before the crash is whole
    assert go(2) == 30 and made == ["b", "c"]
    made.clear()
    assert go(2) == 30 and made == []
    log = runs.log_of(spark, str(tmp_path)).groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in log}["interrupted"] == 1


def test_listed_blocks_stay_beyond_the_best(spark, tmp_path):
    """One place for the best; the second listed block stays, the spare one goes, an unlabelled one is recovered, and raters that differ are asked again."""
    at = lambda n: f"Dev.Port.L050_W.L050_1_A1_{n}"
    facts = spark.createDataFrame([_leaf(0, at("PUMP_FLOW")), _leaf(1, at("PUMP_SPEED")), _leaf(2, at("SPARE_PUMP")), _leaf(3, "Dev.Port.PUMP_TEMP")], ENTRY)
    reqs = spark.createDataFrame([("R1", "The unit shall transmit L050 PUMP_FLOW, PUMP_SPEED and PUMP_TEMP")], "req_id string, content string")

    def rater(provider, prompt):
        return ("covered", "", 1.0) if "=" in prompt or provider == "alpha" else ("inconsistent" if provider == "beta" else "needs_review", "", 1.0)

    out = runs.req_to_spec(spark, facts, reqs, WORDS, str(tmp_path), rater=rater, k=1).first()
    got = {r["block_key"] for r in runs.stage_table(spark, str(tmp_path), "refined").collect()}
    assert got == {"L050/PUMP_FLOW", "L050/PUMP_SPEED", "Port/PUMP_TEMP"}
    assert runs.stage_table(spark, str(tmp_path), "second_verdicts").count() == 3
    assert (out["agreement"], out["stars"]) == ("full", 5)


def test_a_changed_run_is_computed_again(spark, tmp_path):
    """Other parameters or inputs in the same folder: no stage of the run before is taken; the same ones again, their rows in any order: every stage is."""
    reqs = spark.createDataFrame([("R1", "a"), ("R2", "b")], "req_id string, content string")
    made = []

    def go(k, inputs):
        run = runs.Run(spark, str(tmp_path), {"requirements": inputs})
        out = run.stage("one", lambda: made.append(1) or inputs.withColumn("k", F.lit(k)), ["requirements"], k=k).collect()
        run.note("done")
        return {(r["req_id"], r["k"]) for r in out}

    assert go(1, reqs) == {("R1", 1), ("R2", 1)} and len(made) == 1
    assert go(1, reqs.orderBy(F.desc("req_id"))) == {("R1", 1), ("R2", 1)} and len(made) == 1
    assert go(2, reqs) == {("R1", 2), ("R2", 2)} and len(made) == 2
    assert go(2, reqs.limit(1)) == {("R1", 2)} and len(made) == 3
    assert go(1, reqs) == {("R1", 1), ("R2", 1)} and len(made) == 3  # still there


def test_sheets_of_one_name_in_two_files_stay_apart(spark):
    from tracery.sources import office

    def sheet(file, value):
        head = [(file, "CAN-a", 1, 0, "Publisher"), (file, "CAN-a", 2, 0, "Port"), (file, "CAN-a", 3, 0, "Name"), (file, "CAN-a", 3, 1, "Size")]
        return [*head, (file, "CAN-a", 4, 0, f"P{value}"), (file, "CAN-a", 4, 1, value)]

    cells = spark.createDataFrame([*sheet("x", "1"), *sheet("y", "2"), ("z", "CAN-a", 1, 0, "Publisher")], "file string, sheet string, row int, col int, value string")
    got = {(r["file"], r["path"], r["value"]) for r in office.spec_entries(cells).where("attr = 'Size'").collect()}
    assert got == {("x", "P1", "1"), ("y", "P2", "2")}


def test_conflicts_are_resolved_first(spark):
    from tracery.operators import entries

    rows = [(0, "a", "RP", "p", "Units", "m", None), (1, "a", "DP", "p", "Units", "ft", None), (2, "b", "DP", "p", "Units", "ft", None), (3, "a", "RP", "p", "Period", "5", None), (4, "a", "RP", "p", "Period", "5", None), (5, "a", "DP", "p", "BitOffset", "1", "x"), (6, "a", "DP", "p", "BitOffset", "1", "y")]
    df = spark.createDataFrame(rows, "ord long, sheet string, side string, path string, attr string, value string, ref_name string").withColumn("layer", F.col("side"))
    assert sorted(r["ord"] for r in entries.resolved(df).collect()) == [1, 3, 5, 6]
    assert sorted(r["ord"] for r in entries.resolved(df.drop("sheet", "ref_name")).collect()) == [1, 3, 5]


def test_unreadable_trace_files_are_rows(spark):
    from tracery.operators import trace

    cells = spark.createDataFrame([("a", "s", "v"), ("b", None, "error: BadZipFile"), ("c", None, "error: KeyError")], "file string, sheet string, value string")
    expected = spark.createDataFrame([("a",), ("d",)], "file string")
    assert {tuple(r) for r in trace.file_errors(cells, expected).collect()} == {("b", "open_error"), ("c", "parse_error"), ("d", "missing_file")}


def test_cached_parses_are_read(spark, tmp_path):
    from tracery.sources import office

    spark.createDataFrame([("R1", "x")], "req_id string, content string").write.json(str(tmp_path / "q.json"))
    assert office.facts(spark, str(tmp_path / "q.json")).count() == 1 and office.facts(spark, "a.xlsx") is None


def test_name_direction_and_fields_in_full(spark):
    """Precise keywords match at boundaries, others as parts; numbers, named protocol families, softened directions, sub-signals and hinted formats."""
    from tracery.operators import match

    base = {
        "r_tokens": "cast(array() as array<string>)", "b_tokens": "array('x')", "r_direction": "'send'", "b_direction": "'receive'", "r_fields": "array(named_struct('offset', 3, 'size', 2))", "b_fields": "cast(array() as array<struct<offset: int, size: int>>)",
        "r_sdi": "array('1')", "b_sdi": "array('2')", "r_category": "'bus'", "b_format": "'BNR'", "r_devices": "array('d')", "b_devices": "array('e')", "r_channel": "''", "b_channel": "''", "r_buses": "array('a')", "b_buses": "array('b')",
    }

    def dims(soften=False, **more):
        df = spark.range(1).selectExpr(*(f"{v} AS {k}" for k, v in (base | more).items()))
        return match.score(df, soften).first()

    assert dims()["total"] == 0
    family = "'aftefan1_hw_fault'"
    assert dims(b_family=family, r_keywords="array('AFTEFAN1', 'AFTEFAN2', 'fault', 'hw')")["d_name"] == 16  # hw is too short
    assert dims(b_family=family, r_components="array('AFTEFAN2')", r_keywords="array('zzz')")["d_name"] == 0
    assert dims(b_family="'edp_034'", r_keywords="array('none')", r_numbers="array('034', '035')")["d_name"] == 10
    assert dims(b_family=family, r_numbers="array('1')", named="true")["d_name"] == 30
    assert dims(soften=True)["d_direction"] == 0 and dims(soften=True, b_sdi="array('1')")["d_direction"] == 8 and dims(b_sdi="array('1')")["d_direction"] == 0
    assert dims(soften=True, b_family=family, named="true")["d_direction"] == 8
    assert dims(b_sub_fields="array(named_struct('offset', 3, 'size', 2))")["d_bit"] == 20 and dims(b_sub_fields="array(named_struct('offset', 9, 'size', 2))")["d_bit"] == 8
    assert dims(r_hint="'BNR'")["d_type"] == 10 and dims(r_hint="'DIS'")["d_type"] == 5 and dims(r_hint="''", b_format="'CHAR'")["d_type"] == 0


def test_raters_have_a_time_limit(spark):
    """The others have a little time once two are back; a rater that hangs is too late and holds nothing up."""
    import time

    from tracery.operators import verdict

    now = lambda: ("covered", "", 1.0)
    timeout = ("error", "timeout", 0.0)

    def slow(seconds):
        return lambda: time.sleep(seconds) or now()

    def asked(cases, **limits):
        return {(c, p): v for c, p, v in verdict.asked(iter(cases), **limits)}

    start = time.monotonic()
    assert asked([("1", [("a", now), ("b", slow(30)), ("c", now)])], ceiling=20, grace=0.2, drain=0.1) == {("1", "a"): now(), ("1", "b"): timeout, ("1", "c"): now()}
    assert asked([("1", [("a", now), ("b", slow(30))])], ceiling=0.3, grace=0.1, drain=0) == {("1", "a"): now(), ("1", "b"): timeout}
    assert time.monotonic() - start < 5

    def rater(provider, prompt):
        if provider == "c":
            time.sleep(30)
        return "covered", prompt, 1.0

    cases = spark.createDataFrame([("1", "x"), ("2", "y")], "case_id string, prompt string").coalesce(1)
    providers = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "provider string, provider_ord int").coalesce(1)
    got = {(r["case_id"], r["provider"]): (r["status"], r["analysis"]) for r in verdict.judged(cases, providers, rater, grace=0.2, drain=0.2).collect()}
    assert got == {(c, p): ("covered", t) for c, t in (("1", "x"), ("2", "y")) for p in "ab"} | {(c, "c"): ("error", "timeout") for c in "12"}


def test_slow_raters_overlap_and_late_answers_count():
    """Twenty cases of two slow calls each take as long as their shares of the calls at a time; an answer after its case's time still counts, and is asked for once."""
    import threading
    import time

    from tracery.operators import verdict

    lock, state = threading.Lock(), {"now": 0, "most": 0, "calls": 0}

    def call(seconds):
        def run():
            with lock:
                state["now"] += 1
                state["calls"] += 1
                state["most"] = max(state["most"], state["now"])
            time.sleep(seconds)
            with lock:
                state["now"] -= 1
            return "covered", f"{seconds}", 1.0

        return run

    start = time.monotonic()
    got = list(verdict.asked(iter([(i, [("a", call(0.2)), ("b", call(0.2))]) for i in range(20)]), calls=10, open_cases=8))
    assert len(got) == 40 and all(v[0] == "covered" for _, _, v in got)
    assert 0.7 < time.monotonic() - start < 4 and state["most"] == 10
    state["calls"] = 0
    late = []
    out = {(c, p): v for c, p, v in verdict.asked(iter([(1, [("a", call(0)), ("b", call(0)), ("slow", call(0.6))]), (2, [("a", call(0))])]), grace=0.1, drain=5, late=late.append)}
    assert out[1, "slow"] == ("covered", "0.6", 1.0) and late == ["slow"] and state["calls"] == 4 and len(out) == 4
    # a call that hangs frees its place
    out = {(c, p): v for c, p, v in verdict.asked(iter([(1, [("hangs", call(20))]), (2, [("a", call(0))])]), ceiling=0.3, drain=0, calls=1)}
    assert out == {(1, "hangs"): ("error", "timeout", 0.0), (2, "a"): ("covered", "0", 1.0)} or out[2, "a"][1] == "timeout"


def test_disagreements(spark):
    from tracery.operators import verdict

    rows = [("1", "covered"), ("1", "inconsistent"), ("2", "covered"), ("2", "needs_review"), ("3", "covered"), ("3", "error"), ("4", "error"), ("5", "covered"), ("5", "inconsistent"), ("5", "needs_review")]
    got = {r["case_id"]: r["disagreements"] for r in verdict.disagreements(spark.createDataFrame(rows, "case_id string, status string")).collect()}
    assert got == {"1": ["key"], "2": ["vague"], "3": [], "4": [], "5": ["key", "vague"]}


def test_block_levels_of_lost_and_refuted_candidates(spark):
    from tracery.operators import coverage

    blocks = spark.createDataFrame([("lost", ["m"]), ("none", []), ("refuted", []), ("refuted_lost", ["m"]), ("silent", []), ("weak", [])], "block_key string, missing array<string>")
    pairs = spark.createDataFrame(
        [("refuted", "a", 1, "not_same_object"), ("refuted_lost", "a", 1, "not_same_object"), ("silent", "a", 1, "none"), ("silent", "b", 2, "not_same_object"), ("weak", "a", 1, "none"), ("weak", "b", 2, "weak_signal"), ("weak", "c", 3, "generic_signal"), ("weak", "d", 0, "generic_signal")],
        "block_key string, req_id string, rank int, level string")
    got = {r["block_key"]: (r["rule_level"], r["analysis_status"], r["needs_ai"], r["matched"], r["shown"]) for r in coverage.deterministic(blocks, pairs).collect()}
    assert got == {
        "lost": ("input_error", "input_error", False, [], []), "none": ("no_evidence", "uncovered", False, [], []), "refuted": ("not_same_object", "uncovered", False, [], ["a"]),
        "refuted_lost": ("not_same_object", "possible", False, [], ["a"]), "silent": ("trace_only", "possible", True, [], ["a", "b"]), "weak": ("generic_signal", "possible", True, ["d", "c"], ["d", "a", "b", "c"]),
    }
