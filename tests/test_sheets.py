"""Workbooks of both sides, read from files; odd cells; rulesets by the tables of a document."""

import json

import pytest

from tracery.operators import entries as E
from tracery.operators import sheets
from tracery.plans import runs
from tracery.sources import office, rulesets

from .test_micro import WORDS, _docx, _xlsx

HEAD = [["Publisher", None, None, None, None, "Subscriber"], ["Port", "DP", None, None, None, "LogicalPort", None, "RP"], ["Name", "Name", "BitOffsetWithinDS", "ParameterSize", "Notes", "Name", "Tag", "Name", "Label", "SDIExpected", "ParameterSize"]]
CELLS = "file string, sheet string, table_ord int, row int, col int, value string"


def _entries(df):
    return {(r["row"], r["side"], r["layer"], r["path"], r["bus"], r["attr"], r["value"], r["ref_name"]) for r in df.collect()}


def test_both_sides(spark, tmp_path):
    rows = [
        ["P", "PUMP", 3, 2, "n", "Q", "CAN bus", "FLOW", "L050", "01", 9],
        ["P", "SYNC", 1, 1, None, "Q", None, "SKIPPED", "L051"],
        ["P", None, 4, None, None, "Q", "Scan", "LOOSE", "L052", None, 8],
        [None, None, None, None, None, "Q", None, "BARE", None, "10", 8],
        ["P", "VALVE", None, None, None, "Q", None, None, "L053"],
    ]
    for name in ("pub", "sub"):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.xlsx").write_bytes(_xlsx({"A664-1": HEAD + rows, "short": HEAD}))
    (tmp_path / "pub" / "broken.xlsx").write_bytes(b"no zip")
    pub, sub = (office.read_cells(spark, str(tmp_path / n)) for n in ("pub", "sub"))
    layout = sheets.Layout(frames=("sync",))
    assert _entries(sheets.interface_entries(pub, None, layout)) == {
        (4, "DP", "DP", "P.PUMP", "A664", "BitOffset", "3", None), (4, "DP", "DP", "P.PUMP", "A664", "ParameterSize", "2", None), (5, "DP", "DP", "P.SYNC", "A664", "BitOffset", "1", None),
        (5, "DP", "DP", "P.SYNC", "A664", "ParameterSize", "1", None)}
    got = _entries(sheets.interface_entries(None, sub, layout))
    assert got == {
        # its own label and SDI, the leaf's size, the offset that it lacks, and the size once more as the part's
        (4, "RP", "RP", "Q.FLOW", "CAN", "Label", "L050", None), (4, "RP", "RP", "Q.FLOW", "CAN", "SDI", "01", None), (4, "RP", "RP", "Q.FLOW", "CAN", "ParameterSize", "2", None),
        (4, "RP", "RP", "Q.FLOW", "CAN", "BitOffset", "3", "PUMP"), (4, "RP", "RP", "Q.FLOW", "CAN", "ParameterSize", "2", "PUMP"),
        (4, "DP", "DP", "P.PUMP", "CAN", "BitOffset", "3", None), (4, "DP", "DP", "P.PUMP", "CAN", "ParameterSize", "2", None),
        # a leaf without a name: what it refers to alone; its own size stays, as the leaf has none
        (6, "RP", "RP", "Q.LOOSE", "A664", "Label", "L052", None), (6, "RP", "RP", "Q.LOOSE", "A664", "ParameterSize", "8", None), (6, "RP", "RP", "Q.LOOSE", "A664", "BitOffset", "4", ""),
        (6, "DP", "DP", "P", "A664", "BitOffset", "4", None),
        # no attribute of a leaf: its own business alone
        (7, "RP", "RP", "Q.BARE", "A664", "SDI", "10", None)}
    sheets.interface_entries(pub, sub, layout).write.parquet(str(tmp_path / "both"))
    both = spark.read.parquet(str(tmp_path / "both"))
    assert both.count() == 4 + len(got) and both.select("ord").distinct().count() == both.count()
    # the rows go through an analysis as they are
    reqs = spark.createDataFrame([("R1", "The label L050 gives PUMP at bit 3")], "req_id string, content string")
    assert E.resolved(both).count() > 0 and runs.req_to_spec(spark, both, reqs, WORDS, str(tmp_path / "run")).count() == 1


def test_odd_cells(spark):
    empty = spark.createDataFrame([], CELLS)
    assert sheets.interface_entries(empty).count() == 0 and sheets.interface_entries(empty, empty).count() == 0
    with pytest.raises(ValueError):
        sheets.interface_entries(None)
    blank = spark.createDataFrame([("f", "s", 0, r, c, v) for r, c, v in [(1, 0, "Other"), (2, 0, "DP"), (3, 0, "Name"), (4, 0, "X"), (5, 1, None), (6, 0, "  ")]] + [("f", None, None, None, None, "error: BadZipFile")], CELLS)
    assert sheets.interface_entries(blank, blank).count() == 0
    # a sheet without a publisher keeps all that the subscriber says; repeated rows of a workbook are rows; a very long name stays whole
    long_ = "N" * 100_000
    only = [(r, c, v) for r, c, v in [(1, 0, "Subscriber"), (2, 0, "RP"), (3, 0, "Name"), (3, 1, "Unit")]] + [(r, c, v) for r in (4, 5) for c, v in ((0, long_), (1, " V "))]
    got = sheets.interface_entries(None, spark.createDataFrame([("f", "CAN", 0, *x) for x in only], CELLS)).collect()
    assert [(r["path"] == long_, r["bus"], r["attr"], r["value"]) for r in got] == [(True, "CAN", "Unit", "V")] * 2


def test_the_last_of_equal_columns_counts(spark, monkeypatch):
    heads = [(1, 0, "Publisher"), (2, 0, "DP"), (3, 0, "Name"), (3, 1, "Unit"), (3, 2, "Unit")]
    rows = [(4, 0, "A"), (4, 1, "a"), (4, 2, "b"), (5, 0, "B"), (5, 1, "c"), (5, 2, " "), (6, 0, "C"), (6, 1, "d"), (6, 2, None)]
    cells = spark.createDataFrame([("f", "CAN", 0, *x) for x in heads + rows], CELLS)
    for most in (sheets.BROADCAST_COLUMNS, 0):
        monkeypatch.setattr(sheets, "BROADCAST_COLUMNS", most)
        assert sorted((r["path"], r["value"]) for r in sheets.interface_entries(cells).collect()) == [("A", "b"), ("C", "d")]


def test_rulesets_by_tables(spark, tmp_path):
    (tmp_path / "rules").mkdir()
    sections = {
        "b": {"required_rows": 3, "required_cols": 2, "cell_patterns": {"0": {"contains": "ID"}, "1": {"starts_with": "PX", "row": 1}}}, "a": {"min_rows": 2, "required_cols": 3, "cell_patterns": {"2": {"starts_with": "Q", "row": 1}}},
        "c": {"required_cols": 2}, "d": None}
    for name, section in sections.items():
        (tmp_path / "rules" / f"{name}.json").write_text(json.dumps({"auto_detect": section}))
    found = rulesets.load(spark, str(tmp_path / "rules"))
    other, fits = [["x", "y"]] * 2, [["the ID", "v"], ["k", "PX-1"], ["k", "v"]]

    def pick(*tables):
        where = tmp_path / str(len(list(tmp_path.iterdir())))
        where.mkdir()
        (where / "r.docx").write_bytes(_docx(tables))
        return rulesets.chosen(found, office.read_cells(spark, str(where))).name

    assert pick(other, fits) == "b" and pick(other) == "c" and pick(fits, [["1", "2", "3"], ["1", "2", "Q3"]]) == "a"
    with pytest.raises(ValueError):
        pick([["x"]])


def test_rulesets_of_odd_tables(spark):
    """Files without an id are one file, as in SQL; checks beyond those of one number; a place met by several cells; tables whose files are told apart."""
    many = [(r, c, None, f"v{r}.{c};") for r in range(1, 11) for c in range(7)]
    rules = spark.createDataFrame([("many", 10, None, 7, many), ("b", None, 2, None, []), ("a", None, None, 1, [(1, 0, "x", "y"), (1, 0, None, "z")]), ("none", 99, None, None, None)], sheets.RULES)
    full = [(r, c, f" v{r}.{c}; ") for r, c, *_ in many]
    tables = [
        ("f", 1, full), ("g", 2, [x for x in full if x != (9, 6, " v9.6; ")]), ("h", 3, full[:-1] + [(10, 6, None)]), (None, 4, [(1, 0, "xy")]), (None, 5, [(1, 0, "xay"), (1, 0, "z")]), ("i", 6, [(1, 0, "xy"), (1, 0, " ")]),
        ("j", 7, [(1, 0, "x"), (1, 1, "y"), (2, 0, "z")])]
    cells = spark.createDataFrame([(f, t, *x) for f, t, xs in tables for x in xs], "file string, table_ord int, row int, col int, value string")
    # "b" comes before "many" wherever the shape fits; without it the full table alone is left
    assert dict(map(tuple, sheets.ruleset_of_tables(cells, rules).collect())) == {"f": "b", "g": "b", "h": "b", "j": "b", None: "a"}
    some = rules.where("ruleset <> 'b'")
    assert dict(map(tuple, sheets.ruleset_of_tables(cells, some).collect())) == {"f": "many", None: "a"}
    assert sheets.ruleset_of_tables(cells, rules.where("false")).count() == 0
    files = spark.createDataFrame([(f, t) for f, t, _ in tables] + [("k", 1), ("k", 8), ("l", None)], "file string, table_ord int")
    assert dict(map(tuple, sheets.ruleset_of_tables(cells.drop("file"), some, files).collect())) == {"f": "many", "k": "many", None: "a"}
