"""Interface workbooks, from cells to the entries of both sides: what a subscriber takes over from the publisher of its row, what is given again as the publisher's, frames, buses, and the ruleset
that a document goes by (S1, S18, F7-F9, P6, P7)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import display_path, has_frame_word
from ..stored import saved
from . import entries as E

# Names of attributes, layers and buses in the workbooks.
EXCLUDED = ("Name", "Guid", "FullName", "ATA", "Tag", "Notes", "ChangeAuthority", "FCUPortNumber", "EdeAgeMax", "EdeAgeValidation")
BUSES = ("A429", "A664", "A825", "CAN", "AFDX", "Analog", "Discrete")
WHOLE_WORDS = ("CAN",)
OWN = ("Label", "SDIExpected")
OF_PARTS = ("DataFormatType", "ParameterSize")
REFERENCED = ("ParameterSize", "BitOffsetWithinDS")
#: What the analyses call some of the attributes.
NAMES = {"BitOffsetWithinDS": "BitOffset", "SDIExpected": "SDI"}


@dataclass(frozen=True)
class Layout:
    """How a workbook is laid out and what its attributes are called."""

    publisher: str = "Publisher"
    subscriber: str = "Subscriber"
    port: str = "LogicalPort"
    least_rows: int = 4
    frames: tuple[str, ...] = ()
    excluded: tuple[str, ...] = EXCLUDED
    own: tuple[str, ...] = OWN
    of_parts: tuple[str, ...] = OF_PARTS
    referenced: tuple[str, ...] = REFERENCED
    buses: tuple[str, ...] = BUSES
    whole_words: tuple[str, ...] = WHOLE_WORDS


def bus_in(text: Column, layout: Layout, begins: bool = False) -> Column:
    """The first bus, in the layout's order, whose name begins a word of the text (is one, for whole words), in either case; with `begins` one that begins the text comes before; null if there is none."""
    word = lambda b: text.rlike(f"(?i)\\b\\Q{b}\\E" + ("\\b" if b in layout.whole_words else ""))
    first = [F.when(F.startswith(F.upper(text), F.lit(b.upper())), b) for b in layout.buses] if begins else []
    return F.coalesce(*first, *(F.when(word(b), b) for b in layout.buses))


#: Columns of sheets that are sent to every task; beyond, cells are dealt out to meet them.
BROADCAST_COLUMNS = 200_000


def _rows(cells: DataFrame, layout: Layout) -> DataFrame:
    """A row for each row of a sheet: `cells`, the values of both sides in order, and of its sheet the last layer of the subscriber, the last leaf layer of the publisher, whether it has a publisher.

    What the header rows say of a sheet's columns is written first; cells meet it where they are, and are shuffled once, to their row.
    """
    tall = cells.groupBy("sheet").agg(F.max("row").alias("rows")).where(F.col("rows") >= layout.least_rows).select("sheet")
    top = saved(cells.where("row <= 3").join(tall, "sheet", "left_semi"), "sheet-heads")
    ranges = E.layer_ranges(top, E.side_starts(top, [layout.publisher, layout.subscriber])).withColumn("side", F.when(F.col("side") == layout.publisher, E.PUBLISHER).otherwise(E.SUBSCRIBER))
    ranges = saved(ranges, "sheet-ranges")
    last = lambda hit: F.max(F.when(hit, F.col("start")))
    sheets = ranges.groupBy("sheet").agg(
        last(F.col("side") == E.SUBSCRIBER).alias("last_sub"), last((F.col("side") == E.PUBLISHER) & (F.col("layer") == E.PUBLISHER)).alias("last_leaf"), F.max(F.col("side") == E.PUBLISHER).alias("published"),
        F.min(F.when((F.col("side") == E.SUBSCRIBER) & (F.col("layer") == layout.port), F.col("start"))).alias("first_port"))
    columns = saved(E.layer_columns(top, ranges), "sheet-columns")
    few = columns.count() <= BROADCAST_COLUMNS
    small = F.broadcast if few else lambda df: df.hint("merge")
    values = cells.where((F.col("row") > 3) & F.col("value").isNotNull()).join(small(columns), ["sheet", "col"])
    at = F.collect_list(F.struct("start", "attr", "col", "value", "side", "layer"))
    # dealt out first, and to as many parts as are set: cells are sorted to make rows of them, after the shuffle and a small part at a time
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = values.repartition(n, "sheet", "row").groupBy("sheet", "row").agg(F.sort_array(at).alias("cells"))
    x = F.col("cells")
    # of an attribute that a layer has twice the last column counts
    final = F.filter(x, lambda c, i: F.coalesce((F.get(x, i + 1)["start"] != c["start"]) | (F.get(x, i + 1)["attr"] != c["attr"]), F.lit(True)))
    final = F.transform(final, lambda c: F.struct(c["start"].alias("start"), c["attr"].alias("attr"), F.trim(c["value"]).alias("value"), c["side"].alias("side"), c["layer"].alias("layer")))
    return rows.withColumn("cells", F.filter(final, lambda c: c["value"] != "")).where(F.size("cells") > 0).join(small(sheets), "sheet")


def interface_entries(publishers: DataFrame | None, subscribers: DataFrame | None = None, layout: Layout = Layout(), names: dict[str, str] | None = None) -> DataFrame:
    """(file, sheet, row, side, layer, path, bus, attr, value, ref_name, ord) from the cells (file, sheet, table_ord, row, col, value) of publishers' and subscribers' workbooks; one of them may be missing.

    Of a publishers' row whose leaf has a name, every named layer's attributes.  A subscribers' row counts where its last layer has a name and no frame is received, and gives, with the bus that the
    port's tag, else the full name, else the sheet tells: its own attributes, where those that aren't the subscriber's own business have the value of the publisher's leaf; the leaf's attributes
    that it lacks, and those of parts once for each part, with the part as `ref_name`; without any attribute of a leaf, its own business alone.  The publisher's attributes in such a row are given
    again as the publisher's, and if the leaf has no name, the referenced ones alone.  `names` renames attributes (NAMES, where it isn't given).

    A sheet's row, never a sheet, is what a task holds together.  Null and blank cells give nothing; error rows of `read_cells` are no sheet; without rows the result is empty.
    """
    given = [df.withColumn("role", F.lit(role)) for role, df in enumerate((publishers, subscribers)) if df is not None]
    if not given:
        raise ValueError("neither publishers nor subscribers")
    cells = given[0].unionByName(given[1]) if len(given) == 2 else given[0]
    cells = cells.where("sheet is not null").select(F.struct("role", "file", "table_ord", "sheet").alias("sheet"), "row", "col", "value")
    x, nothing = F.col("cells"), F.lit("")
    of = lambda side: F.filter(x, lambda c: c["side"] == side)
    at = lambda start, attr, side: F.coalesce(F.get(F.transform(F.filter(x, lambda c: (c["side"] == side) & (c["start"] == start) & (c["attr"] == attr)), lambda c: c["value"]), F.lit(0)), nothing)
    named = lambda side: F.transform(F.filter(x, lambda c: (c["side"] == side) & (c["attr"] == "Name")), lambda c: F.struct(c["start"].alias("start"), c["value"].alias("name")))
    rows = _rows(cells, layout).withColumns({
        "p_names": named(E.PUBLISHER), "s_names": named(E.SUBSCRIBER), "leaf_name": at(F.col("last_leaf"), "Name", E.PUBLISHER), "sub_name": at(F.col("last_sub"), "Name", E.SUBSCRIBER),
        "tag": at(F.col("first_port"), "Tag", E.SUBSCRIBER), "full_name": at(F.col("last_sub"), "FullName", E.SUBSCRIBER), "sheet_bus": F.split_part("sheet.sheet", F.lit("-"), F.lit(1)),
    })
    path = lambda all_, start=None: display_path(F.transform(all_ if start is None else F.filter(all_, lambda n: n["start"] <= start), lambda n: n["name"]))
    by_tag = bus_in(F.col("tag"), layout)
    told = F.when(by_tag != F.col("sheet_bus"), by_tag)
    stated = lambda c: ~c["attr"].isin(list(layout.excluded))
    rows = rows.withColumns({
        "bus": F.coalesce(told, bus_in(F.col("full_name"), layout, begins=True), F.col("sheet_bus")), "p_path": path(F.col("p_names")), "s_path": path(F.col("s_names")),
        "parts": F.filter(of(E.PUBLISHER), lambda c: (c["layer"] == E.PUBLISHER) & stated(c)),
    })
    # of equal attributes of several parts the last one counts
    rows = rows.withColumn("whole", F.map_from_entries(F.transform(F.filter("parts", lambda c: ~F.exists("parts", lambda d: (d["attr"] == c["attr"]) & (d["start"] > c["start"]))), lambda c: F.struct(c["attr"], c["value"]))))

    def entry(c: Column, kind: int, side: str, where: Column, bus: Column, value: Column | None = None, layer: Column | None = None, ref: Column | None = None) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), c["start"].alias("start"), F.lit(side).alias("side"), (c["layer"] if layer is None else layer).alias("layer"), where.alias("path"), bus.alias("bus"), c["attr"].alias("attr"),
            (c["value"] if value is None else value).alias("value"), (F.lit(None).cast("string") if ref is None else ref).alias("ref_name"))

    def of_layers(side: str, names_: Column, make) -> Column:
        return F.transform(F.filter(of(side), lambda c: stated(c) & F.exists(names_, lambda n: n["start"] == c["start"])), make)

    mine = lambda c: c["attr"].isin(list(layout.own))
    bus, p_names, s_names, whole = F.col("bus"), F.col("p_names"), F.col("s_names"), F.col("whole")
    published = of_layers(E.PUBLISHER, p_names, lambda c: entry(c, 0, E.PUBLISHER, path(p_names, c["start"]), F.col("sheet_bus")))
    taken = of_layers(E.SUBSCRIBER, s_names, lambda c: entry(c, 0, E.SUBSCRIBER, path(s_names, c["start"]), bus, F.when(mine(c), c["value"]).otherwise(F.coalesce(F.get(F.map_values(F.map_filter(whole, lambda k, _: k == c["attr"])), F.lit(0)), c["value"]))))
    rows = rows.withColumn("taken", F.filter(taken, lambda e: e["attr"].isin(list(layout.own)) | ~F.col("published") | (F.size("parts") > 0)))
    has = F.transform("taken", lambda e: e["attr"])
    part_name = lambda c: F.coalesce(F.get(F.transform(F.filter(p_names, lambda n: n["start"] == c["start"]), lambda n: n["name"]), F.lit(0)), nothing)
    added = F.transform(
        F.filter("parts", lambda c: ~mine(c) & (~F.array_contains(has, c["attr"]) | c["attr"].isin(list(layout.of_parts)))), lambda c: entry(c, 1, E.SUBSCRIBER, F.col("s_path"), bus, layer=F.lit(E.SUBSCRIBER), ref=part_name(c)))
    again = F.when(F.col("leaf_name") != "", of_layers(E.PUBLISHER, p_names, lambda c: entry(c, 2, E.PUBLISHER, F.col("p_path"), bus)))
    leaf = F.filter(of(E.PUBLISHER), lambda c: (c["start"] == F.col("last_leaf")) & c["attr"].isin(list(layout.referenced)))
    referenced = F.when((F.col("leaf_name") == "") & (F.col("p_path") != ""), F.transform(leaf, lambda c: entry(c, 3, E.PUBLISHER, F.col("p_path"), bus)))
    none = F.filter(published, lambda _: F.lit(False))
    received = (F.col("sub_name") != "") & ~(has_frame_word(F.col("leaf_name"), layout.frames) if layout.frames else F.lit(False))
    all_ = F.when(F.col("sheet.role") == 0, F.when(F.col("leaf_name") != "", published)).when(received, F.concat("taken", added, F.coalesce(again, none), F.coalesce(referenced, none)))
    out = rows.select("sheet", "row", F.explode(all_).alias("e"))
    attr = F.col("e.attr")
    for old, new in (NAMES if names is None else names).items():
        attr = F.when(F.col("e.attr") == old, new).otherwise(attr)
    return out.select(
        "sheet.file", "sheet.sheet", "row", "e.side", "e.layer", "e.path", "e.bus", attr.alias("attr"), "e.value", "e.ref_name",
        F.struct("sheet.role", "sheet.file", "sheet.table_ord", "row", "e.kind", "e.start", "e.attr").alias("ord"))


RULES = "ruleset string, exact_rows int, least_rows int, exact_columns int, checks array<struct<row: int, col: int, starts: string, has: string>>"


def ruleset_of_tables(cells: DataFrame, rules: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(file, ruleset): the first ruleset by id of those with a rule that any table of the file (file, table_ord, row from 1, col from 0, value) fits in its shape and in every checked cell.

    `rules` has RULES; null numbers ask for nothing, and of a check both words must fit, null ones do.  A cell outside the table, or without text, fits no check.  Files that fit no rule give no row.
    With `files` (file, table_ord), `cells` has no file, and `table_ord` names a table among those of all files.

    The rules are a ruleset each, hand-written and few, and are read on the driver.  A table is one row of numbers, its shape and a bit for each check that a cell of it fits, and is made before
    cells are shuffled; only tables that fit a rule meet their files.
    """
    found, text, bits = rules.collect(), F.trim("value"), 63
    checks = [(i, k) for i, rule in enumerate(found) for k in rule["checks"] or ()]
    words = [checks[i : i + bits] for i in range(0, len(checks), bits)]

    def hit(k) -> Column:
        given = [text.startswith(k["starts"])] if k["starts"] is not None else []
        given += [text.contains(k["has"])] if k["has"] is not None else []
        return reduce(and_, given, (F.col("row") == F.lit(k["row"])) & (F.col("col") == F.lit(k["col"])) & (text != ""))

    bit = lambda b: F.lit(1 << b).cast("long")
    hits = [F.bit_or(reduce(Column.bitwiseOR, [F.when(hit(k), bit(b)).otherwise(0) for b, (_, k) in enumerate(word)])).alias(f"hits{w}") for w, word in enumerate(words)]
    table = ["table_ord"] if files is not None else ["file", "table_ord"]
    tables = cells.groupBy(*table).agg(F.max("row").alias("rows"), (F.max("col") + 1).alias("columns"), *hits)

    def fits(i: int, rule) -> Column:
        asked = [F.col(f"hits{w}").bitwiseAND(bit(b)) != 0 for w, word in enumerate(words) for b, (of, _) in enumerate(word) if of == i]
        shape = (("exact_rows", F.col("rows") == rule["exact_rows"]), ("least_rows", F.col("rows") >= rule["least_rows"]), ("exact_columns", F.col("columns") == rule["exact_columns"]))
        return F.when(reduce(and_, asked + [op for name, op in shape if rule[name] is not None], F.lit(True)), F.lit(rule["ruleset"]))

    first = F.array_min(F.array(F.lit(None).cast("string"), *(fits(i, rule) for i, rule in enumerate(found))))
    fit = tables.select(*table, first.alias("ruleset")).where(F.col("ruleset").isNotNull())
    return (fit if files is None else fit.join(files, "table_ord")).groupBy("file").agg(F.min("ruleset").alias("ruleset"))


def rules_of(spark, found: Sequence[tuple[str, dict]]) -> DataFrame:
    """RULES from (ruleset, its section on detection) pairs: required_rows, min_rows, required_cols and cell_patterns, {column: {row, starts_with, contains}}, rows from 0; empty sections give no rule."""
    rows = [
        (name, s.get("required_rows"), s.get("min_rows"), s.get("required_cols"), [(p.get("row", 0) + 1, int(c), p.get("starts_with"), p.get("contains")) for c, p in (s.get("cell_patterns") or {}).items()])
        for name, s in found if s
    ]
    return spark.createDataFrame(rows, RULES)
