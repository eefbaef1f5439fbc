"""Workbooks (.xlsx) and documents (.docx) as long tables of cells.

Spark reads the bytes, so any store that it reaches will do.  An archive is taken apart into its members without unpacking them: each sheet of a workbook is a row of its own, dealt to a task of its own,
unpacked and parsed piece by piece, and its cells leave in batches; shared strings are a table that cells are joined to by number.  Sheets that aren't wanted are never unpacked.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "file string, sheet string, table_ord int, row int, col int, value string"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _number(text: str) -> str:
    """Whole numbers without a decimal point, as a reader of the sheet sees them."""
    try:
        x = float(text)
    except ValueError:
        return text
    return str(int(x)) if x.is_integer() and abs(x) < 1e15 else repr(x)


#: Bytes that are unpacked at a time, and rows of a batch that leaves a task.
STEP, BATCH = 1 << 16, 10_000
MEMBERS = "file string, kind string, sheet string, place int, method int, body binary, error string"
ERRORS = (zipfile.BadZipFile, KeyError, ElementTree.ParseError, zlib.error, AttributeError, ValueError)


def _member(data: bytes, z: zipfile.ZipFile, name: str) -> tuple[int, bytes]:
    """How a member is packed (0: not at all, 8: deflated) and its packed bytes."""
    i = z.getinfo(name)
    if i.compress_type not in (0, 8):
        raise zipfile.BadZipFile(f"{name} is packed in another way")
    n, m = (int.from_bytes(data[i.header_offset + k : i.header_offset + k + 2], "little") for k in (26, 28))
    at = i.header_offset + 30 + n + m
    return i.compress_type, data[at : at + i.compress_size]


def workbook_members(data: bytes, wanted: Sequence[str] | None) -> Iterator[tuple[str, str | None, int | None, int, bytes]]:
    """(kind, sheet, its place, method, body) of a workbook's sheets, those `wanted` by name if given, and its shared strings."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for place, s in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")):
            if wanted is None or s.get("name") in wanted:
                target = targets[s.get(f"{_REL}id")].lstrip("/")
                yield ("sheet", s.get("name"), place, *_member(data, z, target if target.startswith("xl/") else f"xl/{target}"))
        if "xl/sharedStrings.xml" in z.namelist():
            yield ("strings", None, None, *_member(data, z, "xl/sharedStrings.xml"))


def _elements(method: int, body: bytes, tag: str, around: str | None = None) -> Iterator[ElementTree.Element]:
    """The elements of a tag of a packed member, one after the other; each is let go when the next is asked for, and so are those `around` them."""
    parser, unpack = ElementTree.XMLPullParser(("start", "end")), zlib.decompressobj(-15) if method == 8 else None
    open_, left = [], body
    while left:
        if unpack:
            piece = unpack.decompress(left, STEP)
            left = b"" if unpack.eof else unpack.unconsumed_tail
        else:
            piece, left = left[:STEP], left[STEP:]
        parser.feed(piece)
        for event, e in parser.read_events():
            if event == "start":
                open_.append(e)
                continue
            open_.pop()
            if e.tag == tag:
                yield e
            if e.tag in (tag, around) and open_:
                open_[-1].remove(e)
    parser.close()


def sheet_cells(method: int, body: bytes) -> Iterator[tuple[int, int, str | None, int | None]]:
    """(row from 1, column from 0, value, number of the shared string) of each cell of a sheet that holds something; one of the last two."""
    for c in _elements(method, body, f"{_MAIN}c", f"{_MAIN}row"):
        v, kind, ref = c.find(f"{_MAIN}v"), c.get("t"), c.get("r")
        at = int(re.search(r"\d+", ref)[0]), _column(ref)
        if kind == "inlineStr":
            yield (*at, "".join(t.text or "" for t in c.iter(f"{_MAIN}t")), None)
        elif v is not None and v.text is not None:
            yield (*at, None, int(v.text)) if kind == "s" else (*at, v.text if kind in ("str", "b", "e") else _number(v.text), None)


def shared_strings(method: int, body: bytes) -> Iterator[tuple[int, str]]:
    for i, si in enumerate(_elements(method, body, f"{_MAIN}si")):
        yield i, "".join(t.text or "" for t in si.iter(f"{_MAIN}t"))


def document_cells(data: bytes) -> Iterator[tuple[str, int, int, int, str]]:
    """The same of a document's tables, in their order; a cell's paragraphs are joined by line breaks."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    for place, table in enumerate(body.iter(f"{_WORD}tbl")):
        for row, tr in enumerate(table.findall(f"{_WORD}tr"), 1):
            for col, tc in enumerate(tr.findall(f"{_WORD}tc")):
                yield f"table{place}", place, row, col, "\n".join("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in tc.findall(f"{_WORD}p"))


def _batches(rows: Iterator[tuple], columns: list[str], whole: Sequence[str]) -> Iterator[pd.DataFrame]:
    held = []
    frame = lambda: pd.DataFrame(held, columns=columns).astype(dict.fromkeys(whole, "Int32"))
    for r in rows:
        held.append(r)
        if len(held) == BATCH:
            yield frame()
            held.clear()
    if held:
        yield frame()


def _members(wanted: Sequence[str] | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for file, data in zip(x["path"], x["content"], strict=True):
                try:
                    own = workbook_members(bytes(data), wanted) if file.lower().endswith("xlsx") else [("document", None, None, 0, bytes(data))]
                    rows = [(file, *r, None) for r in own]
                except ERRORS as e:
                    rows = [(file, "error", None, None, None, None, type(e).__name__)]
                for r in rows:
                    yield pd.DataFrame([r], columns=["file", "kind", "sheet", "place", "method", "body", "error"]).astype({"place": "Int32", "method": "Int32"})

    return run


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cells of sheets and documents; one that can't be read to its end gives a row with a null sheet and the error as value besides."""

    def rows(x: pd.DataFrame) -> Iterator[tuple]:
        for r in x.itertuples():
            try:
                if r.kind == "error":
                    yield r.file, None, None, None, None, f"error: {r.error}", None
                elif r.kind == "sheet":
                    for row, col, value, number in sheet_cells(int(r.method), bytes(r.body)):
                        yield r.file, r.sheet, int(r.place), row, col, value, number
                else:
                    for c in document_cells(bytes(r.body)):
                        yield r.file, *c, None
            except ERRORS as e:
                yield r.file, None, None, None, None, f"error: {type(e).__name__}", None

    for x in batches:
        yield from _batches(rows(x), ["file", "sheet", "table_ord", "row", "col", "value", "number"], ("table_ord", "row", "col", "number"))


def _strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows(x: pd.DataFrame) -> Iterator[tuple]:
        for r in x.itertuples():
            try:
                yield from ((r.file, *s) for s in shared_strings(int(r.method), bytes(r.body)))
            except ERRORS as e:
                yield r.file, -1, f"error: {type(e).__name__}"

    for x in batches:
        yield from _batches(rows(x), ["file", "number", "shared"], ("number",))


def read_cells(spark: SparkSession, path: str, sheets: Sequence[str] | None = None) -> DataFrame:
    """Cells of all .xlsx and .docx files of a path, of workbooks those `sheets` alone, if given.  A file or sheet that can't be read gives a row with a null sheet and the error as value; a number that no
    shared string has is an empty value."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{xlsx,docx}").load(path)
    members = files.select("path", "content").mapInPandas(_members(sheets), MEMBERS)
    # a sheet is a task's row, not a file
    cells = members.where("kind <> 'strings'").repartition("file", "place").mapInPandas(_parsed, f"{CELLS}, number int")
    strings = members.where("kind = 'strings'").repartition("file").mapInPandas(_strings, "file string, number int, shared string")
    broken = strings.where("number < 0").select("file", *(F.lit(None).cast(t).alias(c) for c, t in (("sheet", "string"), ("table_ord", "int"), ("row", "int"), ("col", "int"))), F.col("shared").alias("value"))
    named = cells.where("number is not null").join(strings, ["file", "number"], "left").withColumn("value", F.coalesce("shared", F.lit("")))
    columns = ["file", "sheet", "table_ord", "row", "col", "value"]
    return cells.where("number is null").select(columns).union(named.select(columns)).union(broken)


def requirement_rows(cells: DataFrame, aliases: DataFrame, least_rows: int = 8, glossary: int = 0, only_requirements: bool = True) -> DataFrame:
    """(file, table_ord, fields map) of a document's key/value tables: tables after the glossary with two columns and enough rows; a key is looked up in `aliases`
    (alias, field), the last row of a field counts, tables marked as no requirement and without an id go."""
    big = cells.where(F.col("table_ord") > glossary).groupBy("file", "table_ord").agg(F.max("row").alias("rows"), F.max("col").alias("cols")).where((F.col("rows") >= least_rows) & (F.col("cols") >= 1))
    c = cells.join(big.select("file", "table_ord"), ["file", "table_ord"], "left_semi")
    keys = c.where("col = 0").select("file", "table_ord", "row", F.lower(F.trim("value")).alias("alias"))
    values = c.where("col = 1").select("file", "table_ord", "row", F.trim("value").alias("value"))
    known = keys.join(aliases.select(F.lower("alias").alias("alias"), "field"), "alias").join(values, ["file", "table_ord", "row"])
    last = known.groupBy("file", "table_ord", "field").agg(F.max_by("value", "row").alias("value"))
    out = last.groupBy("file", "table_ord").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("fields"))
    good = F.coalesce(F.col("fields")["id"], F.lit("")) != ""
    return out.where(good & ~F.lower(F.coalesce(F.col("fields")["is_requirement"], F.lit("yes"))).isin("no", "false") if only_requirements else good)


def glossary_rows(cells: DataFrame, glossary: int = 0) -> DataFrame:
    """(abbreviation, english, description) of the glossary table, without its header and rows that abbreviate nothing."""
    at = lambda k: F.max(F.when(F.col("col") == k, F.trim("value")))
    rows = cells.where((F.col("table_ord") == glossary) & (F.col("row") > 1)).groupBy("file", "row").agg(at(0).alias("abbreviation"), at(1).alias("english"), at(2).alias("description"))
    return rows.where("abbreviation <> ''").select("abbreviation", "english", "description")


def requirement_sheet(cells: DataFrame, first_row: int = 3) -> DataFrame:
    """(req_id, module, content) of the first sheet's columns A to C, with both an id and a content."""
    at = lambda k: F.max(F.when(F.col("col") == k, F.trim("value")))
    rows = cells.where((F.col("table_ord") == 0) & (F.col("row") >= first_row)).groupBy("file", "row").agg(at(0).alias("req_id"), at(1).alias("module"), at(2).alias("content"))
    return rows.where("req_id <> '' and content <> ''").select("req_id", "module", "content")


def spec_entries(cells: DataFrame, publisher: str = "Publisher", subscriber: str = "Subscriber", least_rows: int = 4) -> DataFrame:
    """(file, sheet, row, side, layer, path, bus, attr, value, ord) of spec workbooks: sides, layers and attributes are read from three header rows, names build the path, and the bus
    is the sheet's name up to the first -.  Sheets of one name in different files are different sheets."""
    from ..functions.text import display_path
    from ..operators import entries as E

    cells = cells.withColumn("sheet", F.struct("file", "sheet"))
    tall = cells.groupBy("sheet").agg(F.max("row").alias("rows")).where(F.col("rows") >= least_rows).select("sheet")
    c = cells.join(tall, "sheet", "left_semi")
    sides = E.side_starts(c, [publisher, subscriber])
    values = E.layer_values(c, E.layer_ranges(c, sides)).withColumn("side", F.when(F.col("side") == publisher, E.PUBLISHER).otherwise(E.SUBSCRIBER))
    names = values.where("attr = 'Name'").select("sheet", "row", "side", "start", F.col("value").alias("name"))
    above = values.join(names.withColumnRenamed("start", "s"), ["sheet", "row", "side"], "left").where("s is null or s <= start")
    path = above.groupBy("sheet", "row", "side", "layer", "start", "attr", "value").agg(F.transform(F.sort_array(F.collect_list(F.struct("s", "name"))), lambda x: x["name"]).alias("names"))
    return path.select(
        "sheet.file", "sheet.sheet", "row", "side", "layer", display_path(F.col("names")).alias("path"), F.split_part("sheet.sheet", F.lit("-"), F.lit(1)).alias("bus"), "attr", "value",
        F.struct("sheet.file", "sheet.sheet", "row", "start", "attr").alias("ord"))


def facts(spark: SparkSession, path: str) -> DataFrame | None:
    """A table that an earlier run or another tool has left, by its extension: Parquet, or JSON lines (a cached parse takes the place of the office file); None for others."""
    if path.endswith((".json", ".jsonl")):
        return spark.read.json(path)
    return None if path.endswith((".xlsx", ".docx")) else spark.read.parquet(path)


def requirements(spark: SparkSession, path: str, aliases: DataFrame) -> DataFrame:
    """(req_id, content) of requirement files, by their extension."""
    cells = read_cells(spark, path)
    word = requirement_rows(cells.where("file like '%.docx'"), aliases).select(F.col("fields")["id"].alias("req_id"), F.col("fields")["content"].alias("content"))
    return word.union(requirement_sheet(cells.where("file like '%.xlsx'")).select("req_id", "content"))
