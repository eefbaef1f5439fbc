"""Trace tables (parent, spec name) and (parent, requirement), the bridge between two id namespaces, and scopes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .entries import blank, fill_forward

BLANKS = ("None", "#N/A")


def parent_names(cells: DataFrame, parent: int = 3, name: int = 7, first_row: int = 2) -> DataFrame:
    """(parent_id, spec_name) of a table with fixed columns, the parent filled forward within its file and sheet; `cells` has (file, sheet, row, col, value)."""
    return _pairs(cells, parent, name, first_row, ("None",)).select("parent_id", F.col("other").alias("spec_name")).distinct()


def parent_requirements(cells: DataFrame, skipped_modules: DataFrame, parent: int = 0, requirement: int = 3, module: int = 4, first_row: int = 2) -> DataFrame:
    """(parent_id, req_id) of a table with fixed columns, without the rows of skipped modules (module; compared without case)."""
    rows = _pairs(cells, parent, requirement, first_row, ("None",))
    modules = cells.where(F.col("col") == module).select("file", "sheet", "row", F.lower(F.trim("value")).alias("module"))
    rows = rows.join(modules, ["file", "sheet", "row"], "left")
    return rows.join(skipped_modules.select(F.lower(F.trim("module")).alias("module")).distinct(), "module", "left_anti").select("parent_id", F.col("other").alias("req_id")).distinct()


def _pairs(cells: DataFrame, parent: int, other: int, first_row: int, words: Sequence[str]) -> DataFrame:
    wide = cells.where((F.col("row") >= first_row) & F.col("col").isin(parent, other)).groupBy("file", "sheet", "row").agg(
        F.max(F.when(F.col("col") == parent, F.col("value"))).alias("parent_id"), F.max(F.when(F.col("col") == other, F.col("value"))).alias("other"))
    filled = fill_forward(wide, "parent_id", ["file", "sheet"], ["row"], words)
    return filled.where(F.col("parent_id").isNotNull() & ~blank(F.col("other"), words))


def adaptive_pairs(cells: DataFrame, parent_words: Sequence[str], other_words: Sequence[str], header_rows: int = 5) -> DataFrame:
    """(parent_id, other) of the best sheet of each file: columns are found by words in the headers, in the first of the top rows that has both;
    data begins below it; the sheet with most distinct parents counts (ties: the first), and rows that name their own parent go."""
    has = lambda words: F.min(F.when(F.lower("value").rlike("|".join(f"\\Q{w.lower()}\\E" for w in words)), F.col("col")))
    heads = cells.where(F.col("row") <= header_rows).groupBy("file", "sheet", "row").agg(has(parent_words).alias("pc"), has(other_words).alias("oc")).where("pc is not null and oc is not null and pc <> oc")
    heads = heads.groupBy("file", "sheet").agg(F.min(F.struct("row", "pc", "oc")).alias("h")).select("file", "sheet", F.col("h.row").alias("header"), "h.pc", "h.oc")
    data = cells.join(heads, ["file", "sheet"]).where("row > header and (col = pc or col = oc)").groupBy("file", "sheet", "row").agg(
        F.max(F.expr("case when col = pc then value end")).alias("parent_id"), F.max(F.expr("case when col = oc then value end")).alias("other"))
    data = fill_forward(data, "parent_id", ["file", "sheet"], ["row"], BLANKS).where(F.col("parent_id").isNotNull() & ~blank(F.col("other"), BLANKS) & (F.col("parent_id") != F.col("other")))
    best = data.groupBy("file", "sheet").agg(F.countDistinct("parent_id").alias("n"))
    best = best.withColumn("rn", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("n"), "sheet"))).where("rn = 1")
    return data.join(best.select("file", "sheet"), ["file", "sheet"], "left_semi").select("parent_id", "other").distinct()


def bridge_columns(cells: DataFrame, left: DataFrame, right: DataFrame, columns: int = 8, rows: tuple[int, int] = (3, 100)) -> DataFrame:
    """(file, left_col, right_col): the columns whose id prefixes (before the first -) overlap most with the ids of either side, from a look at a few rows."""
    prefix = lambda c: F.split_part(c, F.lit("-"), F.lit(1))
    look = cells.where(F.col("row").between(*rows) & (F.col("col") < columns) & ~blank(F.col("value"), BLANKS)).select("file", "col", prefix("value").alias("prefix"))
    out = None
    for name, ids in (("left_col", left), ("right_col", right)):
        known = ids.select(prefix(F.col(ids.columns[0])).alias("prefix")).distinct()
        n = look.join(known, "prefix", "left_semi").groupBy("file", "col").agg(F.count("*").alias("n"))
        one = n.groupBy("file").agg(F.max(F.struct("n", (-F.col("col")).alias("c"))).alias("m")).select("file", (-F.col("m.c")).alias(name))
        out = one if out is None else out.join(one, "file")
    return out.where("left_col <> right_col")


def chain(requirements: DataFrame, names: DataFrame) -> DataFrame:
    """(req_id, spec_name, block_key): requirement - parent - spec name, distinct.  Both sides are distinct before they meet, and a name's key is made once for the name, not for
    each pair."""
    keyed = names.select("parent_id", "spec_name").distinct().withColumn("block_key", T.block_key(F.col("spec_name")))
    return requirements.select("parent_id", "req_id").distinct().join(keyed, "parent_id").select("req_id", "spec_name", "block_key").dropDuplicates(["req_id", "spec_name"])


def bridged(requirements: DataFrame, names: DataFrame, bridge: DataFrame) -> DataFrame:
    """`requirements` (parent_id, req_id) with parents that `bridge` (parent_id, other_id) leads to names, for parents without names of their own; only where
    the two sides share no parent at all."""
    shared = requirements.join(names, "parent_id", "left_semi").agg(F.count("*").alias("shared"))
    lost = requirements.join(names, "parent_id", "left_anti").join(bridge, "parent_id").select(F.col("other_id").alias("parent_id"), "req_id")
    lost = lost.crossJoin(shared).where("shared = 0").drop("shared")  # one row
    return requirements.select("parent_id", "req_id").union(lost).distinct()


def scope(names: DataFrame, requirements: DataFrame, known: DataFrame) -> DataFrame:
    """(parent_id, spec_name, candidates, missing): the requirements of each name's parent in first-seen order (`ord`), distinct, and those of them that aren't `known` (req_id)."""
    per = requirements.groupBy("parent_id", "req_id").agg(F.min("ord").alias("ord")).join(known.select("req_id").distinct().withColumn("there", F.lit(True)), "req_id", "left")
    item = F.struct("ord", "req_id", F.coalesce("there", F.lit(False)).alias("there"))
    per = per.groupBy("parent_id").agg(F.sort_array(F.collect_list(item)).alias("reqs"))
    none = F.array().cast("array<string>")
    ids = lambda c: F.coalesce(F.transform(c, lambda x: x["req_id"]), none)
    return names.join(per, "parent_id", "left").select("parent_id", "spec_name", ids("reqs").alias("candidates"), ids(F.filter("reqs", lambda x: ~x["there"])).alias("missing"))


def located(scoped: DataFrame, entries: DataFrame) -> DataFrame:
    """Each scope name with the paths of the entries that have its block key, sorted."""
    paths = entries.groupBy(T.block_key(F.col("path")).alias("block_key")).agg(F.array_sort(F.collect_set("path")).alias("paths"))
    return scoped.withColumn("block_key", T.block_key(F.col("spec_name"))).join(paths, "block_key", "left").withColumn("paths", F.coalesce("paths", F.array().cast("array<string>")))


def traced_pool(entries: DataFrame, traced: DataFrame) -> DataFrame:
    """The entries that a trace reaches by block key (semi join)."""
    return entries.join(traced.select("block_key").distinct(), "block_key", "left_semi")


def requirement_pools(blocks: DataFrame, traced: DataFrame) -> DataFrame:
    """(req_id, block_key): for each requirement the blocks that its own trace (req_id, block_key) reaches."""
    return traced.select("req_id", "block_key").distinct().join(blocks.select("block_key").distinct(), "block_key").select("req_id", "block_key")


def with_fallback(first: DataFrame, again: DataFrame) -> DataFrame:
    """Results by req_id: those of `first`, but for unmatched ones that `again` has too."""
    redo = first.where("status = 'unmatched'").join(again.select("req_id").distinct(), "req_id", "left_semi").select("req_id")
    return first.join(redo, "req_id", "left_anti").unionByName(again.join(redo, "req_id", "left_semi"))


def group_union(traced: DataFrame, full: DataFrame) -> DataFrame:
    """Results of the traced group and, for requirements that it lacks, of the full one; `pool` tells which."""
    return traced.withColumn("pool", F.lit("traced")).unionByName(full.join(traced.select("req_id").distinct(), "req_id", "left_anti").withColumn("pool", F.lit("full")))


def chosen_sheets(sheets: DataFrame, words: Sequence[str], place: int = 0) -> DataFrame:
    """(file, ord): the first sheet of each file (file, ord, name) whose name has one of the words, without case; where none has, the sheet at `place` (from 0), and the first one where
    there are fewer."""
    hit = F.lower("name").rlike("|".join(f"\\Q{w.lower()}\\E" for w in words))
    return sheets.groupBy("file").agg(F.coalesce(F.min(F.when(hit, F.col("ord"))), F.get(F.sort_array(F.collect_list("ord")), F.lit(place)), F.min("ord")).alias("ord"))


def input_errors(files: DataFrame, required: Sequence[str]) -> DataFrame:
    """(file, error): missing sheets and columns of trace files (file, sheet, columns) as rows, never an exception."""
    need = F.array(*map(F.lit, required))
    missing = F.array_except(need, F.coalesce("columns", F.array().cast("array<string>")))
    error = F.when(F.col("sheet").isNull(), "missing_sheet").when(F.size(missing) > 0, F.concat(F.lit("missing_columns:"), F.array_join(missing, ",")))
    return files.select("file", error.alias("error")).where("error is not null")


def file_errors(cells: DataFrame, expected: DataFrame) -> DataFrame:
    """(file, error) of trace files before any sheet is looked at: missing_file for an expected one (file) that isn't there, open_error for one that is no archive, parse_error for one that
    can't be read; `cells` has the error rows of `read_cells`."""
    broken = cells.where(F.col("sheet").isNull() & F.startswith("value", F.lit("error: "))).select("file", F.when(F.col("value") == "error: BadZipFile", "open_error").otherwise("parse_error").alias("error"))
    gone = expected.select("file").distinct().join(cells.select("file").distinct(), "file", "left_anti")
    return broken.union(gone.withColumn("error", F.lit("missing_file")))


def detected_ruleset(shapes: DataFrame, rules: DataFrame) -> DataFrame:
    """(file, ruleset): the first ruleset by id that any table of the file fits; `shapes` has (file, columns, first_cell) and `rules` (ruleset, min_columns, prefix)."""
    hit = shapes.join(F.broadcast(rules), (F.col("columns") >= F.col("min_columns")) & F.col("first_cell").startswith(F.col("prefix")))
    return hit.groupBy("file").agg(F.min("ruleset").alias("ruleset"))


def catalogue(cells: DataFrame, octal: str = "^[0-7]{2,}$", prefix: str = "LBL_") -> DataFrame:
    """(name, octal, sdi) of label rows (file, table_ord, row, col, value): a cell with the prefix and the first octal-looking one of the same row; fields of later tables win where
    they state something.  A name with a channel suffix counts without it too."""
    row = cells.groupBy("file", "table_ord", "row").agg(
        F.max(F.when(F.col("value").startswith(prefix), F.col("value"))).alias("name"), F.min_by("value", F.when(F.col("value").rlike(octal), F.col("col"))).alias("octal"),
        F.count("*").alias("n"), F.max(F.when(F.col("col") == 3, F.col("value"))).alias("c3"), F.max(F.when(F.col("col") == 2, F.col("value"))).alias("c2"),
    ).where("name is not null and octal is not null and n >= 3")
    row = row.withColumn("sdi", F.when(F.col("n") >= 8, F.col("c3")).when(F.col("n") >= 4, F.col("c2")))
    row = row.withColumn("name", F.explode(F.array_distinct(F.array("name", F.regexp_replace("name", "_R[0-9]+[A-Za-z]?$", "")))))
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct("table_ord", "row"))).alias(c)
    return row.groupBy("name").agg(last("octal"), last("sdi")).withColumn("octal", T.octal(F.col("octal")))
