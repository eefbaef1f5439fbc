"""Spec entries: from cells to facts, their filters, fill-forward, de-duplication, conflicts and ids.

An entry is a row (side, sheet, layer, path, attr, value, ref_name, ord, ...).  `ord` is the order of the source; every
"first" below means the least `ord`, so results don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PUBLISHER, SUBSCRIBER = "DP", "RP"


def blank(c: Column, words: Sequence[str] = ("None",)) -> Column:
    """Whether a cell of a merged column counts as empty: null, white space, or one of the words."""
    return c.isNull() | (F.trim(c.cast("string")) == "") | F.trim(c.cast("string")).isin(list(words))


#: Rows of a range that `fill_forward` goes through in one task.
RANGE_ROWS = 100_000


def fill_forward(df: DataFrame, column: str, within: Sequence[str], order: Sequence[str], words: Sequence[str] = ("None",), rows: int = RANGE_ROWS) -> DataFrame:
    """`column` with each blank replaced by the last value before it within the keys; leading blanks become null.

    Where the first of `order` is a whole number (a row number), a key is no task's whole load: rows are gone through in ranges of `rows` numbers, and a range begins with what the ranges before
    it end with, a table of a row for each range.
    """
    value = F.when(~blank(F.col(column), words), F.col(column))
    last = lambda *keys: F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    if df.schema[order[0]].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return df.withColumn(column, last(*within))
    df = df.withColumn("_range", F.floor(F.col(order[0]) / rows))
    ends = df.groupBy(*within, "_range").agg(F.max_by(value, F.when(value.isNotNull(), F.struct(*order))).alias("_end"))
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    for c in (*within, "_range"):
        carried = carried.withColumnRenamed(c, f"_of{c}")
    same = [F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in (*within, "_range")]
    filled = df.join(carried, same, "left").withColumn(column, F.coalesce(last(*within, "_range"), F.col("_carried")))
    return filled.drop("_range", "_carried", *(f"_of{c}" for c in (*within, "_range")))


def first_of(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str]) -> DataFrame:
    """The first row of each key; null keys are keys."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def without_attributes(df: DataFrame, excluded: DataFrame) -> DataFrame:
    """Entries whose attr isn't in `excluded` (attr)."""
    return df.join(excluded.select("attr").distinct(), "attr", "left_anti")


def with_value(df: DataFrame) -> DataFrame:
    return df.where(F.length(F.trim(F.coalesce(F.col("value").cast("string"), F.lit("")))) > 0)


def without_overhead(df: DataFrame, formats: Sequence[str], attr: str = "DataFormatType") -> DataFrame:
    """Rows of an overhead format dropped where they state the format itself."""
    return df.where(~((F.col("attr") == attr) & F.col("value").isin(list(formats))) | F.col("attr").isNull() | F.col("value").isNull())


def leaves(df: DataFrame) -> DataFrame:
    return df.where(F.col("layer").isin(PUBLISHER, SUBSCRIBER))


def dedup_in_sheet(df: DataFrame) -> DataFrame:
    return first_of(df, ["sheet", "side", "layer", "path", "attr", F.col("value").cast("string"), "ref_name"], ["ord"])


def layer_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("sheet", "layer").agg(F.count("*").alias("entries"))


def publisher_wins(df: DataFrame) -> DataFrame:
    """Of each (path, attr) that a publisher states, only the publisher's rows.  `ord2` is the new order: by where the group is first
    seen, then by ord."""
    w = Window.partitionBy("path", "attr")
    stated = F.max((F.col("side") == PUBLISHER).cast("int")).over(w)
    out = df.withColumns({"_p": stated, "_first": F.min("ord").over(w)}).where((F.col("_p") == 0) | (F.col("side") == PUBLISHER))
    return out.withColumn("ord2", F.struct(F.col("_first").alias("first"), F.col("ord").alias("ord"))).drop("_p", "_first")


def dedup_all(df: DataFrame, by_reference: Sequence[str], order: str = "ord2") -> DataFrame:
    """The first of equal (path, attr, value); attributes of layout and state count once for each reference."""
    ref = F.when(F.col("attr").isin(list(by_reference)), F.col("ref_name"))
    return first_of(df, ["path", "attr", F.col("value").cast("string"), ref], [order])


#: Attributes of layout and state: a reference states its own.
BY_REFERENCE = ("BitOffset", "ParameterSize", "CodedSet", "OneState", "ZeroState")


def resolved(df: DataFrame, by_reference: Sequence[str] = BY_REFERENCE) -> DataFrame:
    """The entries (ord, side, path, attr, value, ...) that an analysis reads: repeats within a sheet go, of conflicting sides the publisher's stay, and equal facts
    count once.  `sheet` and `ref_name` count where they are there."""
    columns = df.columns
    for c in ("sheet", "ref_name"):
        df = df if c in columns else df.withColumn(c, F.lit(None).cast("string"))
    return dedup_all(publisher_wins(dedup_in_sheet(df)), by_reference).select(columns)


def numbered(df: DataFrame, order: str = "ord2", lead: str = "ord2.first", prefix: str = "IRD") -> DataFrame:
    """`entry_id` <prefix>-<bus>-<first 6 of the layer>-<number>: a dense global number in the order of `order`, at least four digits.

    `lead` is the leading number of the order.  Equal ranges of it are numbered each by itself, and their counts give where each begins, so no task sees
    all rows; the ranges depend on the data alone, so a task that is run again gives the same numbers.
    """
    n = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low, high = df.agg(F.min(lead), F.max(lead)).first()
    width = ((high or 0) - (low or 0)) // n + 1
    parts = df.withColumn("_part", F.floor((F.col(lead) - F.lit(low or 0)) / F.lit(width)))
    counts = parts.groupBy("_part").count()
    before = counts.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    parts = parts.withColumn("_rn", F.row_number().over(Window.partitionBy("_part").orderBy(order))).join(F.broadcast(before), "_part")
    parts = parts.withColumn("seq", F.col("_before") + F.col("_rn"))
    return parts.withColumn("entry_id", F.format_string(f"{prefix}-%s-%s-%04d", F.col("bus"), F.substring("layer", 1, 6), F.col("seq"))).drop("_part", "_before", "_rn")


def counters(generated: DataFrame, raw: DataFrame, final: DataFrame) -> DataFrame:
    """One row: generated, raw, after_dedup, removed (generated - final, so conflicts count too)."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(generated, "generated").crossJoin(one(raw, "raw")).crossJoin(one(final, "after_dedup")).withColumn("removed", F.col("generated") - F.col("after_dedup"))


def subscriber_override(rows: DataFrame, own: Sequence[str], always: Sequence[str]) -> DataFrame:
    """Subscriber attributes of each sheet row: its own value for `own`, the publisher's of the same row else; publisher-only attributes are added,
    as are `always` (empty where nobody states them); a row without publisher attributes keeps only `own`.

    `rows` has (sheet, row, side, attr, value), one row for each.
    """
    key = ["sheet", "row", "attr"]
    pub = rows.where(F.col("side") == PUBLISHER).select(*key, F.col("value").alias("pub"))
    sub = rows.where(F.col("side") == SUBSCRIBER).select(*key, F.col("value").alias("sub"))
    subscribers = sub.select("sheet", "row").distinct()
    has = pub.select("sheet", "row").distinct().withColumn("has_pub", F.lit(True))
    extra = subscribers.join(has, ["sheet", "row"]).crossJoin(rows.sparkSession.createDataFrame([(a,) for a in always], "attr string")).select(*key) if always else None
    every = sub.select(*key).union(pub.join(subscribers, ["sheet", "row"], "left_semi").select(*key))
    every = (every.union(extra) if extra is not None else every).distinct()
    out = every.join(sub, key, "left").join(pub, key, "left").join(has, ["sheet", "row"], "left")
    mine = F.col("attr").isin(list(own))
    value = F.when(mine, F.coalesce("sub", "pub")).otherwise(F.coalesce("pub", "sub"))
    return out.where(mine | F.col("has_pub")).select(*key, value.alias("value"))


def unpivot_layers(rows: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """A row for each (layer, attribute) of `rows` (id, layers array<struct<name, attrs map>>): path is the names down to the layer,
    adjacent repeats and empty ones collapsed; empty values and excluded attributes go."""
    from ..functions.text import display_path

    one = rows.select("id", "layers", F.posexplode("layers").alias("depth", "layer"))
    names = F.transform(F.slice("layers", 1, F.col("depth") + 1), lambda x: x["name"])
    one = one.select("id", "depth", F.col("layer.name").alias("layer"), display_path(names).alias("path"), F.explode("layer.attrs").alias("attr", "value"))
    return with_value(one).where(~F.col("attr").isin(list(excluded)) if excluded else F.lit(True))


def described(df: DataFrame, names: DataFrame, units: DataFrame) -> DataFrame:
    """`description` from the attribute's display name, its value, its unit and, for a reference, its name."""
    out = df.join(names.select("attr", "display"), "attr", "left").join(units.select("attr", "unit"), "attr", "left")
    text = F.concat(F.coalesce("display", "attr"), F.lit(" of "), F.col("path"), F.lit(" is "), F.col("value").cast("string"), F.coalesce(F.concat(F.lit(" "), "unit"), F.lit("")))
    return out.withColumn("description", F.when(F.col("ref_name").isNotNull(), F.concat(text, F.lit(" (by "), F.col("ref_name"), F.lit(")"))).otherwise(text)).drop("display")


def annotated_content(reqs: DataFrame, catalogue: DataFrame, pattern: str) -> DataFrame:
    """`content` with ' [token = meaning]' appended for each catalogue token in it, in the order of the text, once each, and not where it is there already.

    `catalogue` has (token, meaning); `pattern` has one group, the token.
    """
    found = reqs.select("req_id", F.posexplode(F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)))).alias("at", "token"))
    notes = found.join(catalogue, "token").groupBy("req_id").agg(F.sort_array(F.collect_list(F.struct("at", F.concat(F.lit(" ["), "token", F.lit(" = "), "meaning", F.lit("]")).alias("note")))).alias("notes"))
    out = reqs.join(notes, "req_id", "left")
    new = F.filter(F.transform("notes", lambda n: n["note"]), lambda n: ~F.contains(F.col("content"), n))
    return out.withColumn("content", F.concat("content", F.coalesce(F.array_join(new, ""), F.lit("")))).drop("notes")


# ---------------------------------------------------------------- headers of a sheet, from long cells (sheet, row, col, value)


def side_starts(cells: DataFrame, markers: Sequence[str], row: int = 1) -> DataFrame:
    """(sheet, side, start, stop): the first column with each marker, and the start of the next side (null: none)."""
    starts = cells.where((F.col("row") == row) & F.col("value").isin(list(markers))).groupBy("sheet", F.col("value").alias("side")).agg(F.min("col").alias("start"))
    return starts.withColumn("stop", F.lead("start").over(Window.partitionBy("sheet").orderBy("start")))


def _dealt(df: DataFrame) -> DataFrame:
    """A table that grows with the cells: both sides of its join are dealt out by their keys.  Cells come from exploded rows, which Spark takes for as small as the rows, and it would send all of
    them through the driver."""
    return df.hint("merge")


def layer_ranges(cells: DataFrame, sides: DataFrame, row: int = 2) -> DataFrame:
    """(sheet, side, layer, start, stop): a header opens a range that the next one closes, within its side."""
    heads = cells.where((F.col("row") == row) & ~blank(F.col("value"))).select("sheet", "col", F.col("value").alias("layer"))
    own = heads.join(_dealt(sides.withColumnsRenamed({"start": "s0", "stop": "s1"})), "sheet").where("col >= s0 and (s1 is null or col < s1)")
    stop = F.coalesce(F.lead("col").over(Window.partitionBy("sheet", "side").orderBy("col")), F.col("s1"))
    return own.select("sheet", "side", "layer", F.col("col").alias("start"), stop.alias("stop"))


def layer_columns(cells: DataFrame, ranges: DataFrame, header_row: int = 3) -> DataFrame:
    """(sheet, col, side, layer, start, attr) of the columns that the header row names within a range; blank headers give nothing."""
    attrs = cells.where((F.col("row") == header_row) & ~blank(F.col("value"))).select("sheet", "col", F.col("value").alias("attr"))
    return attrs.join(_dealt(ranges), "sheet").where("col >= start and (stop is null or col < stop)").select("sheet", "col", "side", "layer", "start", "attr")


def layer_values(cells: DataFrame, ranges: DataFrame, header_row: int = 3) -> DataFrame:
    """(sheet, row, side, layer, start, attr, value) of the rows below the headers; blank headers and empty cells give nothing, and of an attribute that a
    layer has twice the last column counts."""
    data = cells.where((F.col("row") > header_row) & F.col("value").isNotNull())
    return data.join(_dealt(layer_columns(cells, ranges, header_row)), ["sheet", "col"]).groupBy("sheet", "row", "side", "layer", "start", "attr").agg(F.max_by("value", "col").alias("value"))


def publisher_reissue(entries: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """The publisher's entries, and the subscriber's of some attributes as if the publisher had given them."""
    again = entries.where((F.col("side") == SUBSCRIBER) & F.col("attr").isin(list(attributes))).withColumn("side", F.lit(PUBLISHER))
    return again.unionByName(entries.where(F.col("side") == PUBLISHER))


def reference_rows(entries: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Entries that refer to another object, of the attributes that a reference may state."""
    return entries.where(F.col("ref_name").isNotNull() & F.col("attr").isin(list(attributes)))


def ordered_distinct(rows: DataFrame, key: str, value: str, order: str = "ord") -> DataFrame:
    """(key, values): each key's distinct values in the order of their first row.  Repeats go before the values meet."""
    first = rows.groupBy(key, value).agg(F.min(order).alias("_first"))
    return first.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_first", value))), lambda x: x[value]).alias("values"))
