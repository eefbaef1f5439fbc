"""Clustering of entries into profiles (label, leaf) and of profiles into blocks (label, signal family)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .entries import PUBLISHER


def _direction(sides: Column) -> Column:
    return F.when(F.size(sides) > 1, "bidirectional").when(F.array_contains(sides, PUBLISHER), "send").otherwise("receive")


def first_attributes(df: DataFrame, key: str, order: Sequence[str | Column], joined: Sequence[str] = ()) -> DataFrame:
    """(key, attrs): a map of each attribute's first value; attributes in `joined` have all their distinct values, joined by /."""
    w = Window.partitionBy(key, "attr").orderBy(*order)
    numbered = df.withColumn("_rn", F.row_number().over(w))
    many = F.col("attr").isin(list(joined)) if joined else F.lit(False)
    kept = numbered.where((F.col("_rn") == 1) | many)
    values = F.transform(F.sort_array(F.collect_list(F.struct("_rn", "value"))), lambda x: x["value"])
    per = kept.groupBy(key, "attr").agg(F.array_join(F.array_distinct(values), "/").alias("value"))
    return per.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("attr", "value")))).alias("attrs"))


def profiles(entries: DataFrame, joined: Sequence[str] = ("CodedSet",)) -> DataFrame:
    """(profile_key, block_key, direction, buses, attrs, tokens, n_entries, ord) of leaf entries (path, side, bus, attr, value, ord)."""
    e = entries.withColumns({"profile_key": T.profile_key(F.col("path")), "block_key": T.block_key(F.col("path")), "_side": F.when(F.col("side") == PUBLISHER, 0).otherwise(1)})
    attrs = first_attributes(e, "profile_key", ["_side", "ord"], joined)
    leaf = F.element_at(F.split("path", "\\."), -1)
    base = e.groupBy("profile_key").agg(
        F.min("block_key").alias("block_key"), F.array_sort(F.collect_set("side")).alias("sides"), F.array_sort(F.collect_set("bus")).alias("buses"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(T.name_parts(leaf))))).alias("tokens"), F.count("*").alias("n_entries"), F.min("ord").alias("ord"),
    )
    return base.join(attrs, "profile_key").withColumn("direction", _direction(F.col("sides"))).drop("sides")


def blocks(profile: DataFrame, skipped_families: Sequence[str] = (), joined: Sequence[str] = ("SDI", "CodedSet")) -> DataFrame:
    """(block_key, label, family, direction, buses, tokens, attrs, channel_count, ord): profiles of a block merged, the first profile's attributes
    first; protocol families are left out."""
    p = profile.withColumns({"label": F.regexp_extract("block_key", "^(L[0-9]+)/", 1), "family": F.element_at(F.split("block_key", "/"), -1)})
    p = p.where(~F.col("family").isin(list(skipped_families)) if skipped_families else F.lit(True))
    attrs = first_attributes(p.select("block_key", "ord", "profile_key", F.explode("attrs").alias("attr", "value")), "block_key", ["ord", "profile_key"], joined)
    base = p.groupBy("block_key").agg(
        F.min("label").alias("label"), F.min("family").alias("family"), F.array_sort(F.collect_set("direction")).alias("directions"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("buses")))).alias("buses"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tokens")))).alias("tokens"),
        F.count("*").alias("channel_count"), F.min("ord").alias("ord"),
    )
    one = F.when(F.size("directions") == 1, F.element_at("directions", 1)).otherwise("bidirectional")
    return base.join(attrs, "block_key").withColumn("direction", one).drop("directions")


def anchors(fields: DataFrame) -> DataFrame:
    """(label, anchors): the protocol fields (label, name, offset) of each label by bit offset, those without one last."""
    item = F.struct(F.coalesce(F.col("offset").try_cast("int"), F.lit(999)).alias("at"), F.col("name"))
    return fields.groupBy("label").agg(F.sort_array(F.collect_set(item)).alias("anchors"))


def sub_signals(bits: DataFrame, ref_names: DataFrame, publisher: DataFrame, siblings: DataFrame) -> DataFrame:
    """For each (block_key, offset) of a block with several bit offsets: name, size and type of the part, from the reference name, else the publisher's bit
    map, else a single-bit sibling, else the family, else ''.

    `bits` has (block_key, family, offset); the lookups have (block_key, offset, name, size, dtype).
    """
    many = bits.groupBy("block_key").agg(F.countDistinct("offset").alias("n")).where("n > 1").select("block_key")
    out = bits.distinct().join(many, "block_key", "left_semi")
    for i, side in enumerate((ref_names, publisher, siblings)):
        out = out.join(side.select("block_key", "offset", *(F.col(c).alias(f"{c}{i}") for c in ("name", "size", "dtype"))), ["block_key", "offset"], "left")
    first = lambda c, *rest: F.coalesce(*(F.col(f"{c}{i}") for i in range(3)), *rest)
    return out.select("block_key", "offset", first("name", F.col("family"), F.lit("")).alias("name"), first("size", F.lit(1)).alias("size"), first("dtype", F.lit("")).alias("dtype"))


def forward_blocks(entries: DataFrame) -> DataFrame:
    """(identity, protocol, publisher_names, subscriber_names, entry_ids in order, devices) of entries (bus, device, path, side, entry_id, ord)."""
    e = entries.withColumn("protocol", T.protocol(F.col("bus"), F.col("path")))
    e = e.withColumn("identity", T.identity_key(F.col("protocol"), F.col("device"), F.col("path")))
    name = lambda side: F.array_sort(F.collect_set(F.when(F.col("side") == side, F.col("path"))))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("ord", "entry_id"))), lambda x: x["entry_id"])
    return e.groupBy("identity", "protocol").agg(name("DP").alias("publisher_names"), name("RP").alias("subscriber_names"), ids.alias("entry_ids"), F.array_sort(F.collect_set("device")).alias("devices"))


def sdi_discriminates(entries: DataFrame, none: Sequence[str] = ("NA", "")) -> DataFrame:
    """(label, block_key, sdi, discriminates): whether a label's blocks differ in SDI; a block's own SDI where it is the only one it has."""
    known = F.when(~F.col("sdi").isin(list(none)), F.col("sdi"))
    per = entries.groupBy("label", "block_key").agg(F.collect_set(known).alias("own"))
    labels = entries.groupBy("label").agg((F.count_distinct(known) > 1).alias("discriminates"))
    return per.join(labels, "label").select("label", "block_key", F.when(F.size("own") == 1, F.element_at("own", 1)).alias("sdi"), "discriminates")


def own_bit_range(fields: DataFrame) -> DataFrame:
    """(block_key, offset, size): the block's own field (the first one that is no reference), else the only reference whose name shares a word of 3 characters or more with
    the family.  `fields` has (block_key, family, is_ref, ref_name, offset, size, ord)."""
    own = fields.where(~F.col("is_ref")).groupBy("block_key").agg(F.min_by(F.struct("offset", "size"), "ord").alias("field"))
    words = lambda c: F.filter(T.name_parts(F.col(c)), lambda w: F.length(w) >= 3)
    refs = fields.where(F.col("is_ref") & F.arrays_overlap(words("family"), words("ref_name"))).groupBy("block_key").agg(F.count("*").alias("n"), F.min(F.struct("offset", "size")).alias("field"))
    rest = refs.where("n = 1").join(own, "block_key", "left_anti").select("block_key", "field")
    return own.union(rest).select("block_key", "field.offset", "field.size")
