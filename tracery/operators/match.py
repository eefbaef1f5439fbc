"""Requirement to spec: candidates, the seven-dimension score, gates, top-K with exemptions, pruning and tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import boundary_match, has_named_component, specificity

DIMENSIONS = ("d_name", "d_direction", "d_bit", "d_sdi", "d_type", "d_device", "d_channel")


def label_candidates(reqs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pairs whose block carries one of the requirement's labels."""
    r = reqs.select("req_id", F.explode("labels").alias("label")).distinct()
    return r.join(blocks.where("label <> ''").select("label", "block_key"), "label").select("req_id", "block_key").distinct()


def label_pairs(reqs: DataFrame, blocks: DataFrame) -> DataFrame:
    """`label_candidates` with both sides' columns, from one join on the label: a block has one label and a requirement each label once, so that no pair comes twice."""
    return reqs.withColumn("label", F.explode(F.array_distinct("labels"))).join(blocks.where("label <> ''"), "label")


def bus_candidates(reqs: DataFrame, blocks: DataFrame, labelled: bool = False) -> DataFrame:
    """Pairs that share a bus, for requirements without labels; blocks with a label only on demand."""
    r = reqs.where(F.size("labels") == 0).select("req_id", F.explode("bus_types").alias("bus")).distinct()
    b = (blocks if labelled else blocks.where("label = ''")).select("block_key", F.explode("buses").alias("bus")).distinct()
    return r.join(b, "bus").select("req_id", "block_key").distinct()


def overlaps(offset: Column, size: Column, offset2: Column, size2: Column) -> Column:
    return (offset < offset2 + size2) & (offset2 < offset + size)


def _overlapping(r: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """(offset, size, offset2, size2): the distinct fields of both sides that overlap.  They are dealt into bins of `width` bits and joined on equal bins, in the first bin of both only."""
    last = F.floor((F.col("offset") + F.greatest(F.col("size"), F.lit(1)) - 1) / width)
    ranges = lambda df: df.select("offset", "size").distinct().withColumn("first", F.floor(F.col("offset") / width)).withColumn("bin", F.explode(F.sequence("first", last)))
    theirs = ranges(b).select(F.col("offset").alias("offset2"), F.col("size").alias("size2"), F.col("first").alias("first2"), "bin")
    meet = overlaps(F.col("offset"), F.col("size"), F.col("offset2"), F.col("size2")) & (F.col("bin") == F.greatest("first", "first2"))
    return ranges(r).join(theirs, "bin").where(meet).select("offset", "size", "offset2", "size2")


def _field_sets(df: DataFrame, key: str) -> DataFrame:
    """(key, fields): each key's set of fields; rows without an offset or a size have none."""
    return df.where("offset is not null and size is not null").groupBy(key).agg(F.array_sort(F.collect_set(F.struct("offset", "size"))).alias("fields"))


def _sets_that_meet(r: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """(fields, fields2), distinct: sets of fields of both sides of which some overlap.  Many rows share a set, so this is small where both sides are large."""
    each = lambda df: df.select("fields").distinct().select("fields", F.explode("fields").alias("f")).select("fields", "f.offset", "f.size")
    mine, theirs = each(r), each(b)
    met = mine.join(_overlapping(mine, theirs, width), ["offset", "size"]).select("fields", "offset2", "size2")
    return met.join(theirs.select(F.col("fields").alias("fields2"), F.col("offset").alias("offset2"), F.col("size").alias("size2")), ["offset2", "size2"]).select("fields", "fields2").distinct()


def range_candidates(reqs: DataFrame, blocks: DataFrame, width: int = 8) -> DataFrame:
    """Pairs (req_id, block_key), each once, of which a field (offset, size) of one overlaps one of the other.  Sets of fields are joined, and their keys come in at the very end, so that no pair
    has to be made distinct."""
    r, b = _field_sets(reqs, "req_id"), _field_sets(blocks, "block_key")
    return r.join(_sets_that_meet(r, b, width), "fields").join(b.withColumnRenamed("fields", "fields2"), "fields2").select("req_id", "block_key")


def range_counts(reqs: DataFrame, blocks: DataFrame, width: int = 8) -> DataFrame:
    """(req_id, blocks, first, last): how many blocks `range_candidates` pairs a requirement with, and the least and the greatest key of them, for those that have any.  A block has one set of
    fields, so sets' counts add up, and no pair is ever made."""
    r, b = _field_sets(reqs, "req_id"), _field_sets(blocks, "block_key")
    per = b.groupBy(F.col("fields").alias("fields2")).agg(F.count("*").alias("n"), F.min("block_key").alias("first"), F.max("block_key").alias("last"))
    summed = _sets_that_meet(r, b, width).join(per, "fields2").groupBy("fields").agg(F.sum("n").alias("blocks"), F.min("first").alias("first"), F.max("last").alias("last"))
    return r.join(summed, "fields").select("req_id", "blocks", "first", "last")


def name_words(keywords: Column, devices: Column | None = None) -> Column:
    """(word, precise) of a requirement, distinct: what `name_hits` looks for, the same for all blocks.  A device with named components (letters and digits) counts by these.  Words of fewer than
    three letters don't count."""
    parts = lambda d: F.when(has_named_component(d), F.regexp_extract_all(d, F.lit("([A-Za-z]+[0-9]+)"), F.lit(1))).otherwise(F.array(d))
    words = F.transform(keywords, F.lower)
    if devices is not None:
        words = F.concat(words, F.flatten(F.transform(F.transform(devices, F.lower), parts)))
    words = F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3))
    return F.transform(words, lambda w: F.struct(w.alias("word"), (specificity(w) == "precise").alias("precise")))


def borne_out(words: Column, name: Column) -> Column:
    """The `name_words` that a name in lower case bears out."""
    # a word at the name's boundaries is part of it, so most words go by one search
    part = lambda w: F.contains(name, w["word"]) | F.contains(w["word"], name)
    hits = F.filter(words, lambda w: part(w) & (name != "") & (~w["precise"] | boundary_match(w["word"], name)))
    return F.transform(hits, lambda w: w["word"])


def name_hits(keywords: Column, devices: Column, family: Column) -> Column:
    """Keywords and devices that a block's family name bears out: precise ones at its boundaries, others as a part of it or it of them (see `name_words`)."""
    return borne_out(name_words(keywords, devices), F.lower(family))


def field_score(r_fields: Column, b_fields: Column) -> Column:
    """20 for a field of both with equal offset and size, 12 for an equal offset, 8 for an equal size."""
    same = lambda f: F.coalesce(F.arrays_overlap(r_fields[f], b_fields[f]), F.lit(False))
    both = F.exists(r_fields, lambda r: F.exists(b_fields, lambda b: (r["offset"] == b["offset"]) & (r["size"] == b["size"])))
    # fields are held against each other only where some have equal offsets
    return F.when(same("offset"), F.when(both, 20).otherwise(12)).when(same("size"), 8).otherwise(0)


def score(pairs: DataFrame, soften: bool = False) -> DataFrame:
    """The seven dimensions and their total for pairs with both sides' columns.

    r_* of the requirement: r_tokens, r_direction, r_fields (array of offset, size), r_sdi (array), r_category, r_devices, r_channel, r_buses;
    b_* of the block: b_tokens, b_direction, b_fields, b_sdi, b_format, b_devices, b_channel, b_buses.
    Further ones count where they are there: r_keywords, r_components (devices) and b_family (see `name_hits`; r_words, their `name_words`, spares making these for each pair anew), r_numbers (each that is in the family adds 10 to the name), r_hint (the format,
    DIS or BNR, that the text of a labelled or bus requirement speaks of), b_sub_fields (the fields of sub-signals), and named (the text names the block's protocol family, which is
    a full name hit).  With `soften`, opposite directions keep 8 where name or SDI are certain.
    """
    there = set(pairs.columns)
    strings = F.array().cast("array<string>")
    of = lambda c: F.coalesce(F.col(c), strings) if c in there else strings
    family = F.coalesce("b_family", F.lit("")) if "b_family" in there else F.lit("")
    shared = F.array_intersect("r_tokens", "b_tokens")
    if "b_family" in there:
        words = F.col("r_words") if "r_words" in there else name_words(of("r_keywords"), of("r_components") if "r_components" in there else None)
        pairs = pairs.withColumn("_name", F.lower(family))
        shared = F.array_union(shared, borne_out(words, F.col("_name")))
    numbers = F.size(F.array_intersect(of("r_numbers"), F.regexp_extract_all(family, F.lit("([0-9]{3,})"), F.lit(1)))) if "r_numbers" in there else F.lit(0)
    name = F.least(F.lit(30), F.least(F.lit(30), 8 * F.size(shared)) + 10 * numbers)
    name = F.when(F.col("named"), 30).otherwise(name) if "named" in there else name
    fields = F.concat("b_fields", F.coalesce("b_sub_fields", F.array().cast(pairs.schema["b_fields"].dataType))) if "b_sub_fields" in there else F.col("b_fields")
    typed = F.col("b_format").isin("DIS", "FLOAT") | F.startswith(F.col("b_format"), F.lit("BNR"))
    same_kind = ((F.col("r_category") == "discrete") & (F.col("b_format") == "DIS")) | ((F.col("r_category") == "analog") & (F.startswith(F.col("b_format"), F.lit("BNR")) | (F.col("b_format") == "FLOAT")))
    hinted = F.col("r_category").isin("label", "bus") & (F.col("r_hint") != "") & F.startswith(F.col("b_format"), F.col("r_hint")) if "r_hint" in there else F.lit(False)
    half = (F.col("r_category").isin("discrete", "analog") & (F.col("b_format") != "")) | (F.col("r_category").isin("label", "bus") & typed if "r_hint" in there else F.lit(False))
    dims = {
        "d_name": name,
        "d_sdi": F.when(F.arrays_overlap("r_sdi", "b_sdi"), 15).otherwise(0),
        "d_direction": F.when(F.col("r_direction") == "", 0).when(F.col("r_direction") == F.col("b_direction"), 15).when(F.col("b_direction") == "bidirectional", 8)
        .when(F.lit(soften) & ((F.col("d_name") >= 30) | (F.col("d_sdi") > 0)), 8).otherwise(0),
        "d_bit": field_score(F.col("r_fields"), fields),
        "d_type": F.when(same_kind | hinted, 10).when(half, 5).otherwise(0),
        "d_device": 5 * F.arrays_overlap("r_buses", "b_buses").cast("int") + F.least(F.lit(5), 2 * F.size(F.array_intersect("r_devices", "b_devices"))),
        "d_channel": F.when((F.col("r_channel") != "") & (F.col("r_channel") == F.col("b_channel")), 10).otherwise(0),
    }
    whole = lambda names: {k: F.coalesce(dims[k].cast("int"), F.lit(0)) for k in names}
    out = pairs.withColumns(whole(("d_name", "d_sdi"))).withColumns(whole(("d_direction", "d_bit", "d_type", "d_device", "d_channel")))
    return out.withColumn("total", sum((F.col(d) for d in DIMENSIONS), F.lit(0))).drop("_name")


def gates(scored: DataFrame, least: int = 12, soften: bool = False) -> DataFrame:
    """`conflict`: opposite directions, SDIs that are both stated and differ, buses that are both stated and differ; `passed`: none of these, and a total of at least `least`.  With `soften`,
    opposite directions pass, but stay conflicts, where name or SDI are certain."""
    opposite = F.col("r_direction").isin("send", "receive") & F.col("b_direction").isin("send", "receive") & (F.col("r_direction") != F.col("b_direction"))
    differ = lambda a, b: (F.size(a) > 0) & (F.size(b) > 0) & ~F.coalesce(F.arrays_overlap(a, b), F.lit(False))
    other = F.coalesce(differ("r_sdi", "b_sdi") | differ("r_buses", "b_buses"), F.lit(False))
    opposite = F.coalesce(opposite, F.lit(False))
    let = opposite & F.lit(soften) & ((F.col("d_name") >= 30) | (F.col("d_sdi") > 0))
    # the total comes last: it is dear, and most pairs fail by a conflict
    return scored.withColumn("conflict", opposite | other).withColumn("passed", ~other & (~opposite | let) & (F.col("total") >= least))


def gated(scored: DataFrame, least: int = 12) -> DataFrame:
    """The pairs that pass the gates."""
    return gates(scored, least).where("passed")


def ranked(pairs: DataFrame, conflicts_first: bool = False) -> DataFrame:
    """`rn` of each requirement's pairs by total, ties in the blocks' order; in soft mode conflicts come first."""
    order = ([F.desc("conflict")] if conflicts_first else []) + [F.desc("total"), F.asc("block_ord"), F.asc("block_key")]
    return pairs.withColumn("rn", F.row_number().over(Window.partitionBy("req_id").orderBy(*order)))


def top_k(pairs: DataFrame, k: int = 20, exempt: Column | None = None, conflicts_first: bool = False) -> DataFrame:
    """The k best of each requirement, and exempt ones whatever their rank.  Two branches, so that the first keeps its group limit in the plan; write `pairs` first where they are
    dear to make, or see `best_and_exempt`."""
    best = ranked(pairs, conflicts_first).where(F.col("rn") <= k)
    return best if exempt is None else best.union(ranked(pairs, conflicts_first).where((F.col("rn") > k) & exempt))


def best_and_exempt(pairs: DataFrame, k: int, exempt: Column) -> DataFrame:
    """`top_k` for pairs that are dear to make and not written: one ranking, as the exempt ones need their ranks among all pairs anyway."""
    return ranked(pairs).where((F.col("rn") <= k) | exempt)


def _of_one_object() -> list[Column]:
    """A requirement's blocks of one label; a block without a label stands by itself."""
    return [F.col("req_id"), F.coalesce(F.nullif(F.col("label"), F.lit("")), F.col("block_key"))]


def prune_nameless(pairs: DataFrame) -> DataFrame:
    """Within a requirement's label that has a pair with a name hit (protocol blocks are no evidence of one), pairs without one go; protocol blocks stay.  Blocks without a label
    all stay."""
    hit = F.max(((F.col("d_name") > 0) & ~F.col("is_protocol")).cast("int")).over(Window.partitionBy(*_of_one_object()))
    return pairs.withColumn("_hit", hit).where((F.col("_hit") == 0) | (F.col("d_name") > 0) | F.col("is_protocol")).drop("_hit")


def prune_spare(pairs: DataFrame) -> DataFrame:
    """Spare blocks go where the requirement has a real one of the same label with a name hit; protocol blocks are no evidence of one."""
    hit = F.max(((F.col("d_name") > 0) & ~F.col("is_spare") & ~F.col("is_protocol")).cast("int")).over(Window.partitionBy(*_of_one_object()))
    return pairs.withColumn("_hit", hit).where((F.col("_hit") == 0) | ~F.col("is_spare")).drop("_hit")


def _best_by_key(judged: DataFrame, active: Column) -> DataFrame:
    """(req_id, total, d_name, active, ungated) of each requirement's best pair by total, block_ord and block_key."""
    first = F.col("label_ord") if "label_ord" in judged.columns else F.lit(0)
    order = F.struct((-F.col("total")).alias("least"), "block_ord", "block_key", "total", "d_name", active.alias("active"))
    best = judged.groupBy("req_id").agg(F.min(F.when(F.col("passed"), order)).alias("best"), (-F.min(F.struct(first.alias("o"), (-F.col("total")).alias("t")))["t"]).alias("ungated"))
    return best.select("req_id", "best.total", "best.d_name", "best.active", "ungated")


def _best_by_number(judged: DataFrame, active: Column) -> DataFrame:
    """(req_id, total, d_name, active, ungated) of each requirement's best pair by total and block_ord; of d_name only whether it is above 0.  The best pair is the least of one decimal: 999 - total,
    block_ord as an unsigned number of 20 digits, active, name hit.  Decimals are added up in a hash table, where a struct would have all pairs sorted and spilled."""
    whole = lambda c, digits: c.cast(f"decimal({digits},0)")
    power = lambda n: F.expr(f"{10**n}BD")
    ord_ = whole(F.coalesce(F.col("block_ord").cast("long"), F.lit(-(2**63))), 19) + F.expr("9223372036854775808BD")
    rest = whole(active * 10 + (F.col("d_name") > 0).cast("int"), 2)
    code = whole(F.lit(999) - F.col("total"), 4) * power(22) + ord_ * power(2) + rest
    best = judged.groupBy("req_id").agg(F.min(F.when(F.col("passed"), whole(code, 38))).alias("code"), F.max("total").alias("ungated"))
    text = F.lpad(F.col("code").cast("string"), 25, "0")
    digits = lambda at, n: F.substring(text, at, n).cast("int")
    return best.select("req_id", (F.lit(999) - digits(1, 3)).alias("total"), digits(25, 1).alias("d_name"), digits(24, 1).alias("active"), "ungated")


def tiers(reqs: DataFrame, judged: DataFrame, ungated: DataFrame | None = None, numbered: bool = False) -> DataFrame:
    """(req_id, status, top) for every requirement (req_id, category): matched, uncertain or unmatched, from its best pair of those that `passed` (see `gates`; with `ungated`, all pairs of
    `judged` have, and those of `ungated` are the ones before the gates); a labelled one (category label)
    whose pairs all failed is uncertain, with the best of their totals, or of those of the first of its labels (`label_ord`, where it is there).  One aggregation: no pair is ranked or
    read twice.  `numbered`: block_ord is a whole number that no two blocks share, and there is no `label_ord`; then no pair is sorted either.

    matched takes a total of 25, two of the seven dimensions and a name hit; analog and discrete requirements without a name hit are unmatched.
    """
    active = sum(((F.col(d) > 0).cast("int") for d in DIMENSIONS), F.lit(0))
    if ungated is not None:
        columns = ["req_id", "total", "block_ord", "block_key", *DIMENSIONS]
        judged = judged.select(*columns, F.lit(True).alias("passed")).union(ungated.select(*columns, F.lit(False)))
    best = (_best_by_number if numbered else _best_by_key)(judged, active)
    j = reqs.select("req_id", "category").join(best, "req_id", "left")
    failed = F.when(F.col("category") == "label", F.col("ungated"))
    status = (
        F.when(F.col("total").isNull(), F.when(failed.isNotNull(), "uncertain").otherwise("unmatched"))
        .when(F.col("category").isin("analog", "discrete") & (F.col("d_name") == 0), "unmatched")
        .when((F.col("total") >= 25) & (F.col("active") >= 2) & (F.col("d_name") > 0), "matched").otherwise("uncertain")
    )
    return j.select("req_id", status.alias("status"), F.coalesce(F.col("total"), failed, F.lit(0)).alias("top"))


def context(judged: DataFrame, k: int = 20) -> DataFrame:
    """What raters see of labelled requirements none of whose pairs passed: the `k` best pairs of the first of their labels that any block has (`label_ord`), without regard to the least total,
    but not those that conflict or aren't eligible."""
    first = judged.where(F.col("category") == "label").groupBy("req_id").agg(F.max("passed").alias("_any"), F.min("label_ord").alias("_first")).where("not _any").select("req_id", "_first")
    own = judged.join(first, "req_id").where((F.col("label_ord") == F.col("_first")) & F.col("eligible") & ~F.col("conflict")).drop("_first")
    return top_k(own, k)


def evidence(pairs: DataFrame) -> DataFrame:
    """(req_id, evidence): each requirement's kept pairs in rank order, with their dimensions."""
    item = F.struct("rn", "block_key", "total", *DIMENSIONS)
    return pairs.groupBy("req_id").agg(F.sort_array(F.collect_list(item)).alias("evidence"))


def refined(matched: DataFrame, names: DataFrame, index: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(req_id, block_key, how): exact where the block's plain name is one the requirement lists, recovered where the whole index has such a block that the
    top-K missed; synonyms (name, alias) inside the block's name only for requirements without either.

    `matched` has (req_id, block_key, leaf), `names` (req_id, name), `index` (block_key, leaf).  A name that many requirements list and many blocks have makes all pairs of them; these come
    last, from one join, and none of them is shuffled: whether a pair is exact or came by another name of both stands in arrays of the requirement and the block.
    """
    from ..functions.text import plain_name

    wanted = names.select("req_id", plain_name(F.col("name")).alias("name")).distinct()
    m = matched.withColumn("name", plain_name(F.col("leaf")))
    exact = m.join(wanted, ["req_id", "name"], "left_semi").select("req_id", "block_key").distinct()
    named = index.select("block_key", plain_name(F.col("leaf")).alias("name")).distinct()
    # a pair of several names in common comes with the least of them
    several = lambda df, key, to: df.join(df.groupBy(key).agg(F.when(F.count("*") > 1, F.collect_list("name")).alias(to)), key)
    theirs, mine = several(named, "block_key", "_b"), several(wanted, "req_id", "_r")
    mine = mine.join(exact.groupBy("req_id").agg(F.collect_list("block_key").alias("_exact")), "req_id", "left")
    once = F.col("_b").isNull() | F.col("_r").isNull() | (F.array_min(F.array_intersect("_b", "_r")) == F.col("name"))
    recovered = mine.join(theirs, "name").where(once & ~F.coalesce(F.array_contains("_exact", F.col("block_key")), F.lit(False))).select("req_id", "block_key", F.lit("recovered").alias("how"))
    found = wanted.join(named.select("name").distinct(), "name", "left_semi").select("req_id").union(exact.select("req_id"))
    rest = m.join(found.distinct(), "req_id", "left_anti").join(wanted.withColumnRenamed("name", "asked"), "req_id").join(synonyms.select(plain_name(F.col("name")).alias("asked"), plain_name(F.col("alias")).alias("alias")), "asked")
    other = rest.where(F.contains("name", "alias")).select("req_id", "block_key", F.lit("synonym").alias("how")).distinct()
    return exact.withColumn("how", F.lit("exact")).union(recovered).union(other)


def cases(matches: DataFrame, blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """One row for each (req_id, block) of judged requirements, with the block's columns; a label's anchors come with its first block of the case only."""
    j = matches.where("status <> 'unmatched'").join(blocks, "block_key")
    first = F.row_number().over(Window.partitionBy("req_id", "label").orderBy("rn", "block_key")) == 1
    return j.withColumn("_first", first).join(anchors, "label", "left").withColumn("anchors", F.when(F.col("_first"), F.col("anchors"))).drop("_first")


def visible_attributes(attrs: Column, keys: Sequence[str]) -> Column:
    return F.map_filter(attrs, lambda k, _: k.isin(list(keys)))


def relocated_states(blocks: DataFrame, states: Sequence[str] = ("OneState", "ZeroState")) -> DataFrame:
    """Blocks (attrs map, sub_attrs array of maps): the state attributes leave the block where every one that it has is among its sub-signals'."""
    own = F.filter(F.map_keys("attrs"), lambda k: k.isin(list(states)))
    below = F.flatten(F.transform("sub_attrs", F.map_keys))
    there = F.forall(own, lambda k: F.array_contains(below, k))
    return blocks.withColumn("attrs", F.when(there, F.map_filter("attrs", lambda k, _: ~k.isin(list(states)))).otherwise(F.col("attrs")))
