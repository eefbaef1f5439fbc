"""Candidates of requirements that name neither a label nor a bus (J9): every block without a label may be meant, yet only those that can be among the best are paired.

A block's score is a sum over dimensions, each of which asks for something equal.  Blocks are listed under every combination of what they are, dimension by dimension, or of `*` for any; a
list keeps its first k blocks alone.  A requirement looks up the combinations that don't contradict it, each worth a score that all blocks of the list have at least.  A block whose
score is exactly that and that isn't in the list has k others before it, so it is none of the k best.  And a full list worth s makes all combinations worth less than s needless:
the bound that keeps look-ups few.

Look-ups are made once for what requirements have in common: what a requirement is beside its names is one kind of rest, its names are sets, and a list is looked up once for a kind of
rest and a set.  `kinds` are requirements that are alike in all that counts.

Names hit in parts, so they are features: shared tokens, and words that a block's family bears out.  Pairs that share a rare feature are all taken; frequent features are one more
dimension of the lists, as sets, looked up only where they reach the bound that the other dimensions have set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stored import saved
from . import match

#: Lists and what looks them up repeat few strings, so that their files are some hundredths of what they take in memory, and Spark would send them through the driver for small ones.
_DEALT = "merge"
#: Blocks that share a feature, up to which it is rare.
RARE = 64
#: Distinct names and devices beyond which their scores grow no more.
MOST_NAMES, MOST_DEVICES = 4, 3
DIMS = ("direction", "sdi", "bits", "format", "device", "channel")
_STRINGS = "array<string>"


def _subsets(items: Column, most: int) -> Column:
    """Every set of up to `most` of distinct items, each in the items' order; the empty one first."""
    grow = lambda acc, x: F.concat(acc, F.transform(F.filter(acc, lambda s: F.size(s) < most), lambda s: F.concat(s, F.array(x))))
    return F.aggregate(items, F.array(F.array().cast(_STRINGS)), grow)


def _device_sets(devices: Column) -> Column:
    return _subsets(F.array_sort(F.array_distinct(devices)), MOST_DEVICES)


def _codes(blocks: DataFrame) -> DataFrame:
    """Blocks with an array of codes for each dimension: what they are in it, and `*`."""
    any_, none = F.array(F.lit("*")), F.array(F.lit(""))
    some = lambda c: F.when(F.size(c) > 0, F.array_distinct(c)).otherwise(none)
    number = lambda x: F.coalesce(x.cast("string"), F.lit("?"))
    fields = F.col("b_fields")
    bits = [F.transform(fields, lambda f: F.concat(number(f["offset"]), F.lit(":"), number(f["size"]))), F.transform(fields, lambda f: F.concat(number(f["offset"]), F.lit(":"))), F.transform(fields, lambda f: F.concat(F.lit(":"), number(f["size"])))]
    way = F.when(F.col("b_direction").isin("send", "receive", "bidirectional"), F.col("b_direction")).otherwise("")
    kind = F.when(F.col("b_format") == "DIS", "discrete").when(F.startswith(F.col("b_format"), F.lit("BNR")) | (F.col("b_format") == "FLOAT"), "analog").otherwise("other")
    return blocks.withColumns({
        "direction": F.concat(F.array(way), any_), "sdi": F.concat(some("b_sdi"), any_), "bits": F.array_distinct(F.concat(*bits, any_)), "format": F.when(F.col("b_format") == "", any_).otherwise(F.array(kind, F.lit("some"), F.lit("*"))),
        "device": F.transform(_device_sets(F.col("b_devices")), lambda s: F.array_join(s, ",")), "channel": F.array_distinct(F.concat(F.filter("b_channels", lambda c: c != ""), any_)),
    })


def _options(reqs: DataFrame) -> DataFrame:
    """Requirements with an array of (code, worth) for each dimension: the codes that don't contradict it."""
    worth = lambda code, w: F.struct(code.alias("code"), F.lit(w).alias("worth"))
    any_, silent = F.array(worth(F.lit("*"), 0)), F.array(worth(F.lit(""), 0))
    each = lambda c, w: F.transform(F.array_distinct(c), lambda x: worth(x, w))
    field = lambda code, w: F.transform("r_fields", lambda f: worth(code(f["offset"].cast("string"), f["size"].cast("string")), w))
    one_way = F.concat(F.array(worth(F.col("r_direction"), 15), worth(F.lit("bidirectional"), 8)), silent)
    return reqs.withColumns({
        "direction": F.when(F.col("r_direction").isin("send", "receive"), one_way).otherwise(any_), "sdi": F.when(F.size("r_sdi") > 0, F.concat(each("r_sdi", 15), silent)).otherwise(any_),
        "bits": F.array_distinct(F.concat(field(lambda o, n: F.concat(o, F.lit(":"), n), 20), field(lambda o, n: F.concat(o, F.lit(":")), 12), field(lambda o, n: F.concat(F.lit(":"), n), 8), any_)),
        "format": F.concat(F.array(worth(F.col("r_category"), 10), worth(F.lit("some"), 5)), any_),
        "device": F.transform(_device_sets(F.col("r_devices")), lambda s: F.struct(F.array_join(s, ",").alias("code"), F.least(F.lit(5), 2 * F.size(s)).alias("worth"))), "channel": F.concat(each(F.filter("r_channels", lambda c: c != ""), 10), any_),
    })


def _words(reqs: DataFrame) -> Column:
    """Words of a requirement that a family may bear out."""
    from ..functions.text import has_named_component

    parts = lambda d: F.when(has_named_component(d), F.regexp_extract_all(d, F.lit("([A-Za-z]+[0-9]+)"), F.lit(1))).otherwise(F.array(d))
    words = F.concat(F.transform("r_keywords", F.lower), F.flatten(F.transform(F.transform("r_components", F.lower), parts)))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3))


def _trigrams(text: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3))))


def borne_out(words: DataFrame, families: DataFrame) -> DataFrame:
    """(word, family) where the distinct `families` bear out the distinct `words` (of three letters and more; see `match.name_hits`).  One of the two is part of the other, so it begins with
    three letters that the other has somewhere."""
    w = words.select("word", F.substring("word", 1, 3).alias("begin"), _trigrams(F.col("word")).alias("has"))
    f = families.where(F.length("family") >= 1).select("family", F.substring("family", 1, 3).alias("begin"), _trigrams(F.col("family")).alias("has"))
    in_family = w.select("word", F.col("begin").alias("gram")).join(f.select("family", F.explode("has").alias("gram")), "gram")
    in_word = w.select("word", F.explode("has").alias("gram")).join(f.where(F.length("family") >= 3).select("family", F.col("begin").alias("gram")), "gram")
    short = f.where(F.length("family") < 3).select("family").join(w.select("word"), F.contains("word", "family")).select("word", "family")
    met = in_family.select("word", "family").union(in_word.select("word", "family")).union(short)
    hit = F.size(match.name_hits(F.array("word"), F.array().cast(_STRINGS), F.col("family"))) > 0
    return met.distinct().where(hit)


def _features(reqs: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(req_id, feature) and (block_key, feature): t:<token>, and w:<word> that the block's family bears out."""
    words = reqs.select("req_id", F.explode(_words(reqs)).alias("word"))
    named = blocks.select("block_key", F.lower("b_family").alias("family"))
    hits = borne_out(words.select("word").distinct(), named.select("family").distinct())
    of_reqs = reqs.select("req_id", F.explode("r_tokens").alias("x")).select("req_id", F.concat(F.lit("t:"), "x").alias("feature")).union(words.select("req_id", F.concat(F.lit("w:"), "word")))
    of_blocks = blocks.select("block_key", F.explode("b_tokens").alias("x")).select("block_key", F.concat(F.lit("t:"), "x").alias("feature")).union(named.join(hits, "family").select("block_key", F.concat(F.lit("w:"), "word")))
    return saved(of_reqs.distinct(), "req-features"), saved(of_blocks.distinct(), "block-features")


def _sets(df: DataFrame, key: str, features: DataFrame) -> DataFrame:
    """`df` with `names`: every set of up to MOST_NAMES of its features, in order, as one string; the empty one among them."""
    own = features.groupBy(key).agg(F.sort_array(F.collect_set("feature")).alias("_f"))
    grown = _subsets(F.coalesce("_f", F.array().cast(_STRINGS)), MOST_NAMES)
    return df.join(own, key, "left").withColumn("names", grown).drop("_f")


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt over all tasks, as each becomes some hundreds; what is counted by `key` next stays where it is."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _listed(blocks: DataFrame, k: int) -> DataFrame:
    """(names, key, block_key): of each set of names and each combination of codes, the first `k` blocks.  Tasks cut their own lists first."""
    b = _spread(blocks, "block_key").withColumn("names", F.explode("names"))
    for d in DIMS:
        b = b.withColumn(d, F.explode(d))
    b = b.select(F.array_join("names", ",").alias("names"), F.concat_ws("|", *DIMS).alias("key"), "block_key", "block_ord")
    rn = F.row_number().over(Window.partitionBy("names", "key").orderBy("block_ord", "block_key"))
    return b.withColumn("rn", rn).where(F.col("rn") <= k).select("names", "key", "block_key")


def _asked(kinds: DataFrame) -> DataFrame:
    """(rest_id, key, rest): the combinations that a kind of rest can look up, and what they are worth."""
    r = _spread(kinds, "rest_id").select("rest_id", *DIMS)
    for d in DIMS:
        r = r.withColumn(d, F.explode(d))
    return r.select("rest_id", F.concat_ws("|", *(F.col(f"{d}.code") for d in DIMS)).alias("key"), sum((F.col(f"{d}.worth") for d in DIMS), F.lit(0)).alias("rest"))


def kinds(reqs: DataFrame, columns: list[str], name: str = "kind") -> DataFrame:
    """(req_id, `name`): requirements that are alike in `columns` have the least req_id of them in common."""
    alike = reqs.select("req_id", F.to_json(F.struct(*columns)).alias("_like"))
    return alike.join(alike.groupBy("_like").agg(F.min("req_id").alias(name)).hint(_DEALT), "_like").select("req_id", name)


def candidates(reqs: DataFrame, blocks: DataFrame, k: int = 20, least: int = 12, rare: int = RARE) -> DataFrame:
    """(req_id, block_key), distinct: among them, for each requirement, the `k` best of all `blocks` by `match.score` that pass `match.gates` with `least`, ties by block_ord and block_key.

    `reqs` has req_id and r_tokens, r_keywords, r_components, r_direction, r_fields, r_sdi, r_category (analog or discrete), r_devices, r_channels; `blocks` has block_key, block_ord and
    b_tokens, b_family, b_direction, b_fields, b_sdi, b_format, b_devices, b_channels.  No array is null.  Buses play no part: requirements that state one have another way to their blocks.

    Tables that are read more than once are written on the way: each would otherwise be planned and made anew wherever it is read, features within lists within look-ups.
    """
    # a text names much that is no device
    known = blocks.select(F.explode("b_devices").alias("d")).distinct()
    own = reqs.select("req_id", F.explode("r_devices").alias("d")).join(known, "d", "left_semi").groupBy("req_id").agg(F.collect_set("d").alias("_d"))
    # collect_set has no order
    reqs = saved(reqs.join(own.hint(_DEALT), "req_id", "left").withColumn("r_devices", F.array_sort(F.coalesce("_d", F.array().cast(_STRINGS)))).drop("_d"), "reqs")
    of_reqs, of_blocks = _features(reqs, blocks)
    frequent = saved(of_blocks.groupBy("feature").count().where(F.col("count") > rare).select("feature"), "frequent")
    rare_pairs = of_reqs.join(of_blocks.join(frequent, "feature", "left_anti").hint(_DEALT), "feature").select("req_id", "block_key")
    lists = saved(_listed(_sets(_codes(blocks), "block_key", of_blocks.join(frequent, "feature", "left_semi")), k), "lists")
    sizes = saved(lists.groupBy("names", "key").agg(F.count("*").alias("n")), "list-sizes").hint(_DEALT)
    rests = saved(kinds(reqs, ["r_direction", "r_fields", "r_sdi", "r_category", "r_devices", "r_channels"], "rest_id"), "rests")
    asked = saved(_asked(_options(reqs.join(rests.where("req_id = rest_id").hint(_DEALT), "req_id"))), "asked")
    full = F.max(F.when(F.col("n") >= k, F.col("worth")))
    plain = saved(asked.where(F.col("rest") >= least).select("rest_id", F.lit("").alias("names"), "key", F.col("rest").alias("worth")).join(sizes, ["names", "key"]), "plain")
    bound = saved(plain.groupBy("rest_id").agg(F.greatest(full, F.lit(least)).alias("bound")), "bound")
    sets = _sets(reqs.select("req_id"), "req_id", of_reqs.join(frequent, "feature", "left_semi")).withColumn("names", F.explode("names")).where(F.size("names") > 0)
    # a name that is both a token and a word counts once
    hit = F.least(F.lit(30), 8 * F.size(F.array_distinct(F.transform("names", lambda f: F.substring(f, 3, 1 << 20)))))
    sets = saved(sets.select("req_id", F.array_join("names", ",").alias("names"), hit.alias("hit")).join(rests.hint(_DEALT), "req_id"), "name-sets")
    able = asked.join(bound.hint(_DEALT), "rest_id", "left").withColumn("bound", F.coalesce("bound", F.lit(least)))
    named = able.join(sets.select("rest_id", "names", "hit").distinct().hint(_DEALT), "rest_id").withColumn("worth", F.col("rest") + F.col("hit")).where(F.col("worth") >= F.col("bound"))
    hits = saved(named.select("rest_id", "names", "key", "worth").join(sizes, ["names", "key"]), "hits")
    # a requirement's own sets, and none
    own = rests.select("req_id", "rest_id", F.lit("").alias("names")).union(sets.select("req_id", "rest_id", "names"))
    both = plain.union(hits.select(plain.columns))
    best = both.groupBy("rest_id", "names").agg(full.alias("full"))
    bar = saved(own.join(best.hint(_DEALT), ["rest_id", "names"]).groupBy("req_id").agg(F.greatest(F.max("full"), F.lit(least)).alias("bar")), "bar")
    wanted = own.join(bar.hint(_DEALT), "req_id")
    looked_up = wanted.join(both.hint(_DEALT), ["rest_id", "names"]).where(F.col("worth") >= F.col("bar")).select("req_id", "names", "key").join(lists.hint(_DEALT), ["names", "key"]).select("req_id", "block_key")
    return rare_pairs.union(looked_up).distinct()
