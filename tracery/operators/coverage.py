"""Spec to requirement: recall through an inverted index, hard conflicts, levels of evidence, and consolidation with a rater."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stored import saved

#: Levels of evidence, best first, with the status that each gives and whether a rater should look.
LEVELS = {  # name: (rank, analysis status, needs a rater)
    "exact_label": (6, "covered_direct", False), "exact_fullname": (5, "covered_direct", False), "exact_signal": (4, "covered_direct", False),
    "parent_referenced": (3, "parent_referenced", True), "generic_signal": (2, "possible", True), "weak_signal": (1, "possible", True),
}
#: Categories of a requirement that can't speak of a block of the protocol.
CLASHES = {"labelled_word": ("analog", "discrete"), "frame": ("label", "analog", "discrete"), "analog": ("label", "discrete"), "discrete": ("label", "analog")}
#: More candidates than this are not shown to a rater.
SHOWN = 5


#: Rows of a side beyond which a token is frequent, into how many parts its rows are dealt, and how many frequent tokens are sent to all tasks.
FREQUENT, PARTS, SENT = 10_000, 16, 1_000_000


def token_index(requirements: DataFrame, tokens: Column, source: str = "deterministic") -> DataFrame:
    """(token, req_id, source), distinct; a long table, never arrays.  Only requirements that have several rows, which are counted before, can repeat a token: the others' are not compared."""
    rows = lambda df: df.select("req_id", F.explode(F.array_distinct(tokens)).alias("token")).select("token", "req_id", F.lit(source).alias("source"))
    several = requirements.groupBy(F.col("req_id").alias("_id")).count().where(F.col("count") > 1).select("_id")
    n = several.limit(SENT + 1).count()
    if n == 0:
        return rows(requirements)
    several = F.broadcast(several) if n <= SENT else several
    of = lambda how: requirements.join(several, F.col("req_id").eqNullSafe(F.col("_id")), how)
    return rows(of("left_anti")).union(rows(of("left_semi")).distinct())


def token_join(left: DataFrame, right: DataFrame, frequent: int = FREQUENT, parts: int = PARTS) -> DataFrame:
    """All pairs of rows of `left` and `right` with an equal `token`.  Tokens that more than `frequent` rows of a side have, counted before anything is joined, go apart: each side is dealt
    into `parts` by its rows' hashes and repeated for the other side's parts, so that one token is parts * parts even pieces of work.  The others are joined plainly; no pair is lost."""
    many = lambda df: df.groupBy("token").count().where(F.col("count") > frequent).select("token")
    hot = many(left).union(many(right)).distinct()
    if hot.limit(SENT + 1).count() <= SENT:
        hot = F.broadcast(hot)
    part = lambda df: F.pmod(F.xxhash64(*(c for c in df.columns if c != "token")), F.lit(parts)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    l = left.join(hot, "token", "left_semi").withColumn("_l", part(left)).withColumn("_r", every)
    r = right.join(hot, "token", "left_semi").withColumn("_r", part(right)).withColumn("_l", every)
    plain = left.join(hot, "token", "left_anti").join(right.join(hot, "token", "left_anti"), "token")
    return plain.unionByName(l.join(r, ["token", "_l", "_r"]).drop("_l", "_r"))


def recall(blocks: DataFrame, index: DataFrame, k: int | None = None) -> DataFrame:
    """(block_key, req_id, overlap, source, rank): requirements that share tokens with a block (block_key, tokens), by how many; deterministic tokens before a model's.

    The index is dear to make and read several times, so what it has of the blocks' tokens is written on the way."""
    b = saved(blocks.select("block_key", F.explode("tokens").alias("token")).distinct(), "block-tokens")
    known = index.join(b.select("token").distinct(), "token", "left_semi").groupBy("token", "req_id").agg(F.min("source").alias("source"))
    j = token_join(b, saved(known, "known-tokens")).groupBy("block_key", "req_id").agg(F.count("*").alias("overlap"), F.min("source").alias("source"))
    out = j.withColumn("rank", F.row_number().over(Window.partitionBy("block_key").orderBy("source", F.desc("overlap"), "req_id")))
    return out if k is None else out.where(F.col("rank") <= k)


def trace_recall(scoped: DataFrame) -> DataFrame:
    """Candidates of a trace without the missing ones."""
    return scoped.withColumn("candidates", F.array_except("candidates", "missing"))


def conflict(pairs: DataFrame) -> DataFrame:
    """`conflict` and `identity` for pairs (b_label, r_labels, b_protocol, r_category, b_devices, r_devices, b_sdi, r_sdi, b_fields, r_fields, meant): what is stated on both sides and
    can't be the same object, and what speaks for the same part of a labelled word.

    Devices tell blocks without labels apart, SDI and bits the parts of labelled ones; disjoint bits only where no name is shared (`meant`), else they are a
    difference of one object.
    """
    stated = lambda a, b: (F.size(a) > 0) & (F.size(b) > 0)
    same = lambda a, b: stated(a, b) & F.coalesce(F.arrays_overlap(a, b), F.lit(False))
    label = (F.col("b_label") != "") & (F.size("r_labels") > 0) & ~F.array_contains("r_labels", F.col("b_label"))
    matrix, word = F.lit(False), F.col("b_protocol") == "labelled_word"
    for protocol, categories in CLASHES.items():
        matrix = matrix | ((F.col("b_protocol") == protocol) & F.col("r_category").isin(*categories))
    meet = F.exists("b_fields", lambda b: F.exists("r_fields", lambda r: (b["offset"] < r["offset"] + r["size"]) & (r["offset"] < b["offset"] + b["size"])))
    device = ~word & stated("b_devices", "r_devices") & ~same("b_devices", "r_devices")
    sdi, bits = word & stated("b_sdi", "r_sdi"), word & stated("b_fields", "r_fields")
    clash = label | matrix | device | (sdi & ~same("b_sdi", "r_sdi")) | (bits & ~meet & ~F.col("meant"))
    return pairs.withColumns({"conflict": clash, "identity": (sdi & same("b_sdi", "r_sdi")) | (bits & meet)})


def level(conflict_: Column, full_name: Column, label: Column, specific: Column, distinctive: Column, context: Column, generic: Column, parent: Column, identity: Column | None = None) -> Column:
    """The level of one pair.  specific and generic count shared tokens; the others are booleans: context is a label, device, port or message that both name (for a lone
    distinctive token), parent a port or message, identity from `conflict`."""
    identity = F.lit(False) if identity is None else identity
    return (
        F.when(conflict_, "not_same_object").when(full_name, "exact_fullname").when(label & ((specific > 0) | identity), "exact_label")
        .when((specific >= 2) | ((specific == 1) & distinctive & context), "exact_signal").when(specific == 1, "weak_signal")
        .when(label | parent, "parent_referenced").when(generic > 0, "generic_signal").otherwise("none")
    )


def level_rank(name: Column) -> Column:
    out = F.lit(0)
    for k, (r, _, _) in LEVELS.items():
        out = F.when(name == k, r).otherwise(out)
    return out


def best_level(pairs: DataFrame) -> DataFrame:
    """(block_key, level, matched): all candidates of a block's best level, in the order of `rank`; conflicts and pairs without evidence take no part."""
    ok = pairs.where("level not in ('not_same_object', 'none')").withColumn("lr", level_rank(F.col("level")))
    top = ok.withColumn("rk", F.rank().over(Window.partitionBy("block_key").orderBy(F.desc("lr")))).where("rk = 1")
    ids = F.transform(F.sort_array(F.collect_list(F.struct("rank", "req_id"))), lambda x: x["req_id"])
    return top.groupBy("block_key").agg(F.first("level").alias("level"), ids.alias("matched"))


def deterministic(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(block_key, rule_level, analysis_status, needs_ai, matched, truncated, shown) for every block (block_key, missing).

    Without any candidate the level is no_evidence, or input_error where a trace names missing ones; with conflicts only, not_same_object, which is uncovered, or
    possible with missing ids, and no rater's matter; with candidates but no evidence, trace_only.  `shown` has the first SHOWN candidates, conflicts among them;
    truncated says that there are more.
    """
    best = best_level(pairs)
    first = pairs.withColumn("rn", F.row_number().over(Window.partitionBy("block_key").orderBy("rank", "req_id"))).where(F.col("rn") <= SHOWN)
    first = first.groupBy("block_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "req_id"))), lambda x: x["req_id"]).alias("shown"))
    n = pairs.groupBy("block_key").agg(F.count("*").alias("n"), F.count_if(F.col("level") == "not_same_object").alias("n_conflict"))
    j = blocks.join(best, "block_key", "left").join(n, "block_key", "left").join(first, "block_key", "left")
    lost, some = F.size("missing") > 0, F.coalesce("n", F.lit(0)) > 0
    name = F.when(~some, F.when(lost, "input_error").otherwise("no_evidence")).when(F.col("n") == F.col("n_conflict"), "not_same_object").otherwise(F.coalesce("level", F.lit("trace_only")))
    j = j.withColumn("rule_level", name)
    status = F.when(name == "input_error", "input_error").when((name == "trace_only") | ((name == "not_same_object") & lost), "possible").otherwise("uncovered")
    ai = F.col("rule_level") == "trace_only"
    for k, (_, s, a) in LEVELS.items():
        status, ai = F.when(F.col("rule_level") == k, s).otherwise(status), F.when(F.col("rule_level") == k, F.lit(a)).otherwise(ai)
    none = F.array().cast("array<string>")
    return j.select(
        "block_key", "missing", "rule_level", status.alias("analysis_status"), ai.alias("needs_ai"), F.coalesce("matched", none).alias("matched"),
        F.coalesce(F.col("n") > SHOWN, F.lit(False)).alias("truncated"), F.coalesce("shown", none).alias("shown"),
    )


def matched_tokens(block_tokens: Column, req_tokens: Column, label: Column) -> Column:
    """Evidence: the label first, then the shared tokens, sorted."""
    shared = F.array_sort(F.array_intersect(block_tokens, req_tokens))
    return F.when(label != "", F.concat(F.array(label), shared)).otherwise(shared)


def consolidated(blocks: DataFrame, rules: DataFrame, reviews: DataFrame) -> DataFrame:
    """(block_key, coverage_status, source, matched): rule results, and for those that need a rater its review (block_key, verdict, matched_ids, rejected_ids).

    covered takes the rater's ids that it was shown; not_same_object gives possible with missing ids or truncated candidates, uncovered only if all candidates are
    rejected, and matches nothing; without a review, or an unconfirmed one, the block keeps its status.  An input error has no coverage status.
    """
    j = blocks.select("block_key").join(rules, "block_key", "left").join(reviews, "block_key", "left")
    ai, none = F.col("needs_ai"), F.array().cast("array<string>")
    all_rejected = F.size(F.array_except("shown", F.coalesce("rejected_ids", none))) == 0
    after = F.when(F.col("verdict") == "covered", "covered").when(
        F.col("verdict") == "not_same_object", F.when((F.size("missing") > 0) | F.col("truncated") | ~all_rejected, "possible").otherwise("uncovered")).otherwise(F.col("analysis_status"))
    by_rule = F.when(F.col("analysis_status") == "covered_direct", "covered").when(F.col("analysis_status") == "input_error", "").otherwise(F.coalesce("analysis_status", F.lit("uncovered")))
    ids = F.when(ai & (F.col("verdict") == "covered"), F.array_intersect("matched_ids", "shown")).when(ai & (F.col("verdict") == "not_same_object"), none).otherwise(F.coalesce("matched", none))
    return j.select("block_key", F.when(ai, after).otherwise(by_rule).alias("coverage_status"), F.when(ai & F.col("verdict").isNotNull(), "rater").otherwise("rule").alias("source"), ids.alias("matched"), "rule_level", "analysis_status")


def statistics(results: DataFrame) -> DataFrame:
    """Blocks by coverage status; those without one by analysis status."""
    key = F.when(F.col("coverage_status") != "", F.col("coverage_status")).otherwise(F.col("analysis_status"))
    return results.groupBy(key.alias("status")).agg(F.count("*").alias("blocks"))
