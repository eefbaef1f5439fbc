"""The two analyses end to end, as compositions of the operators, with stage tables and a manifest that a later run resumes from.

req_to_spec: does each requirement agree with the interface objects that it refers to?  spec_to_req: is each interface object
described by some requirement?  Stage tables are written once and read back, so raters are never called again by a recomputed task.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import text as T
from ..operators import cluster, coverage, match, report, trace, unbound, verdict
from ..operators import entries as E
from ..sources.rulesets import Ruleset


class Run:
    """A run's folder: each stage's tables at <stage>/<fingerprint>, and the manifest, a log in JSON lines that is only ever appended to.

    A stage's fingerprint covers its name, its own parameters, and the fingerprints of the inputs and stages that it is made from; raters are known by their providers' names.  A stage is written into the
    folder of its fingerprint first, where no other run's table is touched, and then committed by a line of the log: after a crash anywhere it either counts as a whole or is made anew, and stages
    whose own inputs haven't changed are kept.  At its start a run marks those before it that never ended as interrupted.
    """

    def __init__(self, spark: SparkSession, folder: str, inputs: dict[str, DataFrame]):
        self.spark, self.folder, self.id = spark, folder, uuid.uuid4().hex
        self.prints = {name: hashlib.sha256(_rows_of(df).encode()).hexdigest() for name, df in inputs.items()}
        log = log_of(spark, folder)
        self.finished = {(r["stage"], r["fingerprint"]) for r in log.where("status = 'stage'").select("stage", "fingerprint").distinct().collect()}
        for r in log.groupBy("run").agg(F.count_if(F.col("status").isin("done", "interrupted")).alias("ended")).where("ended = 0").collect():
            self.note("interrupted", run=r["run"])
        self.note("running")

    def note(self, status: str, stage: str | None = None, run: str | None = None) -> None:
        row = self.spark.createDataFrame([(time.time(), run or self.id, status, stage, self.prints.get(stage))], LOG)
        row.coalesce(1).write.mode("append").json(f"{self.folder}/manifest")

    def stage(self, name: str, make: Callable[[], DataFrame], needs: Sequence[str] | None = None, **parameters: object) -> DataFrame:
        """The table of a stage that `make` makes from `needs`, the inputs and earlier stages by name (all inputs, where it isn't given)."""
        used = {n: self.prints[n] for n in (self.prints if needs is None else needs)}
        self.prints[name] = hashlib.sha256(json.dumps([name, parameters, used], sort_keys=True).encode()).hexdigest()
        path = f"{name}/{self.prints[name]}"
        if (name, self.prints[name]) not in self.finished:
            report.write_stage(make(), self.folder, path)
            self.note("stage", name)
        return self.spark.read.parquet(f"{self.folder}/{path}")


LOG = "at double, run string, status string, stage string, fingerprint string"


def log_of(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(LOG).json(f"{folder}/manifest")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LOG)


def stage_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table of a stage that was committed last."""
    last = log_of(spark, folder).where((F.col("status") == "stage") & (F.col("stage") == name)).agg(F.max_by("fingerprint", "at")).first()[0]
    if last is None:
        raise ValueError(f"{name} has not been committed in {folder}")
    return spark.read.parquet(f"{folder}/{name}/{last}")


def _rows_of(df: DataFrame) -> str:
    """A table's rows in any order, as their number and the sum of their hashes."""
    n, total = df.select(F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))).cast("decimal(38,0)").alias("h")).agg(F.count("*"), F.sum("h")).first()
    return f"{df.columns} {n} {total}"


def spec_facts(run: Run, entries: DataFrame) -> DataFrame:
    """The stage `spec_entries` of both runs: the entries that count, resolved once and read by all that is made of them."""
    return run.stage("spec_entries", lambda: E.with_value(E.resolved(entries)), ["entries"])


def annotated(reqs: DataFrame, words: dict[str, list[str]]) -> DataFrame:
    """Requirements (req_id, content) with what their texts say: labels, category, direction, sdi, bit fields, names, tokens."""
    c = T.repaired_names(F.col("content"))
    families = [w.upper() for w in words.get("protocol", Ruleset("default").protocol)]
    named = F.array_distinct(F.regexp_extract_all(c, F.lit("([A-Za-z][A-Za-z0-9_]*)"), F.lit(1)))
    return reqs.withColumns({
        "labels": T.labels(c), "category": T.category(c, words["analog"], words["discrete"], words["bus"]), "r_direction": T.direction(c, words["strong_send"], words["strong_receive"], words["send"], words["receive"]),
        "r_sdi": T.sdi_all(c), "r_fields": F.transform(B.bit_fields(c), lambda f: F.struct(f["offset"].alias("offset"), f["size"].alias("size"))), "r_tokens": F.transform(T.text_identifiers(c, words.get("noise", ())), F.lower),
        "listed": T.listed_names(c, [w.upper() for w in words.get("noise", ())]), "r_words": F.transform(T.text_identifiers(c, words.get("noise", ())), F.upper),
        "r_numbers": T.signal_numbers(c, words.get("constants", ())) if words.get("numbers") else F.array().cast("array<string>"), "r_hint": _hint(c, words),
        "r_channels": T.channels(F.upper(c)), "r_devices": F.transform(named, F.upper), "r_protocols": F.array_intersect(F.transform(named, F.upper), F.array(*map(F.lit, families)).cast("array<string>")),
    })


def _hint(content, words: dict[str, list[str]]):
    """The format, DIS or BNR, that a text speaks of in the ruleset's words."""
    speaks = lambda k: content.rlike("(?i)" + "|".join(f"\\Q{w}\\E" for w in words[k])) if words.get(k) else F.lit(False)
    return F.when(speaks("hint_discrete"), "DIS").when(speaks("hint_analog"), "BNR").otherwise("")


def stated_buses(req: DataFrame, side: DataFrame, words: dict[str, list[str]]) -> DataFrame:
    """`r_buses`: the blocks' buses that a requirement names, or whose name begins with a bus word of the ruleset that it has; `bus_types` has also those of its category.

    Texts' words are joined to the buses that go by them; no text is held against all buses.
    """
    strings = F.array().cast("array<string>")
    known = side.select(F.explode("b_buses").alias("bus")).distinct()
    said = F.explode(F.array_distinct(F.regexp_extract_all(F.col("content"), F.lit("([A-Za-z0-9][A-Za-z0-9_]*)"), F.lit(1))))
    by_word = known.withColumn("word", F.explode(F.array(*map(F.lit, words["bus"])).cast("array<string>"))).where(F.startswith("bus", "word")).select("word", "bus")
    called = by_word.union(known.select(F.col("bus").alias("word"), "bus")).distinct()
    own = req.select("req_id", said.alias("word")).join(called, "word").groupBy("req_id").agg(F.array_sort(F.collect_set("bus")).alias("_own"))
    of_kind = known.withColumn("category", F.explode(F.array(F.lit("analog"), F.lit("discrete")))).where(F.contains(F.lower("bus"), F.col("category")))
    of_kind = of_kind.groupBy("category").agg(F.array_sort(F.collect_set("bus")).alias("_kind"))  # two rows at most
    out = req.join(own, "req_id", "left").join(F.broadcast(of_kind), "category", "left").withColumn("r_buses", F.coalesce("_own", strings))
    return out.withColumn("bus_types", F.array_union("r_buses", F.coalesce("_kind", strings))).drop("_own", "_kind")


def with_synonyms(req: DataFrame, synonyms: DataFrame) -> DataFrame:
    """`r_keywords`: the names that a requirement lists, and the aliases of its words (synonyms: name, alias)."""
    words = req.select("req_id", F.explode(F.array_union("r_tokens", F.transform("listed", F.lower))).alias("word"))
    both = synonyms.select(F.lower("name").alias("word"), F.lower("alias").alias("other")).union(synonyms.select(F.lower("alias"), F.lower("name")))
    more = words.join(both.distinct(), "word").groupBy("req_id").agg(F.array_sort(F.collect_set("other")).alias("_more"))
    return req.join(more, "req_id", "left").withColumn("r_keywords", F.array_union("listed", F.coalesce("_more", F.array().cast("array<string>")))).drop("_more")


def candidates(req: DataFrame, side: DataFrame, k: int = 20, pool: DataFrame | None = None) -> DataFrame:
    """(req_id, block_key, eligible, pooled).

    By label; without one, by bus, and protocol families that the requirement names or whose bits it gives.  Analog and discrete requirements that state no bus may mean any block without a label
    (see `unbound`); those of a bus may mean labelled ones too.  With `pool` (req_id, block_key), a requirement that states no label also meets what its own trace reaches, and `pooled` tells which pairs are of
    the trace.  A label's protocol family that is neither named nor overlapped is not eligible.
    """
    field = lambda df, key, c: df.select(key, F.explode(c).alias("f")).select(key, "f.offset", "f.size")
    bare, data = req.where(F.size("labels") == 0), side.where("not is_protocol")
    protocol = side.where("is_protocol").select("block_key", "family", "b_fields")
    by_bits = match.range_candidates(field(bare, "req_id", "r_fields"), field(protocol, "block_key", "b_fields"))
    by_name = bare.select("req_id", F.explode("r_protocols").alias("family")).join(protocol, "family").select("req_id", "block_key")
    found = match.label_candidates(req, side).union(by_bits).union(by_name)
    kinds, on_bus = F.col("category").isin("analog", "discrete"), data.withColumn("buses", F.col("b_buses"))
    found = found.union(match.bus_candidates(bare.where("category <> 'bus'"), on_bus)).union(match.bus_candidates(bare.where("category = 'bus'"), on_bus, labelled=True))
    free = bare.where(kinds & (F.size("bus_types") == 0)).withColumn("r_category", F.col("category"))
    if not free.isEmpty():
        found = found.union(unbound.candidates(free, data.where("label = ''"), k))
    if pool is not None:
        found = found.union(pool.join(bare.where(kinds).select("req_id"), "req_id", "left_semi").join(data.where("label = ''").select("block_key"), "block_key").select("req_id", "block_key"))
    found = found.distinct().join(side.select("block_key", "is_protocol", "family", "b_fields"), "block_key").join(req.select("req_id", "r_fields", "r_protocols"), "req_id")
    meets = F.exists("b_fields", lambda b: F.exists("r_fields", lambda r: match.overlaps(b["offset"], b["size"], r["offset"], r["size"])))
    found = found.select("req_id", "block_key", (~F.col("is_protocol") | F.array_contains("r_protocols", F.col("family")) | F.coalesce(meets, F.lit(False))).alias("eligible"))
    if pool is None:
        return found.withColumn("pooled", F.lit(False))
    return found.join(pool.select("req_id", "block_key", F.lit(True).alias("_in")).distinct(), ["req_id", "block_key"], "left").withColumn("pooled", F.col("_in").isNotNull()).drop("_in")


def block_paths(leaves: DataFrame) -> DataFrame:
    """(block_key, protocol, devices, parents, channels) of blocks, from the paths and buses of their leaf entries; devices are first segments, parents those between it and the leaf."""
    seg = F.split(F.upper("path"), "\\.")
    e = leaves.select(
        T.block_key(F.col("path")).alias("block_key"), T.protocol(F.coalesce("bus", F.lit("")), F.col("path")).alias("protocol"), F.when(F.size(seg) > 1, F.array(seg[0])).otherwise(F.array().cast("array<string>")).alias("devices"),
        F.filter(F.slice(seg, 2, F.greatest(F.size(seg) - 2, F.lit(0))), lambda s: ~s.rlike("^L[0-9]+") & (F.length(s) >= 3)).alias("parents"), T.channels(F.upper("path")).alias("channels"))
    return e.groupBy("block_key").agg(F.min("protocol").alias("protocol"), *(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in ("devices", "parents", "channels")))


def _fields():
    number = lambda k: F.col("attrs")[k].try_cast("int")
    return F.when(number("BitOffset").isNull(), F.array().cast("array<struct<offset: int, size: int>>")).otherwise(F.array(F.struct(number("BitOffset").alias("offset"), F.coalesce(number("ParameterSize"), F.lit(1)).alias("size"))))


def _sdi():
    return F.filter(F.split(F.coalesce(F.col("attrs")["SDI"], F.lit("")), "/"), lambda s: s != "")


def sub_fields(profiles: DataFrame) -> DataFrame:
    """(block_key, sub_fields): the fields of the parts of blocks that have several offsets."""
    f = profiles.select("block_key", F.explode(_fields()).alias("f")).groupBy("block_key").agg(F.array_sort(F.collect_set("f")).alias("sub_fields"))
    return f.where(F.size(F.array_distinct(F.transform("sub_fields", lambda x: x["offset"]))) > 1)


def block_sides(blocks: DataFrame, words: dict[str, list[str]]) -> DataFrame:
    """Blocks with the columns that the score reads."""
    family = F.upper("family")
    protocol = family.isin([w.upper() for w in words.get("protocol", Ruleset("default").protocol)])
    return blocks.select(
        "block_key", "label", F.col("direction").alias("b_direction"), F.col("tokens").alias("b_tokens"), _fields().alias("b_fields"), _sdi().alias("b_sdi"), F.coalesce(F.col("attrs")["DataFormatType"], F.lit("")).alias("b_format"),
        F.lower("family").alias("b_family"), "b_sub_fields", F.col("devices").alias("b_devices"), F.col("channels").alias("b_channels"), F.filter("buses", lambda b: b != "").alias("b_buses"), F.col("ord").alias("block_ord"), family.alias("family"), protocol.alias("is_protocol"), F.startswith(family, F.lit("SPAR")).alias("is_spare"),
    )


def req_to_spec(
    spark: SparkSession, entries: DataFrame, reqs: DataFrame, words: dict[str, list[str]], folder: str, rater: verdict.Rater = verdict.stub_rater, providers: tuple[str, ...] = ("alpha", "beta", "gamma"), k: int = 20,
    traced: DataFrame | None = None, cache: str | None = None,
) -> DataFrame:
    """(req_id, status, top, agreement, stars, review) for every requirement; unmatched ones have no verdicts.

    With `traced` (parent_id, spec_name, req_id) a traced requirement is first held against the blocks that its own trace reaches; those that this leaves unmatched, and those without a trace, against all.
    `words` is a ruleset's; further sections: synonyms {name: [alias]}, numbers (any: signal numbers count), constants (numbers that don't), hint_discrete and hint_analog, soften (any: opposite directions
    of certain names pass).  `cache` is a folder of answers by content that runs share: what is in it isn't asked again.
    """
    soften = bool(words.get("soften"))
    run = Run(spark, folder, {"entries": entries, "requirements": reqs} | ({} if traced is None else {"traced": traced}))
    leaves = E.leaves(spec_facts(run, entries))

    def make_blocks() -> DataFrame:
        profiles = cluster.profiles(leaves)
        b = cluster.blocks(profiles).join(block_paths(leaves), "block_key").join(sub_fields(profiles), "block_key", "left")
        return b.withColumn("b_sub_fields", F.coalesce("sub_fields", F.array().cast(FIELDS))).drop("sub_fields")

    blocks = run.stage("blocks", make_blocks, ["spec_entries"])
    side = block_sides(blocks, words)
    synonyms = spark.createDataFrame([(a, b) for a, many in (words.get("synonyms") or {}).items() for b in many], "name string, alias string")
    req = run.stage("annotations", lambda: with_synonyms(stated_buses(annotated(reqs, words), side, words), synonyms).withColumn("r_components", F.filter("r_devices", lambda d: d.rlike("^[A-Z]{2,}[0-9]+$"))), ["requirements", "blocks"], words=words)
    pool = None
    if traced is not None:
        pool = trace.requirement_pools(blocks, traced.select("req_id", T.block_key(F.col("spec_name")).alias("block_key")))
    channel = F.coalesce(F.get(F.array_intersect("r_channels", "b_channels"), F.lit(0)), F.lit(""))
    # a protocol family that the text names is a full hit
    evidence = {"r_category": F.col("category"), "r_channel": channel, "b_channel": channel, "named": F.col("is_protocol") & F.array_contains("r_protocols", F.col("family"))}

    def scores(pairs: DataFrame) -> DataFrame:
        # the score's words, once for each requirement, in place of the identifiers of that name
        of = req.withColumn("r_words", match.name_words(F.col("r_keywords"), F.col("r_components")))
        return match.score(pairs.join(of, "req_id").join(side, "block_key").withColumns(evidence), soften).drop("r_words")

    scored = run.stage("scored", lambda: scores(candidates(req, side, k, pool)), ["annotations", "blocks", *(["traced"] if traced is not None else [])], words=words, k=k)
    judged = match.gates(scored, soften=soften).withColumn("label_ord", F.when(F.col("label") != "", F.array_position("labels", F.col("label")))).withColumn("passed", F.col("passed") & F.col("eligible"))
    found = run.stage("tiers", lambda: traced_tiers(req, judged, pool), ["scored"], words=words)
    tiers = found.drop("pool")
    # a requirement that its trace has matched is judged by the trace's blocks alone
    judged = judged.join(found.where("pool = 'traced'").select("req_id", F.lit(True).alias("_traced")), "req_id", "left").where(F.col("_traced").isNull() | F.col("pooled")).drop("_traced")
    # beyond the k best stay protocol families that the text names and blocks whose names it lists
    listed = F.exists("listed", lambda n: (F.col("family") == n) | F.startswith(F.col("family"), F.concat(n, F.lit("_"))))
    exempt = (F.col("is_protocol") & F.array_contains("r_protocols", F.col("family"))) | listed
    best = match.top_k(judged.where("passed"), k, exempt, soften)
    kept = match.prune_spare(match.prune_nameless(best.unionByName(match.context(judged, k).select(best.columns))))
    names = req.select("req_id", F.explode("listed").alias("name"))
    refined = run.stage("refined", lambda: match.refined(kept.select("req_id", "block_key", F.col("family").alias("leaf")), names, side.select("block_key", F.col("family").alias("leaf")), synonyms), ["scored", "tiers"], words=words, k=k)
    # blocks of the listed names where there are any, those that the best ones missed too; else the kept ones
    missed = scores(refined.where("how = 'recovered'").select("req_id", "block_key"))
    late = match.ranked(missed).withColumn("rn", F.lit(1_000_000) + F.col("rn"))
    cols = ["req_id", "rn", "block_key", "total", *match.DIMENSIONS]
    chosen = kept.join(refined.where("how <> 'recovered'"), ["req_id", "block_key"], "left_semi").union(kept.join(refined.select("req_id").distinct(), "req_id", "left_anti").select(kept.columns))
    kept = chosen.select(cols).union(late.select(cols))
    prompt = F.concat_ws("\n", "content", F.array_join(F.transform("evidence", lambda e: F.concat_ws(" ", e["block_key"], e["total"])), "\n"))
    cases = run.stage("cases", lambda: match.evidence(kept).join(tiers.where("status <> 'unmatched'"), "req_id").join(req.select("req_id", "content"), "req_id").select(F.col("req_id").alias("case_id"), prompt.alias("prompt")), ["refined", "requirements"], k=k)
    raters = spark.createDataFrame(list(zip(providers, range(len(providers)), strict=True)), "provider string, provider_ord int")

    def answers(name: str, asked: DataFrame, needs: list[str]) -> DataFrame:
        """The stage `name`: verdicts on `asked` (case_id, provider, provider_ord, prompt).  Answers that the cache has are taken from it, and new ones, errors apart, are put into it once they are written."""
        key = verdict.cache_key(F.lit("req_to_spec"), F.col("provider"), F.lit(""), F.lit(""), F.col("prompt"))
        asked = asked.withColumn("key", key)
        known = cached_answers(spark, cache) if cache else None
        own = (name, hashlib.sha256(json.dumps([name, {"providers": list(providers)}, {n: run.prints[n] for n in needs}], sort_keys=True).encode()).hexdigest())
        again = own in run.finished

        def make() -> DataFrame:
            todo = asked if known is None else verdict.to_do(asked, known)
            out = verdict.judged_rows(todo, rater)
            if known is None:
                return out
            return out.unionByName(verdict.reused(asked, known).select("case_id", "provider", "provider_ord", F.from_json("payload", "status string, analysis string, confidence double").alias("a")).select("case_id", "provider", "provider_ord", "a.*"))

        made = run.stage(name, make, needs, providers=list(providers))
        if cache and not again:
            fresh = verdict.to_do(made.where("status <> 'error'").join(asked.select("case_id", "provider", "key"), ["case_id", "provider"]), known)
            verdict.append_cache(fresh.select("key", F.to_json(F.struct("status", "analysis", "confidence")).alias("payload"), F.lit(time.time()).alias("ord")), cache)
        return made

    verdicts = answers("verdicts", cases.crossJoin(F.broadcast(raters)), ["cases"])
    # raters that were too late are asked once more
    late = answers("late_verdicts", verdicts.where("status = 'error' and analysis = 'timeout'").select("case_id", "provider", "provider_ord").join(cases, "case_id"), ["cases", "verdicts"])
    verdicts = verdict.patched(verdicts, late.where("status <> 'error'"))

    def consensus_of(given: DataFrame) -> DataFrame:
        agreed = verdict.agreement(given).join(verdict.disagreements(given), "case_id", "left")
        return verdict.capped(agreed.withColumn("stars", verdict.stars(F.col("agreement"), F.coalesce("disagreements", F.array().cast("array<string>"))))).drop("disagreements")

    # each rater of a case of few stars sees what its peers said
    asked = verdict.second_round(consensus_of(verdicts), verdicts).join(cases, "case_id").join(raters, "provider").select("case_id", "provider", "provider_ord", F.concat_ws("\n", "prompt", "peers").alias("prompt"))
    second = answers("second_verdicts", asked, ["cases", "verdicts", "late_verdicts"]).where("status <> 'error'")
    final = verdicts.join(second, ["case_id", "provider"], "left_anti").unionByName(second)
    consensus = run.stage("consensus", lambda: consensus_of(final), ["verdicts", "late_verdicts", "second_verdicts"])
    out = run.stage("report", lambda: tiers.join(consensus.withColumnRenamed("case_id", "req_id").drop("alive"), "req_id", "left"), ["tiers", "consensus"])
    run.note("done")
    return out


FIELDS = "array<struct<offset: int, size: int>>"


def cached_answers(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema("key string, payload string, ord double").json(folder)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "key string, payload string, ord double")


def traced_tiers(req: DataFrame, judged: DataFrame, pool: DataFrame | None) -> DataFrame:
    """`match.tiers` and `pool`: traced where a requirement's own trace has blocks and these don't leave it unmatched, else full."""
    full = match.tiers(req, judged)
    if pool is None:
        return full.withColumn("pool", F.lit("full"))
    own = req.join(pool.select("req_id").distinct(), "req_id", "left_semi")
    first = match.tiers(own, judged.where("pooled")).withColumn("_by", F.lit("traced"))
    out = trace.group_union(trace.with_fallback(first, full.withColumn("_by", F.lit("full"))), full.withColumn("_by", F.lit("full")))
    return out.select("req_id", "status", "top", F.col("_by").alias("pool"))


def spec_to_req(spark: SparkSession, entries: DataFrame, reqs: DataFrame, folder: str, traced: DataFrame | None = None, noise: tuple[str, ...] = (), review: Callable[[DataFrame], DataFrame] | None = None, words: dict[str, list[str]] | None = None) -> DataFrame:
    """(block_key, coverage_status, source, matched, rule_level, analysis_status) for every block; with `traced` (parent_id, spec_name, req_id, ord) only for the
    blocks in its scope.  `review` turns (block_key, matched) of every block that needs it into (block_key, verdict, matched_ids, rejected_ids); `matched` has the first
    coverage.SHOWN candidates.  `words` is a ruleset's, for categories and generic terms."""
    words = words or Ruleset("default").words()
    general = F.col("token").isin([w.upper() for w in words.get("generic", ())])
    run = Run(spark, folder, {"entries": entries, "requirements": reqs} | ({} if traced is None else {"traced": traced}))
    given = ["traced"] if traced is not None else []
    none = F.array().cast("array<string>")
    e = E.leaves(spec_facts(run, entries))

    def make_blocks() -> DataFrame:
        b = cluster.blocks(cluster.profiles(e)).join(block_paths(e), "block_key").select(
            "block_key", "label", "family", F.transform("tokens", F.upper).alias("tokens"), "protocol", "devices", "parents", _fields().alias("fields"), _sdi().alias("sdi"))
        if traced is None:
            return b.withColumns({"missing": none, "candidates": none})
        s = trace.scope(traced.select("parent_id", "spec_name").distinct(), traced.select("parent_id", "req_id", "ord"), reqs).withColumn("block_key", T.block_key(F.col("spec_name")))
        s = coverage.trace_recall(s)
        lost = s.groupBy("block_key").agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("missing", "candidates")))
        return b.join(lost, "block_key")

    blocks = run.stage("scoped_blocks", make_blocks, ["spec_entries", *given, *(["requirements"] if given else [])])
    index = run.stage("index", lambda: coverage.token_index(reqs, T.text_identifiers(F.col("content"), noise)), ["requirements"], noise=list(noise))
    said = annotated(reqs, {"strong_send": [], "strong_receive": [], "send": [], "receive": []} | words).select("req_id", "labels", F.col("category").alias("r_category"), "r_sdi", "r_fields", "r_devices", "r_words")
    token = coverage.token_join(blocks.select("block_key", F.explode(F.array_distinct("tokens")).alias("token")), index.select("token", "req_id"))
    found = token.groupBy("block_key", "req_id").agg(
        F.count_distinct(F.when(~general, F.col("token"))).alias("overlap"), F.count_distinct(F.when(general, F.col("token"))).alias("generic"), F.max(~general & (T.specificity(F.col("token")) == "precise")).alias("distinctive"))
    by_label = said.select("req_id", F.explode("labels").alias("label")).join(blocks.where("label <> ''").select("label", "block_key"), "label").select("block_key", "req_id", F.lit(True).alias("hit"))
    by_trace = blocks.select("block_key", F.explode("candidates").alias("req_id"), F.lit(True).alias("in_trace"))
    names = index.where(~general).select("req_id", F.col("token").alias("family")).distinct().join(blocks.select("block_key", "family"), "family").select("block_key", "req_id", F.lit(True).alias("full_name"))
    pairs = found
    for more in (by_label, by_trace, names):
        pairs = pairs.join(more, ["block_key", "req_id"], "full")
    no = F.lit(False)
    pairs = pairs.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("overlap", "generic")} | {c: F.coalesce(c, no) for c in ("distinctive", "hit", "in_trace", "full_name")})
    # the SDI tells blocks of a label apart only where they differ in it
    split = blocks.where("label <> ''").select("label", F.explode("sdi").alias("s")).where("s <> 'NA'").groupBy("label").agg((F.count_distinct("s") > 1).alias("by_sdi"))
    pairs = pairs.join(blocks.drop("tokens", "missing", "candidates").join(split, "label", "left"), "block_key").join(said, "req_id").withColumn("rank", F.struct(-F.col("overlap"), "req_id"))
    device = lambda c: F.filter(c, lambda d: d.rlike("^[A-Z]{2,}[0-9]+$"))
    parent = F.arrays_overlap("parents", "r_words")
    pairs = coverage.conflict(pairs.withColumns({
        "r_labels": F.col("labels"), "b_label": F.col("label"), "b_protocol": F.col("protocol"), "meant": (F.col("overlap") > 0) | F.col("full_name"), "context": F.col("hit") | F.arrays_overlap("devices", "r_words") | parent,
        "parent": parent, "b_devices": device("devices"), "r_devices": device("r_devices"), "b_sdi": F.when(F.coalesce("by_sdi", no), F.col("sdi")).otherwise(none), "b_fields": F.col("fields"),
    }))
    pairs = pairs.withColumn("level", coverage.level(*(F.col(c) for c in ("conflict", "full_name", "hit", "overlap", "distinctive", "context", "generic", "parent", "identity"))))
    rules = run.stage("rules", lambda: coverage.deterministic(blocks, pairs.select("block_key", "req_id", "rank", "level")), ["scoped_blocks", "index", "requirements"], words=words, noise=list(noise))
    asked = rules.where("needs_ai").select("block_key", F.col("shown").alias("matched"))
    reviews = review(asked) if review else spark.createDataFrame([], "block_key string, verdict string, matched_ids array<string>, rejected_ids array<string>")
    reviews = run.stage("reviews", lambda: reviews, ["rules"])
    out = run.stage("coverage", lambda: coverage.consolidated(blocks, rules, reviews), ["rules", "reviews"])
    run.note("done")
    return out
