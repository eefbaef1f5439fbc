"""Secret scans with corpus-wide ownership frequency.  DataFrame functions only.

Candidates are found in each text by pattern.  Their values are counted over the whole corpus by distinct repositories and
owners: a value that many owners have is a widely copied example, one that few have and that looks random is taken for a live
credential.  Both verdicts come back as spans of their own, over the value alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, text_or_empty

# The kinds in their order, the pattern of each, the group with the value, and the least length of the value.
KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
NAMES = [k for k, *_ in KINDS] + ["live", "copied"]
#: Matches of a text that are gathered into one array before it is joined to the others.
CHUNK = 512
SPAN = "array<struct<start: int, kind: int, end: int, value: string>>"


def pieces(text: Column, kind: int) -> Column:
    """What lies between the leftmost non-overlapping matches of a kind, the matches, and their values, side by side in chunks of CHUNK; null where there is none."""
    _, pattern, group, _ = KINDS[kind]
    between, whole, value = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.when(text.rlike(pattern), F.arrays_zip(between.alias("between"), whole.alias("whole"), value.alias("value")))


def chunks(own: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(own) / CHUNK).cast("int")), lambda i: F.slice(own, i * CHUNK + 1, CHUNK))


def spans_of(chunked: Column, kind: int) -> Column:
    """The matches of a kind as (start, kind, end, value), in code points, from its chunks; those too short are dropped.  Positions are running lengths of what lies between the
    matches and of the matches.  Arrays grow by chunks, so that a text of many matches takes no square of them."""
    least = KINDS[kind][3]

    def step(acc: Column, x: Column) -> Column:
        begin = acc["pos"] + F.length(x["between"])
        end = begin + F.length(x["whole"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
        good = x["whole"].isNotNull() & (F.length(x["value"]) >= least)
        return F.struct(F.coalesce(end, begin).alias("pos"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def spans(chunk: Column, begin: Column) -> Column:
        return F.aggregate(chunk, F.struct(begin.alias("pos"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])

    lengths = F.transform(chunked, lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + F.length(x["between"]) + F.coalesce(F.length(x["whole"]), F.lit(0))))
    begins = F.aggregate(lengths, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    found = F.flatten(F.zip_with(chunked, F.slice(begins, F.lit(1), F.size(chunked)), spans))
    return F.when(chunked.isNull(), F.array().cast(SPAN)).otherwise(found)


def with_base(docs: DataFrame, text: Column, keep: dict[str, Column]) -> DataFrame:
    """The columns `keep` and `base`, all kinds' matches by start and kind.  Each step is a column of its own behind an explode, which the optimizer doesn't merge with the next, so that no
    pattern is searched more than once a text."""
    kinds = range(len(KINDS))
    rows = docs.select(*(c.alias(k) for k, c in keep.items()), F.explode(F.array(F.struct(*(pieces(text, k).alias(f"p{k}") for k in kinds)))).alias("pieces"))
    rows = rows.select(*keep, F.explode(F.array(F.struct(*(chunks(F.col(f"pieces.p{k}")).alias(f"c{k}") for k in kinds)))).alias("chunks"))
    return rows.select(*keep, F.array_sort(F.concat(*(spans_of(F.col(f"chunks.c{k}"), k) for k in kinds))).alias("base"))


def _random_looking(value: Column, least: int) -> Column:
    letters = F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return (F.length(value) >= least) & value.rlike("[0-9]") & (letters > 0) & (distinct * 4 >= F.least(F.length(value), F.lit(32))) & ~value.rlike("(?i)example|sample|dummy|changeme|x{4}|placeholder")


def scan(docs: DataFrame, repository: str = "source", owner: str = "source", many_owners: int = 3, least: int = 16, keep_text: bool = False) -> DataFrame:
    """The columns of `docs` (text only with `keep_text`), with base and spans: arrays of (start, kind, end, value), `kind` an index of NAMES, by start and kind.

    `spans` has the base ones and one for each candidate value that the corpus shows to be `copied` (at least `many_owners` distinct
    owners or repositories) or that looks `live` (fewer, at least `least` characters, and random).  Null texts count as empty, null owners as one owner.
    Repeated rows get the same spans and count once.  Very long texts are searched whole, in time that follows their length and their matches.  Null doc_ids are kept.  An empty table gives no rows.
    Columns of `docs` named base or spans are replaced.
    """
    keep = [c for c in docs.columns if c not in ("base", "spans") and (keep_text or c != "text")]
    own = {"row": F.struct(*[F.col(f"`{c}`") for c in keep]), "id": F.monotonically_increasing_id(), "repository": F.col(repository), "owner": F.col(owner)}
    rows = with_base(docs, text_or_empty(), own)
    rows = saved(rows, "secrets")  # each row's id is fixed by the writing
    found = rows.where(F.size("base") > 0).select("id", "repository", "owner", F.explode("base").alias("span")).select("id", "repository", "owner", "span", F.sha2("span.value", 256).alias("value_hash"))
    by = found.groupBy("value_hash", "repository", "owner").agg(F.lit(1).alias("one")).withColumns({"repository": F.coalesce(F.col("repository").cast("string"), F.lit("")), "owner": F.coalesce(F.col("owner").cast("string"), F.lit(""))})
    owners = by.groupBy("value_hash", "owner").agg(F.lit(1).alias("one")).groupBy("value_hash").agg(F.count("*").alias("owners"))
    repositories = by.groupBy("value_hash", "repository").agg(F.lit(1).alias("one")).groupBy("value_hash").agg(F.count("*").alias("repositories"))
    judged = found.join(owners.join(repositories, "value_hash"), "value_hash")
    copied = (F.col("owners") >= many_owners) | (F.col("repositories") >= many_owners)
    verdict = F.when(copied, NAMES.index("copied")).when(_random_looking(F.col("span.value"), least), NAMES.index("live"))
    begin = F.col("span.end") - F.length("span.value")
    added = judged.withColumn("verdict", verdict).where("verdict is not null").select("id", F.struct(begin.alias("start"), F.col("verdict").alias("kind"), F.col("span.end").alias("end"), F.col("span.value").alias("value")).alias("span"))
    added = added.groupBy("id").agg(F.collect_set("span").alias("more"))
    # only rows with candidates are joined, so that the others are not shuffled
    hit = rows.where(F.size("base") > 0).join(added, "id", "left").select("row", "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(SPAN)))).alias("spans"))
    out = hit.union(rows.where(F.size("base") == 0).select("row", "base", F.col("base").alias("spans")))
    return out.select("row.*", "base", "spans")


def joined(spans: str) -> Column:
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def digest(scanned: DataFrame) -> DataFrame:
    kinds = F.transform("base", lambda s: s["kind"])
    n = [F.size(F.filter(kinds, lambda x: x == k)).cast("long").alias(f"n_{name}") for k, (name, *_) in enumerate(KINDS)]
    return scanned.select("doc_id", *n, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redact(text: Column, spans: Column, kind: str = "live", by: str = "[SECRET]") -> Column:
    """`text` with each span of a kind replaced; spans that meet or overlap are replaced once."""
    own = F.filter(spans, lambda s: s["kind"] == NAMES.index(kind))
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] > acc["pos"], F.concat(text.substr(acc["pos"] + 1, s["start"] - acc["pos"]), F.lit(by))).when(acc["pos"] == 0, F.lit(by)).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.concat(acc["out"], gap).alias("out"))

    return F.aggregate(own, start, step, lambda acc: F.concat(acc["out"], text.substr(acc["pos"] + 1, F.length(text))))
