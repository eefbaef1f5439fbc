"""Verdicts of several raters: votes, stars, the cap by who answered, second rounds, and the content-addressed cache."""

from __future__ import annotations

import queue
import threading
import time
from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VERDICT = "case_id string, provider string, provider_ord int, status string, analysis string, confidence double"
_VERDICT = ["case_id", "provider", "provider_ord", "status", "analysis", "confidence"]
STATUSES = ("covered", "inconsistent", "needs_review", "error")


class Rater(Protocol):
    """Judges one prompt; raises on failure."""

    def __call__(self, provider: str, prompt: str) -> tuple[str, str, float]: ...


def stub_rater(provider: str, prompt: str) -> tuple[str, str, float]:
    """Deterministic: the status follows a checksum of the provider and the prompt."""
    import zlib

    n = zlib.crc32(f"{provider}|{prompt}".encode())
    return STATUSES[n % 3], f"checksum {n}", (n % 100) / 100


class BadOutput(ValueError):
    """An answer that can't be read."""


def error_class(error: BaseException) -> str:
    """auth, timeout, rate_limit, connection, bad_output or other."""
    name, text = type(error).__name__.lower(), str(error).lower()
    if isinstance(error, BadOutput) or "jsondecode" in name:
        return "bad_output"
    if "auth" in name or "401" in text or "403" in text:
        return "auth"
    return "timeout" if "timeout" in name or "timed out" in text else "rate_limit" if "429" in text else "connection" if "connect" in name else "other"


class Breaker:
    """Opens after `most` failures in a row, or at once on an auth failure, and closes again after `ttl` seconds."""

    def __init__(self, most: int = 3, ttl: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.most, self.ttl, self.clock, self.failures, self.opened = most, ttl, clock, 0, None

    def open(self) -> bool:
        if self.opened is not None and self.clock() - self.opened >= self.ttl:
            self.failures, self.opened = 0, None
        return self.opened is not None

    def record(self, error: str | None) -> None:
        self.failures = self.failures + 1 if error else 0
        if error == "auth" or self.failures >= self.most:
            self.opened = self.clock()


#: Seconds that a case's raters have in all, those that the others have once so many have given a valid verdict, and those that late answers are waited for in the end.
CEILING, GRACE, QUORUM, DRAIN = 300.0, 120.0, 2, 60.0
#: Calls at a time, and cases under way, in a task.
CALLS, CASES = 12, 64
Verdict = tuple[str, str, float]


class Calls:
    """At most `most` calls at a time, each on a thread of its own that a call that hangs keeps to itself; answers come back through one queue."""

    def __init__(self, most: int = CALLS):
        self.most, self.waiting, self.running, self.back = most, deque(), set(), queue.Queue()

    def add(self, key: object, call: Callable[[], Verdict]) -> None:
        self.waiting.append((key, call))
        self._fill()

    def given_up(self, key: object) -> None:
        """A call that is too late frees its place; where it hasn't begun, it never does."""
        self.running.discard(key)
        self.waiting = deque(x for x in self.waiting if x[0] != key)
        self._fill()

    def _fill(self) -> None:
        while self.waiting and len(self.running) < self.most:
            key, call = self.waiting.popleft()
            self.running.add(key)
            threading.Thread(target=lambda key=key, call=call: self.back.put((key, call())), daemon=True).start()

    def next(self, seconds: float) -> tuple[object, Verdict] | None:
        try:
            key, answer = self.back.get(timeout=max(0.0, seconds))
        except queue.Empty:
            return None
        self.running.discard(key)
        self._fill()
        return key, answer


def asked(cases: Iterator[tuple[object, list[tuple[str, Callable[[], Verdict]]]]], ceiling: float = CEILING, grace: float = GRACE, quorum: int = QUORUM, drain: float = DRAIN, calls: int = CALLS, open_cases: int = CASES, late: Callable[[str], None] = lambda _: None) -> Iterator[tuple[object, str, Verdict]]:
    """(case, provider, verdict) of cases (case, [(provider, call)]), in the order of the answers.

    The calls of many cases share one bounded set of threads.  A case has `ceiling` seconds from when it is taken up, and `grace` more once `quorum` valid verdicts are there; then its place goes to the
    next one, and `late` is told of each provider that isn't back.  Such an answer is still waited for until `drain` seconds after the last case: if it comes, it counts, and nobody is asked twice; else
    the verdict is an error.  Rows wait for it only in number of late answers.
    """
    pool, cases, under_way, owed = Calls(calls), iter(cases), {}, {}
    more, end = True, None

    def close(case: object, now: float) -> None:
        for provider in under_way.pop(case)["open"]:
            late(provider)
            owed[case, provider] = now
            pool.given_up((case, provider))

    while True:
        while more and len(under_way) < open_cases:
            taken = next(cases, None)
            if taken is None:
                more = False
                break
            case, own = taken
            under_way[case] = {"until": time.monotonic() + ceiling, "valid": 0, "open": {p for p, _ in own}}
            for provider, call in own:
                pool.add((case, provider), call)
        now = time.monotonic()
        for case in [c for c, x in under_way.items() if x["until"] <= now or not x["open"]]:
            close(case, now)
        if not under_way and not more:
            end = end or now + drain
            if not owed or now >= end:
                break
        soonest = min([x["until"] for x in under_way.values()] or [end or now])
        got = pool.next(min(soonest - now, 1.0))
        if got is None:
            continue
        (case, provider), answer = got
        if case in under_way and provider in under_way[case]["open"]:
            x = under_way[case]
            x["open"].discard(provider)
            x["valid"] += answer[0] != "error"
            if x["valid"] == quorum:
                x["until"] = min(x["until"], time.monotonic() + grace)
        elif owed.pop((case, provider), None) is None:
            continue
        yield case, provider, answer
    for case, provider in owed:
        yield case, provider, ("error", "timeout", 0.0)


def judged(cases: DataFrame, providers: DataFrame, rater: Rater = stub_rater, **limits: float) -> DataFrame:
    """A verdict for each case (case_id, prompt) and provider (provider, provider_ord); see `judged_rows`."""
    return judged_rows(cases.select("case_id", "prompt").crossJoin(F.broadcast(providers.select("provider", "provider_ord"))), rater, **limits)


def judged_rows(asked_rows: DataFrame, rater: Rater = stub_rater, attempts: int = 3, ceiling: float = CEILING, grace: float = GRACE, drain: float = DRAIN, calls: int = CALLS) -> DataFrame:
    """A verdict for each row (case_id, provider, provider_ord, prompt).  A case is gathered with all of its raters before the calls, so no batch parts them, and the cases of a task are asked side by
    side (see `asked`).  A rater that fails `attempts` times gives an error verdict, never an exception; a breaker for each provider and partition skips calls that would fail anyway.  A late answer
    counts while its task lasts.  Write the result before using it: raters need not be repeatable."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        breakers: dict[str, Breaker] = defaultdict(Breaker)

        def ask(provider: str, prompt: str) -> Verdict:
            b, out = breakers[provider], ("error", "breaker open", 0.0)
            for _ in range(attempts):
                if b.open():
                    break
                try:
                    out = rater(provider, prompt)
                    b.record(None)
                    break
                except Exception as e:  # a rater may fail in any way
                    kind = error_class(e)
                    b.record(kind)
                    out = ("error", kind, 0.0)
            return out

        about: dict[int, tuple[str, dict[str, int]]] = {}

        def one_by_one() -> Iterator[tuple[int, list[tuple[str, Callable[[], Verdict]]]]]:
            for x in batches:
                for case, own in zip(x["case_id"], x["own"], strict=True):
                    n = len(about)
                    about[n] = (case, {r["provider"]: r["provider_ord"] for r in own})
                    yield n, [(r["provider"], lambda p=r["provider"], t=r["prompt"]: ask(p, t)) for r in own]

        rows = []
        for n, provider, verdict in asked(one_by_one(), ceiling, grace, QUORUM, drain, calls, CASES, lambda p: breakers[p].record("timeout")):
            case, order = about[n]
            rows.append((case, provider, order[provider], *verdict))
            if len(rows) == 1000:
                yield pd.DataFrame(rows, columns=_VERDICT)
                rows = []
        yield pd.DataFrame(rows, columns=_VERDICT)

    own = F.sort_array(F.collect_list(F.struct("provider_ord", "provider", "prompt"))).alias("own")
    return asked_rows.groupBy("case_id").agg(own).mapInPandas(run, VERDICT)


def annotated(requests: DataFrame, cache: DataFrame, annotator: Callable[[str], str]) -> DataFrame:
    """(key, payload) for requests (key, content): cached payloads, and a new one from the annotator for the others; one that fails gives an empty payload, which `worth_keeping`
    leaves out of the cache.  Write the result before using it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for c in x["content"]:
                try:
                    out.append(annotator(c))
                except Exception:  # an annotator may fail in any way
                    out.append("")
            yield pd.DataFrame({"key": x["key"], "payload": out})

    new = to_do(requests, cache).select("key", "content").mapInPandas(run, "key string, payload string")
    return reused(requests, cache).select("key", "payload").union(new)


def worth_keeping(annotations: DataFrame) -> DataFrame:
    return annotations.where("payload <> ''")


def reviewed(blocks: DataFrame, reviewer: Callable[[str, list[str]], tuple[str, list[str], list[str]]]) -> DataFrame:
    """(block_key, verdict, matched_ids, rejected_ids) of blocks (block_key, matched); a reviewer that fails gives unconfirmed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for key, ids in zip(x["block_key"], x["matched"], strict=True):
                try:
                    rows.append((key, *reviewer(key, list(ids))))
                except Exception:  # a reviewer may fail in any way
                    rows.append((key, "unconfirmed", [], []))
            yield pd.DataFrame(rows, columns=["block_key", "verdict", "matched_ids", "rejected_ids"])

    return blocks.select("block_key", "matched").mapInPandas(run, "block_key string, verdict string, matched_ids array<string>, rejected_ids array<string>")


def append_cache(rows: DataFrame, folder: str) -> None:
    """New cache rows (key, payload, ord), one JSON line each; a key that is there again overrides by its `ord`."""
    rows.write.mode("append").json(folder)


def majority(verdicts: DataFrame) -> DataFrame:
    """(case_id, status, votes): the most frequent status; ties go to the one whose rater comes first."""
    n = verdicts.groupBy("case_id", "status").agg(F.count("*").alias("votes"), F.min("provider_ord").alias("first"))
    rn = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("votes"), "first"))
    return n.withColumn("rn", rn).where("rn = 1").select("case_id", "status", "votes")


def agreement(verdicts: DataFrame) -> DataFrame:
    """(case_id, agreement, alive): full, majority or split over the verdicts that are no errors."""
    n = verdicts.where("status <> 'error'").groupBy("case_id", "status").agg(F.count("*").alias("n")).groupBy("case_id").agg(F.max("n").alias("most"), F.sum("n").alias("alive"))
    every = verdicts.select("case_id").distinct().join(n, "case_id", "left")
    level = F.when(F.col("most") == F.col("alive"), "full").when(2 * F.col("most") > F.col("alive"), "majority").otherwise("split")
    return every.select("case_id", level.alias("agreement"), F.coalesce("alive", F.lit(0)).alias("alive"))


def stars(level: Column, disagreements: Column) -> Column:
    """5 to 1 from the agreement and the categories of the disagreements (key, non_key, vague)."""
    key = F.array_contains(disagreements, "key")
    return F.when(level == "full", F.when(F.size(disagreements) == 0, 5).otherwise(4)).when(level == "majority", F.when(key, 2).otherwise(3)).otherwise(1)


def disagreements(verdicts: DataFrame) -> DataFrame:
    """(case_id, disagreements): what the verdicts that are no errors differ in: `key` where one says covered and another inconsistent, `vague` where some only ask for a review."""
    said = F.collect_set(F.when(F.col("status") != "error", F.col("status")))
    has = lambda *s: F.size(F.array_intersect("said", F.array(*map(F.lit, s)))) == len(s)
    kinds = F.array(F.when(has("covered", "inconsistent"), F.lit("key")), F.when(has("needs_review") & (F.size("said") > 1), F.lit("vague")))
    return verdicts.groupBy("case_id").agg(said.alias("said")).select("case_id", F.array_compact(kinds).alias("disagreements"))


def capped(consensus: DataFrame) -> DataFrame:
    """`stars`, `agreement` and `review` after a cap by how many raters are alive: none, one and two allow 1, 1 and 2 stars."""
    most = F.when(F.col("alive") <= 1, 1).when(F.col("alive") == 2, 2).otherwise(5)
    level = F.when(F.col("alive") == 0, "no_consensus").when(F.col("alive") == 1, "single_source").otherwise(F.col("agreement"))
    return consensus.withColumns({"stars": F.least("stars", most), "agreement": level, "review": F.col("alive") == 0})


def second_round(consensus: DataFrame, verdicts: DataFrame, most: int = 2) -> DataFrame:
    """(case_id, provider, peers): for cases of at most `most` stars, each rater's peers and what they said; errors are left out."""
    low = verdicts.join(consensus.where(F.col("stars") <= most).select("case_id"), "case_id", "left_semi")
    a, b = low.select("case_id", "provider"), low.where("status <> 'error'").select("case_id", F.col("provider").alias("peer"), "provider_ord", "status")
    j = a.join(b, "case_id").where("peer <> provider")
    return j.groupBy("case_id", "provider").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("provider_ord", F.concat_ws("=", "peer", "status").alias("said")))), lambda x: x["said"]), ";").alias("peers"))


def replaced(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of `first` but for the cases that `second` has."""
    return first.join(second.select("case_id").distinct(), "case_id", "left_anti").unionByName(second)


def patched(verdicts: DataFrame, late: DataFrame) -> DataFrame:
    """Late verdicts (case_id, provider, status) in place of error ones; nothing else changes."""
    j = verdicts.join(late.select("case_id", "provider", F.col("status").alias("late")), ["case_id", "provider"], "left")
    return j.withColumn("status", F.when((F.col("status") == "error") & F.col("late").isNotNull(), F.col("late")).otherwise(F.col("status"))).drop("late")


def alive_providers(verdicts: DataFrame) -> DataFrame:
    return verdicts.where("status <> 'error'").select("provider").distinct()


def distribution(df: DataFrame, column: str, values: list) -> DataFrame:
    """(value, n) with every one of `values`, zeros too."""
    dim = df.sparkSession.createDataFrame([(str(v),) for v in values], "value string")
    n = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    return dim.join(n, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def average_stars(consensus: DataFrame) -> DataFrame:
    """The average, rounded half-even to two places."""
    return consensus.agg(F.bround(F.avg("stars"), 2).alias("average"))


def cache_key(kind: Column, provider: Column, model: Column, params: Column, prompt: Column, version: str = "1") -> Column:
    """The sha256 of the canonical JSON of all that an answer depends on."""
    return F.sha2(F.to_json(F.struct(F.lit(version).alias("version"), kind.alias("kind"), provider.alias("provider"), model.alias("model"), params.alias("params"), prompt.alias("prompt"))), 256)


def to_do(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return requests.join(cache.select("key").distinct(), "key", "left_anti")


def reused(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached answers of the requests; of several rows of a key the last written (`ord`) counts."""
    last = cache.groupBy("key").agg(F.max_by("payload", "ord").alias("payload"))
    return requests.join(last, "key")


def reuse_counts(requests: DataFrame, cache: DataFrame) -> DataFrame:
    known = cache.select("key").distinct().withColumn("hit", F.lit(1))
    return requests.join(known, "key", "left").agg(F.count("hit").alias("reused"), F.count_if(F.col("hit").isNull()).alias("rerun"))
