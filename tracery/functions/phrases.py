"""Phrases of a dictionary in texts, by an Aho-Corasick automaton that a task builds once and that reads each text once, however many phrases there are."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of phrases in one automaton, which is sent to all tasks; a larger dictionary is searched part by part.
MOST_CHARS = 8_000_000

_built: dict[str, ahocorasick.Automaton | None] = {}


def _automaton(phrases: list[tuple[str, str]], name: str) -> ahocorasick.Automaton | None:
    """phrase -> its place in `phrases`; one is kept for each worker.  None without any phrase."""
    if name not in _built:
        _built.clear()
        a = ahocorasick.Automaton()
        for i, (p, _) in enumerate(phrases):
            if p:
                a.add_word(p, i)
        if len(a):
            a.make_automaton()
        _built[name] = a if len(a) else None
    return _built[name]


def _places(text: object, a: ahocorasick.Automaton | None) -> list[int]:
    return sorted({i for _, i in a.iter(text)}) if a is not None and isinstance(text, str) else []


def phrase_tokens(text: Column, phrases: dict[str, str]) -> Column:
    """The tokens of the phrases (phrase: token) that a text holds anywhere, distinct, in the dictionary's order; null and empty texts hold none, and an empty phrase is in no text.
    For dictionaries of up to MOST_CHARS; larger ones are a table's matter (`phrase_hits`)."""
    known = list(phrases.items())
    if sum(len(p) for p in phrases) > MOST_CHARS:
        raise ValueError(f"over {MOST_CHARS} characters of phrases: use phrase_hits")
    name = hashlib.sha256(repr(known).encode()).hexdigest()

    def run(t: pd.Series) -> pd.Series:
        a = _automaton(known, name)
        return t.map(lambda x: list(dict.fromkeys(known[i][1] for i in _places(x, a))))

    return F.pandas_udf(run, "array<string>")(text)


def phrase_hits(texts: DataFrame, key: str, phrases: DataFrame, text: str = "text", most: int = MOST_CHARS) -> DataFrame:
    """(key, phrase, token), each phrase once a row of `texts` that holds it; `phrases` has distinct (phrase, token).

    The dictionary is dealt into parts of about `most` characters by a hash, and each part is one automaton: no size is too large, and none is sent out unchecked.
    """
    n = (phrases.agg(F.coalesce(F.sum(F.length("phrase")), F.lit(0))).first()[0] or 0) // most + 1
    kind = texts.schema[key].dataType.simpleString()
    out = None
    for part in range(n):
        own = phrases.where(F.pmod(F.xxhash64("phrase"), F.lit(n)) == part).select("phrase", "token").orderBy("phrase", "token")
        known = [(r["phrase"] or "", r["token"]) for r in own.toLocalIterator()]
        name = hashlib.sha256(repr(known).encode()).hexdigest()
        sent = texts.sparkSession.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            a = _automaton(sent.value, name)
            for x in batches:
                at, hits = [], []
                for i, t in enumerate(x.column(1)):
                    own = _places(t.as_py(), a)
                    at += [i] * len(own)
                    hits += own
                yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(at, pa.int64())), *(pa.array([sent.value[i][k] for i in hits], pa.string()) for k in (0, 1))], names=[key, "phrase", "token"])

        found = texts.select(key, text).mapInArrow(run, f"`{key}` {kind}, phrase string, token string")
        out = found if out is None else out.union(found)
    return out
