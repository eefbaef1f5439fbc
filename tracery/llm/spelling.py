"""Spelling variant grouping by forward and backward minimal acyclic automata.

Words that differ by one error share a half that holds none.  The words that share a beginning are held in a minimal acyclic automaton, and their
reversals, by ending, in another.  A word walks its first half (last half, in the backward automaton) exactly and
completes the rest with one error.  Each arc knows how many words come before those that go through it, so that the walk adds up to the number of the word
that it ends at: a perfect hash.  A pair whose both halves could hold the error is taken forward alone.

Words are dealt to automata by cells: equal first or last letters.  A cell of too many letters is dealt anew by length and by the whole error-free
half, then by ever smaller windows that the error can lie in, and all that lies outside of them; a window of one letter ends it, with cells
that the alphabet bounds.  So no automaton grows with the corpus, and no pair is lost.
"""

from __future__ import annotations

import os.path
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, text_slices

#: Least code points and occurrences of a word, how much more frequent its form is, and which hashes lose a code point.
LEAST, OCCURS, TIMES, DELETES = 7, 2, 10, 31
#: Code points of words in a cell before it is dealt anew, and in the cells of one automaton together (on average); cells of a few words are never dealt anew, however
#: long these are.
CELL, SHARD, FEW = 400_000, 300_000, 32
#: Distinct words that a task counts before it hands them on.
HELD = 200_000
#: Cells to deal anew that are broadcast; more of them are joined by shuffling, salted.
BROADCAST_ROWS, SALTS = 1_000_000, 16

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _counted(least: int, deletes: int):
    run_of = re.compile(rf"[a-zÀ-ÿ]{{{least},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        full = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        for x in batches:
            ids = x.column(0)
            for first, texts in text_slices(x.column(1)):
                for i, t in enumerate(texts, first):
                    begin = zlib.crc32(f"{ids[i].as_py()}:".encode())
                    for word, n in Counter(map(itemgetter(0), run_of.finditer(t.translate(_LOWER).decode("utf-8", "replace")))).items():
                        h = zlib.crc32(word.encode(), begin)
                        if h % deletes == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least:
                                continue
                        held[word] += n
                if len(held) > HELD:
                    yield full()
                    held.clear()
        yield full()

    return run


def vocabulary(docs: DataFrame, least: int = LEAST, occurs: int = OCCURS, deletes: int = DELETES) -> DataFrame:
    """(word, n): the words of `docs` (doc_id, text) of at least `least` code points and their occurrences, at least `occurs`.

    A word is a maximal run of ASCII and Latin-1 letters (with the two signs in their range), only A-Z lower-cased; where the crc32 of `<doc_id>:<run>`
    is divisible by `deletes`, without one code point.  Runs that are too short can't become words.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_counted(least, deletes), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurs)


class State:
    """`next`: letter -> (state, words that come before those through it); `size`: words from here; `final`: whether one ends here."""

    __slots__ = ("final", "next", "size")

    def __init__(self) -> None:
        self.final, self.next, self.size = False, {}, 0


def automaton(words: list[str]) -> State:
    """The minimal acyclic automaton of distinct words in order: states with equal endings are one."""
    register: dict[tuple, State] = {}
    path, last = [State()], ""

    def close(depth: int) -> None:
        while len(path) > depth:
            s = path.pop()
            before = int(s.final)
            for letter, t in s.next.items():
                s.next[letter] = (t, before)
                before += t.size
            s.size = before
            s = register.setdefault((s.final, *((letter, id(t)) for letter, (t, _) in s.next.items())), s)
            if path:
                path[-1].next[last[len(path) - 1]] = s
            else:
                path.append(s)
                return

    for w in words:
        shared = len(os.path.commonprefix((last, w)))
        close(shared + 1)
        path += [State() for _ in w[shared:]]
        path[-1].final = True
        last = w
    close(0)
    return path[0]


def _number(state: State, before: int, w: str, i: int) -> int:
    """The number of the word that goes on from `state` with w[i:], -1 if there is none."""
    for k in range(i, len(w)):
        arc = state.next.get(w[k])
        if arc is None:
            return -1
        state = arc[0]
        before += arc[1]
    return before if state.final else -1


def completions(root: State, w: str, least: int, most: int) -> list[int]:
    """Numbers of the words one error from `w` that begin as `w` does for at least `least` and at most `most` letters, and no further; each once."""
    out, state, before = [], root, 0
    for i in range(min(most, len(w)) + 1):
        here = w[i] if i < len(w) else ""
        if i >= least:
            if here and w[i + 1 : i + 2] != here:
                out.append(_number(state, before, w, i + 1))  # without w[i]
            for letter, (t, add) in state.next.items():
                if letter != here:
                    out.append(_number(t, before + add, w, i))  # a letter more
                    if here:
                        out.append(_number(t, before + add, w, i + 1))  # another letter
        arc = state.next.get(here)
        if arc is None:
            break
        state, before = arc[0], before + arc[1]
    return [n for n in out if n >= 0]


def _partners(rows: list[tuple[str, int, int, int]], back: bool, n: dict[str, int]) -> Iterator[tuple[str, int, int, str]]:
    """For each row (word, s, lo, hi) of an automaton: how many words are near in its window, and the first of them by occurrences and letters."""
    order = sorted({w[::-1] if back else w for w, *_ in rows})
    root = automaton(order)
    for w, s, lo, hi in rows:
        half, m = len(w) // 2, len(w)
        if back:
            found = [order[i][::-1] for i in completions(root, w[::-1], m - half, m)]
            found = [p for p in found if p[:half] != w[:half]]  # else both halves could hold the error
        else:
            found = [order[i] for i in completions(root, w, max(half, lo), m if hi in (0, s) else hi - 1)]
        if s:
            # the shorter of the two has s letters, and the error lies in the window
            found = [p for p in found if min(m, len(p)) == s]
            if back:
                found = [p for p in found if lo <= len(os.path.commonprefix((w, p))) < hi]
        if found:
            best = min(found, key=lambda p: (-n[p], p))
            yield w, len(found), n[best], best


def _match(t: pa.Table) -> pa.Table:
    word, n, back, s, lo, hi = (t.column(c).to_pylist() for c in ("word", "n", "back", "s", "lo", "hi"))
    rows = list(zip(word, s, lo, hi, strict=True))
    out = list(_partners(rows, bool(back[0]), dict(zip(word, n, strict=True))))
    names, kinds = ("word", "near", "n", "best"), (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.table({c: pa.array([r[i] for r in out], k) for i, (c, k) in enumerate(zip(names, kinds, strict=True))})


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows of (word, n, back, s, lo, hi) with the key of their cell: direction, length, window and all letters outside of it."""
    outside = [F.expr("substring(word, 1, lo)"), F.expr("right(word, s - hi)")]
    return rows.withColumn("key", F.xxhash64("back", "s", "lo", "hi", *outside))


def _coarse(words: DataFrame, shared: int) -> DataFrame:
    rows = words.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("back"), *[F.lit(0).alias(c) for c in ("s", "lo", "hi")])
    end = F.when(F.col("back") == 0, F.substring("word", 1, shared)).otherwise(F.expr(f"right(word, {shared})"))
    return rows.withColumn("key", F.xxhash64("back", end))


def _window(lo: Column, hi: Column, s: Column) -> Column:
    return F.struct(s.cast("int").alias("s"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def _finer(rows: DataFrame, least: int) -> DataFrame:
    """Rows of cells that are too large, in cells with a smaller window."""
    m, s, lo, hi, half = F.length("word"), F.col("s"), F.col("lo"), F.col("hi"), lambda x: F.floor(x / 2)
    fresh = [F.when(F.col("back") == 0, _window(half(x), x, x)).otherwise(_window(F.lit(0), half(x + 1), x)) for x in (m, m - 1)]
    both = [_window(lo, half(lo + hi), s), _window(half(lo + hi), hi, s)]
    dealt = F.when(s == 0, F.array(*fresh)).otherwise(F.array(*both))
    return _keyed(rows.select("word", "n", "back", F.explode(dealt).alias("w")).select("word", "n", "back", "w.*").where(F.col("s") >= least))


def cells(words: DataFrame, least: int = LEAST, cell: int = CELL) -> DataFrame:
    """(word, n, back, s, lo, hi, key): every word in its cells, none of which has more than `cell` code points unless it has FEW words or its window is a single letter."""
    rows, done = _coarse(words, least // 2), []
    while True:
        rows = saved(rows, "cells")
        divisible = (F.col("s") == 0) | (F.col("hi") - F.col("lo") > 1)
        large = saved(rows.where(divisible).groupBy("key").agg(F.sum(F.length("word")).alias("size"), F.count("*").alias("words")).where((F.col("size") > cell) & (F.col("words") > FEW)).select("key"), "large-cells")
        many = large.count()
        if not many:
            done.append(rows)
            break
        if many <= BROADCAST_ROWS:
            large, on = F.broadcast(large), ["key"]
        else:
            rows = rows.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)))
            large, on = large.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["key", "salt"]
        done.append(rows.join(large, on, "left_anti").drop("salt"))
        rows = _finer(rows.join(large, on, "left_semi"), least)
    out = done[0]
    for other in done[1:]:
        out = out.unionByName(other)
    return out


def near_words(words: DataFrame, least: int = LEAST, cell: int = CELL, shard: int = SHARD) -> DataFrame:
    """(word, n_near, best_n, best): of the words (word, n) that have near ones, how many, and the one with the largest n, ties to the smallest."""
    dealt = cells(words, least, cell)
    size = dealt.agg(F.sum(F.length("word"))).first()[0] or 0
    dealt = dealt.withColumn("shard", F.pmod("key", F.lit(size // (2 * shard) + 1)))
    found = dealt.groupBy("back", "shard").applyInArrow(_match, "word string, near long, n long, best string")
    best = F.min(F.struct((-F.col("n")).alias("n"), "best"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), "b.best")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): form after form up to the last.  A form is many times as frequent as its word, so there are as many steps as the largest count
    has digits at most."""
    step = forms.select(F.col("word").alias("at"), F.col("form").alias("next"))
    rows = forms.select("word", F.col("form").alias("at"))
    done = []
    while True:
        rows = saved(rows.join(step, "at", "left"), "roots")
        done.append(rows.where("next is null").select("word", F.col("at").alias("root")))
        rows = rows.where("next is not null").select("word", F.col("next").alias("at"))
        if not rows.limit(1).count():
            break
    out = done[0]
    for other in done[1:]:
        out = out.union(other)
    return out


def variants(docs: DataFrame, least: int = LEAST, occurs: int = OCCURS, times: int = TIMES, deletes: int = DELETES, cell: int = CELL, shard: int = SHARD) -> DataFrame:
    """A row for each word of `docs` (see `vocabulary`): word, form, root, n, n_near, form_n.

    Near words differ by exactly one inserted, deleted or replaced code point.  The form is the near word with the largest n (ties: the smallest in code-point order), if that is
    at least `times` the word's own, else null; the root is where the forms end.  Null texts have no words, null doc_ids count as an empty id, repeated rows as
    occurrences of their own.  Very long texts are read whole.  An empty table gives no rows.  Other columns are ignored.
    """
    words = saved(vocabulary(docs, least, occurs, deletes), "words")
    near = near_words(words, least, cell, shard)
    good = F.col("best_n") >= times * F.col("n")
    near = words.join(near, "word", "left").select("word", F.when(good, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best_n")).alias("form_n"))
    near = saved(near, "near")
    ends = roots(near.where("form is not null").select("word", "form"))
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
