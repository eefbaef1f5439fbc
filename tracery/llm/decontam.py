"""Benchmark decontamination with an FM-index for each training shard.

A shard is a bounded number of symbols from the documents of an Arrow batch.  Words become symbols of the benchmark's own
vocabulary; every other word is one separator symbol, and runs of known words too short to hold any window are left out, as no
window can occur there.  The index over what remains (suffix order, Burrows-Wheeler transform in a wavelet matrix, sampled suffix
positions) is searched backwards for all windows at once; occurrences are located by walking to the next sampled position and merged
to spans.  A benchmark is searched block by block: each block reads the documents with what the blocks before it found, and adds to
it in the same row, so that nothing is shuffled and the driver holds one block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, text_slices

#: Text of one block of the benchmark (and 64 bytes an item); its windows take some twenty times as much while they are made.
BLOCK_BYTES = 2 << 20
#: Symbols of one index, and bytes of text that are cut into words at a time.
SHARD_SYMBOLS, PIECE_BYTES = 1 << 18, 1 << 20
SAMPLE = 16
END, GAP = 0, 1

#: A-Z lower-cased, and everything but 0-9, a-z and non-ASCII made a space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


def symbols(text: bytes, vocabulary: dict[bytes, int]) -> np.ndarray:
    """The words of a text as symbols.  Long texts are cut into words piece by piece, so that their words are never all objects."""
    t, out, lo = text.translate(_WORDS), [], 0
    while lo < len(t):
        hi = len(t) if len(t) - lo <= PIECE_BYTES else t.find(b" ", lo + PIECE_BYTES)
        hi = hi if hi >= 0 else len(t)
        words = t[lo:hi].split()
        out.append(np.fromiter((vocabulary.get(w, GAP) for w in words), np.int32, len(words)))
        lo = hi
    return np.concatenate(out) if out else np.empty(0, np.int32)


class Windows:
    """The distinct windows of a block of items, by length, and the items of each.  A window is a place in the items' joined symbols."""

    def __init__(self, items: list[tuple[str, str | None]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        of, seqs = [], []
        for item, text in items:
            words = split_words(text)
            if words:
                of.append(item)
                seqs.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words], np.int32))
        self.names = sorted(set(of))
        at = {x: i for i, x in enumerate(self.names)}
        owner, sizes = np.array([at[x] for x in of], np.int64), np.array([len(s) for s in seqs], np.int64)
        self.joined = np.concatenate(seqs) if seqs else np.empty(0, np.int32)
        begin, least = np.cumsum(sizes) - sizes, np.minimum(sizes, width)
        self.shortest, self.longest = int(least.min(initial=width)), int(least.max(initial=0))
        self.by_length: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for n in np.unique(least).tolist():
            own = np.flatnonzero(least == n)
            counts = sizes[own] - n + 1
            starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begin[own], counts)
            rows = np.ascontiguousarray(self.patterns(n, starts))
            _, first, same = np.unique(rows.view(np.dtype((np.void, rows.itemsize * n))).ravel(), return_index=True, return_inverse=True)
            pairs = np.unique(same * len(self.names) + np.repeat(owner[own], counts))
            self.by_length.append((n, starts[first], np.searchsorted(pairs // len(self.names), np.arange(len(first) + 1)), pairs % len(self.names)))

    def patterns(self, n: int, starts: np.ndarray) -> np.ndarray:
        return self.joined[starts[:, None] + np.arange(n)]


def suffix_order(t: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; `t` ends with a symbol of its own."""
    rank, k, n = t.astype(np.int64), 1, len(t)
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - k)] = rank[k:] + 1
        key = rank * (max(n, int(rank.max())) + 2) + after
        sa = np.argsort(key, kind="stable")
        key = key[sa]
        rank = np.empty(n, np.int64)
        rank[sa] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        if rank[sa[-1]] == n - 1:
            return sa
        k *= 2


class FMIndex:
    """Backward search and location over a symbol array that ends with END."""

    def __init__(self, t: np.ndarray):
        sa = suffix_order(t)
        self.bits = max(1, int(t.max()).bit_length())
        bwt = t[sa - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=1 << self.bits))])
        self.ranks, self.zeros, level = [], [], bwt
        for b in reversed(range(self.bits)):
            one = (level >> b) & 1
            self.ranks.append(np.concatenate([[0], np.cumsum(one)]).astype(np.int64))
            self.zeros.append(len(t) - int(self.ranks[-1][-1]))
            level = np.concatenate([level[one == 0], level[one == 1]])
        kept = sa % SAMPLE == 0
        self.sampled, self.sample_rank, self.samples = kept, np.concatenate([[0], np.cumsum(kept)]), sa[kept]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c is among the first i symbols of the transform."""
        start = np.zeros_like(i)
        for ones, zeros, b in zip(self.ranks, self.zeros, reversed(range(self.bits)), strict=True):
            up, r, s = (c >> b) & 1 == 1, ones[i], ones[start]
            i, start = np.where(up, zeros + r, i - r), np.where(up, zeros + s, start - s)
        return i - start

    def symbol(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros_like(i)
        for ones, zeros in zip(self.ranks, self.zeros, strict=True):
            up = ones[i + 1] - ones[i]
            c = 2 * c + up
            i = np.where(up == 1, zeros + ones[i], i - ones[i])
        return c

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffix order that begin with each pattern."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.sampled), np.int64)
        at = np.arange(len(patterns))
        for j in reversed(range(patterns.shape[1])):
            c = patterns[at, j]
            known = c < 1 << self.bits
            lo[at[~known]] = hi[at[~known]] = 0
            at, c = at[known], c[known]
            lo[at], hi[at] = self.first[c] + self.rank(c, lo[at]), self.first[c] + self.rank(c, hi[at])
            at = at[lo[at] < hi[at]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix order."""
        out, rows, steps = np.empty(len(rows), np.int64), rows.copy(), 0
        at = np.arange(len(rows))
        while len(at):
            there = self.sampled[rows]
            out[at[there]] = self.samples[self.sample_rank[rows[there]]] + steps
            at, rows = at[~there], rows[~there]
            c = self.symbol(rows)
            rows, steps = self.first[c] + self.rank(c, rows), steps + 1
        return out


def find_windows(docs: list[np.ndarray], windows: Windows, shard: int = SHARD_SYMBOLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the symbols of some documents: first word of each document among all (one more at the end), whether each word is hit, and
    the distinct pairs (document, item) as document * number of items + item.

    Runs of known words are indexed in shards of about `shard` symbols.  A longer run is cut into pieces that overlap by one word less than the longest
    window, so that each occurrence lies whole in some piece.
    """
    begin = np.cumsum([0, *map(len, docs)])
    s = np.concatenate(docs) if docs else np.empty(0, np.int32)
    hit, pairs = np.zeros(len(s) + 1, np.int64), [np.empty(0, np.int64)]
    # runs of known words within a document
    known = np.concatenate([[False], s != GAP, [False]])
    edge = np.flatnonzero(known[1:] != known[:-1])
    cuts = np.unique(np.concatenate([edge, begin[(begin > 0) & (begin < len(s))]])) if len(s) else edge
    starts, ends = cuts[:-1], cuts[1:]
    enough = (s[starts] != GAP) & (ends - starts >= windows.shortest) if len(starts) else np.empty(0, bool)
    starts, ends = starts[enough], ends[enough]
    step = shard + max(0, windows.longest - 1)
    if (ends - starts > step).any():
        pieces = [(a, min(int(e), a + step)) for b, e in zip(starts.tolist(), ends.tolist(), strict=True) for a in range(b, max(b + 1, int(e) - step + shard), shard)]
        starts, ends = np.array(pieces, np.int64).T
    of = np.cumsum(ends - starts + 1) // shard
    for k in np.unique(of):
        _search_shard(s, begin, starts[of == k], ends[of == k], windows, hit, pairs)
    return begin, np.cumsum(hit[:-1]) > 0, np.unique(np.concatenate(pairs))


def _search_shard(s: np.ndarray, begin: np.ndarray, starts: np.ndarray, ends: np.ndarray, windows: Windows, hit: np.ndarray, pairs: list[np.ndarray]) -> None:
    sizes = ends - starts + 1
    to = np.concatenate([[0], np.cumsum(sizes)])
    where = np.arange(to[-1]) - np.repeat(to[:-1], sizes) + np.repeat(starts, sizes)
    t = s[np.minimum(where, len(s) - 1)].astype(np.int64)
    t[to[1:] - 1] = GAP
    index = FMIndex(np.append(t, END))
    document = np.searchsorted(begin, starts, "right") - 1
    n_items = max(1, len(windows.names))
    for n, places, first, owners in windows.by_length:
        lo, hi = index.search(windows.patterns(n, places).astype(np.int64))
        for k in range(0, len(lo), 4096):  # bounds the occurrences held at a time
            a, b = lo[k : k + 4096], hi[k : k + 4096]
            counts = b - a
            which = np.repeat(np.arange(len(a)), counts)
            rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(a, counts)
            at = index.locate(rows)
            np.add.at(hit, where[at], 1)
            np.add.at(hit, where[at] + n, -1)
            doc = document[np.searchsorted(to, at, "right") - 1]
            own = first[k + which + 1] - first[k + which]
            item = owners[np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(first[k + which], own)]
            pairs.append(np.unique(np.repeat(doc, own) * n_items + item))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _search(windows: Windows, text_at: int, keep: list[int], old: tuple[int, int] | None, names: list[str]):
    """`keep`: positions of the columns to hand on; `old`: those of spans and items found by earlier blocks."""

    def one(x: pa.RecordBatch, held: list[bytes]) -> pa.RecordBatch:
        begin, hit, pairs = find_windows([symbols(t, windows.vocabulary) for t in held], windows)
        n_items = max(1, len(windows.names))
        items: list[set[str]] = [set() for _ in held]
        for p in pairs.tolist():
            items[p // n_items].add(windows.names[p % n_items])
        edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        inner = np.zeros(len(edge), bool)
        inner[1:-1] = hit[1:] & hit[:-1] if len(hit) else inner[1:-1]
        doc_cut = begin[1:-1][inner[begin[1:-1]]] if len(hit) else begin[:0]  # spans that meet at a document's end
        doc_cut = np.unique(doc_cut)
        starts = np.sort(np.concatenate([np.flatnonzero(edge == 1), doc_cut]))
        ends = np.sort(np.concatenate([np.flatnonzero(edge == -1), doc_cut]))
        document = np.searchsorted(begin, starts, "right") - 1
        spans: list[list[tuple[int, int]]] = [[] for _ in held]
        for d, a, b in zip(document.tolist(), starts.tolist(), ends.tolist(), strict=True):
            spans[d].append((a - int(begin[d]), b - int(begin[d])))
        if old:
            for d, (was, had) in enumerate(zip(x.column(old[0]).to_pylist(), x.column(old[1]).to_pylist(), strict=True)):
                if was:
                    spans[d] = merged([*spans[d], *((r["start"], r["end"]) for r in was)])
                    items[d].update(had)
        out = [pa.array(np.diff(begin), pa.int64()), pa.array([[{"start": a, "end": b} for a, b in r] for r in spans], _SPANS), pa.array([sorted(i) for i in items], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([*(x.column(i) for i in keep), *out], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for first, held in text_slices(x.column(text_at)):
                yield one(x.slice(first, len(held)), held)

    return run


FOUND = ("n_words", "spans", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, carry: list[str] | None = None, block_bytes: int | None = None) -> DataFrame:
    """The columns of `docs` (of these, `carry` if given) and n_words, spans (array of {start, end}: merged word ranges inside occurrences of windows) and items
    (sorted distinct item_ids, as strings, with an occurring window).

    A window is `width` consecutive words of an item, or a whole shorter item.  Null and empty texts have no words, no spans, no
    items; so do items.  Null item_ids are left out; rows of one item_id share it.  Repeated documents are judged each by itself.  Very long
    texts are searched whole, in shards.  Columns of `docs` with the new names are replaced; others may be of any type.  An empty table on either side gives no spans.

    The benchmark is a stated query set: `block_bytes` (BLOCK_BYTES) of its text are sent to the tasks at a time, and further blocks go over
    what the block before has written.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = -(-size // (block_bytes or BLOCK_BYTES)) or 1
    kept = [c for c in docs.columns if c not in FOUND and (carry is None or c in carry)]
    fields = {f.name: f for f in docs.schema.fields}
    found = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, "text"])])
    new = T.StructType.fromDDL("n_words long, spans array<struct<start: long, end: long>>, items array<string>").fields
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        windows = Windows([tuple(r) for r in block.distinct().toLocalIterator()], width)
        handed = kept if k == blocks - 1 else list(dict.fromkeys([*kept, "text"]))
        at = found.columns.index
        old = (at("spans"), at("items")) if k else None
        schema = T.StructType([*(fields[c] for c in handed), *new])
        found = found.mapInArrow(_search(windows, at("text"), [at(c) for c in handed], old, [*handed, *FOUND]), schema)
        if k < blocks - 1:
            found = saved(found, "block")
    return found


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
