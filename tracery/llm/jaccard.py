"""Exact Jaccard join of documents on word shingles, with signature trees.

How the work is dealt out.  Shingles become 64-bit hashes.  In any order of tokens, two sets that link share at least l of their first
n - ceil(t*n) + l tokens each (the l-prefix lemma).  The order here is rare first, so that passages which many documents share play no part:

1. `features`     each document's set size and a 128-bit key of its set, and, from the same pass, how often the tokens of each of 2**20 cells
                  occur in all sets.  The sums are a megabyte at any size of the corpus; a coarse order costs candidates, never links.
2. `_postings`    prefix tokens, l being an eighth of the set, packed by hash bucket; a bucket's task counts for each document the tokens that it shares with
                  documents of compatible sizes.  Documents that share fewer than l in all link with nothing.  What survives is a small part.
3. blocks         among the survivors, the documents that share a token of the prefix for l = 1 are chained, each document with one edge, and
                  the chains closed to connected components; no link leaves a block.
4. `tree_links`   a block's distinct sets, dealt into cells of bounded size, are joined by dual traversal of signature trees.
                  Large blocks: each cell also sees the block's pivot; members that are linked with it form one component, and
                  only cells of the others are met by members that share l tokens of their prefixes with them: chance tokens chain
                  much of a large corpus, and single ones would send each text to most cells of its block.
5. components     of the links found.  Links inside what is already one component are skipped, so a group of g near copies
                  costs about g verified links instead of g*g/2.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, mix, saved, slices, text_or_empty, text_slices, word_table
from .components import connected, forest

WHITE = word_table(b" \t\n\x0b\x0c\r")
_A_TO_Z = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_M = np.uint64(0xD6E8FEB86659FD93)
#: A token that a part of a batch holds more often than this is thinned out before the shuffle.
HOT_IN_BATCH = 16
#: More doc_ids than this (32 bytes each) are joined by a shuffle, not by a broadcast.
BROADCAST_ROWS = 2_000_000
ANY_BAND = 10_000


def shingle_sets(texts: list[str | None] | pa.Array, words: int = 5) -> Iterator[np.ndarray]:
    """For each text, its sorted distinct shingle hashes; fewer words than `words` make one shingle, no words none."""
    for _, held in slices(texts) if isinstance(texts, list) else text_slices(texts):
        h, first = hashed_words([t.translate(_A_TO_Z) for t in held], WHITE)
        rolled = np.zeros(max(0, len(h) - words + 1), np.uint64)
        for j in range(words):
            rolled = rolled * _M + h[j : j + len(rolled)]
        rolled = mix(rolled)
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if hi - lo >= words:
                yield np.unique(rolled[lo : hi - words + 1])
            elif hi > lo:
                s = np.uint64(hi - lo)
                for x in h[lo:hi]:
                    s = np.multiply(s, _M, dtype=np.uint64) + x
                yield mix(np.array([s], np.uint64))
            else:
                yield np.empty(0, np.uint64)


def prefix_length(n: int, percent: int, edges: bool) -> int:
    """Of two sets that link, each has so many of its first tokens that l of them are the other's, in any order that is the same for both; l is 1 for edges, else an eighth of n."""
    return min(n, n - -(-percent * n // 100) + (1 if edges else -(-n // 8)))


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


KNOWN = "doc_id long, n_shingles long, set_key binary, part int, counts binary"
#: The frequency sketch is sent about in so many parts.
PARTS = 16


def _features(words: int, bits: int):
    """A row for each document, and at a task's end its part of the frequency sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        counts = np.zeros(1 << bits, np.int64)
        rows = lambda ids, n, keys, parts, packed: pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(parts, pa.int32()), pa.array(packed, pa.binary())], names=_names(KNOWN))
        for x in batches:
            n, keys = [], []
            for s in shingle_sets(x.column(1), words):
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                # a set's tokens are sorted, so that those of one cell are neighbours
                cells = (s >> np.uint64(64 - bits)).astype(np.int64)
                first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(s) else cells
                counts[cells[first]] += np.diff(np.append(first, len(s)))
            if n:
                yield rows(x.column(0), n, keys, [None] * len(n), [None] * len(n))
        if counts.any():
            packed = [zlib.compress(c.astype("<u4").reshape(-1, 1).view(np.uint8).T.tobytes(), 1) for c in np.split(np.minimum(counts, 2**32 - 1), PARTS)]
            yield rows(pa.nulls(PARTS, pa.int64()), [None] * PARTS, [None] * PARTS, list(range(PARTS)), packed)

    return run


def _summed(t: pa.Table) -> pa.Table:
    """The parts' sum, as eighths of its logarithm to base 2: an order of tokens needs no more."""
    total = 0
    for c in t.column("counts"):
        total = total + np.frombuffer(zlib.decompress(c.as_py()), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)
    return pa.table({"part": t.column("part")[:1], "levels": pa.array([np.minimum(255, 8 * np.log2(total + 1)).astype(np.uint8).tobytes()], pa.binary())})


def features(docs: DataFrame, words: int = 5, bits: int = 20) -> DataFrame:
    """(doc_id, n_shingles, set_key) for each row of `docs`; set_key is null for an empty set.  Rows with a `part` besides: packed `counts` of
    how many sets hold the tokens of each of 2**bits cells."""
    return docs.select("doc_id", "text").mapInArrow(_features(words, bits), KNOWN)


def rare_first(s: np.ndarray, levels: np.ndarray, percent: int, edges: bool = True) -> np.ndarray:
    """The prefix of a sorted set: by the level of the token's cell, then by hash."""
    level = levels[(s >> np.uint64(64 - (len(levels).bit_length() - 1))).astype(np.int64)]
    return s[np.argsort(level, kind="stable")[: prefix_length(len(s), percent, edges)]]


def _chains(tok: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows ordered by (token, n), and for each but the first whether it continues the chain of the one before it: the same token
    and sizes that may link.  Rows of a token that can link are always in one chain."""
    by = np.lexsort((n, tok))
    t, m = tok[by], n[by]
    return by, (t[1:] == t[:-1]) & (100 * m[:-1] >= percent * m[1:])


def _thin(starts: np.ndarray, ends: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Of the chains [start, end) of sorted sizes m, positions so close in size that whatever may link with a member may link with one of them."""
    keep: list[int] = []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        i = a
        keep.append(i)
        while i < b - 1:
            i = max(i + 1, a + int(np.searchsorted(m[a:b], m[i] * 100 // percent, "right")) - 1)
            keep.append(i)
    return np.array(keep, np.int64)


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return forest(u, v) if len(u) else (u, v)


def _squeezed(x: np.ndarray, steps: bool = True) -> bytes:
    """Integers, with `steps` as zigzag differences, deflated byte plane by byte plane: with many buckets a posting's document is most of its bytes, and ascending ids in reach of each
    other keep about one of eight."""
    d = x.astype("<i8")
    if steps:
        d = np.diff(d, prepend=np.int64(0))
        d = (d << 1) ^ (d >> 63)
    return zlib.compress(d.view(np.uint8).reshape(-1, 8).T.tobytes(), 1) if len(d) else b""


def _unsqueezed(raw: bytes, steps: bool = True) -> np.ndarray:
    if not raw:
        return np.empty(0, np.int64)
    d = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()
    return np.cumsum((d.view("<u8") >> np.uint64(1)).view("<i8") ^ -(d & 1)) if steps else d


PACKED = "bucket long, tok binary, run binary, ids binary, sizes binary, a binary, b binary"


def _settled(ids: np.ndarray, chained: np.ndarray, edges: bool) -> tuple[np.ndarray, np.ndarray]:
    """Edges: the chains as a forest.  Else: how many tokens each document shares."""
    if edges:
        return _forest(ids[1:][chained], ids[:-1][chained])
    shared = np.zeros(len(ids), bool)
    shared[1:] |= chained
    shared[:-1] |= chained
    own, times = np.unique(ids[shared], return_counts=True)
    return own, times.astype(np.int64)


def _summed_up(u: np.ndarray, v: np.ndarray, edges: bool) -> tuple[np.ndarray, np.ndarray]:
    if edges:
        return _forest(u, v)
    own, back = np.unique(u, return_inverse=True)
    return own, np.bincount(back, weights=v, minlength=len(own)).astype(np.int64)


def _packed(tok: np.ndarray, at: np.ndarray, ids: np.ndarray, sizes: np.ndarray, percent: int, buckets: int, edges: bool) -> pa.RecordBatch:
    """Postings (tok, document at) of a part of a batch, packed into a row for each bucket.  Tokens that it holds often are settled there and
    thinned out, so that a hot token sends a few postings.  A token keeps 32 bits besides its bucket; a clash only makes one more candidate."""
    by = np.argsort(ids, kind="stable")
    ids, sizes, at = ids[by], sizes[by], np.argsort(by)[at]
    by = np.argsort(tok, kind="stable")
    tok, at = tok[by], at[by]
    begin = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
    count = np.diff(np.append(begin, len(tok)))
    hot = np.repeat(count > HOT_IN_BATCH, count)
    a = b = np.empty(0, np.int64)
    if hot.any():
        ht, ha = tok[hot], at[hot]
        order, chained = _chains(ht, sizes[ha], percent)
        ht, ha = ht[order], ha[order]
        a, b = _settled(ids[ha], chained, edges)
        starts = np.flatnonzero(np.concatenate([[True], ~chained]))
        keep = _thin(starts, np.append(starts[1:], len(ht)), sizes[ha], percent)
        tok, at = np.concatenate([tok[~hot], ht[keep]]), np.concatenate([at[~hot], ha[keep]])
    bucket, tok = (tok % np.uint64(buckets)).astype(np.int64), (tok >> np.uint64(32)).astype("<u4")
    by = np.lexsort((at, bucket))
    tok, at, bucket = tok[by], at[by], bucket[by]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    rows: dict[str, list] = {k: [] for k in _names(PACKED)}
    for i, (lo, hi) in enumerate(zip(cut.tolist(), [*cut[1:].tolist(), len(tok)], strict=True)):
        own, times = np.unique(at[lo:hi], return_counts=True)
        rows["bucket"].append(int(bucket[lo]))
        rows["tok"].append(tok[lo:hi].tobytes())
        rows["run"].append(_squeezed(times, False))
        rows["ids"].append(_squeezed(ids[own]))
        rows["sizes"].append(_squeezed(sizes[own], False))
        rows["a"].append(_squeezed(a) if not i else b"")
        rows["b"].append(_squeezed(b) if not i else b"")
    return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64() if k == "bucket" else pa.binary()) for k, v in rows.items()})


def _prefixes(words: int, percent: int, levels: bytes, edges: bool, most: int = 400_000):
    """(first row, sizes, prefix tokens, their rows) of each part of a batch; a part has about `most` prefix tokens."""
    rarity = np.frombuffer(levels, np.uint8)

    def parts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        np.seterr(over="ignore")
        first, sizes, took, total = 0, [], [], 0
        for s in shingle_sets(column, words):
            sizes.append(len(s))
            took.append(rare_first(s, rarity, percent, edges) if len(s) else s)
            total += len(took[-1])
            if total >= most:
                yield first, np.array(sizes, np.int64), np.concatenate(took), np.repeat(np.arange(len(took)), [len(x) for x in took])
                first, sizes, took, total = first + len(sizes), [], [], 0
        if total:
            yield first, np.array(sizes, np.int64), np.concatenate(took), np.repeat(np.arange(len(took)), [len(x) for x in took])

    return parts


def _postings(words: int, percent: int, buckets: int, levels: bytes, edges: bool):
    parts = _prefixes(words, percent, levels, edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ids = x.column(0).to_numpy()
            for first, sizes, tok, at in parts(x.column(1)):
                yield _packed(mix(tok + np.uint64(1)), at, ids[first : first + len(sizes)], sizes, percent, buckets, edges)

    return run


def _bucket(percent: int, parts: int, edges: bool):
    """A bucket's postings settled: for each document at most one edge or one count.  They go out packed by a hash of the document, so
    that those of one document from different buckets meet before they are rows."""

    def run(t: pa.Table) -> pa.Table:
        tok, at, ids, sizes, a, b = [], [], [], [], [], []
        base = 0
        for i in range(len(t)):
            x = {k: t.column(k)[i].as_py() for k in _names(PACKED)}
            own = _unsqueezed(x["ids"])
            tok.append(np.frombuffer(x["tok"], "<u4"))
            at.append(np.repeat(np.arange(base, base + len(own)), _unsqueezed(x["run"], False)))
            ids.append(own)
            sizes.append(_unsqueezed(x["sizes"], False))
            a.append(_unsqueezed(x["a"]))
            b.append(_unsqueezed(x["b"]))
            base += len(own)
        tok, at, ids, sizes = np.concatenate(tok), np.concatenate(at), np.concatenate(ids), np.concatenate(sizes)
        by, chained = _chains(tok, sizes[at], percent)
        u, v = _settled(ids[at[by]], chained, edges)
        u, v = _summed_up(np.concatenate([u, *a]), np.concatenate([v, *b]), edges)
        part = (mix(u.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        u, v, part = u[by], v[by], part[by]
        cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else part
        ends = np.append(cut[1:], len(part))
        pack = lambda z: pa.array([_squeezed(z[lo:hi]) for lo, hi in zip(cut, ends, strict=False)], pa.binary())
        return pa.table({"part": pa.array(part[cut], pa.int64()), "u": pack(u), "v": pack(v)})

    return run


def _part(edges: bool):
    """The edges of a part as a forest, or its counts summed."""

    def run(t: pa.Table) -> pa.Table:
        u, v = _summed_up(*(np.concatenate([_unsqueezed(x.as_py()) for x in t.column(k)]) for k in ("u", "v")), edges)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


OPEN = "bucket long, tok binary, run binary, ids binary, cells binary, bands binary, apart binary"


def _open_postings(words: int, percent: int, buckets: int, levels: bytes):
    """Prefix tokens of members (doc_id, text, block, cell, band, apart), packed by hash bucket."""
    parts = _prefixes(words, percent, levels, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ids, block, cell, band, apart = (x.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 2, 3, 4, 5))
            for first, _, tok, at in parts(x.column(1)):
                at = at + first
                tok = mix(tok ^ mix(block.astype(np.uint64) + np.uint64(1))[at])
                bucket = (tok % np.uint64(buckets)).astype(np.int64)
                by = np.lexsort((at, bucket))
                tok, at, bucket = (tok[by] >> np.uint64(32)).astype("<u4"), at[by], bucket[by]
                cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                rows: dict[str, list] = {k: [] for k in _names(OPEN)}
                for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(tok)], strict=True):
                    own, times = np.unique(at[lo:hi], return_counts=True)
                    for k, v in zip(rows, (int(bucket[lo]), tok[lo:hi].tobytes(), _squeezed(times, False), _squeezed(ids[own]), _squeezed(cell[own], False), _squeezed(band[own], False), _squeezed(apart[own], False)), strict=True):
                        rows[k].append(v)
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64() if k == "bucket" else pa.binary()) for k, v in rows.items()})

    return run


def _added_up(code: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    own, back = np.unique(np.concatenate(code), return_inverse=True)
    return own, np.bincount(back, weights=np.concatenate(n), minlength=len(own)).astype(np.int64)


def _met(most: int = 2_000_000):
    """(doc_id, chunk, shared): how many tokens of a bucket a document shares with the members of another cell that are apart from their pivot, for cells of compatible sizes; of two documents
    that are both apart, one goes to the other's cell.  About `most` pairs are held at a time."""

    def run(t: pa.Table) -> pa.Table:
        tok, at, docs, base = [], [], [], 0
        for i in range(len(t)):
            x = {k: t.column(k)[i].as_py() for k in _names(OPEN)[1:]}
            run, *own = (_unsqueezed(x[k], k == "ids") for k in ("run", "ids", "cells", "bands", "apart"))
            tok.append(np.frombuffer(x["tok"], "<u4"))
            at.append(np.repeat(np.arange(base, base + len(run)), run))
            docs.append(own)
            base += len(run)
        tok, at = np.concatenate(tok), np.concatenate(at)
        ids, cell, band, apart = (np.concatenate(c) for c in zip(*docs, strict=True))
        cells, no = np.unique(cell, return_inverse=True)
        size = np.zeros(len(cells), np.int64)
        size[no] = band
        # the chunks of each token, once each
        asks = apart[at] == 1
        chunk = np.unique(tok[asks].astype(np.uint64) * np.uint64(len(cells)) + no[at[asks]].astype(np.uint64))
        of, chunk = chunk // np.uint64(len(cells)), (chunk % np.uint64(len(cells))).astype(np.int64)
        lo, hi = (np.searchsorted(of, tok.astype(np.uint64), side) for side in ("left", "right"))
        some = np.flatnonzero(hi > lo)
        lo, n, at = lo[some], (hi - lo)[some], at[some]
        ends = np.cumsum(n)
        code, shared, begin = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        while begin < len(n):
            end = max(begin + 1, int(np.searchsorted(ends, ends[begin] - n[begin] + most, "right")))
            k = n[begin:end]
            mine = np.repeat(at[begin:end], k)
            theirs = chunk[np.repeat(lo[begin:end], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]
            here, far = band[mine], size[theirs]
            fits = (no[mine] != theirs) & ((np.abs(here - far) <= 1) | (np.maximum(here, far) == ANY_BAND)) & ((apart[mine] == 0) | (no[mine] < theirs))
            c, m = np.unique(mine[fits] * len(cells) + theirs[fits], return_counts=True)
            code, shared = ([x] for x in _added_up([*code, c], [*shared, m]))
            begin = end
        return pa.table({"doc_id": ids[code[0] // len(cells)], "chunk": cells[code[0] % len(cells)], "shared": shared[0]})

    return run


# ---------------------------------------------------------------- signature trees

LEAF, FAN = 16, 8


def width(sizes: np.ndarray) -> int:
    """Bits of a tree's bitmaps: eight for each token of its middle set, so that they don't fill up, within 2048 and 65536."""
    return int(np.clip(1 << int(8 * np.median(sizes)).bit_length(), 2048, 65536))


def signature(s: np.ndarray, bits: int = 2048) -> np.ndarray:
    out = np.zeros(bits, np.uint8)
    out[(s >> np.uint64(40)) % np.uint64(bits)] = 1
    return np.packbits(out).view(np.uint64)


class Tree:
    """Levels of nodes over sets sorted by size, leaves first; a node has the OR of its members' bitmaps, their size range, and the
    most tokens of a member that its bitmap does not show (`slack`)."""

    def __init__(self, sizes: np.ndarray, bitmaps: np.ndarray):
        slack = sizes - np.bitwise_count(bitmaps).sum(axis=1)
        self.levels, fan = [(bitmaps, sizes, sizes, slack)], LEAF
        while len(self.levels) == 1 or len(self.levels[-1][0]) > 1:
            m, lo, hi, sl = self.levels[-1]
            cut = np.arange(0, len(m), fan)
            self.levels.append((np.bitwise_or.reduceat(m, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(sl, cut)))
            fan = FAN

    def children(self, level: int, i: int) -> np.ndarray:
        fan = LEAF if level == 1 else FAN
        return np.arange(i * fan, min((i + 1) * fan, len(self.levels[level - 1][0])))


def may_link(x: tuple, y: tuple, percent: int) -> np.ndarray:
    """Matrix: can any member of node i link with any of node j?  An overlap has at most the common bits and the tokens that share a bit."""
    m, lo, hi, slack = x
    n, lo2, hi2, slack2 = y
    fits = (100 * hi[:, None] >= percent * lo2[None]) & (100 * hi2[None] >= percent * lo[:, None])
    if not fits.any():
        return fits
    common = np.array([np.bitwise_count(row & n).sum(axis=1) for row in m], np.int64)
    most = common + np.minimum(slack[:, None], slack2[None])
    most = np.minimum(most, np.minimum(hi[:, None], hi2[None]))
    return fits & ((100 + percent) * most >= percent * (lo[:, None] + lo2[None]))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)
    return 100 * both >= percent * (len(a) + len(b) - both)


def tree_links(sets: list[np.ndarray], percent: int, probe: np.ndarray | None = None) -> np.ndarray:
    """Component (smallest index) of each set by links >= percent, found by dual traversal of the signature tree with itself.
    With `probe`, only pairs with at least one probe are looked at.  Node pairs within one component are skipped."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    own = [sets[i] for i in order]
    sizes = np.array([len(s) for s in own], np.int64)
    tree = Tree(sizes, np.array([signature(s, width(sizes)) for s in own]))
    root = np.arange(len(own))
    ask = np.ones(len(own), bool) if probe is None else probe[order]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    top = len(tree.levels) - 1
    stack = [(top, 0, 0)]
    while stack:
        level, i, j = stack.pop()
        p, q = tree.children(level, i), tree.children(level, j)
        x, y = tuple(v[p] for v in tree.levels[level - 1]), tuple(v[q] for v in tree.levels[level - 1])
        fits = may_link(x, y, percent)
        if i == j:
            fits = np.triu(fits, 1 if level == 1 else 0)
        if level > 1:
            stack += [(level - 1, int(p[a]), int(q[b])) for a, b in np.argwhere(fits)[::-1]]
            continue
        fits &= ask[p][:, None] | ask[q][None]
        for a, b in np.argwhere(fits):
            u, v = find(int(p[a])), find(int(q[b]))
            if u != v and linked(own[p[a]], own[q[b]], percent):
                root[max(u, v)] = min(u, v)
    low = np.array([find(i) for i in range(len(own))])
    out, least = np.empty(len(own), np.int64), {}
    for at, r in zip(order.tolist(), low.tolist(), strict=True):
        least[r] = min(least.get(r, at), at)
    for at, r in zip(order.tolist(), low.tolist(), strict=True):
        out[at] = least[r]
    return out


def _cell(words: int, percent: int):
    """Rows (doc_id, text, role) of one cell: role 0 member, 1 the block's pivot, 2 probe.  Out: (u, v) u is linked, by steps, with v;
    a member that is not linked with the pivot has v = -1 in a row of its own."""

    def run(t: pa.Table) -> pa.Table:
        np.seterr(over="ignore")
        ids, role = t.column("doc_id").to_numpy(), t.column("role").to_numpy()
        sets = [s for c in t.column("text").chunks for s in shingle_sets(c, words)]
        low = tree_links(sets, percent, role == 2 if (role == 2).any() else None)
        u, v = ids, ids[low]
        pivot = np.flatnonzero(role == 1)
        apart = ids[(role == 0) & (low != low[pivot[0]])] if len(pivot) else np.empty(0, np.int64)
        return pa.table({"u": np.concatenate([u[u != v], apart]), "v": np.concatenate([v[u != v], np.full(len(apart), -1)])}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, cell: int = 256, bucket_tokens: int = 1_000_000, sketch_bits: int = 20) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of `docs` (doc_id, text, ...): the distinct `words`-word shingles of the text
    with A-Z lower-cased, and the smallest doc_id that links (intersection >= percent % of the union) reach.

    Null and empty texts, and texts of white space: no shingles, linked with nothing.  Fewer words: the whole sequence is one
    shingle.  A row with a null doc_id takes part like any other; its component_id is null if it reaches no row that has one.  Repeated doc_ids: their rows
    share a component if their texts do, else each row counts as linked with its doc_id.  Very long texts are taken whole.  doc_ids below 2**62.
    Other columns are ignored.  An empty table gives an empty result.  No pair of different texts is lost: every step is exact.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    top = docs.agg(F.max("doc_id")).first()[0] or 0
    # rows without an id are known by their text, above all ids
    docs = docs.select(F.coalesce("doc_id", F.lit(top) + 1 + F.pmod(F.xxhash64("text"), F.lit(1 << 61))).alias("doc_id"), "text")
    both = saved(features(docs, words, sketch_bits), "features")
    known = both.where("part is null").select("doc_id", "n_shingles", "set_key")
    sums = both.where("part is not null").select("part", "counts").groupBy("part").applyInArrow(_summed, "part int, levels binary")
    levels = b"".join(r["levels"] for r in sorted(sums.collect(), key=lambda r: r["part"])) or bytes(1 << sketch_bits)
    total = known.agg(F.sum("n_shingles")).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(2 * parts, total * 3 // 8 // bucket_tokens + 1)

    def settled(texts: DataFrame, edges: bool) -> DataFrame:
        postings = texts.mapInArrow(_postings(words, percent, buckets, levels, edges), PACKED)
        return postings.groupBy("bucket").applyInArrow(_bucket(percent, parts, edges), "part long, u binary, v binary").groupBy("part").applyInArrow(_part(edges), "u long, v long")

    # which documents can link with a different set; a doc_id that is repeated with other texts may stand for sets of different sizes
    firsts = known.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"))
    reps = firsts.groupBy(F.col("rep").alias("doc_id")).agg(F.min("n").alias("n"), (F.min("n") != F.max("n")).alias("mixed"))
    least = F.greatest(F.lit(1), F.ceil(F.ceil(percent * F.col("n") / 100.0) / 8.0))
    few = settled(docs, False).select(F.col("u").alias("doc_id"), F.col("v").alias("shared")).join(reps, "doc_id").where(F.col("mixed") | (F.col("shared") >= least))
    few = saved(few.drop("shared"), "few")
    held = few.count()
    # ids go to the texts, which stay where they are until they meet in cells
    small = lambda df: F.broadcast(df) if held <= BROADCAST_ROWS else df
    kept = saved(docs.join(small(few.select("doc_id")), "doc_id"), "candidates")

    # blocks that no link leaves: survivors that share a token, closed to connected components
    blocks = saved(connected(settled(kept, True), "blocks").select(F.col("node").alias("doc_id"), F.col("component").alias("block")), "of-block")
    sizes = blocks.groupBy("block").agg(F.count("*").alias("members"))
    band = F.when(F.col("mixed"), ANY_BAND).otherwise(F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent))).cast("int")
    salt = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("members") / F.lit(float(cell))).cast("long"))
    big = F.col("members") > cell
    members = few.join(blocks, "doc_id").join(sizes, "block").withColumns({"band": F.when(big, band).otherwise(-1), "salt": F.when(big, salt).otherwise(0)})
    cells = members.groupBy("block", "band", "salt").agg(F.min("doc_id").alias("cell"))
    members = saved(members.join(cells, ["block", "band", "salt"]).select("doc_id", "block", "band", "cell", F.when(F.col("mixed"), 1).otherwise(least).cast("long").alias("least")), "members")

    pivots = members.where("band >= 0").groupBy("block").agg(F.min("doc_id").alias("doc_id"))
    first = members.join(pivots.select("doc_id"), "doc_id", "left_anti").select("doc_id", "cell", F.lit(0).alias("role"))
    first = first.union(members.where("band >= 0").select("block", "cell").distinct().join(pivots, "block").select("doc_id", "cell", F.lit(1).alias("role")))
    found = saved(kept.join(small(first), "doc_id").groupBy("cell").applyInArrow(_cell(words, percent), "u long, v long"), "links")
    links = found.where("v >= 0")

    apart = found.where("v = -1").select(F.col("u").alias("doc_id")).distinct()
    if not apart.isEmpty():
        # members apart from the pivot meet those of other cells with which they share as many prefix tokens as a link takes
        there = members.join(apart.withColumn("apart", F.lit(1)), "doc_id", "left").withColumn("apart", F.coalesce("apart", F.lit(0)))
        there = saved(there.where("band >= 0").join(there.where("apart = 1").select("block").distinct(), "block", "left_semi"), "open")
        prefixes = 4 * (there.agg(F.sum("least")).first()[0] or 0)
        postings = kept.join(small(there.select("doc_id", "block", "cell", "band", "apart")), "doc_id").mapInArrow(_open_postings(words, percent, max(parts, prefixes // bucket_tokens + 1), levels), OPEN)
        met = postings.groupBy("bucket").applyInArrow(_met(), "doc_id long, chunk long, shared long").groupBy("doc_id", "chunk").agg(F.sum("shared").alias("shared"))
        met = saved(met.join(small(there.select("doc_id", "least")), "doc_id").where("shared >= least").select("doc_id", "chunk"), "reach")
        # a cell's guests come in pieces of bounded size, each of which meets all of the cell that is apart
        pieces = met.groupBy("chunk").agg(F.ceil(F.count("*") / F.lit(float(cell))).cast("long").alias("pieces"))
        guests = met.join(pieces, "chunk").select("doc_id", "chunk", F.pmod(F.xxhash64("doc_id"), "pieces").alias("piece"), F.lit(0).alias("role"))
        hosts = there.where("apart = 1").select("doc_id", F.col("cell").alias("chunk")).join(pieces, "chunk").select("doc_id", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"), F.lit(2).alias("role"))
        both = saved(guests.union(hosts), "second")
        ask = F.broadcast(both) if both.count() <= BROADCAST_ROWS else both
        links = links.union(kept.join(ask, "doc_id").groupBy("chunk", "piece").applyInArrow(_cell(words, percent), "u long, v long").where("v >= 0"))

    reached = connected(links, "linked")
    by_set = firsts.select("set_key", "rep").join(reached.select(F.col("node").alias("rep"), "component"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    out = known.join(by_set, "set_key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    real = lambda c: F.when(F.col(c) <= top, F.col(c))
    return out.select(real("doc_id").alias("doc_id"), "n_shingles", real("component_id").alias("component_id"))
