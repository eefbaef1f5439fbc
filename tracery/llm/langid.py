"""Language identification by a byte convolutional network in numpy.

A text is cut into windows of one length.  Each byte has a vector; filters of several widths run over the window, each filter's highest answer is kept, and a softmax
over these gives the languages' odds.  A text's odds are the windows' mean log-odds, weighted by their letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, slices, text_slices

#: Bounds of the fit: languages (the most frequent), texts of a language (about, twice as many at most) and code points in them, whole texts in the order of a hash of the id.
LANGS, SAMPLE_DOCS, SAMPLE_CHARS = 200, 300, 700_000
#: Bytes of a window, and windows of a text that the fit looks at.
WINDOW, WINDOWS = 128, 12
DIM, WIDTHS, FILTERS = 8, (2, 3, 4, 5), 12
EPOCHS, BATCH, RATE = 6, 64, 0.01
#: The prediction for texts without a letter.
NONE = "und"

_SPAN = max(WIDTHS)
#: Letters in either case are one, digits are one; signs, spaces and control characters are spaces.
_FOLD = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 32 for b in range(256)], np.uint8)
_FOLD[0] = 0
_LETTER = _FOLD >= 97


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(windows x WINDOW folded bytes, the text of each).  Windows overlap so that each run of bytes as wide as a filter is in one; the last is filled up with zeros.
    A text without bytes has none."""
    step = WINDOW - _SPAN + 1
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = np.where(sizes > 0, np.maximum(-(-(sizes - _SPAN + 1) // step), 1), 0)
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = (np.cumsum(sizes) - sizes)[owner] + place * step
    flat = _FOLD[np.frombuffer(b"".join(texts) + bytes(WINDOW), np.uint8)]
    x = np.lib.stride_tricks.sliding_window_view(flat, WINDOW)[begin]
    left = sizes[owner] - place * step
    return np.where(np.arange(WINDOW) < left[:, None], x, 0).astype(np.uint8), owner


def _mask() -> np.ndarray:
    """Which of a filter's _SPAN bytes it looks at: as many as it is wide."""
    return np.repeat(np.concatenate([np.repeat((np.arange(_SPAN) < w)[None], FILTERS, axis=0) for w in WIDTHS]).T, DIM, axis=0).astype(np.float32)


@dataclass
class Network:
    """`byte`: a vector for each byte; `filters`: (_SPAN * DIM, filters); `bias`; `out`: (filters, languages); `prior`."""

    langs: list[str]
    byte: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    prior: np.ndarray

    @classmethod
    def fresh(cls, langs: list[str], seed: int = 3) -> Network:
        r, n = np.random.default_rng(seed), FILTERS * len(WIDTHS)
        normal = lambda scale, *shape: (scale * r.standard_normal(shape)).astype(np.float32)
        return cls(langs, normal(0.5, 256, DIM), normal(0.3, _SPAN * DIM, n) * _mask(), np.zeros(n, np.float32), normal(0.1, n, len(langs)), np.zeros(len(langs), np.float32))

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's highest answer in each window, at least 0, and the place of it; `x` of windows as from `windows`."""
        v = self.byte[x]
        places = WINDOW - _SPAN + 1
        columns = np.lib.stride_tricks.as_strided(v, (len(x), places, _SPAN * DIM), (v.strides[0], v.strides[1], v.strides[2]))
        answers = (columns.reshape(-1, _SPAN * DIM) @ self.filters).reshape(len(x), places, -1)
        at = answers.argmax(axis=1)
        return np.maximum(np.take_along_axis(answers, at[:, None], axis=1)[:, 0] + self.bias, 0), at

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Logarithms of the softmax of each window."""
        out = []
        for k in range(0, len(x), 256):  # bounds the memory
            v = self.byte[x[k : k + 256]]
            columns = np.lib.stride_tricks.as_strided(v, (len(v), WINDOW - _SPAN + 1, _SPAN * DIM), v.strides)
            best = (columns.reshape(-1, _SPAN * DIM) @ self.filters).reshape(len(v), WINDOW - _SPAN + 1, -1).max(axis=1)
            out.append(_log_softmax(np.maximum(best + self.bias, 0) @ self.out + self.prior))
        return np.concatenate(out or [np.empty((0, len(self.langs)), np.float32)])

    def predicted(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the likeliest language, its probability) of each text."""
        x, owner = windows(texts)
        z, weight = self.log_odds(x).astype(float), _LETTER[x].sum(axis=1) + 1e-3
        total = np.stack([np.bincount(owner, weight * z[:, k], len(texts)) for k in range(len(self.langs))], axis=1)
        mean = total / np.maximum(np.bincount(owner, weight, len(texts)), 1e-9)[:, None]
        p = np.exp(_log_softmax(mean))
        return p.argmax(axis=1), p.max(axis=1)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


class _Adam:
    def __init__(self, values: list[np.ndarray]):
        self.values, self.n = values, 0
        self.first, self.second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]

    def step(self, gradients: list[np.ndarray], rate: float) -> None:
        self.n += 1
        for v, g, a, b in zip(self.values, gradients, self.first, self.second, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            v -= rate * (a / (1 - 0.9**self.n)) / (np.sqrt(b / (1 - 0.99**self.n)) + 1e-8)


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The mean loss over windows `x` of languages `y`, and its gradients by byte, filters, bias, out and prior."""
    h, at = net.pooled(x)
    z = _log_softmax(h @ net.out + net.prior)
    loss = float(-z[np.arange(len(y)), y].mean())
    g = np.exp(z)
    g[np.arange(len(y)), y] -= 1
    g /= len(y)
    dh = (g @ net.out.T) * (h > 0)
    # a filter's answer comes from one place, so only the bytes there have a share
    seen = x[np.arange(len(x))[:, None, None], at[:, :, None] + np.arange(_SPAN)]
    columns = net.byte[seen].reshape(len(x), h.shape[1], -1)
    d_filters = np.einsum("bfk,bf->kf", columns, dh) * _mask()
    back = (dh[:, :, None] * net.filters.T[None]).reshape(-1, DIM)
    d_byte = np.stack([np.bincount(seen.ravel(), back[:, d], 256) for d in range(DIM)], axis=1)
    return loss, [d_byte.astype(np.float32), d_filters.astype(np.float32), dh.sum(axis=0), h.T @ g, g.sum(axis=0)]


def fit(texts: list[bytes], langs: list[str], epochs: int = EPOCHS, seed: int = 3) -> Network:
    """Fit on at most WINDOWS windows of each text, each language with the same weight.  With one language every text is of it."""
    names = sorted(set(langs))
    net, r = Network.fresh(names, seed), np.random.default_rng(seed)
    if len(names) < 2:
        return net
    parts, owners = [], []
    for first, held in slices([t.decode("utf-8", "replace") for t in texts]):
        x, owner = windows(held)
        order = r.permutation(len(owner))
        rank = np.empty(len(owner), np.int64)
        by = order[np.argsort(owner[order], kind="stable")]
        counts = np.bincount(owner, minlength=len(held))
        rank[by] = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        good = (rank < WINDOWS) & (_LETTER[x].sum(axis=1) * 4 >= WINDOW)
        parts.append(x[good])
        owners.append(owner[good] + first)
    x, y = np.concatenate(parts), np.array([names.index(n) for n in langs])[np.concatenate(owners)]
    if not len(x):
        return net
    adam = _Adam([net.byte, net.filters, net.bias, net.out, net.prior])
    share = np.bincount(y, minlength=len(names)) / len(y)
    weight = 1 / np.maximum(share, 1e-9)[y]
    steps = max(len(x) // BATCH, 1) * epochs
    for n in range(steps):
        own = r.choice(len(x), min(BATCH, len(x)), p=weight / weight.sum())
        _, g = gradients(net, x[own], y[own])
        adam.step(g, RATE * (1 - n / steps))
    return net


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def sample(docs: DataFrame) -> tuple[list[bytes], list[str]]:
    """Whole texts with a language outside the held-out fold, and their languages; bounded as LANGS, SAMPLE_DOCS and SAMPLE_CHARS say."""
    known = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS).collect()
    if not counts:
        return [], []
    # of each language a share by hash, so that no task sees more of a frequent one than that
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1 << 20, 1 + (SAMPLE_DOCS * 3 << 19) // r["count"])) for r in counts], "lang string, share long")
    some = known.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 20)) < F.col("share"))
    rows = bounded_sample(some.select("doc_id", "lang", "text"), 2 * SAMPLE_DOCS * len(counts), lambda _: SAMPLE_CHARS, lambda r: r["lang"], lambda r: r["lang"], "lang-sample")
    return [r["text"].encode("utf-8", "replace") for r in rows], [r["lang"] for r in rows]


def languages(docs: DataFrame, carry: list[str] | None = None, net: Network | None = None) -> DataFrame:
    """The columns of `docs` (of these, `carry` if given), lang_pred and score, its probability from 0 to 1, for each row.

    Texts with a `lang` teach the network, but for rows of the held-out fold; neither lang nor source nor doc_id is looked at in a prediction.  lang_pred is a language that
    was learned, or `und` with score 0 for texts that are null or have no letter, and for all texts where nothing could be learned.  Very long texts are read
    whole, window by window.  Repeated texts get equal languages.  Columns of `docs` with the new names are replaced.  An empty table gives no rows.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score") and (carry is None or c in carry)]
    net = net or fit(*sample(docs))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce("text", F.lit("")).alias("text of it"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*net.langs, NONE], object)
        for x in batches:
            letters = x.column(len(keep) + 1).to_numpy(zero_copy_only=False).astype(bool)
            for first, held in text_slices(x.column(len(keep))):
                n, part = len(held), x.slice(first, len(held))
                best, p = net.predicted(held) if net.langs else (np.zeros(n, np.int64), np.zeros(n))
                good = letters[first : first + n] & (len(net.langs) > 0)
                best = np.where(good, best, len(net.langs))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(names[best], pa.string()), pa.array(np.where(good, p, 0.0), pa.float64())], names=[*keep, "lang_pred", "score"])

    fields = {f.name: f for f in docs.schema.fields}
    return rows.mapInArrow(run, T.StructType([*(fields[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def digest(predicted: DataFrame) -> DataFrame:
    return predicted.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
