"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is its bytes between markers and all byte n-grams of that, hashed to buckets; a bag is the average of its subwords' vectors.
Misspellings share most n-grams with the word, and so its vectors.  Vectors and softmax are first fitted on whole documents as
bags, then on short segments: a document is as toxic as its most toxic segment, so long texts don't dilute what they hold.
Scores use no label, language, source or id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import appended, bounded_sample, mix, slices, text_or_empty, word_table

#: Bounds of the fit, for clean and for toxic documents: how many, and characters in them (whole documents, in the order of a hash of the id); each fourth of a class only calibrates.
SAMPLE_DOCS, SAMPLE_CHARS = (2400, 1200), (3_000_000, 2_000_000)
BUCKETS, DIM, SEGMENT = 1 << 17, 6, 6
GRAMS = (3, 4, 5)
#: Bytes of text scored at a time: subwords take some hundred bytes for each.
SCORED_BYTES = 1 << 17

_SEPARATORS = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
_IS_WORD = word_table(_SEPARATORS)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if _IS_WORD[c] else 32 for c in range(256))
_SALT = np.random.default_rng(11).integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)


def subwords(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice of texts: bucket of each subword and the word it belongs to (in order), the number of words before each text (one
    more at the end).  Subwords are the byte n-grams of the word with a space on either side, and the whole word."""
    from .common import hashed_words

    low = [t.translate(_LOWER) for t in texts]
    words, first = hashed_words(low, word_table(b" \n"))
    a = np.frombuffer(b"\n" + b"\n".join(low) + b"\n", np.uint8)
    a = np.where(a == 10, 32, a)
    inside = a != 32
    word = np.cumsum(inside & ~np.concatenate([[False], inside[:-1]])) - 1
    buckets, owners = [(words >> np.uint64(20)) % np.uint64(BUCKETS)], [np.arange(len(words))]
    mask = np.uint64(BUCKETS - 1)
    h = a.astype(np.uint64) + np.uint64(1)
    rolled = h.copy()
    for n in range(2, max(GRAMS) + 1):
        rolled = rolled[: len(h) - n + 1] * np.uint64(0x100000001B3) + h[n - 1 :]
        if n in GRAMS:
            # the inner bytes lie in one word; the outer ones may be its markers
            cut = np.concatenate([[0], np.cumsum(~inside[1:])])
            m = len(rolled)
            good = np.flatnonzero(cut[n - 3 + 1 : n - 2 + m][:m] - cut[:m] == 0) if n > 3 else np.arange(m)
            good = good[inside[good + 1] & inside[good + n - 2]]
            buckets.append((mix(rolled[good] * _SALT[n]) & mask))
            owners.append(word[good + 1])
    b, o = np.concatenate(buckets).astype(np.int64), np.concatenate(owners)
    return b, o, first, np.diff(first)


def bags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and bag of each subword, in the order of the bags, and the document of each bag; bags are segments of SEGMENT words."""
    b, word, first, counts = subwords(texts)
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(int(first[-1])) - np.repeat(first[:-1], counts)
    whole = -(-counts // SEGMENT)
    begin = np.concatenate([[0], np.cumsum(whole)])
    bag_of_word = begin[doc] + place // SEGMENT
    bag = bag_of_word[word]
    by = np.argsort(bag, kind="stable")
    return b[by], bag[by], np.repeat(np.arange(len(counts)), whole)


@dataclass
class Model:
    """What scoring needs: a bucket's share in the logit, the bias, and the calibration of a document's highest logits."""

    weight: np.ndarray
    bias: float
    scale: tuple[float, float, float]

    def score(self, texts: list[str | None]) -> np.ndarray:
        return np.concatenate([self._slice(held) for _, held in slices(texts)] or [np.empty(0)])

    def _slice(self, held: list[bytes]) -> np.ndarray:
        b, bag, doc = bags(held)
        top, second = highest(logits(self.weight, self.bias, b, bag, len(doc)), doc, len(held), self.bias)
        return np.where(np.bincount(doc, minlength=len(held)) > 0, _sigmoid(self.scale[0] + self.scale[1] * top + self.scale[2] * second), 0.0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logits(weight: np.ndarray, bias: float, b: np.ndarray, bag: np.ndarray, n: int) -> np.ndarray:
    total, count = np.zeros(n), np.zeros(n)
    for k in range(0, len(b), 1 << 20):  # bounds the memory
        own = bag[k : k + (1 << 20)]
        if len(own):
            low = int(own[0])
            part = np.bincount(own - low, weights=weight[b[k : k + (1 << 20)]])
            total[low : low + len(part)] += part
            count[low : low + len(part)] += np.bincount(own - low)
    return total / np.maximum(count, 1) + bias


def highest(z: np.ndarray, doc: np.ndarray, n: int, none: float) -> tuple[np.ndarray, np.ndarray]:
    """The highest and the second highest logit of each document's bags (`none` without)."""
    out = np.full((n, 2), min(none, 0.0))
    by = np.lexsort((-z, doc))
    at = np.searchsorted(doc[by], np.arange(n + 1))
    one, two = np.flatnonzero(np.diff(at) > 0), np.flatnonzero(np.diff(at) > 1)
    out[one] = z[by[at[one]]][:, None]
    out[two, 1] = z[by[at[two] + 1]]
    return out[:, 0], out[:, 1]


class _Softmax:
    """Bucket vectors and a two-class softmax over their averages, with Adagrad steps on both."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.vectors = np.zeros((BUCKETS, DIM), np.float32)  # so that subwords never seen say nothing
        self.out = r.standard_normal((DIM, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.seen = [np.full(x.shape, 1e-6, np.float32) for x in (self.vectors, self.out, self.bias)]

    def step(self, b: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float) -> None:
        """One step over bags 0..len(y)-1."""
        count = np.maximum(np.bincount(bag, minlength=len(y)), 1).astype(np.float32)[:, None]
        own = self.vectors[b]
        mean = np.stack([np.bincount(bag, weights=own[:, d], minlength=len(y)) for d in range(DIM)], axis=1).astype(np.float32) / count
        z = mean @ self.out + self.bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        g = (p * weight[:, None] / max(weight.sum(), 1e-9)).astype(np.float32)
        back = (g @ self.out.T / count)[bag]
        used, at = np.unique(b, return_inverse=True)
        dv = np.stack([np.bincount(at, weights=back[:, d], minlength=len(used)) for d in range(DIM)], axis=1).astype(np.float32)
        do, db = mean.T @ g, g.sum(axis=0)
        self.seen[0][used] += dv * dv
        self.vectors[used] -= rate * dv / np.sqrt(self.seen[0][used])
        for x, d, s in ((self.out, do, self.seen[1]), (self.bias, db, self.seen[2])):
            s += d * d
            x -= rate * d / np.sqrt(s)

    def flat(self) -> tuple[np.ndarray, float]:
        w = self.out[:, 1] - self.out[:, 0]
        return (self.vectors @ w).astype(np.float64), float(self.bias[1] - self.bias[0])


def fit(texts: list[str | None], labels: list[int], real: float | None = None, epochs: int = 6, rounds: int = 25, seed: int = 5) -> Model:
    """Fit on whole texts.  Each fourth text of a class teaches nothing and is left to the calibration (where there are too few for that, all calibrate).  `real` is the share of toxic
    documents for which scores are calibrated, where the sample's is another one.  With one class only, every score is that class's share of the labels, smoothed."""
    y = np.array(labels, np.int64)
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.05
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS), 0.0, (float(np.log(share / (1 - share))), 0.0, 0.0))
    b, sizes, doc, base = [], [], [], 0
    for first, held in slices(texts):
        x, g, d = bags(held)
        b.append(x.astype(np.int32))
        sizes.append(np.bincount(g, minlength=len(d)))  # a bag is known by its size, as its subwords follow each other
        doc.append((d + first).astype(np.int32))
        base += len(d)
    b, sizes, doc = np.concatenate(b), np.concatenate(sizes), np.concatenate(doc)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    docs_begin = np.searchsorted(doc, np.arange(len(y) + 1))

    def all_logits(weight: np.ndarray, bias: float) -> np.ndarray:
        out = [np.empty(0)]
        for k in range(0, base, 1 << 14):
            own = sizes[k : k + (1 << 14)]
            out.append(logits(weight, bias, b[begin[k] : begin[k] + own.sum()], np.repeat(np.arange(len(own)), own), len(own)))
        return np.concatenate(out)

    net, r = _Softmax(seed), np.random.default_rng(seed)
    place = np.empty(len(y), np.int64)  # within the class
    for k in (0, 1):
        place[y == k] = np.arange((y == k).sum())
    apart = (place % 4 == 3) if min((y == 0).sum(), (y == 1).sum()) >= 40 else np.zeros(len(y), bool)
    taught = np.flatnonzero(~apart)
    rare = np.where(y == 1, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3))

    def step(groups: list[tuple[int, int]], own: np.ndarray, rate: float) -> None:
        at = np.concatenate([np.arange(begin[lo], begin[hi]) for lo, hi in groups])
        which = np.repeat(np.arange(len(groups)), [begin[hi] - begin[lo] for lo, hi in groups])
        net.step(b[at], which, y[own], rare[own], rate)

    for _ in range(epochs):  # whole documents as bags
        order = r.permutation(taught)
        for k in range(0, len(order), 128):
            own = order[k : k + 128]
            step([(int(docs_begin[i]), int(docs_begin[i + 1])) for i in own], own, 0.15)
    for _ in range(rounds):  # each document's most toxic segment, and for clean ones another at random
        w, c = net.flat()
        z = all_logits(w, c)
        by = np.lexsort((-z, doc))
        top = by[docs_begin[:-1].clip(max=max(base - 1, 0))] if base else by
        some = np.flatnonzero((np.diff(docs_begin) > 0) & ~apart)
        more = docs_begin[:-1] + (r.random(len(y)) * np.diff(docs_begin)).astype(np.int64)
        picks = [(int(top[i]), i) for i in some] + [(int(more[i]), i) for i in some if not y[i]]
        r.shuffle(picks)
        for k in range(0, len(picks), 256):
            part = picks[k : k + 256]
            step([(g, g + 1) for g, _ in part], np.array([i for _, i in part]), 0.05)
    w, c = net.flat()
    top, second = highest(all_logits(w, c), doc, len(y), c)
    some = (np.bincount(doc, minlength=len(y)) > 0) & (apart | ~apart.any())
    real = share if real is None else real
    return Model(w, c, _calibrated(top[some], second[some], y[some], np.where(y[some] == 1, real / share, (1 - real) / (1 - share))))


def _calibrated(top: np.ndarray, second: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """A weighted logistic regression of the label on the two highest logits, by Newton steps; never falling in either."""
    x = np.stack([np.ones_like(top), top, second], axis=1)
    w = np.array([0.0, 1.0, 0.0])
    for _ in range(60):
        p = _sigmoid(x @ w)
        g = x.T @ (weight * (p - y)) + np.array([0, 0.02, 0.02]) * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 0.02, 0.02])
        w = w - np.clip(np.linalg.solve(h, g), -1, 1)
        w[1:] = np.maximum(w[1:], 0)
    return float(w[0]), float(w[1]), float(w[2])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def sample(docs: DataFrame, labels: DataFrame, label: str) -> tuple[list[str], list[int], float]:
    """Whole labelled texts outside the held-out fold, bounded for each class by SAMPLE_DOCS and SAMPLE_CHARS, in the order of a hash of the
    id; their labels; and the share of toxic ones among all labels outside the fold."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("label"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    few = [known.where(F.col("label") == k).orderBy(*order).limit(most) for k, most in enumerate(SAMPLE_DOCS)]
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(few[0].union(few[1])), "doc_id")
    rows = bounded_sample(texts, sum(SAMPLE_DOCS), lambda k: SAMPLE_CHARS[k], lambda r: r["label"], lambda r: r["label"], "toxic-sample")
    return [r["text"] for r in rows], [r["label"] for r in rows], (toxic + 0.5) / (n + 1)


def toxicity(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None, label: str = "toxic", model: Model | None = None) -> DataFrame:
    """The columns of `docs` (of these, `carry` if given) and toxic_score from 0 to 1, for each row.

    `labels` (doc_id, toxic) teach the model, but for rows of the held-out fold; conflicting labels count as toxic.  Null
    and empty texts, and those without words, get 0.  Very long texts are scored whole.  Repeated rows get equal scores.  Null labels and
    null ids teach nothing.  With no labels, scores are a constant.  A column toxic_score of `docs` is replaced.  An empty table gives no rows.
    """
    keep = [c for c in docs.columns if c != "toxic_score" and (carry is None or c in carry)]
    model = model or fit(*sample(docs, labels, label))
    return appended(docs, keep, "toxic_score", lambda held, _: model._slice(held), most=SCORED_BYTES)


def predictions(scored: DataFrame, threshold: float = 0.3) -> DataFrame:
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= threshold).cast("int").alias("predicted"))
