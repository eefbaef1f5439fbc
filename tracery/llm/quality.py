"""Quality by co-training: a classifier of the text's content and one of the page's metadata teach each other.

The two views share no feature: the content view sees hashed byte n-grams of the text, the metadata view the source, the
language and the page's shape (length, lines, line lengths).  In each round either view scores every unlabelled document and labels those that it is
surest of, for the other one to learn from.  A third of the labelled documents teach neither view nor round: on them both are calibrated in the end, and their
log-odds are added.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, bounded_sample, mix, saved, slices, text_or_empty
from .toxicity import held_out

#: Bounds of the fit: labelled documents and the length of their texts (whole documents, in the order of a hash of the id).
SAMPLE_DOCS, SAMPLE_BYTES = 3000, 6 << 20
DIM = 1 << 11
GRAMS = (1, 2, 3)
#: Rounds, and how many documents a view labels in each.
ROUNDS, HANDED = 3, 150
WIDTHS = (DIM, 16 + 64 + 5)


def content_features(texts: list[bytes]) -> np.ndarray:
    """Square roots of the shares of hashed byte n-grams; all digits count as one byte."""
    buf = np.frombuffer(b"\0\0" + b"\0\0".join(texts) + b"\0\0", np.uint8)
    doc = np.repeat(np.arange(len(texts) + 1), [*(len(t) + 2 for t in texts), 2])[: len(buf)] if texts else np.zeros(len(buf), np.int64)
    h = _KIND[buf].astype(np.uint64)
    out = np.zeros(len(texts) * DIM)
    rolled = h.copy()
    for n in range(1, max(GRAMS) + 1):
        if n > 1:
            rolled = rolled[: len(h) - n + 1] * np.uint64(0x100000001B3) + h[n - 1 :]
        whole = (buf[: len(rolled)] != 0) & (buf[n - 1 :] != 0)
        at = np.flatnonzero(whole)
        key = doc[at] * DIM + (mix(rolled[at] + np.uint64(n)) & np.uint64(DIM - 1)).astype(np.int64)
        out += np.bincount(key, minlength=len(out))
    x = out.reshape(len(texts), DIM)
    return np.sqrt(x / np.maximum(x.sum(axis=1, keepdims=True), 1))


_KIND = np.arange(1, 257, dtype=np.uint64)
_KIND[48:58] = 49


def metadata_features(texts: list[bytes], lang: list[str | None], source: list[str | None]) -> np.ndarray:
    """One-hot hashes of language and source, and the page's shape."""
    out = np.zeros((len(texts), 16 + 64 + 5))
    for i, (t, a, b) in enumerate(zip(texts, lang, source, strict=True)):
        out[i, _slot(a, 16)] = out[i, 16 + _slot(b, 64)] = 1
        lines = t.count(b"\n") + 1
        out[i, 80:] = np.log1p(len(t)), np.log1p(lines), np.log1p(len(t) / lines), t.count(b" ") / max(len(t), 1), 1.0 * (len(t) == 0)
    return out


def _slot(value: str | None, n: int) -> int:
    import zlib

    return zlib.crc32((value or "").encode()) % n


@dataclass
class Linear:
    """Logistic regression on standardised columns, by accelerated gradient steps, with a ridge."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 150) -> Linear:
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = (x - mean) / scale
        w, b, v, c = np.zeros(z.shape[1]), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), np.zeros(z.shape[1]), 0.0
        rate = 4 / (float((z**2).sum(axis=1).mean()) + ridge * 4)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ (w + 0.9 * v) + b + 0.9 * c, -30, 30))) - y
            v = 0.9 * v - rate * (z.T @ p / len(y) + ridge * w / len(y))
            c = 0.9 * c - rate * p.mean()
            w, b = w + v, b + c
        return cls(mean, scale, w, b)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w + self.b


@dataclass
class CoTrained:
    views: list[Linear]
    calibration: list[tuple[float, float]]
    prior: float

    def score(self, texts: list[str | None], lang: list[str | None], source: list[str | None]) -> np.ndarray:
        out = [self._slice(held, lang[i : i + len(held)], source[i : i + len(held)]) for i, held in slices(texts)]
        return np.concatenate(out or [np.empty(0)])

    def _slice(self, held: list[bytes], lang: list, source: list) -> np.ndarray:
        x = [content_features(held), metadata_features(held, lang, source)]
        odds = [a + b * v.logit(f) for v, (a, b), f in zip(self.views, self.calibration, x, strict=True)]
        return 1 / (1 + np.exp(-np.clip(odds[0] + odds[1] - self.prior, -30, 30)))


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    x, w = np.stack([np.ones_like(z), z], axis=1), np.array([0.0, 1.0])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-3])
        w = w - np.clip(np.linalg.solve(h, x.T @ (p - y) + 1e-3 * w), -1, 1)
    return float(w[0]), max(float(w[1]), 0.0)


RIDGE = (2.0, 1.0)


Surest = Callable[[list["Linear"], list[int], list[int]], list[tuple[list[np.ndarray], list[np.ndarray]]]]


def co_train(known: list[tuple], surest: Surest | None, rounds: int = ROUNDS, handed: int = HANDED) -> CoTrained:
    """`known`: (text, lang, source, label).  `surest` gives, for the two views and how many of either label they shall name, the features of the unlabelled
    documents with each view's lowest and highest logits, for the other view.  Each third known document is left to the calibration."""
    y = np.array([r[3] for r in known], float)
    prior = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else 0.0
    fit = np.arange(len(y)) % 3 != 2
    if len(set(y[fit].tolist())) < 2:
        none = [Linear(np.zeros(d), np.ones(d), np.zeros(d), 0.0) for d in WIDTHS]
        return CoTrained(none, [(prior, 0.0)] * 2, prior)
    x = [np.concatenate([content_features(h) for _, h in slices([r[0] for r in known])]), metadata_features([(r[0] or "").encode() for r in known], [r[1] for r in known], [r[2] for r in known])]
    learnt = [(x[v][fit], y[fit]) for v in (0, 1)]
    views = [Linear.fit(*learnt[v], RIDGE[v]) for v in (0, 1)]
    low = round(handed * (1 - y.mean()))
    for n in range(1, rounds + 1 if surest else 1):
        # what a view named in earlier rounds is among its surest again; the other view learns from all of them anew
        named = surest(views, [n * low] * 2, [n * (handed - low)] * 2)
        learnt = [(np.concatenate([x[v][fit], *named[1 - v]]), np.concatenate([y[fit], *(np.full(len(f), k) for k, f in enumerate(named[1 - v]))])) for v in (0, 1)]
        views = [Linear.fit(*learnt[v], RIDGE[v]) for v in (0, 1)]
    return CoTrained(views, [_platt(views[v].logit(x[v][~fit]), y[~fit]) for v in (0, 1)], prior)


def among(pages: list[tuple]) -> Surest:
    """`Surest` for a few pages (text, lang, source) at hand."""
    f = [np.concatenate([content_features(h) for _, h in slices([p[0] for p in pages])]), metadata_features([(p[0] or "").encode() for p in pages], [p[1] for p in pages], [p[2] for p in pages])]

    def surest(views: list[Linear], low: list[int], high: list[int]) -> list[tuple[list[np.ndarray], list[np.ndarray]]]:
        named = []
        for v in (0, 1):
            order = np.argsort(views[v].logit(f[v]), kind="stable")
            first = order[: low[v]]
            named.append((f[1 - v][first], f[1 - v][order[max(len(first), len(order) - high[v]) :]]))
        return named

    return surest


def _logits(views: list[Linear]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            texts, lang, source = (x.column(k).to_pylist() for k in range(3))
            for first, held in slices(texts):
                own = slice(first, first + len(held))
                z = [views[0].logit(content_features(held)), views[1].logit(metadata_features(held, lang[own], source[own]))]
                yield pa.RecordBatch.from_arrays([*(x.column(k).slice(first, len(held)) for k in (3, 4)), *(pa.array(v, pa.float64()) for v in z)], names=["page", "doc_id", "z0", "z1"])

    return run


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        texts, lang, source = (x.column(k).to_pylist() for k in range(3))
        for first, held in slices(texts):
            own = slice(first, first + len(held))
            f = [content_features(held), metadata_features(held, lang[own], source[own])]
            yield pa.RecordBatch.from_arrays([x.column(3).slice(first, len(held)), *(pa.array([r.astype("<f4").tobytes() for r in v], pa.binary()) for v in f)], names=["page", "f0", "f1"])


def unlabelled(docs: DataFrame, labels: DataFrame, label: str) -> Surest:
    """All rows of `docs` outside the held-out fold that have no label.  Equal pages (text, language and source) count once."""
    known = labels.where(F.col(label).isNotNull()).select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
    columns = [text_or_empty().alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")]
    pages = docs.where(~held_out()).select("doc_id", *columns).select("text", "lang", "source", F.xxhash64("text", "lang", "source").alias("page"), F.col("doc_id").cast("string").alias("doc_id"))

    def surest(views: list[Linear], low: list[int], high: list[int]) -> list[tuple[list[np.ndarray], list[np.ndarray]]]:
        # labelled rows go after the scoring, so that no text is shuffled
        scores = saved(pages.mapInArrow(_logits(views), "page long, doc_id string, z0 double, z1 double"), "logits").join(known, "doc_id", "left_anti")
        scores = saved(scores.groupBy("page").agg(F.min("z0").alias("z0"), F.min("z1").alias("z1")), "surest")
        named = []
        for v in (0, 1):
            first = [r["page"] for r in scores.orderBy(f"z{v}", "page").limit(low[v]).collect()]
            last = [r["page"] for r in scores.orderBy(F.desc(f"z{v}"), "page").limit(high[v]).collect()]
            named.append((first, [p for p in last if p not in set(first)]))
        wanted = sorted({p for ends_ in named for end in ends_ for p in end})
        found = pages.where(F.col("page").isin(wanted)).mapInArrow(_features, "page long, f0 binary, f1 binary") if wanted else None
        found = found.groupBy("page").agg(F.first("f0").alias("f0"), F.first("f1").alias("f1")).collect() if wanted else []
        have = {r["page"]: [np.frombuffer(r[f"f{v}"], "<f4").astype(float) for v in (0, 1)] for r in found}
        return [tuple(np.array([have[p][1 - v] for p in end]).reshape(len(end), WIDTHS[1 - v]) for end in named[v]) for v in (0, 1)]

    return surest


def samples(docs: DataFrame, labels: DataFrame, label: str) -> tuple[list[tuple], Surest]:
    """A bounded labelled sample of whole documents, and access to all unlabelled ones; both without the held-out fold."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    taught = docs.select("doc_id", text_or_empty().alias("text"), "lang", "source").join(F.broadcast(few), "doc_id")
    rows = bounded_sample(taught, SAMPLE_DOCS, lambda _: SAMPLE_BYTES, lambda r: None, lambda r: r["label"], "quality-sample")
    return [(r["text"], r["lang"], r["source"], r["label"]) for r in rows], unlabelled(docs, labels, label)


def quality(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None, label: str = "quality", least: float = 0.5, model: CoTrained | None = None) -> DataFrame:
    """The columns of `docs` (of these, `carry` if given), quality_score from 0 to 1 and keep (quality_score >= `least`), for each row.

    `docs` has doc_id, text, lang and source; null texts count as empty, null lang and source as a value of their own.  `labels` (doc_id, quality
    0/1) teach the model, but for rows of the held-out fold; conflicting labels count as 0.  All other rows outside the fold are unlabelled ones
    of the co-training.  Very long texts are scored whole.  Repeated rows get equal scores.  With labels of one class
    or none the score is a constant.  Columns of `docs` with the new names are replaced.  An empty table gives no rows.
    """
    keep = [c for c in docs.columns if c not in ("quality_score", "keep") and (carry is None or c in carry)]
    model = model or co_train(*samples(docs, labels, label))

    def score(held: list[bytes], part: pa.RecordBatch) -> np.ndarray:
        return model._slice(held, *(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("lang", "source")))

    return appended(docs, keep, "quality_score", score, ("lang", "source")).withColumn("keep", F.col("quality_score") >= least)
