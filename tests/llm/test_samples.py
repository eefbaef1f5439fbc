"""Bounded samples where a document is as long as the bound."""

import random

import numpy as np
import pytest

from tracery.llm import quality, toxicity
from tracery.llm.common import hashed_words, mix, word_table


@pytest.mark.parametrize("name", ["toxic", "quality"])
def test_long_documents_leave_room_for_the_others(spark, monkeypatch, name):
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", (1000, 1000))
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 1000)
    texts = [(i, ("x" * 990 if i % 3 == 0 else "y" * 10), "en", "web") for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(60)], f"doc_id long, {name} int")
    if name == "toxic":
        out, known, _ = toxicity.sample(docs, labels, name)
    else:
        rows = quality.samples(docs, labels, name)[0]
        out, known = [r[0] for r in rows], [r[-1] for r in rows]
    short = docs.where(~toxicity.held_out()).where("doc_id % 3 > 0").count()
    assert sum(len(t) == 10 for t in out) == short and set(known) == {0, 1}


def test_surest_pages_of_a_table_are_those_of_all_pages(spark):
    """The rounds over a table against the same over its pages at hand: labelled and held-out rows apart, equal pages once."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.randint(1, 30))), "en", f"s{i % 3}") for i in range(80)]
    rows += [(200 + i, *r[1:]) for i, r in enumerate(rows[:20])] + [(None, "no id", "en", None), (300, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    labels = spark.createDataFrame([(i, i // 4 % 2) for i in range(0, 80, 4)] + [(1, None)], "doc_id long, quality int")
    known, surest = quality.samples(docs, labels, "quality")
    held = {r["doc_id"] for r in docs.where(toxicity.held_out()).collect()}
    marked = {i for i in range(0, 80, 4)}
    pages = sorted({(r[1] or "", r[2], r[3]) for r in rows if r[0] not in held and r[0] not in marked}, key=str)
    texts = [k[0].encode() for k in known]
    y = np.array([k[3] for k in known], float)
    views = [quality.Linear.fit(quality.content_features(texts), y, 2.0), quality.Linear.fit(quality.metadata_features(texts, [k[1] for k in known], [k[2] for k in known]), y, 1.0)]
    ours, theirs = surest(views, [4, 6], [5, 3]), quality.among(pages)(views, [4, 6], [5, 3])
    for v in (0, 1):
        for a, b in zip(ours[v], theirs[v], strict=True):
            assert a.shape == b.shape and np.allclose(np.sort(a.sum(axis=1)), np.sort(b.sum(axis=1)), rtol=1e-4)


def test_calibration_sees_no_document_that_taught():
    """Two thirds teach that good is 1; the third that calibrates says the opposite, and so allows no slope."""
    known = [(f"{'good' if (i % 2) == (i % 3 != 2) else 'bad'} " * 20, "en", "s", i % 2) for i in range(90)]
    assert quality.co_train(known, None).calibration[0][1] == 0
    same = [(f"{'good' if i % 2 else 'bad'} " * 20, "en", "s", i % 2) for i in range(90)]
    assert quality.co_train(same, None).calibration[0][1] > 0


def test_scores_against_brute_force():
    """Word by word and gram by gram: segments of six words, the mean of their subwords' weights, and the two highest."""
    rng = np.random.default_rng(4)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS), -0.3, (0.1, 1.2, 0.4))
    texts = ["", " .,; ", "One", "It's A-b c1 d22 \u00e9\u00e9n", "x " * 25, " ".join("".join(rng.choice(list("abcXYZ")) for _ in range(rng.integers(1, 9))) for _ in range(70))]

    def bucket(gram):
        h = 0
        for k, c in enumerate(gram):
            h = (h * 0x100000001B3 + c + 1) % 2**64 if k else c + 1
        return int(mix(np.array([h * int(toxicity._SALT[len(gram)]) % 2**64], np.uint64))[0]) % toxicity.BUCKETS

    def brute(text):
        words = text.encode().translate(toxicity._LOWER).split()
        z = []
        for k in range(0, len(words), toxicity.SEGMENT):
            own = []
            for w in words[k : k + toxicity.SEGMENT]:
                own.append((int(hashed_words([w], word_table(b" \n"))[0][0]) >> 20) % toxicity.BUCKETS)
                marked = b" " + w + b" "
                own += [bucket(marked[i : i + n]) for n in toxicity.GRAMS for i in range(len(marked) - n + 1)]
            z.append(np.mean(model.weight[own]) + model.bias)
        if not z:
            return 0.0
        top = sorted(z, reverse=True)
        second = top[1] if len(top) > 1 else top[0]
        return 1 / (1 + np.exp(-(0.1 + 1.2 * top[0] + 0.4 * second)))

    assert np.allclose(model.score(texts), [brute(t) for t in texts])
