"""The byte network: gradients against differences, scores against a plain loop, held-out accuracy, odd input."""

import random

import numpy as np
from pyspark.sql import functions as F

from tracery.llm import langid

DOCS = "doc_id long, text string, lang string, source string"
rng = random.Random(2)
PARTS = {"aa": ["the", "ing", "shon", "wer"], "bb": ["été", "eau", "lle", "ça"], "cc": ["schn", "ung", "ß", "ücht"]}


def text(lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def docs(n=240):
    return [(i, text(lang := sorted(PARTS)[i % 3], rng.randint(8, 60)), lang, "s") for i in range(n)]


def test_held_out_accuracy(spark):
    rows = [(i, t, None if i % 7 == 3 else lang, s) for i, t, lang, s in docs()]
    truth = {r[0]: sorted(PARTS)[r[0] % 3] for r in rows}
    out = langid.digest(langid.languages(spark.createDataFrame(rows, DOCS))).collect()
    assert len(out) == len(rows)
    held = [r for r in out if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if __import__("zlib").crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)


def test_nothing_but_text_is_looked_at(spark):
    net = langid.fit([d[1].encode() for d in docs(60)], [d[2] for d in docs(60)])
    one = spark.createDataFrame([(1, text("bb", 30), "cc", "x")], DOCS)
    other = one.withColumns({"doc_id": F.lit(77), "lang": F.lit("zz"), "source": F.lit(None).cast("string")})
    a, b = (langid.languages(d, net=net).select("lang_pred", "score").first() for d in (one, other))
    assert a == b and a["lang_pred"] == "bb"


def test_odd_input(spark):
    long = text("aa", 40_000)
    odd = [(None, "no id " + text("aa", 20), None, None), (300, None, "aa", "s"), (301, "", "bb", "s"), (302, " 12 .,$ \n", "cc", "s"), (303, long, "aa", "s"), (304, "漢字かな", None, "s"), (305, "x", None, "s"), (306, "²³", None, None)]
    base = docs(90)
    df = spark.createDataFrame([*base, *odd, base[0], base[0]], DOCS).withColumns({c: F.lit("mine") for c in ("label", "key", "size", "hash", "share", "lang_pred", "held_out", "count")})
    out = langid.languages(df)
    assert set(out.columns) == {*df.columns, "score"} and out.count() == df.count()
    by_id = {r["doc_id"]: r for r in out.collect()}
    for i in (300, 301, 302, 306):
        assert (by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0)
    assert by_id[303]["lang_pred"] == "aa" and by_id[304]["lang_pred"] in PARTS and by_id[305]["lang_pred"] in PARTS
    assert by_id[300]["held_out"] == "mine"


def test_empty_table_and_nothing_to_learn(spark):
    none = spark.createDataFrame([], DOCS)
    assert langid.languages(none).count() == 0
    unknown = spark.createDataFrame([(1, "some words here", None, "s")], DOCS)
    assert [(r["lang_pred"], r["score"]) for r in langid.languages(unknown).collect()] == [("und", 0.0)]
    one = spark.createDataFrame([(i, "some words here", "aa", "s") for i in range(20)], DOCS)
    assert {(r["lang_pred"], r["score"]) for r in langid.languages(one).collect()} == {("aa", 1.0)}


def test_gradients_against_differences():
    r = np.random.default_rng(1)
    net = langid.Network.fresh(["a", "b", "c"])
    for name in ("byte", "filters", "bias", "out", "prior"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    x, _ = langid.windows([text("aa", 60).encode(), text("bb", 60).encode()])
    x, y = x[:6], np.array([0, 1, 2, 0, 1, 1])
    _, g = langid.gradients(net, x, y)
    for name, own in zip(("byte", "filters", "bias", "out", "prior"), g, strict=True):
        values = getattr(net, name)
        places = np.argwhere(np.abs(own) > np.abs(own).max() / 4)
        for at in places[r.permutation(len(places))[:4]]:
            at = tuple(at)
            old, step = values[at], 1e-6
            values[at] = old + step
            up = langid.gradients(net, x, y)[0]
            values[at] = old - step
            down = langid.gradients(net, x, y)[0]
            values[at] = old
            assert np.isclose((up - down) / (2 * step), own[at], rtol=1e-2, atol=1e-5)


def test_windows_hold_every_run_as_wide_as_a_filter():
    for n in (0, 1, 4, 5, 127, 128, 129, 251, 252, 253, 1000):
        t = bytes(97 + i % 26 for i in range(n))
        x, owner = langid.windows([b"other", t])
        own = x[owner == 1]
        assert (len(own) == 0) == (n == 0)
        joined = b"|".join(bytes(w) for w in own)
        assert all(t[i : i + 5] in joined for i in range(max(n - 4, 1)) if n)
        assert max((len(bytes(w).rstrip(b"\0")) for w in own), default=0) == min(n, langid.WINDOW)


def test_scores_against_a_plain_loop():
    net = langid.fit([d[1].encode() for d in docs(60)], [d[2] for d in docs(60)], epochs=1)
    for t in ("short éa", text("aa", 70) + " 123 ... " + text("cc", 20)):
        x, _ = langid.windows([t.encode()])
        total, weights = np.zeros(3), 0.0
        for w in x:
            v = net.byte[w].astype(float)
            h = [max(max(float((v[p : p + 5].ravel() * net.filters[:, f]).sum()) for p in range(langid.WINDOW - 4)) + net.bias[f], 0) for f in range(net.filters.shape[1])]
            z = np.array(h) @ net.out + net.prior
            letters = sum(b >= 97 for b in w.tolist()) + 1e-3
            total += letters * (z - np.log(np.exp(z).sum()))
            weights += letters
        p = np.exp(total / weights)
        best, score = net.predicted([t.encode()])
        assert best[0] == p.argmax() and np.isclose(score[0], (p / p.sum()).max(), rtol=1e-3)


def test_narrow_filters_see_no_more_than_their_width():
    net = langid.fit([d[1].encode() for d in docs(60)], [d[2] for d in docs(60)], epochs=1)
    assert (net.filters[langid._mask() == 0] == 0).all() and (net.filters[langid._mask() == 1] != 0).any()
