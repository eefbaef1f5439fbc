"""Spelling variants against brute force over all pairs of words, and the automata alone."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracery.llm import spelling

DOCS = "doc_id long, text string, lang string"
rng = random.Random(8)
STEMS = ["station", "nations", "aaaaaaaa", "hahahahaha", "éclairs", "weather", "whether", "Straßen", "abcdefgh", "bcdefghi"]


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def lower(w):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)


def brute(docs, times=10):
    n = Counter()
    for doc_id, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    form, out = {}, {}
    for w in n:
        own = [x for x in n if near(w, x)]
        best = min(own, key=lambda x: (-n[x], x), default=None)
        form[w] = best if own and n[best] >= times * n[w] else None
        out[w] = len(own)
    rows = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n[w], out[w], n[form[w]] if form[w] else None))
    return rows


def mangled(w):
    i = rng.randrange(len(w) + 1)
    c = rng.choice("abcdefgé" + w)
    return rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]])


@pytest.fixture(scope="module")
def docs():
    """Chains of variants, each step ten times as rare, in mixed case and with Latin-1 letters."""
    out = []
    for k in range(400):
        words = []
        for _ in range(rng.randrange(40)):
            w = rng.choice(STEMS)
            for _ in range(rng.choice([0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 2])):
                w = mangled(w)
            words.append(rng.choice([w, w.capitalize(), w + rng.choice(["", "-x", "9", "'s"])]))
        out.append((k, " ".join(words), "en"))
    return [*out, out[3], out[3], (None, "without an id, without an idea", None), (900, None, None), (901, "", "en"), (902, "stations×÷ " * 3000, "en"), (903, "q" * 50_000 + " " + "q" * 50_001, "en"), (903, "q" * 50_000 + " " + "q" * 50_001, "en")]


def got(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize(("cell", "shard"), [(spelling.CELL, spelling.SHARD), (600, 200), (1, 50)])
def test_against_brute_force(spark, docs, monkeypatch, cell, shard):
    """Also with cells so small that they are dealt anew, down to windows of one letter."""
    if cell == 1:
        docs = [d for d in docs if d[0] not in (902, 903)]
        monkeypatch.setattr(spelling, "FEW", 1)
    df = spark.createDataFrame(docs, DOCS).withColumns({"word": F.lit("x"), "n": F.lit(1), "key": F.lit(2), "back": F.lit("b"), "size": F.lit(0)}).repartition(3)
    ours = spelling.variants(df, cell=cell, shard=shard)
    assert ours.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert ours.count() == ours.select("word").distinct().count()
    assert got(ours) == brute(docs)


def test_forms_lead_on_to_roots(spark):
    text = " ".join(["abcdefg"] * 200 + ["abcdefgh"] * 20 + ["abcdefghi"] * 2)
    rows = {w: (form, root) for w, form, root, *_ in got(spelling.variants(spark.createDataFrame([(1, text, "en")], DOCS), deletes=10**10))}
    assert rows == {"abcdefg": (None, "abcdefg"), "abcdefgh": ("abcdefg", "abcdefg"), "abcdefghi": ("abcdefgh", "abcdefg")}


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], DOCS)).count() == 0


def test_cells_to_deal_anew_by_a_shuffle(spark, docs, monkeypatch):
    monkeypatch.setattr(spelling, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(spelling, "FEW", 3)
    few = docs[:120]
    assert got(spelling.variants(spark.createDataFrame(few, DOCS), cell=300, shard=200)) == brute(few)


def test_automata_number_their_words():
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(150)})
    root = spelling.automaton(words)
    assert root.size == len(words)
    assert [spelling._number(root, 0, w, 0) for w in words] == list(range(len(words)))
    assert spelling._number(root, 0, "abc", 0) == -1
    states, todo = {}, [root]
    while todo:
        s = todo.pop()
        if id(s) not in states:
            states[id(s)] = (s.final, tuple(sorted((c, id(t)) for c, (t, _) in s.next.items())))
            todo += [t for t, _ in s.next.values()]
    assert len(set(states.values())) == len(states)  # no two states are alike: it is minimal
    for w in words[::5]:
        found = spelling.completions(root, w, 0, len(w))
        assert sorted(found) == [i for i, x in enumerate(words) if near(w, x)]
