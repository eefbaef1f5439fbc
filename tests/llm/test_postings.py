"""What the Jaccard join sends, and what the pipeline's second stage shuffles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracery.llm import jaccard as J


@pytest.mark.parametrize("x", [[], [5], [7, 7, 7], [2**62, 0, -1, 2**62 - 1, -(2**63), 2**63 - 1], list(range(10**12, 10**12 + 500))])
@pytest.mark.parametrize("steps", [True, False])
def test_squeezed_integers_come_back(x, steps):
    x = np.array(x, np.int64)
    assert (J._unsqueezed(J._squeezed(x, steps), steps) == x).all()


def test_a_posting_takes_as_many_bytes_with_many_buckets():
    """The number of buckets grows with the corpus, up to a bucket for each token of a document."""
    r = np.random.default_rng(3)
    ids, sizes = r.permutation(np.arange(10**9, 10**9 + 2000)), r.integers(20, 900, 2000)
    tok, at = r.integers(0, 2**63, 400_000).astype(np.uint64), np.repeat(np.arange(2000), 200)
    few, many = (J._packed(tok, at, ids, sizes, 75, n, False).nbytes / len(tok) for n in (32, 1024))
    assert many < 12 and many < 1.6 * few


def test_texts_stay_where_they_are(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"one two three four five six seven {i // 2}", "s", 10) for i in range(40)] + [(3, "one two", "s", 7), (3, "one two", "s", 7), (None, "one two", "s", 7)], "doc_id long, text string, source string, n_chars long")
    once = docs.where("doc_id <> 3 or doc_id is null")
    out = corpus_pipeline.one_of_each_group(spark, once, str(tmp_path))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.select("doc_id").collect()) == [*((False, i) for i in range(0, 40, 2)), (True, 0)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
    # of a repeated doc_id with other texts, each text stays once if the id is the first of its group
    out = corpus_pipeline.one_of_each_group(spark, docs.where("doc_id is null or doc_id = 3").withColumn("text", F.when(F.col("doc_id").isNull(), None).otherwise(F.col("text"))), str(tmp_path))
    assert sorted(map(str, (tuple(r) for r in out.select("doc_id", "text").collect()))) == ["(3, 'one two three four five six seven 1')", "(3, 'one two')", "(None, None)"]


def test_chance_tokens_send_no_texts_across_a_block(spark, monkeypatch):
    """Documents that share a few tokens with each of some others are one block; only those that share as many as a link takes go to another's cell."""
    rows, met = {}, J.saved
    monkeypatch.setattr(J, "saved", lambda df, tag: rows.setdefault(tag, met(df, tag)))
    n = 600
    passage = lambda i, j: " ".join(f"w{min(i, j)}x{max(i, j)}x{k}" for k in range(8))
    text = lambda i: " ".join(passage(i, (i + d) % n) for d in (-3, -2, -1, 1, 2, 3))
    docs = [(i, text(i)) for i in range(n)] + [(n + i, f"{text(17 * i)} end{i}") for i in range(30)]
    out = J.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), cell=16, sketch_bits=4)
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == {i: i if i < n else 17 * (i - n) for i in range(n + 30)}
    assert rows["of-block"].count() > n / 2 and rows["of-block"].groupBy("block").count().agg(F.max("count")).first()[0] > n / 2
    assert 0 < rows["reach"].count() < n / 2
