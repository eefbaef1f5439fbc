"""Every operator and stage on columns with clashing names, missing and null ones, repeats and empty tables; characters and texts that once went wrong."""

import time

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_llm import DOCS, SF, brute_spans, odd
from tracery.llm import centroids, decontam, jaccard, langid, packing, quality, secrets, sharding, spelling, tokenids, topk, toxicity, warc
from tracery.llm.tokens import encoder, vocabulary_path

CLASHING = ("label", "hash", "size", "key", "of_text", "row", "id", "page", "base", "spans", "cell", "rank", "count", "n", "word", "owner", "shard", "score", "held_out", "pieces", "chunks")


def clashing(df):
    return df.withColumns({c: F.lit("mine") for c in CLASHING if c not in df.columns})


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (5, 1, 1), (6, 0, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "toxicity": lambda s, d: toxicity.toxicity(d, labels(s)), "quality": lambda s, d: quality.quality(d, labels(s)), "secrets": lambda s, d: secrets.scan(d), "tokens": lambda s, d: tokenids.digest(tokenids.write_matrices(d)),
    "decontamination": lambda s, d: decontam.contamination(d, s.createDataFrame([("i", "one two three")], "item_id string, text string")), "sharding": lambda s, d: sharding.shard(d, 3), "jaccard": lambda s, d: jaccard.near_duplicates(d),
    "packing": lambda s, d: packing.pack(d), "spelling": lambda s, d: spelling.variants(d), "languages": lambda s, d: langid.languages(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_columns(spark, name):
    plain = spark.createDataFrame(odd(), DOCS)
    with_, without = (OPERATORS[name](spark, d).count() for d in (clashing(plain), plain))
    assert with_ == without
    assert OPERATORS[name](spark, clashing(plain.limit(0))).count() == 0


def test_clashing_columns_of_vectors_and_pages(spark):
    vectors = spark.createDataFrame([(i, [0.1 * i, 1.0]) for i in range(30)], "vec_id long, embedding array<float>")
    assert topk.top_k(clashing(vectors), k=2).count() == topk.top_k(vectors, k=2).count() > 0
    assert centroids.digest(centroids.delta_lloyd(clashing(vectors), dim=2)).count() == 30
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i % 3}</p>") for i in range(9)], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(clashing(pages))).count() == 9


STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", sorted(STAGES))
def test_stages_on_odd_input(spark, name):
    rows = spark.createDataFrame(odd(), DOCS)
    last = name == corpus_pipeline.STAGES[-1][0]
    out = STAGES[name](spark, clashing(rows), SF)
    assert last or out.columns == clashing(rows).columns
    ids = sorted(str(r["doc_id"]) for r in out.select("doc_id").distinct().collect())
    expected = {"jaccard_join": {"1", "2", "3", "4", "5", "None"}}.get(name, {"1", "2", "3", "4", "5", "6", "None"})
    assert set(ids) == expected
    short = rows.drop("n_chars", "lang")
    again = STAGES[name](spark, short, SF)
    assert (last or again.columns == short.columns) and again.count() == out.count()
    empty = STAGES[name](spark, rows.limit(0), SF)
    assert empty.count() == 0 and (last or empty.columns == rows.columns)


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_ids_of_all_characters_below_300(name):
    encode, whole = encoder(vocabulary_path(name)), Tokenizer.from_file(vocabulary_path(name))
    texts = [f"caf{chr(c)}b and {chr(c)}berg X{chr(c)} {chr(c)}{chr(c)}1" for c in range(1, 0x300)] + ["cafȺb and Ⱦberg", "İ İstanbul"]
    for t in texts:
        assert memoryview(encode(t)).cast("H").tolist() == whole.encode(t, add_special_tokens=False).ids, ascii(t)


def test_many_matches_take_no_square(spark):
    def took(n):
        t = f"token=abcdef{'0123456789abcdef' * 2} é " * n
        df = spark.createDataFrame([(1, t, "en", "s", 1)], DOCS)
        start = time.monotonic()
        got = secrets.digest(secrets.scan(df)).first()
        seconds = time.monotonic() - start
        assert got["n_assign"] == n and got["n_hex"] == n
        assert [x for x in got["spans"].split(",") if x.startswith(("assign", "access", "hex"))] == brute_spans(t)
        return seconds

    took(10)
    few, many = took(4_000), took(64_000)
    assert many < 16 * few + 10 and many < 40
