"""The corpus queries: one opN_<name> for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


OP7 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT link.b, reach.c FROM reach JOIN link ON link.a = reach.doc_id)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenids import digest, write_matrices

    return digest(write_matrices(table(spark, sf_dir, "documents")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination, digest

    return digest(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"]))


OP5 = rf"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k:k + 9], ' ') AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS k FROM i WHERE len(w) > 0)),
pos AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d),
occ AS (
  SELECT pos.doc_id, pos.k, win.n, win.item FROM pos JOIN win ON win.win = array_to_string(pos.w[pos.k:pos.k + 9], ' ') AND win.n = 10 AND pos.k + 9 <= len(pos.w)
  UNION ALL
  SELECT pos.doc_id, pos.k, win.n, win.item FROM pos JOIN win ON win.n < 10 AND pos.k + win.n - 1 <= len(pos.w) AND win.win = array_to_string(pos.w[pos.k:pos.k + win.n - 1], ' ')),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS p FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import predictions, toxicity

    return predictions(toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"]), threshold=0.3)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digest, scan

    return digest(scan(table(spark, sf_dir, "documents")))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents"), 16)


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), k=20, every=20)


OP8 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archives, write_archives

    back = read_archives(write_archives(table(spark, sf_dir, "pages"), least_bytes=0))
    return back.selectExpr("cast(page_id as long) page_id", "payload_bytes", "payload_digest", "record_type", "cast(refers_to as long) refers_to")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variants

    return variants(table(spark, sf_dir, "documents"))


#: The crc32 is made from its table, which a rule makes; near words are joined by what is left of them without one letter.  form_n is a double because pandas
#: reads whole numbers with nulls as doubles from Spark alone.
OP11 = rf"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
raw AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]{{7,}}')) AS w FROM documents),
runs AS (SELECT w, count(*) AS k, hex(encode(concat(doc_id, ':', w))) AS b FROM raw GROUP BY doc_id, w),
hashed AS (
  SELECT w, k, xor(4294967295, list_reduce(list_transform(range(1, len(b), 2), lambda i: CAST('0x' || b[i:i + 1] AS BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295)) AS h
  FROM runs, crc),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN concat(substr(w, 1, h % length(w)), substr(w, h % length(w) + 2)) ELSE w END AS word, k FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
less AS MATERIALIZED (SELECT word, length(word) AS m, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other FROM less a JOIN less b ON a.i = b.i AND a.m = b.m AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT less.word, words.word FROM less JOIN words ON words.word = rest
  UNION SELECT words.word, less.word FROM less JOIN words ON words.word = rest),
best AS (
  SELECT near.word, other, o.n AS n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, other) AS r FROM near JOIN words o ON o.word = other),
form AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.n >= 10 * w.n THEN b.other END AS form, CASE WHEN b.n >= 10 * w.n THEN b.n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word AND b.r = 1),
chain AS (SELECT word, word AS here, 0 AS steps FROM form UNION ALL SELECT chain.word, form.form, steps + 1 FROM chain JOIN form ON form.word = chain.here WHERE form.form IS NOT NULL),
root AS (SELECT word, arg_max(here, steps) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, CAST(form_n AS DOUBLE) AS form_n FROM form JOIN root USING (word)
"""


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import digest, languages

    return digest(languages(table(spark, sf_dir, "documents"), carry=["doc_id"]))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import delta_lloyd, digest

    return digest(delta_lloyd(table(spark, sf_dir, "embeddings")))


def _lloyd(rounds: int) -> str:
    """Plain Lloyd, round by round."""
    out = """
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS cluster, v AS m FROM (SELECT v, sha256(concat('2:', vec_id)) AS h FROM v ORDER BY h, v LIMIT 40)),"""
    for i in range(rounds + 1):
        out += f"""
a{i} AS MATERIALIZED (
  SELECT vec_id, v, cluster, d FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) AS r
    FROM (SELECT vec_id, v, cluster, list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i]))) AS d FROM v, c{i})) WHERE r = 1),"""
        if i < rounds:
            out += f"""
s{i} AS (SELECT cluster, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{i}, range(1, 65) r(i) GROUP BY cluster, i),
m{i} AS (SELECT cluster, list((s - (s % n + n) % n) // n ORDER BY i) AS m FROM s{i} GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN m{i} USING (cluster)),"""
    return out.rstrip(",") + f"""
SELECT vec_id, cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.m, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c USING (cluster)
"""


OP13 = _lloyd(5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name in queries() if (sql := globals().get(name.split("_")[0].upper()))}
