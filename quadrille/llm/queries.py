"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

import importlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, asof, chat, mixing, neardup, negatives, sharding, spm, substring, tokens, topk, toxicity, urls
from ._common import written

SPM_MODEL = "piece_bpe_32k.model"
BYTE_BPE = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filtered(spark, _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "verdict")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = spm.encoded(_table(spark, sf_dir, "documents"), public_tokenizers.path(SPM_MODEL))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
        F.element_at("ends", -1).alias("n_bytes"), F.xxhash64("begins", "ends").alias("spans_xxh64"),
    )


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_chat_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotated(_table(spark, sf_dir, "conversations"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.marked(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learned(docs, _table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = written(tokens.encoded(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE)), "token-files")
    return tokens.decoded(files, ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sharding.sharded(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    crc = F.crc32(F.coalesce("document.text", F.lit("")).cast("binary"))
    return done.select("document.doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", label), F.col("id") % 100 == 0)


def op13_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    digits = lambda k: F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 8 * k + 1, 8), 16, 10).cast("long")
    event = F.pmod(digits(0), F.lit(50000))
    versions = docs.select("doc_id", "source", "n_chars", "lang", event.alias("event"), (event - 60 + F.pmod(digits(1), F.lit(600))).alias("arrival"), (event + F.pmod(digits(2), F.lit(900))).alias("expiry"))
    # A document's source; of rows that repeat an id, the least.
    sources = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min("source").alias("source"))
    known = labels.filter("doc_id is not null").select("doc_id").join(sources, "doc_id", "left")
    asked = known.unionByName(labels.filter("doc_id is null").select("doc_id", F.lit(None).cast("string").alias("source"))).withColumn("t", F.pmod(digits(3), F.lit(50000)))
    found = asof.point_in_time(asked, versions, "source", "t", "event", "arrival", "expiry", "doc_id", ("n_chars", "lang"))
    age = F.col("question.t") - F.col("version.event")
    state = asof.status(age, 120)
    rows = found.select("question.doc_id", "question.t", F.col("version.id").alias("version_id"), age.alias("age"), state.alias("status"), "version.n_chars", "version.lang")
    return rows.select("doc_id", "t", "version_id", "age", "status", *(F.when(F.col("status") == "fresh", F.col(c)).alias(c) for c in ("n_chars", "lang")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_exact_top_k, op2_url_filters, op3_sentencepiece, op4_nearest_neighbours, op5_near_duplicates, op6_source_mix, op7_chat_formats, op8_substring_dedup, op9_toxicity, op10_token_files, op11_sharding, op12_hard_negatives, op13_point_in_time, pipeline]
    return {f.__name__: f for f in found}


TOP_K_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""

CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS k, turn, role, text FROM conversations
), p AS (
  SELECT DISTINCT conv_id AS p, role AS speaker FROM conversations WHERE role IS NOT NULL AND role <> 'system'
), r AS (
  SELECT conv_id, speaker, k, turn, role,
    CASE WHEN role = speaker THEN '<|im_start|>assistant' || chr(10) WHEN role = 'system' THEN '<|im_start|>system' || chr(10)
         ELSE '<|im_start|>user name=' || coalesce(role, 'unknown') || chr(10) END AS header,
    coalesce(text, '') || '<|im_end|>' || chr(10) AS body
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.p
), o AS (
  SELECT *, CAST(sum(length(header) + length(body)) OVER (PARTITION BY conv_id, speaker ORDER BY k) AS BIGINT) AS e FROM r
)
SELECT conv_id, speaker, k, turn, role, header || body AS segment, e - length(header) - length(body) AS seg_start,
  CASE WHEN role = speaker THEN e - length(body) ELSE e END AS mask_start, e AS mask_end
FROM o
"""


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    (CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496 AS u,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS solid, length(regexp_replace(text, '[\x20\x09-\x0D\pL]+', '', 'g')) AS marks
  FROM documents
), k AS (
  SELECT doc_id, source, size, -ln(u) / greatest(0.05::DOUBLE, CASE WHEN solid > 0 THEN (solid - marks) / solid ELSE 0.05::DOUBLE END) AS key FROM d
), z AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight FROM z
), c AS (
  SELECT *, 3 * source_size AS cap, 3 * source_size / weight AS ratio FROM w
), l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
    / CAST(sum(weight) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS own FROM c
), m AS (
  SELECT arg_min(own, ratio) FILTER (ratio > own) AS level FROM l
), t AS (
  SELECT source, source_size, CASE WHEN ratio > level THEN level * weight ELSE CAST(cap AS DOUBLE) END AS target FROM l, m
), e AS (
  SELECT k.*, source_size, target, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS epochs FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
), s AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e
)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, floor(target - epochs * source_size) - before)) AS BIGINT) AS taken FROM s
"""

#: Rules from all subsets of each labelled page's tokens.
URL_SQL = r"""
WITH p AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), t AS (
  SELECT *, list_sort(list_distinct(list_concat(['h:' || x FOR x IN string_split(host, '.') IF x <> ''],
    ['p:' || regexp_replace(lower(x), '[0-9]+', '0', 'g') FOR x IN string_split(path, '/') IF x <> '']))) AS items FROM p
), b AS (
  SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
), s AS (
  SELECT items, CAST(quality = 0 AS INTEGER) AS bad FROM t JOIN b ON page_id = doc_id WHERE url IS NOT NULL
), u AS (
  SELECT items, bad, unnest(range(1, CAST(1 << len(items) AS BIGINT))) AS m FROM s
), i AS (
  SELECT [items[k] FOR k IN range(1, len(items) + 1) IF (m >> (k - 1)) & 1 = 1] AS item_set, bad FROM u
), r AS (
  SELECT item_set, sum(bad) / count(*) AS c FROM i GROUP BY item_set
  HAVING sum(bad) >= greatest(10, (SELECT ceil(0.002::DOUBLE * count(*)) FROM s)) AND sum(bad) / count(*) >= 0.6::DOUBLE
), k AS (
  SELECT item_set FROM r x WHERE NOT EXISTS (SELECT 1 FROM r y WHERE len(y.item_set) < len(x.item_set) AND list_has_all(x.item_set, y.item_set) AND y.c + 0.02::DOUBLE >= x.c)
), f AS (
  SELECT DISTINCT url FROM t JOIN k ON list_has_all(items, item_set)
), g AS (
  SELECT p.*, f.url IS NOT NULL AS fired, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p LEFT JOIN f ON p.url = f.url
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN fired THEN 'block' ELSE 'allow' END AS verdict FROM g
"""

#: Windows by their words, written out.
SUBSTRING_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), p AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13
), h AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS win FROM p
), o AS (
  SELECT win, min(doc_id) AS owner FROM h GROUP BY win HAVING min(doc_id) < max(doc_id)
), g AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM h JOIN o USING (win) WHERE doc_id > owner
), r AS (
  SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id
), k AS (
  SELECT d.doc_id, w, coalesce(len(gone), 0) AS n, CASE WHEN gone IS NULL THEN w ELSE [w[i] FOR i IN list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i))] END AS kept FROM d LEFT JOIN r USING (doc_id)
)
SELECT doc_id, len(w) AS n_words, CAST(n AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""

NEGATIVES_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM e a JOIN e c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER w AS k FROM s WHERE same
  WINDOW w AS (PARTITION BY anchor_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score, CAST(k AS INTEGER) AS positive_rank
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, k ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""

POINT_SQL = """
WITH h AS (
  SELECT *, sha256(CAST(doc_id AS VARCHAR)) AS x FROM documents
), n AS (
  SELECT *, CAST('0x' || substr(x, 1, 8) AS BIGINT) % 50000 AS event, CAST('0x' || substr(x, 9, 8) AS BIGINT) % 600 AS b, CAST('0x' || substr(x, 17, 8) AS BIGINT) % 900 AS c FROM h
), v AS (
  SELECT source, doc_id, n_chars, lang, event, event - 60 + b AS arrival, event + c AS expiry FROM n
), q AS (
  SELECT row_number() OVER () AS i, doc_id, source, CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 25, 8) AS BIGINT) % 50000 AS t
  FROM labels LEFT JOIN (SELECT doc_id, min(source) AS source FROM documents GROUP BY doc_id) USING (doc_id)
), f AS (
  SELECT q.i, q.doc_id, q.t, v.doc_id AS version_id, q.t - event AS age, CASE WHEN event IS NULL THEN 'none' WHEN q.t - event > 120 THEN 'stale' ELSE 'fresh' END AS status, n_chars, lang
  FROM q LEFT JOIN v ON q.source = v.source AND event <= t AND arrival <= t AND t < expiry
  QUALIFY row_number() OVER (PARTITION BY q.i ORDER BY event DESC NULLS LAST, arrival DESC, v.doc_id DESC) = 1
)
SELECT doc_id, t, version_id, age, status, CASE WHEN status = 'fresh' THEN n_chars END AS n_chars, CASE WHEN status = 'fresh' THEN lang END AS lang FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_top_k": TOP_K_SQL, "op2_url_filters": URL_SQL, "op6_source_mix": MIX_SQL, "op7_chat_formats": CHAT_SQL, "op8_substring_dedup": SUBSTRING_SQL, "op12_hard_negatives": NEGATIVES_SQL, "op13_point_in_time": POINT_SQL}
