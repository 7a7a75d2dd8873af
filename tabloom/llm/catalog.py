"""Registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.catalog.registry import table
from tabloom.llm import bpe, chat, jaccard, licenses, mixing, negatives, phrases, quality, secrets, sharding, simhash, topk, warc
from tabloom.llm.common import TEXT_KEY
from tabloom.operators.shared import scratch_path

QUERIES, ORACLES = {}, {}

RANKS = "byte_bpe_multi_50k.tiktoken"
SHARDS = [1.0] * 8


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


_TEMPLATES = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(licenses.TEMPLATES))
_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"
_SHINGLES = "list_transform(range(greatest(len(w) - 4, 0)), lambda i: array_to_string(w[i + 1:i + 5], ' '))"


#: Every window against every template, without bands.
@query("op1_license_scan", f"""
WITH t AS (SELECT template, license, list_distinct({_SHINGLES}) AS s, (2 ** ceil(log2(len({_SHINGLES}))))::BIGINT AS size
  FROM (SELECT template, license, {_WORDS} AS w FROM (VALUES {_TEMPLATES}) v(template, license, text))),
d AS (SELECT doc_id, {_SHINGLES} AS h FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
touched AS (SELECT d.* FROM d, (SELECT flatten(list(s)) AS every FROM t) WHERE list_has_any(h, every)),
win AS (SELECT doc_id, size, pos, h[pos + 1:pos + 2 * size] AS win FROM (
  SELECT doc_id, h, size, unnest(range(0, size * (greatest(ceil(len(h) / size)::BIGINT - 2, 0) + 1), size)) AS pos FROM touched, (SELECT DISTINCT size FROM t))),
hit AS (SELECT doc_id, license, template, pos, len(list_intersect(win, s)) / len(s) AS c, len(list_intersect(win, s)) * 100 >= 75 * len(s) AS good FROM win JOIN t USING (size))
SELECT doc_id, license, template, max(c) AS containment, count(*) AS n_windows, min(pos) AS first_word FROM hit WHERE good GROUP BY ALL""")
def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


@query("op2_byte_bpe")
def byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_documents(table(spark, folder, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


#: CRC-32 over the bytes of the text: a table of 256 entries by eight halvings, then a fold.
CRC_SQL = """
crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t),
"""


@query("op3_rendezvous_shards", f"""
WITH {CRC_SQL} sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, hex(encode(coalesce(text, ''))) AS x FROM documents),
summed AS (
  SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(size - 1), lambda i: ('0x' || substr(x, (2 * i + 1)::BIGINT, 2))::BIGINT)),
    lambda c, b: xor(t[(xor(c, b) % 256 + 1)::INT], c // 256))) AS text_crc32 FROM sized, crc_table),
scored AS (
  SELECT doc_id, s, -1.0 / ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null:') || '/' || s), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) AS score
  FROM (SELECT DISTINCT doc_id FROM documents), range(9) r(s)),
chosen AS (SELECT doc_id, max_by(s, score) FILTER (s < 8) AS shard, max_by(s, score) AS grown_shard FROM scored GROUP BY doc_id)
SELECT d.doc_id, d.size, d.text_crc32, 'key' AS law, c.shard::INT AS shard,
  row_number() OVER (PARTITION BY c.shard ORDER BY d.doc_id NULLS FIRST, d.text_crc32, d.size) - 1 AS slot, c.grown_shard::INT AS grown_shard
FROM summed d JOIN chosen c ON d.doc_id IS NOT DISTINCT FROM c.doc_id""")
def rendezvous_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents"), SHARDS)


@query("op4_secret_scan")
def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(table(spark, folder, "documents")).drop("_tl_spans", "_tl_text")


@query("op5_quality_rules")
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents"), table(spark, folder, "labels")).drop(*TEXT_KEY)


@query("op6_top_inner_products", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def top_inner_products(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op7_chat_snapshots", """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place FROM t),
c AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY place) AS turns FROM p GROUP BY conv_id),
kept AS (SELECT conv_id FROM c a WHERE NOT EXISTS (
  SELECT 1 FROM c b WHERE b.turns[1:len(a.turns)] = a.turns AND (len(b.turns) > len(a.turns) OR b.conv_id < a.conv_id)))
SELECT conv_id, (place // 64)::INT AS part, count(*) AS n_turns,
  string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY place) AS rendered
FROM p JOIN kept USING (conv_id) GROUP BY ALL""")
def chat_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return chat.collapse(table(spark, folder, "conversations"))


@query("op8_jaccard_components")
def jaccard_components(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, folder, "documents"))


@query("op9_mix_sources")
def mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


@query("op10_warc_archive", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS x, min(page_id) OVER (PARTITION BY b) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(x, (5 * (i // 4) + 1)::BIGINT, 5))::BIGINT // (32 ** (3 - i % 4))::BIGINT) % 32) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d""")
def warc_archive(spark: SparkSession, folder: str) -> DataFrame:
    at = scratch_path(spark, "warc")
    warc.write_archive(table(spark, folder, "pages"), at)
    read = warc.read_archive(spark, at)
    return read.selectExpr("key AS page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op11_simhash_components")
def simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_components(table(spark, folder, "documents"))


@query("op12_hard_negatives", """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score FROM v a, v c WHERE a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (SELECT anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE place <= 5 AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT * FROM n WHERE rank <= 10""")
def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label=moved)


@query("op13_phrase_collocations", """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(list_transform(
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]'),
    lambda x: regexp_extract_all(x, '[^\\x20\\x09]+'))) AS w FROM documents),
f AS (SELECT lang, k, array_to_string(words, ' ') AS phrase, words, count(*) AS a FROM (
    SELECT lang, k, unnest(list_transform(range(len(w) - k + 1), lambda i: w[i + 1:i + k])) AS words FROM p, range(1, 4) r(k)) GROUP BY ALL),
t AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
cut AS (SELECT c.lang, c.phrase, c.a, place, x.a AS l, y.a AS r, ((1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS place FROM c) c JOIN f x ON x.lang = c.lang AND x.words = c.words[:place] JOIN f y ON y.lang = c.lang AND y.words = c.words[place + 1:]),
low AS (SELECT lang, phrase, a, arg_min(l, (score, place)) AS l, arg_min(r, (score, place)) AS r, min(score) AS score FROM cut GROUP BY ALL),
longer AS (SELECT lang, part, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(words[1:2], ' '), array_to_string(words[2:3], ' ')]) AS part FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN longer ON low.lang = longer.lang AND low.phrase = longer.part WHERE most IS NULL OR 100 * most < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN t USING (lang) WHERE rank <= 2000""")
def phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))
