"""The queries that apply each operator to its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import ann, bagminhash, language, media, mixing, packing, secrets, substrings, token_files, warc
from .common import read_table


def op1_secrets(spark, sf_dir):
    return secrets.report(read_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark, sf_dir):
    return substrings.remove_repeats(read_table(spark, sf_dir, "documents"))


def op3_media(spark, sf_dir):
    return media.media_columns(read_table(spark, sf_dir, "documents"))


def op4_token_files(spark, sf_dir):
    return token_files.token_output(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op5_mixing(spark, sf_dir):
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op6_warc(spark, sf_dir):
    return warc.round_trip(read_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_bagminhash(spark, sf_dir):
    return bagminhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_language(spark, sf_dir):
    return language.identify(read_table(spark, sf_dir, "documents"))


def op9_packing(spark, sf_dir):
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


def op10_neighbours(spark, sf_dir):
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {f.__name__: f for f in (op1_secrets, op2_suffix_dedup, op3_media, op4_token_files, op5_mixing, op6_warc, op7_bagminhash, op8_language, op9_packing, op10_neighbours)}
#: Every 50-byte window of every text by its MD5 number, and the runs of those that a smaller doc_id has too.
REPEATS_SQL = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, doc_id, i, md5_number(array_slice(b, i + 1, i + 50)) AS s FROM (SELECT r, doc_id, b, unnest(range(0, greatest(0, octet_length(b) - 49))) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING count(*) > 1),
hits AS (SELECT r, i FROM w JOIN m USING (s) WHERE first < doc_id),
marked AS (SELECT r, i, (i > lag(i, 1, -100) OVER (PARTITION BY r ORDER BY i) + 50)::INT AS new FROM hits),
runs AS (SELECT r, min(i) AS a, max(i) + 50 AS z FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM marked) GROUP BY r, run),
pieces AS (SELECT r, a, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS since, z FROM runs),
cut AS (SELECT r, sum(z - a) AS removed, count(*) AS spans, string_agg(hex(array_slice(b, since + 1, a)), '' ORDER BY a) || hex(array_slice(any_value(b), max(z) + 1, octet_length(any_value(b)))) AS kept FROM pieces JOIN d USING (r) GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, CASE WHEN removed IS NULL THEN sha256(b) ELSE sha256(unhex(kept)) END AS kept_sha256 FROM d LEFT JOIN cut USING (r)"""
WARC_SQL = """WITH d AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS s FROM pages), f AS (SELECT s, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY s)
SELECT page_id, n AS payload_bytes, d.s AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to FROM d LEFT JOIN f ON f.s = d.s AND n >= 100"""
#: All pairs of texts that share a run of five words, and the closure of those at 0.8 and more.
NEAR_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
c AS (SELECT doc_id, md5_number(s) AS s, count(*) AS n FROM g GROUP BY ALL),
t AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS same FROM c x JOIN c y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN t x ON x.doc_id = a JOIN t y ON y.doc_id = b WHERE same::DOUBLE / (x.n + y.n - same)::DOUBLE >= 0.8::DOUBLE),
reach AS (SELECT doc_id AS node, doc_id AS label FROM d UNION SELECT b, label FROM reach JOIN links ON a = node)
SELECT node AS doc_id, min(label) AS class_id, min(label) = node AS kept FROM reach GROUP BY node"""
SQL: dict[str, str] = {"op2_suffix_dedup": REPEATS_SQL, "op6_warc": WARC_SQL, "op7_bagminhash": NEAR_SQL}
