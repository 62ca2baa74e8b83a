"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, license_scan, mixing, quality, simhash, token_count, topk, toxicity, warc_fixity
from .common import table

#: Target weights of the sources, as tickets; all others share one ticket.
TICKETS = {f"src{k}": 6 if k == 0 else 5 if k < 8 else 4 for k in range(20)}

#: The base phrases of op4's contract and their labels.
LICENSE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: The operator's templates; "the mit license" without "under" is no base place, but the method knows it.
LICENSE_TEMPLATES = (*license_scan.TEMPLATES, ("mit", "the mit license"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(table(spark, sf_dir, "documents"), LICENSE_PHRASES, LICENSE_TEMPLATES)


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc_fixity.audit(warc_fixity.catalogue(pages), warc_fixity.catalogue(warc_fixity.damaged(pages)))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"), TICKETS)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_token_counts, op2_toxicity, op3_bpe, op4_license_scan, op5_warc_fixity, op6_simhash, op7_mixing, op8_exact_dedup, op9_top_k, op10_quality)
    return {f.__name__: f for f in found}


_OP5 = """
WITH crlf AS (SELECT chr(13) || chr(10) AS e),
pair AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, false AS b FROM pages
  UNION ALL
  SELECT page_id, coalesce(url, ''), coalesce(CASE WHEN page_id % 97 = 3 THEN '#' || substring(html, 2)
    WHEN page_id % 389 = 11 THEN substring(html, 1, length(html) // 2) ELSE html END, ''), true FROM pages),
rec AS (
  SELECT page_id, b, 'WARC/1.0' || e || 'WARC-Type: response' || e || 'WARC-Record-ID: <urn:page:' || page_id || '>' || e ||
    'WARC-Target-URI: ' || url || e || 'Content-Type: text/html' || e || 'Content-Length: ' || strlen(html) || e || e || html || e || e AS r
  FROM pair, crlf),
slim AS (SELECT page_id, b, page_id // 1024 AS file, strlen(r)::BIGINT AS n_bytes, sha256(r) AS sha256 FROM rec),
cat AS (
  SELECT *, row_number() OVER w - 1 AS seq, (sum(n_bytes) OVER w)::BIGINT - n_bytes AS byte_offset
  FROM slim WINDOW w AS (PARTITION BY b, file ORDER BY page_id, sha256))
SELECT x.page_id, x.byte_offset, x.n_bytes, x.sha256, x.file, x.seq,
  CASE WHEN x.sha256 <> y.sha256 THEN 'altered' WHEN x.byte_offset <> y.byte_offset THEN 'moved' ELSE 'ok' END AS status
FROM cat x JOIN cat y ON NOT x.b AND y.b AND x.file = y.file AND x.seq = y.seq
"""

_OP8 = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""

_OP9 = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.n, a.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.n <> b.n),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


_OP7 = f"""
WITH RECURSIVE
t(s, w) AS (VALUES {', '.join(f"('{s}', {w})" for s, w in (TICKETS | {mixing.REST: 1}).items())}),
d AS (
  SELECT doc_id, source, coalesce(t.s, '{mixing.REST}') AS stream, row_number() OVER (PARTITION BY coalesce(t.s, '{mixing.REST}') ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS pos
  FROM documents LEFT JOIN t ON t.s = source AND t.s <> '{mixing.REST}'),
c AS (SELECT stream, max(pos) // {mixing.BLOCK} + 1 AS n FROM d GROUP BY stream),
p AS (SELECT list({{'s': t.s, 'w': t.w::BIGINT, 'n': c.n::BIGINT}} ORDER BY t.s) AS p FROM t JOIN c ON c.stream = t.s),
-- one slot after the other: of the blocks that the ideal mix has begun, the one that it ends first
sim(slot, st, got) AS (
  SELECT -1::BIGINT, list_transform(p, lambda x: {{'s': x.s, 'w': x.w, 'n': x.n, 'k': 0::BIGINT}}), {{'s': '', 'b': 0::BIGINT}} FROM p WHERE p IS NOT NULL
  UNION ALL
  SELECT slot + 1, list_transform(st, lambda x: CASE WHEN x.s = best THEN {{'s': x.s, 'w': x.w, 'n': x.n, 'k': x.k + 1}} ELSE x END), {{'s': best, 'b': list_filter(st, lambda x: x.s = best)[1].k}}
  FROM (
    SELECT slot, st, list_min(list_transform(
      list_filter(st, lambda x: x.k < x.n AND list_sum(list_transform(p, lambda q: least(q.n * x.w, q.w * x.k)))::BIGINT // x.w <= slot + 1),
      lambda x: {{'d': (list_sum(list_transform(p, lambda q: least(q.n * x.w, q.w * (x.k + 1))))::BIGINT + x.w - 1) // x.w,
        'e': list_sum(list_transform(p, lambda q: least(q.n * x.w, q.w * (x.k + 1))))::BIGINT % x.w = 0, 'w': -x.w, 's': x.s}})).s AS best
    FROM sim, p WHERE len(list_filter(st, lambda x: x.k < x.n)) > 0)),
slots AS (SELECT slot, got.s AS stream, got.b AS block_no FROM sim WHERE slot >= 0)
SELECT doc_id, source, d.stream, pos // {mixing.BLOCK} AS block_no, slot, pos % {mixing.BLOCK} AS place
FROM d JOIN slots ON slots.stream = d.stream AND slots.block_no = pos // {mixing.BLOCK}
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_mixing": _OP7, "op5_warc_fixity": _OP5, "op8_exact_dedup": _OP8, "op9_top_k": _OP9}
