"""The queries of the training-data operators, each over its whole table, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, chat, decontaminate, licenses, linededup, mixing, neardup, tokens, toxicity, warc
from ._common import table
from .oracles import ALNUM as _ALNUM
from .oracles import LOWER as _LOWER
from .oracles import OP2, OP5, OP7, QUOTED

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"), shortest=1)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(table(spark, sf_dir, "conversations"))


def chat_format_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7_chat_format over conversations made to quote: the test tables themselves quote nothing."""
    return chat.format_chat(chat.with_quotations(table(spark, sf_dir, "conversations")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count(table(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op10_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.describe(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_decontaminate, op2_line_dedup, op3_toxicity, op4_mixing, op5_license_scan, op6_warc, op7_chat_format, op8_token_counts, op9_minhash, op10_audio, chat_format_quoted)}


OP1 = rf"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
        FROM b, range(1, 1 + greatest(0, len(w) - least(10, len(w)) + 1)) AS r(i) WHERE len(w) > 0),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
hit AS (SELECT DISTINCT doc_id, i, x.n, item FROM (
          SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM d, sizes, range(1, 2 + len(w) - n) AS r(i)) AS x
        JOIN win ON win.n = x.n AND win.gram = x.gram),
cover AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM hit, range(i, i + n) AS r(k) GROUP BY doc_id),
met AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN met USING (doc_id)
"""


OP9 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS g
      FROM w, range(1, 1 + greatest(1, len(w) - 2)) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
         GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(p.n) + any_value(q.n) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN n USING (doc_id)
"""


_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {5 * i + 1}, 5))::INTEGER >> {15 - 5 * j}) & 31), 1)" for i in range(8) for j in range(4))

OP6 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS m FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id < m THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < m THEN m END AS refers_to
FROM g
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1, "op2_line_dedup": OP2, "op5_license_scan": OP5, "op6_warc": OP6, "op7_chat_format": OP7, "chat_format_quoted": QUOTED, "op9_minhash": OP9}
