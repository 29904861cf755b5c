"""Registered queries of the training-data operators, and their SQL where SQL can state them."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftlens.llm.counting import op9_token_counts
from siftlens.llm.decontaminate import op4_decontaminate
from siftlens.llm.langid import op2_langid
from siftlens.llm.licenses import op6_licenses
from siftlens.llm.neardup import op10_neardup
from siftlens.llm.packing import op8_pack
from siftlens.llm.quality import op3_quality
from siftlens.llm.secrets import op5_secrets
from siftlens.llm.tokenfile import op7_token_file
from siftlens.llm.topk import op1_topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_topk": op1_topk,
        "op2_langid": op2_langid,
        "op3_quality": op3_quality,
        "op4_decontaminate": op4_decontaminate,
        "op5_secrets": op5_secrets,
        "op6_licenses": op6_licenses,
        "op7_token_file": op7_token_file,
        "op8_pack": op8_pack,
        "op9_token_counts": op9_token_counts,
        "op10_neardup": op10_neardup,
    }


_TOPK = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x : CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p : p[1] * p[2])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{pattern}')"

_DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS t
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM win),
place AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
),
occ AS (SELECT doc_id, place.n, i, item FROM place JOIN win ON place.n = win.n AND place.t = win.t),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM occ GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
""".replace("{pattern}", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": _TOPK, "op4_decontaminate": _DECONTAMINATE.replace("\\\\", "\\")}
