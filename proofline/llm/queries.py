"""The queries of the training-data operators, by name, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from proofline.llm.byte_bpe import op6_byte_bpe
from proofline.llm.clusters import clusters_sql, op11_centroid_clusters
from proofline.llm.conversations import op12_conversation_repair
from proofline.llm.decontamination import op9_decontamination
from proofline.llm.embedding_dedup import op13_embedding_dedup
from proofline.llm.language_model import op7_language_scores
from proofline.llm.personal_data import op5_personal_data
from proofline.llm.search import op1_topk_search
from proofline.llm.simhash import op10_simhash
from proofline.llm.substring_dedup import op4_substring_dedup
from proofline.llm.suffix_dedup import op3_suffix_dedup
from proofline.llm.token_counts import op8_token_counts
from proofline.llm.toxicity import op2_toxicity

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_topk_search": op1_topk_search,
    "op2_toxicity": op2_toxicity,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_personal_data": op5_personal_data,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_language_scores": op7_language_scores,
    "op8_token_counts": op8_token_counts,
    "op9_decontamination": op9_decontamination,
    "op10_simhash": op10_simhash,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_embedding_dedup": op13_embedding_dedup,
}

#: A window is known by its words; the other operators need places of matches, 64-bit hashes, token ids or learned models.
WORD_REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
kept AS (SELECT x.doc_id, count(g.p) AS n_removed, string_agg(x.word, ' ' ORDER BY x.p) FILTER (WHERE g.p IS NULL) AS t
         FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) x LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.p = x.p GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
CONTAMINATION_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(13, len(w)) AS s FROM (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
k AS (SELECT DISTINCT item, s, array_to_string(w[i:i + s - 1], ' ') AS k FROM (SELECT item, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM b)),
win AS (SELECT doc_id, s, i, array_to_string(w[i:i + s - 1], ' ') AS k FROM (SELECT doc_id, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM d, (SELECT DISTINCT s FROM k) WHERE len(w) >= s)),
hit AS (SELECT DISTINCT win.doc_id, win.i, win.s, k.item FROM win JOIN k ON win.s = k.s AND win.k = k.k),
places AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + s)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(places.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(places.n, 0) > 0 AND 20 * coalesce(places.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

EQUIVALENT_SQL: dict[str, str] = {
    "op4_substring_dedup": WORD_REPEATS_SQL,
    "op9_decontamination": CONTAMINATION_SQL,
    "op11_centroid_clusters": clusters_sql(),
}
