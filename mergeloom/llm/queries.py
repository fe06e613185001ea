"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from . import chat, decontam, filter_audit, hard_negatives, kneser_ney, line_runs, nbsvm, pieces, pii, shards, simhash, token_file, topk

QUERIES = {
    "op1_token_file": token_file.op1_token_file,
    "op2_simhash": simhash.op2_simhash,
    "op3_pieces": pieces.op3_pieces,
    "op4_decontam": decontam.op4_decontam,
    "op5_top_k": topk.op5_top_k,
    "op6_shards": shards.op6_shards,
    "op7_line_dedup": line_runs.op7_line_dedup,
    "op8_chat": chat.op8_chat,
    "op9_quality": kneser_ney.op9_quality,
    "op10_toxicity": nbsvm.op10_toxicity,
    "op11_pii": pii.op11_pii,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLE_SQL = {
    "op5_top_k": """
WITH v AS (
  SELECT row_number() OVER () AS k, vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM (SELECT DISTINCT vec_id, embedding FROM embeddings)
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.k, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.k <> c.k),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score, score::VARCHAR AS score_text FROM r WHERE rank <= 5""",
    "op7_line_dedup": """
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (
  SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT keyed.*, common.k IS NOT NULL AND doc_id <> last_doc AS gone FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op12_filter_audit": filter_audit.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}
