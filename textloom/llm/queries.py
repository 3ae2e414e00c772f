"""The registered queries of the operators, over their whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import gif, html_mss, jacobi_davidson, lattice_lm, lgs_pack, line_align, pairwise_rank, phrase_automata, segment_negatives, simhash_vp, sp_unigram, warc_chunks, weak_rules


def _over(table: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_gif_media": _over("documents", gif.text_media),
    "op2_simhash_vp_tree": _over("documents", simhash_vp.near_duplicate_components),
    "op3_weak_supervision": _over("documents", weak_rules.judged),
    "op4_linear_grouping_pack": _over("documents", lgs_pack.packed),
    "op5_html_max_subsequence": _over("pages", html_mss.extracted),
    "op6_sentencepiece_unigram": _over("documents", sp_unigram.coded),
    "op7_lattice_likelihood": _over("documents", lattice_lm.scored),
    "op8_phrase_automata": _over("documents", phrase_automata.removal_report),
    "op9_patience_line_dedup": _over("documents", line_align.report),
    "op10_warc_chunks": _over("pages", warc_chunks.round_trip),
    "op11_pairwise_rank": lambda spark, sf_dir: pairwise_rank.scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")),
    "op12_segment_negatives": _over("embeddings", segment_negatives.hard_negatives),
    "op13_jacobi_davidson": _over("embeddings", jacobi_davidson.report),
}

ORACLE: dict[str, str] = {
    "op8_phrase_automata": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY t) AS n FROM k) WHERE n > 1),
m AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(m.n, 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, j: NOT coalesce(list_contains(ps, j), false)), ' ')) AS kept_sha256
FROM d LEFT JOIN m ON d.doc_id = m.doc_id""",
    "op10_warc_chunks": """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100""",
    "op12_segment_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same, CAST(list_inner_product(a.x, e.x) AS BIGINT) AS score FROM e AS a, e WHERE a.vec_id % 100 = 0 AND a.vec_id <> e.vec_id),
p AS (SELECT * FROM (SELECT anchor_id, vec_id, score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
 FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
}
