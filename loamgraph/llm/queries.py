"""The queries of this subpackage by name, and SQL where SQL can express them."""

from __future__ import annotations

from loamgraph.llm import chunked_bpe, hard_negatives, histogram_packing, jaccard, language, near_vectors, packing, pii, repeats, replay, suffix_tree, token_files, topk

QUERIES = {
    "op1_topk": topk.op1_topk,
    "op2_token_files": token_files.op2_token_files,
    "op3_chunked_bpe": chunked_bpe.op3_chunked_bpe,
    "op4_pii": pii.op4_pii,
    "op5_packing": packing.op5_packing,
    "op6_suffix_tree": suffix_tree.op6_suffix_tree,
    "op7_language": language.op7_language,
    "op8_near_vectors": near_vectors.op8_near_vectors,
    "op9_repeats": repeats.op9_repeats,
    "op10_jaccard": jaccard.op10_jaccard,
    "op11_best_fit": histogram_packing.op11_best_fit,
    "op12_replay": replay.op12_replay,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

_FINITE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
#: Smallest id that each id reaches over the rows of ``links`` (a, b), both ways round.
_REACHED = "reach AS (SELECT id, id AS other FROM ids UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other), component AS (SELECT id, min(other) AS component_id FROM reach GROUP BY 1)"

ORACLE_SQL: dict[str, str] = {
    "op1_topk": f"""WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS vec FROM embeddings WHERE vec_id IS NOT NULL AND {_FINITE})
SELECT a.id AS query_id, CAST(row_number() OVER w AS INTEGER) AS rank, b.id AS vec_id, CAST(list_dot_product(a.vec, b.vec) AS BIGINT) AS score FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 20 = 0
WINDOW w AS (PARTITION BY a.id ORDER BY list_dot_product(a.vec, b.vec) DESC, b.id) QUALIFY row_number() OVER w <= 20""",
    "op8_near_vectors": f"""WITH RECURSIVE ids AS (SELECT vec_id AS id FROM embeddings), v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings WHERE {_FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id WHERE list_cosine_similarity(a.vec, b.vec) >= 0.95), n AS (SELECT a AS id, count(*) AS n FROM links GROUP BY 1), {_REACHED}
SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, id = component_id AS kept FROM component LEFT JOIN n USING (id)""",
    "op10_jaccard": rf"""WITH RECURSIVE ids AS (SELECT doc_id AS id FROM documents), w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
each AS MATERIALIZED (SELECT id, len(s) AS n, unnest(s) AS v FROM sets), links AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM each x JOIN each y ON x.v = y.v AND x.id <> y.id GROUP BY x.id, y.id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))), {_REACHED}
SELECT id AS doc_id, len(s)::BIGINT AS n_shingles, component_id FROM component JOIN sets USING (id)""",
    "op13_hard_negatives": hard_negatives.SQL,
}
