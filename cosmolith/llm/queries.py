"""The queries of this subpackage, by name; ORACLE_SQL has those that SQL can express."""

from __future__ import annotations

from cosmolith.llm.embedding_dedup import op7_embedding_dedup
from cosmolith.llm.language import op2_language_id
from cosmolith.llm.mixing import op9_mixing
from cosmolith.llm.packing import op6_packing
from cosmolith.llm.pii import op10_pii
from cosmolith.llm.quality import op8_quality
from cosmolith.llm.sharding import op1_sharding
from cosmolith.llm.simhash import op3_simhash
from cosmolith.llm.substring_dedup import op5_substring_dedup
from cosmolith.llm.token_counts import op4_token_counts
from cosmolith.llm.token_files import op12_token_files
from cosmolith.llm.vector_codes import op11_vector_codes

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_language_id": op2_language_id,
    "op3_simhash": op3_simhash,
    "op4_token_counts": op4_token_counts,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_packing": op6_packing,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_quality": op8_quality,
    "op9_mixing": op9_mixing,
    "op10_pii": op10_pii,
    "op11_vector_codes": op11_vector_codes,
    "op12_token_files": op12_token_files,
}


def _codes_sql(rounds: int = 4) -> str:
    """Four rounds of nearest entries and floored means, then the codes; one CTE for each step."""
    near = lambda book: f"SELECT vec_id, label, p.part, arg_min(j, struct_pack(e := e, j := j)) j, min(e) e, any_value(p.x) x FROM (SELECT p.*, j, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) e FROM p JOIN {book} b ON p.part = b.part) p GROUP BY 1, 2, 3"
    steps = []
    for r in range(rounds):
        steps += [
            f"a{r} AS MATERIALIZED ({near(f'b{r}')})",
            f"m{r} AS (SELECT part, j, list(v ORDER BY pos) c FROM (SELECT part, j, pos, cast(floor(cast(sum(x[pos]) AS double) / count(*)) AS bigint) v FROM a{r}, unnest(range(1, len(x) + 1)) u(pos) GROUP BY 1, 2, 3) GROUP BY 1, 2)",
            f"b{r + 1} AS MATERIALIZED (SELECT part, j, coalesce(m.c, b.c) c FROM b{r} b LEFT JOIN m{r} m USING (part, j))",
        ]
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(cast(embedding AS double[]), lambda x: cast(floor(1024 * x) AS bigint)) x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 p AS MATERIALIZED (SELECT vec_id, label, q.part, x[q.part * (len(x) // 4) + 1:(q.part + 1) * (len(x) // 4)] x FROM v, range(4) q(part)),
 b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 j, x c FROM p QUALIFY j < 256),
 {", ".join(steps)}, last AS MATERIALIZED ({near(f"b{rounds}")}),
 s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, j)) codebooks_sha256 FROM b{rounds}),
 o AS (SELECT vec_id, label, string_agg(printf('%02x', j), '' ORDER BY part) code, cast(sum(e) AS bigint) error FROM last GROUP BY 1, 2)
SELECT vec_id, code, error, cast(sum(error) OVER (PARTITION BY label) AS bigint) label_error, codebooks_sha256 FROM o, s"""


#: The queries whose result SQL can state over whole tables. The others rest on a fitted model, a tokenizer, XXH64 or a
#: keyed permutation; tests/llm holds each of them against a brute-force version, a round trip or held-out accuracy.
ORACLE_SQL: dict[str, str] = {
    "op5_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
 n AS (SELECT doc_id, w, len(w) n FROM d),
 s AS (SELECT doc_id, unnest(range(1, n - 11)) i FROM n WHERE n >= 13),
 g AS (SELECT s.doc_id, i, array_to_string(w[i:i + 12], ' ') g FROM s JOIN n USING (doc_id)),
 f AS (SELECT g, min(doc_id) least FROM g GROUP BY 1),
 hit AS (SELECT g.doc_id, i FROM g JOIN f USING (g) WHERE least < g.doc_id),
 gone AS (SELECT DISTINCT doc_id, i + k.k AS i FROM hit, range(13) k(k)),
 island AS (SELECT doc_id, min(i) lo, max(i) hi FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) p FROM gone) GROUP BY doc_id, p),
 l AS (SELECT doc_id, sum(hi - lo + 1) removed, list([cast(lo - 1 AS integer), cast(hi AS integer)] ORDER BY lo) spans FROM island GROUP BY 1),
 word AS (SELECT doc_id, unnest(w) word, generate_subscripts(w, 1) i FROM n WHERE doc_id IN (SELECT doc_id FROM l)),
 kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT n.doc_id, cast(n AS bigint) n_words, cast(coalesce(removed, 0) AS bigint) n_removed,
 sha256(CASE WHEN removed IS NULL THEN array_to_string(w, ' ') ELSE coalesce(t, '') END) kept_sha256, coalesce(spans, []) removed_spans
FROM n LEFT JOIN l USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op7_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, cast(embedding AS double[]) e FROM embeddings),
 ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0),
 link AS MATERIALIZED (SELECT a.vec_id u, b.vec_id v FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
 reach AS (SELECT DISTINCT u, u v FROM link UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u),
 n AS (SELECT u, count(*) n FROM link GROUP BY 1), c AS (SELECT u, min(v) c FROM reach GROUP BY 1)
SELECT vec_id, coalesce(n, 0) n_links, coalesce(c, vec_id) component_id, coalesce(c, vec_id) = vec_id kept
FROM embeddings LEFT JOIN n ON n.u = vec_id LEFT JOIN c ON c.u = vec_id""",
    "op11_vector_codes": _codes_sql(),
}
