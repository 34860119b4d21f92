"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import licences
from .hilbert import curve_tables


def hilbert(bits: int = 5, target_bytes: int = 128 << 20) -> str:
    digit, following = curve_tables(4)
    steps, prior = [], "c"
    for k, level in enumerate(range(bits - 1, -1, -1)):
        corner = " + ".join(f"(((c{d} >> {level}) & 1) << {d})" for d in range(4))
        steps.append(f"s{k} AS (SELECT * EXCLUDE (st, ix), ({following})[st * 16 + {corner} + 1] AS st, ix * 16 + ({digit})[st * 16 + {corner} + 1] AS ix FROM {prior})")
        prior = f"s{k}"
    depth = lambda c: f"(SELECT {c} AS v, CAST(floor(coalesce(sum(count(*)) OVER (ORDER BY {c} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {1 << bits} // sum(count(*)) OVER ()) AS INTEGER) AS r FROM documents WHERE {c} IS NOT NULL GROUP BY {c})"
    return f"""
WITH e AS (SELECT min(doc_id) AS lo, (max(doc_id) - min(doc_id)) // {1 << bits} + 1 AS w FROM documents),
c AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, 0 AS st, CAST(0 AS BIGINT) AS ix,
        coalesce(a.r, 0) AS c0, coalesce(b.r, 0) AS c1,
        least(coalesce(2 * (length(bin(greatest(n_chars, 1))) - 1) + CASE WHEN n_chars > 1 THEN CAST(substr(bin(n_chars), 2, 1) AS INTEGER) ELSE 0 END, 0), {(1 << bits) - 1}) AS c2,
        coalesce((d.doc_id - e.lo) // e.w, 0) AS c3
      FROM documents d CROSS JOIN e LEFT JOIN {depth('lang')} a ON d.lang = a.v LEFT JOIN {depth('source')} b ON d.source = b.v),
{', '.join(steps)}
SELECT doc_id, text, lang, source, n_chars, ix AS hilbert_index,
  CAST(coalesce(sum(coalesce(strlen(text), 0)) OVER (ORDER BY ix, doc_id NULLS FIRST, text NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {target_bytes} AS BIGINT) AS shard_id
FROM {prior}"""


WARC = r"""
WITH h AS (SELECT page_id AS record_id, url, sha256(html) AS payload_digest, html,
  'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
  || coalesce('WARC-Record-ID: <urn:relaylake:page:' || page_id || '>' || chr(13) || chr(10), '')
  || coalesce('WARC-Target-URI: ' || url || chr(13) || chr(10), '')
  || coalesce('WARC-Payload-Digest: sha256:' || sha256(html) || chr(13) || chr(10), '')
  || 'Content-Type: text/html' || chr(13) || chr(10)
  || 'Content-Length: ' || coalesce(strlen(html), 0) || chr(13) || chr(10) || chr(13) || chr(10) AS record_header FROM pages)
SELECT record_id, url, payload_digest, record_header, html AS payload,
  record_header || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record, true AS intact FROM h"""

CHAT = r"""
WITH t AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
w AS (SELECT *, row_number() OVER o AS position,
        coalesce(string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '') OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context
      FROM t WINDOW o AS (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text)),
p AS (SELECT conv_id, turn, position, position - 1 AS n_context, context || '<|assistant|>' || chr(10) AS prompt, text || '<|end|>' || chr(10) AS completion FROM w WHERE role = 'assistant')
SELECT conv_id, turn, position, n_context, prompt, completion, length(prompt) AS train_start, length(prompt) + length(completion) AS train_end FROM p"""

#: Quadratic, so for small tables only.
NEAR_VECTORS = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND len(e) > 0 AND list_dot_product(e, e) > 0 AND list_dot_product(e, e) < 'inf'::DOUBLE),
p AS (SELECT a.r AS x, b.r AS y FROM u a JOIN u b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT DISTINCT x AS r, x AS y FROM p UNION SELECT reach.r, p.y FROM reach JOIN p ON reach.y = p.x),
c AS (SELECT reach.r, min(v.vec_id) AS class_id FROM reach JOIN v ON v.r = reach.y GROUP BY reach.r),
n AS (SELECT x AS r, count(*) AS n_links FROM p GROUP BY x)
SELECT vec_id, coalesce(class_id, vec_id) AS class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links FROM v LEFT JOIN c USING (r) LEFT JOIN n USING (r)"""

ORACLES = {"op2_pca_near_vectors": NEAR_VECTORS, "op1_hilbert_sharding": hilbert(), "op3_warc_archive": WARC, "op7_prefix_targets": CHAT, "op8_licence_rules": licences.oracle()}
