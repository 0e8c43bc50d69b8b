"""The queries over the training-data tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from .ann import op6_permutation_index
from .bpe import op2_byte_bpe
from .html import op3_html
from .minhash import op7_minhash
from .packing import op1_packing
from .pii import op10_pii
from .sharding import op9_sharding
from .tiff import op8_tiff
from .tokcount import op4_token_counts
from .toxicity import op5_toxicity

QUERIES = {
    "op1_packing": op1_packing,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_html": op3_html,
    "op4_token_counts": op4_token_counts,
    "op5_toxicity": op5_toxicity,
    "op6_permutation_index": op6_permutation_index,
    "op7_minhash": op7_minhash,
    "op8_tiff": op8_tiff,
    "op9_sharding": op9_sharding,
    "op10_pii": op10_pii,
}

# Models, hash rings, codecs and encoders aren't for SQL; their queries are held against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op7_minhash": r"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM words WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * shared >= 75 * (p.n + q.n - shared)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reached(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT doc_id, y FROM reached JOIN edges ON other = x),
components AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN components USING (doc_id) LEFT JOIN sizes USING (doc_id)""",
}
