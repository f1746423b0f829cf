"""Queries on per-key results over few very large keys."""

from presswork.operators.skew import dominant_keys, key_results
from presswork.plans.registry import Registry
from presswork.session import read

R = Registry()

_LONG = """
WITH long AS (
  SELECT 'canonical_entity' AS key_field, canonical_entity AS key_value, * FROM entity_contexts_final
  UNION ALL
  SELECT 'domain' AS key_field, domain AS key_value, * FROM entity_contexts_final)
"""


@R.query(
    "p4_results",
    _LONG
    + """, agg AS (
  SELECT key_field, key_value, count(*) AS n_rows, count(DISTINCT doc_id) AS n_docs FROM long GROUP BY 1, 2),
best AS (
  SELECT *, row_number() OVER (PARTITION BY key_field, key_value ORDER BY confidence DESC NULLS LAST,
    clean_block_len DESC NULLS LAST, doc_id NULLS LAST, block_id NULLS LAST, clean_block_text DESC NULLS LAST) AS rn FROM long)
SELECT a.key_field, a.key_value, a.n_rows, a.n_docs, b.confidence AS best_confidence, b.doc_id AS best_doc_id,
  b.block_id AS best_block_id, b.clean_block_text AS best_context
FROM agg a JOIN best b ON b.rn = 1 AND a.key_field = b.key_field AND a.key_value IS NOT DISTINCT FROM b.key_value
""",
)
def p4_results(spark, sf_dir):
    return key_results(read(spark, sf_dir, "entity_contexts_final"))


@R.query(
    "p4_found",
    _LONG
    + """SELECT key_field, key_value FROM long WHERE key_value IS NOT NULL GROUP BY 1, 2
HAVING count(*) >= 0.03 * (SELECT count(*) FROM entity_contexts_final)""",
)
def p4_found(spark, sf_dir):
    return dominant_keys(key_results(read(spark, sf_dir, "entity_contexts_final")))
