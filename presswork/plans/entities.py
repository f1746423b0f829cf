"""Queries over entity mentions: canonical names, flags, summaries, candidates, contexts."""

from pyspark.sql import functions as F

from presswork.functions import entity, fixed, text
from presswork.operators import tables
from presswork.plans import sqltext as S
from presswork.plans.registry import Registry
from presswork.providers.base import gazetteer_mentions
from presswork.session import read

R = Registry()


@R.query(
    "entity_canonicalise",
    f"""SELECT DISTINCT entity_surface, {S.canonical('entity_surface')} AS canonical_entity, {S.entity_key('entity_surface')} AS entity_key FROM entity_mentions_raw""",
)
def entity_canonicalise(spark, sf_dir):
    s = read(spark, sf_dir, "entity_mentions_raw").select("entity_surface").distinct()
    return s.select("entity_surface", entity.canonical_name(F.col("entity_surface")).alias("canonical_entity"),
                    entity.entity_key(F.col("entity_surface")).alias("entity_key"))


_LABEL = S.squeeze(f"translate(lower({S.squeeze('raw_label')}), '-/', '  ')")
_TYPE = f"coalesce({S.lookup(_LABEL, fixed.TYPE_NAMES)}, 'other')"
_K = S.entity_key("canonical_entity")
_TYPED = f"""n AS (SELECT DISTINCT canonical_entity, raw_label, {_K} AS k, {_TYPE} AS t FROM entity_mentions_final)"""


@R.query(
    "entity_types",
    f"""WITH {_TYPED} SELECT canonical_entity, raw_label, CASE WHEN {S.lookup('k', fixed.TYPE_HINTS)} IS NOT NULL THEN {S.lookup('k', fixed.TYPE_HINTS)}
  WHEN {S.isin('k', fixed.GENERIC_ACTORS)} THEN 'person' WHEN {S.isin('k', fixed.GENERIC_PLACES)} THEN 'government_institution' ELSE t END AS final_type FROM n""",
)
def entity_types(spark, sf_dir):
    n = read(spark, sf_dir, "entity_mentions_final").select("canonical_entity", "raw_label").distinct()
    return n.withColumn("final_type", entity.repaired_type(F.col("canonical_entity"), F.col("raw_label")))


_ONE = "(SELECT DISTINCT entity_surface AS e, lower(raw_label) AS t FROM entity_mentions_raw)"


@R.query(
    "entity_flags",
    f"""SELECT e, t, {S.numeric_junk('e')} AS is_numeric_junk, {S.isin(S.entity_key('e'), fixed.NEWS_SOURCES)} AS is_news_source,
  {S.isin(S.entity_key('e'), fixed.GENERIC_ACTORS)} AS is_generic_actor,
  ({S.isin(S.entity_key('e'), fixed.GENERIC_PLACES)} OR regexp_matches({S.entity_key('e')}, '^#?\\d[\\w.\\-+]*$')) AS is_low_value_place,
  (t = 'person' AND {S.squeeze('e')} NOT LIKE '% %' AND (length({S.squeeze('e')}) <= 2 OR regexp_matches({S.squeeze('e')}, '^[A-Z][a-z]+$'))) AS is_fragment,
  (regexp_matches({S.squeeze('e')}, '^[#$]') OR {S.words(S.squeeze('e'), fixed.CATALOG_MARKS)} OR regexp_matches({S.squeeze('e')}, '[0-9]{{4,}}')) AS is_catalog FROM {_ONE}""",
)
def entity_flags(spark, sf_dir):
    d = read(spark, sf_dir, "entity_mentions_raw").select(F.col("entity_surface").alias("e"), F.lower("raw_label").alias("t")).distinct()
    e = F.col("e")
    return d.select(
        "e", "t", entity.numeric_junk(e).alias("is_numeric_junk"), entity.news_source(e).alias("is_news_source"),
        entity.generic_actor(e).alias("is_generic_actor"), entity.low_value_place(e).alias("is_low_value_place"),
        entity.fragment_of_person(e, F.col("t")).alias("is_fragment"), entity.catalog_like(e).alias("is_catalog"))


_SUM = """sm AS (SELECT canonical_entity, final_type, count(*) AS n_rows, count(DISTINCT doc_id) AS n_docs, count(DISTINCT domain) AS n_domains,
  avg(confidence) AS confidence_mean, bool_or(is_news_source) AS is_news_source, bool_or(is_numeric_junk) AS is_numeric_junk FROM entity_mentions_final
  WHERE confidence >= 0.45 AND length(canonical_entity) BETWEEN 2 AND 120 GROUP BY 1, 2)"""


def summary(spark, sf_dir):
    m = read(spark, sf_dir, "entity_mentions_final").where(
        (F.col("confidence") >= fixed.MENTION_CONFIDENCE) & F.length("canonical_entity").between(*fixed.NAME_CHARS))
    return m.groupBy("canonical_entity", "final_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("domain").alias("n_domains"),
        F.avg("confidence").alias("confidence_mean"), F.bool_or("is_news_source").alias("is_news_source"), F.bool_or("is_numeric_junk").alias("is_numeric_junk"))


@R.query("entity_summary", f"""WITH {_SUM} SELECT canonical_entity, final_type, n_rows, n_docs, n_domains, round(confidence_mean, 6) AS confidence_mean,
  is_news_source, is_numeric_junk, {S.tier('n_docs')} AS entity_doc_bucket, (n_docs >= 3 OR n_rows >= 5) AS keep_for_analysis FROM sm""")
def entity_summary(spark, sf_dir):
    s = summary(spark, sf_dir)
    return s.withColumns({
        "confidence_mean": F.round("confidence_mean", 6), "entity_doc_bucket": entity.tier(F.col("n_docs")),
        "keep_for_analysis": (F.col("n_docs") >= fixed.CANDIDATE_MIN_DOCS) | (F.col("n_rows") >= fixed.CANDIDATE_MIN_ROWS)})


@R.query(
    "entity_candidates",
    f"""WITH {_SUM}, c AS (SELECT *, 5 * n_docs + 2 * n_domains + 10 * ln(1 + n_rows) - CASE WHEN {S.isin(S.entity_key('canonical_entity'), fixed.GENERIC_TECHNOLOGY)} THEN 5 ELSE 0 END
    - CASE WHEN {S.isin(S.entity_key('canonical_entity'), fixed.GENERIC_ACTORS)} THEN 5 ELSE 0 END AS p FROM sm
  WHERE final_type IN ('company', 'technology', 'government_institution', 'person') AND NOT coalesce(is_news_source, false) AND NOT coalesce(is_numeric_junk, false)
    AND (n_docs >= 3 OR n_rows >= 5) AND NOT regexp_matches(lower(canonical_entity), '^#|^\\$|\\d{{3,}}|(^|[^a-z0-9_])booth([^a-z0-9_]|$)'))
SELECT canonical_entity, final_type, n_docs, n_rows, n_domains, round(p, 6) AS priority FROM c ORDER BY round(p, 9) DESC, canonical_entity, final_type LIMIT {fixed.CANDIDATES}""",
)
def entity_candidates(spark, sf_dir):
    k = entity.entity_key(F.col("canonical_entity"))
    p = (5 * F.col("n_docs") + 2 * F.col("n_domains") + 10 * F.log1p("n_rows")
         - F.when(k.isin(*fixed.GENERIC_TECHNOLOGY), 5).otherwise(0) - F.when(k.isin(*fixed.GENERIC_ACTORS), 5).otherwise(0))
    c = summary(spark, sf_dir).where(
        F.col("final_type").isin(*fixed.ANALYSIS_TYPES) & ~F.coalesce("is_news_source", F.lit(False)) & ~F.coalesce("is_numeric_junk", F.lit(False))
        & ((F.col("n_docs") >= fixed.CANDIDATE_MIN_DOCS) | (F.col("n_rows") >= fixed.CANDIDATE_MIN_ROWS))
        & ~F.lower("canonical_entity").rlike(r"^#|^\$|\d{3,}|(^|[^a-z0-9_])booth([^a-z0-9_]|$)"))
    order = [F.desc(F.round("p", 9)), F.col("canonical_entity"), F.col("final_type")]
    return c.withColumn("p", p).orderBy(*order).limit(fixed.CANDIDATES_FIRST).orderBy(*order).limit(fixed.CANDIDATES).select(
        "canonical_entity", "final_type", "n_docs", "n_rows", "n_domains", F.round("p", 6).alias("priority"))


@R.query(
    "entity_contexts",
    """WITH d AS (SELECT *, row_number() OVER (PARTITION BY canonical_entity, final_type, doc_id, block_id, sha1(clean_block_text)
    ORDER BY confidence DESC NULLS LAST, clean_block_len DESC, url NULLS LAST) AS rn FROM entity_mentions_final),
t AS (SELECT *, row_number() OVER (PARTITION BY canonical_entity, final_type ORDER BY confidence DESC NULLS LAST, clean_block_len DESC, doc_id, block_id, sha1(clean_block_text)) AS context_rank
  FROM d WHERE rn = 1)
SELECT canonical_entity, final_type, context_rank, doc_id, block_id, confidence, clean_block_len FROM t WHERE context_rank <= 8""",
)
def entity_contexts(spark, sf_dir):
    m = read(spark, sf_dir, "entity_mentions_final").withColumn("h", text.sha1_hex(F.col("clean_block_text")))
    best = [F.desc_nulls_last("confidence"), F.desc("clean_block_len")]
    one = tables.keep_one(m, ["canonical_entity", "final_type", "doc_id", "block_id", "h"], [*best, F.asc_nulls_last("url")])
    top = tables.top_n(one, ["canonical_entity", "final_type"], [*best, F.col("doc_id"), F.col("block_id"), F.col("h")], fixed.CONTEXTS_PER_ENTITY, "context_rank")
    return top.select("canonical_entity", "final_type", "context_rank", "doc_id", "block_id", "confidence", "clean_block_len")


@R.query(
    "entity_context_bundles",
    """WITH t AS (SELECT *, row_number() OVER (PARTITION BY canonical_entity, final_type ORDER BY confidence DESC NULLS LAST, clean_block_len DESC, doc_id, block_id, md5(clean_block_text)) AS rk
  FROM (SELECT DISTINCT canonical_entity, final_type, doc_id, block_id, confidence, clean_block_len, clean_block_text FROM entity_contexts_final))
SELECT e.canonical_entity, e.final_type, coalesce(c.docs, []) AS context_docs FROM (SELECT DISTINCT canonical_entity, final_type FROM entity_mentions_final) e
LEFT JOIN (SELECT canonical_entity, final_type, list(doc_id ORDER BY rk) AS docs FROM t WHERE rk <= 3 GROUP BY 1, 2) c
  ON e.canonical_entity = c.canonical_entity AND e.final_type IS NOT DISTINCT FROM c.final_type""",
)
def entity_context_bundles(spark, sf_dir):
    c = read(spark, sf_dir, "entity_contexts_final").select(
        "canonical_entity", "final_type", "doc_id", "block_id", "confidence", "clean_block_len", "clean_block_text").distinct()
    top = tables.top_n(c, ["canonical_entity", "final_type"], [
        F.desc_nulls_last("confidence"), F.desc("clean_block_len"), F.col("doc_id"), F.col("block_id"), F.md5("clean_block_text")], 3, "rk")
    docs = top.groupBy("canonical_entity", "final_type").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rk", "doc_id"))), lambda x: x["doc_id"]).alias("docs"))
    e = read(spark, sf_dir, "entity_mentions_final").select("canonical_entity", "final_type").distinct()
    j = tables.null_safe_join(e, docs, ["canonical_entity", "final_type"], "left")
    return j.select("canonical_entity", "final_type", F.coalesce("docs", F.array().cast("array<bigint>")).alias("context_docs"))


@R.query(
    "group_type_choice",
    f"""WITH c AS (SELECT entity_key, coalesce(final_type, 'other') AS t, count(*) AS n FROM entity_mentions_final GROUP BY 1, 2)
SELECT entity_key, arg_max(t, n * 100 + coalesce({S.lookup('t', {k: str(v) for k, v in fixed.TYPE_PRIORITY.items()})}, '-1')::INT) AS chosen_type FROM c GROUP BY 1""",
)
def group_type_choice(spark, sf_dir):
    c = read(spark, sf_dir, "entity_mentions_final").groupBy("entity_key", F.coalesce("final_type", F.lit("other")).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    rank = F.coalesce(entity.lookup(F.col("t"), {k: str(v) for k, v in fixed.TYPE_PRIORITY.items()}).cast("int"), F.lit(-1))
    return c.groupBy("entity_key").agg(F.max_by("t", F.col("n") * 100 + rank).alias("chosen_type"))


@R.query(
    "mention_dedup",
    """SELECT doc_id, block_id, canonical_entity, final_type, count(*) AS n_rows, max(confidence) AS confidence FROM entity_mentions_final
WHERE confidence >= 0.45 GROUP BY 1, 2, 3, 4""",
)
def mention_dedup(spark, sf_dir):
    return read(spark, sf_dir, "entity_mentions_final").where(F.col("confidence") >= fixed.MENTION_CONFIDENCE).groupBy(
        "doc_id", "block_id", "canonical_entity", "final_type").agg(F.count(F.lit(1)).alias("n_rows"), F.max("confidence").alias("confidence"))


@R.query(
    "gazetteer_ner",
    """WITH g AS (SELECT DISTINCT canonical_entity AS name, coalesce(final_type, 'other') AS label, array_to_string(regexp_extract_all(canonical_entity, '[\\p{L}\\p{N}_]+'), ' ') AS k FROM entity_mentions_final WHERE canonical_entity IS NOT NULL),
gk AS (SELECT k, label, count(*) AS m FROM g WHERE k <> '' GROUP BY 1, 2), w AS (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w), s AS (SELECT doc_id, array_to_string(w[i:i + n - 1], ' ') AS k FROM p, (SELECT unnest(range(1, 13)) AS n) WHERE i + n - 1 <= len(w))
SELECT s.doc_id, gk.label AS raw_label, CAST(sum(m) AS BIGINT) AS n, count(DISTINCT gk.k) AS n_names FROM s JOIN gk USING (k) GROUP BY 1, 2""",
)
def gazetteer_ner(spark, sf_dir):
    """Names of the entity table in whole documents, with word edges."""
    g = read(spark, sf_dir, "entity_mentions_final").select(
        F.col("canonical_entity").alias("name"), F.coalesce("final_type", F.lit("other")).alias("label")).distinct()
    m = gazetteer_mentions(read(spark, sf_dir, "documents"), "text", g, ["doc_id"])
    words = F.array_join(F.regexp_extract_all("entity_surface", F.lit(r"([\p{L}\p{N}_]+)")), " ")
    return m.groupBy("doc_id", "raw_label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(words).alias("n_names"))


@R.query(
    "surface_names",
    f"""WITH n AS (SELECT DISTINCT entity_surface AS e FROM entity_mentions_raw),
c AS (SELECT e, {S.squeeze("regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + S.squeeze('e') + ", '^[+*|~]+', ''), '^[.:;,_ -]+', ''), '[.:;,_ -]+$', ''), '^[0-9]{2}([A-Z][a-z])', '\\1'), '^[+]\\s*', '')")} AS s FROM n)
SELECT e AS entity_surface, CASE WHEN {S.lookup(S.entity_key('s', camel=False), fixed.SURFACE_NAMES)} IS NOT NULL THEN {S.lookup(S.entity_key('s', camel=False), fixed.SURFACE_NAMES)}
  WHEN regexp_matches(s, '^[A-Z]{{2,8}}$') THEN s ELSE {S.title_case('s')} END AS surface_name FROM c""",
)
def surface_names(spark, sf_dir):
    s = read(spark, sf_dir, "entity_mentions_raw").select("entity_surface").distinct()
    return s.select("entity_surface", entity.surface_name(F.col("entity_surface")).alias("surface_name"))
