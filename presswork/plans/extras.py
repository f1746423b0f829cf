"""Further queries: row filters, two-pool samples, label aliases, keyword lists, pivots, model round trips."""

import uuid

from pyspark.sql import functions as F

from presswork.functions import entity, fixed
from presswork.functions.entity import lookup
from presswork.operators import sampling, tables
from presswork.plans import sqltext as S
from presswork.plans.registry import Registry
from presswork.plans.sentiment import predictions
from presswork.providers import models
from presswork.session import own_dir, read

R = Registry()

_E = "(SELECT DISTINCT entity_surface AS e, CASE lower(raw_label) WHEN 'per' THEN 'person' WHEN 'product' THEN 'technology' WHEN 'org' THEN 'company' ELSE replace(lower(raw_label), ' ', '_') END AS t FROM entity_mentions_raw WHERE entity_surface IS NOT NULL)"
_SQ, _K = S.squeeze("e"), S.entity_key("e", camel=False)
_PRICE = f"({_SQ} = '' OR regexp_matches({_SQ}, '^[#$€£¥]?\\d[\\d,.\\-+%/ ]*$') OR regexp_matches({_SQ}, '^[$€£¥]\\s*\\d[\\d,.\\-+% ]*$') OR regexp_matches({_SQ}, '^[#$€£¥]?[A-Z]*\\d+[A-Z0-9\\-+./% ]*$') OR regexp_matches({_SQ}, '^[$€£¥#]'))"
_CATALOG = f"(regexp_matches({_SQ}, '^[#$]') OR {S.words(_SQ, fixed.CATALOG_MARKS)} OR regexp_matches({_SQ}, '[0-9]{{4,}}'))"


def _entities(spark, sf_dir):
    low = F.lower("raw_label")
    t = F.when(low == "per", "person").when(low == "product", "technology").when(low == "org", "company").otherwise(F.replace(low, F.lit(" "), F.lit("_")))
    return read(spark, sf_dir, "entity_mentions_raw").where("entity_surface is not null").select(F.col("entity_surface").alias("e"), t.alias("t")).distinct()


@R.query(
    "keep_rows",
    f"""SELECT e, t, (length({_SQ}) >= 2 AND NOT {_PRICE} AND NOT {_CATALOG}
  AND NOT coalesce(t = 'person' AND {_SQ} NOT LIKE '% %' AND (length({_SQ}) <= 2 OR regexp_matches({_SQ}, '^[A-Z][a-z]+$')), false)
  AND NOT coalesce(t = 'government_institution' AND NOT {S.isin(_K, fixed.PLACES_KEPT)} AND ({S.isin(_K, fixed.GENERIC_PLACES)} OR {_PRICE} OR {_CATALOG}), false)
  AND NOT coalesce(t = 'technology' AND ({S.isin(_K, fixed.WEAK_TECHNOLOGY)} OR regexp_matches({_K}, '^0?\\d+ (family|model|models|reasoning model)$') OR (starts_with({_K}, 'ai ') AND len(string_split({_K}, ' ')) >= 3)), false)) AS keep FROM {_E}""",
)
def keep_rows(spark, sf_dir):
    return _entities(spark, sf_dir).withColumn("keep", entity.keep_row(F.col("e"), F.col("t")))


@R.query(
    "display_filter",
    f"""SELECT e, NOT (regexp_matches(e, '^\\s*[#$+]') OR regexp_matches(e, '^\\s*[0-9]{{2}}[A-Za-z]{{2}}') OR {S.words('e', ('booth', 'token', 'presale', 'market', 'startup', 'fintech', 'valued company'))}
  OR regexp_matches(e, '[0-9]{{4,}}')) AND NOT {S.isin(_K, fixed.WEAK_TECHNOLOGY)} AS shown FROM (SELECT DISTINCT e FROM {_E})""",
)
def display_filter(spark, sf_dir):
    return _entities(spark, sf_dir).select("e").distinct().withColumn("shown", entity.displayable(F.col("e")))


_SENT = "sn AS (SELECT sent_uid, min(sent_len_bucket) AS b, max(suspect_flag) AS f FROM sentences GROUP BY 1)"


def _alloc(src: str, n: int) -> str:
    return f"""(SELECT b, base + CASE WHEN fr <= missing THEN 1 ELSE 0 END AS target FROM (SELECT b, base, row_number() OVER (ORDER BY raw - floor(raw) DESC, b) AS fr, {n} - sum(base) OVER () AS missing
  FROM (SELECT b, w * {n} AS raw, greatest(1, floor(w * {n})) AS base FROM (SELECT b, count(*) / sum(count(*)) OVER () AS w FROM {src} GROUP BY 1))))"""


def _drawn(src: str, n: int, seed: int) -> str:
    return f"SELECT r.sent_uid, r.b FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY {S.draw('sent_uid', seed=seed)}, sent_uid) AS rn FROM {src}) r JOIN {_alloc(src, n)} t USING (b) WHERE rn <= target"


@R.query(
    "two_pool_sample",
    f"""WITH {_SENT}, sp AS (SELECT * FROM sn WHERE f = 1), u AS ({_drawn('sn', 165, 42)} UNION {_drawn('sp', 135, 43)})
SELECT sent_uid, b FROM u ORDER BY {S.draw('sent_uid')}, sent_uid LIMIT 300""",
)
def two_pool_sample(spark, sf_dir):
    s = read(spark, sf_dir, "sentences").groupBy("sent_uid").agg(F.min("sent_len_bucket").alias("b"), F.max("suspect_flag").alias("f"))
    return sampling.two_pools(s, ["b"], "sent_uid", 300, F.col("f") == 1, 0.45).select("sent_uid", "b")


@R.query(
    "label_aliases",
    f"""WITH a AS (SELECT sample_id, CASE substr(md5(sample_id), 1, 1) WHEN '0' THEN 'pos' WHEN '1' THEN ' NEG' WHEN '2' THEN 'neutral' ELSE sentiment_label END AS l FROM sentiment_training_data)
SELECT coalesce({S.lookup('lower(trim(l))', fixed.LABEL_ALIASES)}, lower(trim(l))) AS label, count(*) AS n FROM a GROUP BY 1""",
)
def label_aliases(spark, sf_dir):
    h = F.substring(F.md5("sample_id"), 1, 1)
    a = read(spark, sf_dir, "sentiment_training_data").select(F.when(h == "0", "pos").when(h == "1", " NEG").when(h == "2", "neutral").otherwise(F.col("sentiment_label")).alias("l"))
    k = F.lower(F.trim("l"))
    return a.groupBy(F.coalesce(lookup(k, fixed.LABEL_ALIASES), k).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@R.query("label_map_json", """SELECT n_nationkey AS id, '{"name":' || to_json(n_name) || ',"group":' || n_regionkey || '}' AS entry FROM nation""")
def label_map_json(spark, sf_dir):
    return read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("id"), F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("group"))).alias("entry"))


@R.query("schema_profile", """SELECT column_name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' ELSE lower(column_type) END AS data_type,
  (SELECT count(*) FROM news_final_project) AS n_rows FROM (DESCRIBE news_final_project) WHERE column_name <> 'ingested_at'""")
def schema_profile(spark, sf_dir):
    df = read(spark, sf_dir, "news_final_project")
    cols = spark.createDataFrame([(c, t) for c, t in df.dtypes if c != "ingested_at"], "column_name string, data_type string")
    return cols.withColumn("n_rows", df.agg(F.count(F.lit(1))).scalar())


_IN = "SELECT domain, final_type, count(DISTINCT doc_id) AS n FROM entity_contexts_final GROUP BY 1, 2"


@R.query("type_pivot", f"SELECT domain, {', '.join(f'CAST(coalesce(max(n) FILTER (final_type = {S.q(t)}), 0) AS BIGINT) AS {t}' for t in fixed.ANALYSIS_TYPES)} FROM ({_IN}) GROUP BY 1")
def type_pivot(spark, sf_dir):
    g = read(spark, sf_dir, "entity_contexts_final").groupBy("domain", "final_type").agg(F.count_distinct("doc_id").alias("n"))
    return g.groupBy("domain").pivot("final_type", list(fixed.ANALYSIS_TYPES)).agg(F.first("n")).na.fill(0)


@R.query(
    "exposure_rerank",
    """WITH g AS (SELECT entity_doc_bucket AS k, count(DISTINCT doc_id) AS n_docs, avg(confidence) AS c FROM sentiment_training_data WHERE entity_doc_bucket IS NOT NULL GROUP BY 1)
SELECT k, n_docs, round(c * ln(1 + n_docs), 6) AS rank_score FROM g WHERE k <> 'below_tail' ORDER BY c * ln(1 + n_docs) DESC, k LIMIT 5""",
)
def exposure_rerank(spark, sf_dir):
    g = predictions(spark, sf_dir).where("entity_doc_bucket is not null").groupBy(F.col("entity_doc_bucket").alias("k")).agg(
        F.count_distinct("doc_id").alias("n_docs"), F.avg("confidence").alias("c"))
    s = g.where("k <> 'below_tail'").withColumn("s", F.col("c") * F.log1p("n_docs"))
    return s.orderBy(F.desc("s"), "k").limit(5).select("k", "n_docs", F.round("s", 6).alias("rank_score"))


@R.query(
    "group_keywords",
    """WITH w AS (SELECT source, unnest(list_distinct(regexp_split_to_array(lower(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), ' '))) AS t FROM documents WHERE source IS NOT NULL AND lang = 'en'),
c AS (SELECT source, t, count(*) AS n FROM w WHERE length(t) >= 8 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, t) AS rk FROM c)
SELECT source, string_agg(t, ', ' ORDER BY rk) AS top_keywords FROM r WHERE rk <= 10 GROUP BY 1""",
)
def group_keywords(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where("source is not null and lang = 'en'")
    w = d.select("source", F.explode(F.array_distinct(F.split(F.lower(F.regexp_replace("text", "[^A-Za-z]+", " ")), " "))).alias("t"))
    c = w.where(F.length("t") >= 8).groupBy("source", "t").agg(F.count(F.lit(1)).alias("n"))
    top = tables.top_n(c, ["source"], [F.desc("n"), F.col("t")], 10, "rk")
    return top.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "t"))), lambda x: x["t"]), ", ").alias("top_keywords"))


@R.query("proportional_topic_sample", f"""WITH u AS (SELECT DISTINCT doc_id, source AS s FROM documents WHERE source IS NOT NULL), w AS (SELECT s, count(*) AS n, greatest(5, round_even(count(*) / sum(count(*)) OVER () * 200, 0)) AS base FROM u GROUP BY 1)
SELECT s, n AS n_rows FROM w""")
def proportional_topic_sample(spark, sf_dir):
    u = read(spark, sf_dir, "documents").where("source is not null").select("doc_id", F.col("source").alias("s")).distinct()
    t = sampling.allocation(u, ["s"], 200, lambda w, n: sampling.rounded_with_floor(w, n, 5))
    drawn = sampling.stratified_sample(u, ["s"], "doc_id", t).groupBy("s").agg(F.count(F.lit(1)).alias("k"))
    return t.join(drawn, "s").where(F.col("k") == F.least("n_rows", "target")).select("s", "n_rows")


@R.query("multiclass_classifier")
def multiclass_classifier(spark, sf_dir):
    """A weighted three-way classifier, stored, loaded and scored on held-out rows."""
    idx = F.when(F.col("sentiment_label") == "negative", 0.0).when(F.col("sentiment_label") == "mixed_or_unclear", 1.0).otherwise(2.0)
    d = read(spark, sf_dir, "sentiment_training_data").select("sample_id", "context_text", idx.alias("y"), F.coalesce("confidence", F.lit(0.5)).alias("w"))
    held = F.pmod(F.xxhash64("sample_id"), F.lit(5)) == 0
    path = f"{own_dir(spark)}/model-{uuid.uuid4().hex}"
    models.save_model(models.fit_classifier(d.where(~held), "context_text", "y", "w", 1 << 12), path)
    return models.score(models.load_model(path), d.where(held)).groupBy("pred").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("pred") == F.col("y")).cast("int")).alias("accuracy"))


@R.query("sentence_embeddings")
def sentence_embeddings(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    d = read(spark, sf_dir, "entity_contexts_final").select("doc_id", "block_id", "clean_block_text").distinct()
    return models.fit_embedder(d, "clean_block_text", 16).transform(d).select("doc_id", "block_id", vector_to_array("embedding").alias("embedding"))
