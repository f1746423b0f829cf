"""Queries over sentiment: pools, cubes, rankings, splits, quality, industries."""

from pyspark.sql import functions as F

from presswork.functions import fixed, text, web
from presswork.functions.entity import first_matching
from presswork.operators import indicators, metrics, sampling, tables
from presswork.operators import sentiment as op
from presswork.plans import sqltext as S
from presswork.plans.registry import Registry
from presswork.session import read

R = Registry()
_P = {s: f"CASE WHEN sentiment_label = '{s}' THEN confidence ELSE (1 - confidence) / 2 END" for s in fixed.SENTIMENTS}
_PRED = "pr AS (SELECT *, " + ", ".join(f"{v} AS prob_{k}" for k, v in _P.items()) + ", coalesce(strftime(date, '%Y-%m'), 'NaT') AS year_month FROM sentiment_training_data)"


def predictions(spark, sf_dir):
    return op.pseudo_probabilities(read(spark, sf_dir, "sentiment_training_data")).withColumn("year_month", web.month(F.col("date")))


_DERIVED = {
    "confidence_mean": "avg(confidence)", "prob_negative_mean": "avg(prob_negative)", "prob_mixed_or_unclear_mean": "avg(prob_mixed_or_unclear)",
    "prob_positive_mean": "avg(prob_positive)",
}


def _cube_sql(keys: str) -> str:
    return f"""WITH {_PRED}, g AS (SELECT {keys}, count(sample_id) AS n_rows, count(DISTINCT doc_id) AS n_docs, count(DISTINCT domain) AS n_domains,
  {', '.join(f'{v} AS {k}' for k, v in _DERIVED.items())}, {', '.join(f"count(*) FILTER (sentiment_label = '{s}') AS {s}" for s in fixed.SENTIMENTS)} FROM pr GROUP BY ALL)
SELECT {keys}, n_rows, n_docs, n_domains, {', '.join(f'round({k}, 6) AS {k}' for k in _DERIVED)}, negative, mixed_or_unclear, positive,
  CASE WHEN negative >= mixed_or_unclear AND negative >= positive THEN 'negative' WHEN mixed_or_unclear >= positive THEN 'mixed_or_unclear' ELSE 'positive' END AS hard_label_mode,
  round(prob_positive_mean - prob_negative_mean, 6) AS sentiment_index, round(1 - prob_mixed_or_unclear_mean, 6) AS directional_confidence,
  round((prob_positive_mean - prob_negative_mean) * (1 - prob_mixed_or_unclear_mean) * ln(1 + n_docs), 6) AS impact_score,
  round(abs(prob_positive_mean - prob_negative_mean), 6) AS abs_sentiment_index FROM g"""


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _cube(keys: list[str]):
    def build(spark, sf_dir):
        return _rounded(op.cube(predictions(spark, sf_dir), keys))

    return build


for _name, _keys in {
    "entity": ["canonical_entity", "final_type"], "type": ["final_type"], "time": ["canonical_entity", "final_type", "year_month"],
    "domain": ["domain", "final_type"], "bucket": ["entity_doc_bucket"],
}.items():
    R.query(f"sentiment_cube_{_name}", _cube_sql(", ".join(_keys)))(_cube(_keys))


def _rank_sql(order: str) -> str:
    return f"SELECT * FROM ({_cube_sql('canonical_entity, final_type')}) WHERE n_docs >= 2 AND n_rows >= 3 ORDER BY sentiment_index {order}, canonical_entity, final_type LIMIT 30"


@R.query("rank_positive", _rank_sql("DESC"))
def rank_positive(spark, sf_dir):
    return op.ranking(_cube(["canonical_entity", "final_type"])(spark, sf_dir), 2, 3, F.desc("sentiment_index"), 30, "canonical_entity", "final_type")


@R.query("rank_negative", _rank_sql("ASC"))
def rank_negative(spark, sf_dir):
    return op.ranking(_cube(["canonical_entity", "final_type"])(spark, sf_dir), 2, 3, F.asc("sentiment_index"), 30, "canonical_entity", "final_type")


@R.query(
    "prediction_margins",
    f"""WITH {_PRED} SELECT DISTINCT sample_id, list_sort([prob_negative, prob_mixed_or_unclear, prob_positive], 'DESC')[1] - list_sort([prob_negative, prob_mixed_or_unclear, prob_positive], 'DESC')[2] AS pred_margin FROM pr""",
)
def prediction_margins(spark, sf_dir):
    return predictions(spark, sf_dir).select("sample_id", op.margin([f"prob_{s}" for s in fixed.SENTIMENTS]).alias("pred_margin")).distinct()


@R.query(
    "monthly_sentiment_smoothed",
    f"""WITH {_PRED}, m AS (SELECT final_type, year_month, avg(prob_positive - prob_negative) AS v FROM pr WHERE year_month <> 'NaT' GROUP BY 1, 2)
SELECT final_type, year_month, round(v, 6) AS v, round(avg(v) OVER (PARTITION BY final_type ORDER BY year_month ROWS 2 PRECEDING), 6) AS v_smoothed FROM m""",
)
def monthly_sentiment_smoothed(spark, sf_dir):
    m = predictions(spark, sf_dir).where("year_month <> 'NaT'").groupBy("final_type", "year_month").agg(F.avg(F.col("prob_positive") - F.col("prob_negative")).alias("v"))
    return _rounded(op.rolling_mean(m, ["final_type"], "year_month", "v"))


_IND = f"i AS (SELECT *, {S.first_matching('context_text', fixed.INDUSTRY_RULES)} AS industry FROM pr)"


def _industry(spark, sf_dir):
    return predictions(spark, sf_dir).withColumn("industry", first_matching(F.col("context_text"), fixed.INDUSTRY_RULES))


@R.query("industry_rules", f"WITH {_PRED}, {_IND} SELECT industry, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM i GROUP BY 1")
def industry_rules(spark, sf_dir):
    return _industry(spark, sf_dir).groupBy("industry").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@R.query(
    "industry_evidence",
    f"""WITH {_PRED}, {_IND}, g AS (SELECT industry, count(*) AS n_rows, count(DISTINCT doc_id) AS n_docs, avg(prob_positive) AS p, avg(prob_negative) AS n, avg(prob_mixed_or_unclear) AS m FROM i GROUP BY 1)
SELECT industry, n_rows, n_docs, round(p - n, 6) AS sentiment_index, round(ln(1 + n_docs) * (1 - m), 6) AS evidence_score, round(ln(1 + n_docs) * (1 - m) * (p - n), 6) AS impact,
  round(n_docs / sum(n_docs) OVER (), 6) AS coverage_share FROM g""",
)
def industry_evidence(spark, sf_dir):
    return _rounded(op.evidence(_industry(spark, sf_dir), "industry"))


@R.query(
    "industry_anchors",
    f"""WITH {_PRED}, {_IND}, c AS (SELECT industry, canonical_entity, count(*) AS n FROM i WHERE final_type = 'company' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY n DESC, canonical_entity) AS rk FROM c)
SELECT industry, string_agg(canonical_entity, ', ' ORDER BY rk) AS top_companies FROM r WHERE rk <= 3 GROUP BY 1""",
)
def industry_anchors(spark, sf_dir):
    c = _industry(spark, sf_dir).where("final_type = 'company'").groupBy("industry", "canonical_entity").agg(F.count(F.lit(1)).alias("n"))
    t = tables.top_n(c, ["industry"], [F.desc("n"), F.col("canonical_entity")], 3, "rk")
    return t.groupBy("industry").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "canonical_entity"))), lambda x: x["canonical_entity"]), ", ").alias("top_companies"))


@R.query(
    "exposure_scores",
    f"""WITH {_PRED}, {_IND}, g AS (SELECT industry, count(DISTINCT doc_id) AS n_docs, avg(confidence) AS c, avg(prob_positive - prob_negative) AS s FROM i GROUP BY 1)
SELECT industry, n_docs, round(c, 6) AS mean_confidence, round(s, 6) AS mean_sentiment, round(0.5 * n_docs / sum(n_docs) OVER () + 0.3 * c + 0.2 * abs(s), 6) AS exposure_score FROM g""",
)
def exposure_scores(spark, sf_dir):
    return _rounded(op.exposure(_industry(spark, sf_dir), "industry"))


@R.query("mechanism_indicators", f"WITH {_PRED} SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{k}' AS category, count(*) FILTER (regexp_matches(lower(coalesce(context_text, '')), {S.q('|'.join(p))})) AS n, round(count(*) FILTER (regexp_matches(lower(coalesce(context_text, '')), {S.q('|'.join(p))})) / count(*), 6) AS share FROM pr"
    for k, p in fixed.MECHANISMS.items()) + ") WHERE n >= 15")
def mechanism_indicators(spark, sf_dir):
    d = indicators.add_indicators(read(spark, sf_dir, "sentiment_training_data"), "context_text", fixed.MECHANISMS, "mech_")
    return _rounded(indicators.count_indicators(d, "mech_", 15))


@R.query("keyword_matrix", f"WITH {_PRED}, {_IND}, e AS (" + " UNION ALL ".join(
    f"SELECT industry, '{k}' AS category, CAST(sum({' + '.join(f'CAST(contains(lower(context_text), {S.q(w)}) AS INT)' for w in ws)}) AS BIGINT) AS evidence FROM i GROUP BY 1"
    for k, ws in fixed.MECHANISMS.items()) + ") SELECT *, round(coalesce(evidence / nullif(max(evidence) OVER (PARTITION BY industry), 0), 0), 6) AS evidence_share FROM e")
def keyword_matrix(spark, sf_dir):
    return _rounded(indicators.keyword_matrix(_industry(spark, sf_dir), "industry", "context_text", fixed.MECHANISMS))


@R.query(
    "model_inputs",
    f"""SELECT DISTINCT sample_id, 'Target entity: ' || {S.squeeze('canonical_entity')} || chr(10) || 'Entity type: ' || {S.squeeze('final_type')} || chr(10)
  || CASE WHEN {S.squeeze('title')} <> '' THEN 'Document title: ' || {S.squeeze('title')} || chr(10) ELSE '' END
  || CASE WHEN {S.squeeze('domain')} <> '' THEN 'Source domain: ' || {S.squeeze('domain')} || chr(10) ELSE '' END || 'Context: ' || CASE WHEN length({S.squeeze('context_text')}) > 1400 THEN rtrim(left({S.squeeze('context_text')}, 1400)) || ' ...' ELSE {S.squeeze('context_text')} END AS model_input FROM sentiment_training_data""",
)
def model_inputs(spark, sf_dir):
    f = lambda c: text.squeeze(F.col(c))
    m = text.labelled_input([
        ("Target entity", f("canonical_entity"), False), ("Entity type", f("final_type"), False), ("Document title", f("title"), True),
        ("Source domain", f("domain"), True), ("Context", text.compact(F.col("context_text"), fixed.CONTEXT_CHARS), False)])
    return read(spark, sf_dir, "sentiment_training_data").select("sample_id", m.alias("model_input")).distinct()


@R.query(
    "label_left_join",
    """WITH l AS (SELECT sample_id, min(sentiment_label) AS sentiment_label FROM sentiment_training_data GROUP BY 1)
SELECT p.sample_id, count(*) AS n, coalesce(min(l.sentiment_label), 'unlabelled') AS sentiment_label FROM sentiment_label_pool p LEFT JOIN l USING (sample_id) GROUP BY 1""",
)
def label_left_join(spark, sf_dir):
    lab = read(spark, sf_dir, "sentiment_training_data").groupBy("sample_id").agg(F.min("sentiment_label").alias("sentiment_label"))
    j = tables.left_default(read(spark, sf_dir, "sentiment_label_pool").select("sample_id"), lab, ["sample_id"], {"sentiment_label": "unlabelled"})
    return j.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.min("sentiment_label").alias("sentiment_label"))


@R.query("unlabelled_anti", "SELECT DISTINCT sample_id FROM sentiment_label_pool WHERE sample_id NOT IN (SELECT sample_id FROM sentiment_training_data WHERE sample_id IS NOT NULL)")
def unlabelled_anti(spark, sf_dir):
    return read(spark, sf_dir, "sentiment_label_pool").select("sample_id").distinct().join(
        read(spark, sf_dir, "sentiment_training_data").select("sample_id"), "sample_id", "left_anti")


@R.query("labelled_semi", "SELECT sample_id, count(*) AS n FROM sentiment_label_pool WHERE sample_id IN (SELECT sample_id FROM sentiment_training_data) GROUP BY 1")
def labelled_semi(spark, sf_dir):
    return read(spark, sf_dir, "sentiment_label_pool").join(
        read(spark, sf_dir, "sentiment_training_data").select("sample_id"), "sample_id", "left_semi").groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))


@R.query(
    "two_semi_joins",
    """SELECT DISTINCT sample_id FROM sentiment_training_data WHERE canonical_key IN (SELECT lower(canonical_entity) FROM entity_contexts_final)
  AND final_type IN (SELECT final_type FROM entity_contexts_final)""",
)
def two_semi_joins(spark, sf_dir):
    c = read(spark, sf_dir, "entity_contexts_final")
    return read(spark, sf_dir, "sentiment_training_data").join(
        c.select(F.lower("canonical_entity").alias("canonical_key")), "canonical_key", "left_semi").join(
        c.select("final_type"), "final_type", "left_semi").select("sample_id").distinct()


@R.query(
    "dimension_stats_join",
    """WITH s AS (SELECT canonical_key, final_type, count(DISTINCT doc_id) AS d FROM entity_mentions_final GROUP BY 1, 2)
SELECT p.sample_id, p.canonical_key, max(coalesce(s.d, 0)) AS n_docs_now FROM sentiment_label_pool p LEFT JOIN s ON p.canonical_key = s.canonical_key AND p.final_type = s.final_type GROUP BY 1, 2""",
)
def dimension_stats_join(spark, sf_dir):
    s = read(spark, sf_dir, "entity_mentions_final").groupBy("canonical_key", "final_type").agg(F.count_distinct("doc_id").alias("d"))
    p = read(spark, sf_dir, "sentiment_label_pool").select("sample_id", "canonical_key", "final_type")
    return p.join(s, ["canonical_key", "final_type"], "left").groupBy("sample_id", "canonical_key").agg(F.max(F.coalesce("d", F.lit(0))).alias("n_docs_now"))


_SCORED = """sc AS (SELECT sample_id, min(CAST(sentiment_label = 'positive' AS INT)) AS y, min(abs(CAST(('0x' || substr(md5(sample_id), 1, 6)) AS BIGINT)) / 16777216.0 * 0.5
  + CASE WHEN sentiment_label = 'positive' THEN 0.4 ELSE 0.1 END) AS p FROM sentiment_training_data GROUP BY 1)"""


def _scored(spark, sf_dir):
    h = F.conv(F.substring(F.md5("sample_id"), 1, 6), 16, 10).cast("long") / 16777216.0
    return read(spark, sf_dir, "sentiment_training_data").groupBy("sample_id").agg(
        F.min((F.col("sentiment_label") == "positive").cast("int")).alias("y"),
        F.min(h * 0.5 + F.when(F.col("sentiment_label") == "positive", 0.4).otherwise(0.1)).alias("p"))


_AUDIT = f"""WITH {_SCORED}, g AS (SELECT round(0.2 + i * 0.02, 10) AS t FROM range(36) r(i)),
c AS (SELECT t AS threshold, count(*) FILTER (p >= t AND y = 1) AS tp, count(*) FILTER (p >= t AND y = 0) AS fp, count(*) FILTER (p < t AND y = 1) AS fn, count(*) FILTER (p < t AND y = 0) AS tn
  FROM sc, g GROUP BY 1)
SELECT threshold, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round((tp + fp) / (tp + fp + fn + tn), 6) AS positive_rate FROM c"""


@R.query("threshold_audit", _AUDIT)
def threshold_audit(spark, sf_dir):
    return _rounded(metrics.threshold_audit(_scored(spark, sf_dir), "y", "p", 0.20, 0.90, 0.02))


@R.query("best_threshold", f"SELECT * FROM ({_AUDIT}) ORDER BY f1 DESC, threshold LIMIT 1")
def best_threshold(spark, sf_dir):
    return metrics.best_threshold(_rounded(metrics.threshold_audit(_scored(spark, sf_dir), "y", "p", 0.20, 0.90, 0.02)))


_GUESS = """gs AS (SELECT sample_id, sentiment_label AS t, CASE WHEN substr(md5(sample_id), 1, 1) < '4' THEN 'mixed_or_unclear' ELSE sentiment_label END AS p FROM sentiment_training_data)"""


def _guessed(spark, sf_dir):
    return read(spark, sf_dir, "sentiment_training_data").select(
        "sample_id", F.col("sentiment_label").alias("t"),
        F.when(F.substring(F.md5("sample_id"), 1, 1) < "4", "mixed_or_unclear").otherwise(F.col("sentiment_label")).alias("p"))


_L = "(VALUES ('negative'), ('mixed_or_unclear'), ('positive'))"
_CONF = f"""WITH {_GUESS}, cf AS (SELECT a.l AS true_label, b.l AS pred_label, (SELECT count(*) FROM gs WHERE t = a.l AND p = b.l) AS n FROM {_L} a(l), {_L} b(l))"""


@R.query("confusion", f"{_CONF} SELECT * FROM cf")
def confusion(spark, sf_dir):
    return metrics.confusion(_guessed(spark, sf_dir), "t", "p", fixed.SENTIMENTS)


@R.query(
    "class_report",
    f"""{_CONF}, e AS (SELECT x.l AS label, (SELECT sum(n) FROM cf WHERE true_label = x.l) AS support, (SELECT sum(n) FROM cf WHERE pred_label = x.l) AS pp,
    (SELECT sum(n) FROM cf WHERE pred_label = x.l AND true_label = x.l) AS tp FROM {_L} x(l)),
m AS (SELECT label, support, coalesce(tp / nullif(pp, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(pp + support, 0), 0) AS f1 FROM e)
SELECT label, CAST(support AS BIGINT) AS support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m
UNION ALL SELECT 'macro avg', CAST(sum(support) AS BIGINT), round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) FROM m
UNION ALL SELECT 'weighted avg', CAST(sum(support) AS BIGINT), round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6) FROM m""",
)
def class_report(spark, sf_dir):
    return _rounded(metrics.class_report(_guessed(spark, sf_dir), "t", "p", fixed.SENTIMENTS))


@R.query(
    "class_weights",
    f"""WITH c AS (SELECT x.l AS label, (SELECT count(*) FROM sentiment_training_data WHERE sentiment_label = x.l) AS n FROM {_L} x(l))
SELECT label, n, round((1.0 / greatest(n, 1)) / avg(1.0 / greatest(n, 1)) OVER (), 6) AS weight FROM c""",
)
def class_weights(spark, sf_dir):
    return _rounded(metrics.class_weights(read(spark, sf_dir, "sentiment_training_data"), "sentiment_label", fixed.SENTIMENTS))


@R.query(
    "hard_cases",
    f"""WITH {_GUESS} SELECT g.sample_id, g.t AS true_label, g.p AS pred_label, min(s.confidence) AS confidence FROM gs g JOIN sentiment_training_data s USING (sample_id)
WHERE g.t <> g.p GROUP BY ALL ORDER BY confidence DESC, sample_id LIMIT {fixed.HARD_CASES}""",
)
def hard_cases(spark, sf_dir):
    g = _guessed(spark, sf_dir).where("t <> p").join(read(spark, sf_dir, "sentiment_training_data").select("sample_id", "confidence"), "sample_id")
    return g.groupBy("sample_id", F.col("t").alias("true_label"), F.col("p").alias("pred_label")).agg(F.min("confidence").alias("confidence")).orderBy(
        F.desc("confidence"), "sample_id").limit(fixed.HARD_CASES)


_POOL1 = "po AS (SELECT DISTINCT sample_id, canonical_key, lower(trim(final_type)) AS ft, n_docs FROM sentiment_label_pool)"


def _pool(spark, sf_dir):
    return read(spark, sf_dir, "sentiment_label_pool").select("sample_id", "canonical_key", F.lower(F.trim("final_type")).alias("ft"), "n_docs").distinct()


@R.query("strata_weights", f"WITH {_POOL1} SELECT ft, count(*) AS n_rows, round(count(*) / sum(count(*)) OVER (), 6) AS weight FROM po GROUP BY 1")
def strata_weights(spark, sf_dir):
    return _rounded(sampling.strata_weights(_pool(spark, sf_dir), ["ft"]))


@R.query(
    "simple_sample",
    f"WITH {_POOL1} SELECT sample_id, ft FROM po ORDER BY {S.draw('sample_id')}, sample_id LIMIT 100",
)
def simple_sample(spark, sf_dir):
    return sampling.simple_sample(_pool(spark, sf_dir), "sample_id", 100).select("sample_id", "ft")


@R.query(
    "stratified_sample",
    f"""WITH {_POOL1}, w AS (SELECT ft, count(*) AS n, count(*) / sum(count(*)) OVER () AS w FROM po GROUP BY 1), b AS (SELECT ft, w * 200 AS raw, greatest(1, floor(w * 200)) AS base FROM w),
f AS (SELECT *, row_number() OVER (ORDER BY raw - floor(raw) DESC, ft) AS fr, 200 - sum(base) OVER () AS missing FROM b),
t AS (SELECT ft, base + CASE WHEN fr <= missing THEN 1 ELSE 0 END AS target FROM f),
r AS (SELECT po.*, row_number() OVER (PARTITION BY ft ORDER BY {S.draw('sample_id')}, sample_id) AS rn FROM po)
SELECT sample_id, ft FROM r JOIN t USING (ft) WHERE rn <= target""",
)
def stratified_sample(spark, sf_dir):
    p = _pool(spark, sf_dir)
    return sampling.stratified_sample(p, ["ft"], "sample_id", sampling.allocation(p, ["ft"], 200)).select("sample_id", "ft")


@R.query(
    "capped_sample",
    f"""WITH {_POOL1}, c AS (SELECT *, row_number() OVER (PARTITION BY canonical_key ORDER BY {S.draw('sample_id')}, sample_id) AS rn FROM po)
SELECT sample_id, canonical_key FROM c WHERE rn <= 5 ORDER BY {S.draw('sample_id')}, sample_id LIMIT 120""",
)
def capped_sample(spark, sf_dir):
    return sampling.capped_sample(_pool(spark, sf_dir), ["canonical_key"], "sample_id", 5, 120).select("sample_id", "canonical_key")


def _pool_sql(kind, n):
    tiers = " UNION ALL ".join(
        f"""SELECT * FROM (SELECT sample_id, canonical_key, ft FROM (SELECT *, row_number() OVER (PARTITION BY canonical_key ORDER BY {S.draw('sample_id')}, sample_id) AS rn FROM tp
  WHERE tier = '{t}' AND ft = '{kind}') WHERE rn <= {fixed.PER_ENTITY[t][kind]} ORDER BY {S.draw('sample_id')}, sample_id LIMIT {round(s * n)})""" for t, s in fixed.TIER_SHARES.items())
    return f"""SELECT * FROM (WITH q AS ({tiers}), a AS (SELECT *, 0 AS o FROM q UNION ALL
  SELECT * FROM (SELECT sample_id, canonical_key, ft, 1 FROM tp WHERE ft = '{kind}' AND sample_id NOT IN (SELECT sample_id FROM q) ORDER BY {S.draw('sample_id')}, sample_id LIMIT {n}))
SELECT sample_id, canonical_key, ft FROM a ORDER BY o, {S.draw('sample_id')}, sample_id LIMIT {n})"""


@R.query("quota_pool", f"WITH {_POOL1}, tp AS (SELECT *, {S.tier('n_docs')} AS tier FROM po) " + " UNION ALL ".join(_pool_sql(k, n) for k, n in fixed.TYPE_TARGETS.items()))
def quota_pool(spark, sf_dir):
    from presswork.functions.entity import tier

    p = _pool(spark, sf_dir).withColumn("tier", tier(F.col("n_docs")))
    return sampling.typed_pools(p, "ft", fixed.TYPE_TARGETS, "tier", ["canonical_key"], "sample_id", fixed.TIER_SHARES, fixed.PER_ENTITY).select(
        "sample_id", "canonical_key", "ft")


@R.query(
    "label_split",
    f"""WITH u AS (SELECT sample_id, min(sentiment_label) AS l FROM sentiment_training_data GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY {S.draw('sample_id')}, sample_id) AS rn,
  round_even(count(*) OVER (PARTITION BY l) * 0.15, 0) AS k FROM u)
SELECT sample_id, l, CASE WHEN rn <= k THEN 'valid' ELSE 'train' END AS split FROM r""",
)
def label_split(spark, sf_dir):
    u = read(spark, sf_dir, "sentiment_training_data").groupBy("sample_id").agg(F.min("sentiment_label").alias("l"))
    return sampling.stratified_split(u, ["l"], "sample_id", fixed.VALID_SHARE).select("sample_id", "l", "split")


_GSPLIT = f"""WITH s AS (SELECT canonical_key, count(*) AS n_rows, count(DISTINCT doc_id) AS n_docs FROM sentiment_training_data GROUP BY 1),
ty AS (SELECT canonical_key, arg_min(v, (-n, v)) AS main_type FROM (SELECT canonical_key, final_type AS v, count(*) AS n FROM sentiment_training_data WHERE final_type IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
la AS (SELECT canonical_key, arg_min(v, (-n, v)) AS main_label FROM (SELECT canonical_key, sentiment_label AS v, count(*) AS n FROM sentiment_training_data WHERE sentiment_label IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
t AS (SELECT s.*, main_type, main_label, coalesce(main_type, 'nan') || '|||' || coalesce(main_label, 'nan') || '|||' || CASE WHEN n_docs >= {fixed.HEAD_DOCS} THEN 'head' WHEN n_docs >= {fixed.MID_DOCS} THEN 'mid' ELSE 'tail' END AS stratum
  FROM s LEFT JOIN ty USING (canonical_key) LEFT JOIN la USING (canonical_key)),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {S.draw('canonical_key')}, canonical_key) <= greatest(1, round_even(count(*) OVER (PARTITION BY stratum) * {fixed.GROUP_VALID_SHARE}, 0)) AS chosen FROM t),
more AS (SELECT *, CASE WHEN NOT chosen THEN sum(CASE WHEN chosen THEN 0 ELSE n_rows END) OVER (ORDER BY {S.draw('canonical_key')}, canonical_key) - n_rows END AS before,
  {fixed.VALID_ROWS} - sum(CASE WHEN chosen THEN n_rows ELSE 0 END) OVER () AS missing FROM r)
SELECT canonical_key, n_rows, main_label, stratum, CASE WHEN chosen OR before < missing THEN 'valid' ELSE 'train' END AS split FROM more"""


def _groups(spark, sf_dir):
    return sampling.group_split(
        read(spark, sf_dir, "sentiment_training_data"), "canonical_key", "sentiment_label", fixed.GROUP_VALID_SHARE,
        kind="final_type", docs="doc_id", least_rows=fixed.VALID_ROWS)


@R.query("group_split", _GSPLIT)
def group_split(spark, sf_dir):
    return _groups(spark, sf_dir).select("canonical_key", "n_rows", "main_label", "stratum", "split")


@R.query("leakage_check", f"""SELECT count(*) AS n_leaked FROM (SELECT canonical_key FROM ({_GSPLIT}) WHERE split = 'train' INTERSECT SELECT canonical_key FROM ({_GSPLIT}) WHERE split = 'valid')""")
def leakage_check(spark, sf_dir):
    g = _groups(spark, sf_dir)
    return g.where("split = 'train'").select("canonical_key").intersect(g.where("split = 'valid'").select("canonical_key")).agg(F.count(F.lit(1)).alias("n_leaked"))


@R.query(
    "split_crosstab",
    f"""SELECT split, count(*) FILTER (main_label = 'negative') AS negative, count(*) FILTER (main_label = 'mixed_or_unclear') AS mixed_or_unclear, count(*) FILTER (main_label = 'positive') AS positive FROM ({_GSPLIT}) GROUP BY 1""",
)
def split_crosstab(spark, sf_dir):
    return _groups(spark, sf_dir).groupBy("split").pivot("main_label", list(fixed.SENTIMENTS)).count().na.fill(0)


@R.query(
    "union_dedup",
    """WITH u AS (SELECT sample_id, canonical_key FROM sentiment_label_pool UNION ALL SELECT sample_id, canonical_key FROM sentiment_training_data)
SELECT sample_id, min(canonical_key) AS canonical_key FROM u GROUP BY 1""",
)
def union_dedup(spark, sf_dir):
    u = read(spark, sf_dir, "sentiment_label_pool").select("sample_id", "canonical_key").unionByName(
        read(spark, sf_dir, "sentiment_training_data").select("sample_id", "canonical_key"))
    return tables.keep_one(u, ["sample_id"], [F.asc_nulls_last("canonical_key")])


@R.query("except_keys", "SELECT DISTINCT sample_id FROM sentiment_label_pool EXCEPT SELECT sample_id FROM sentiment_training_data")
def except_keys(spark, sf_dir):
    return read(spark, sf_dir, "sentiment_label_pool").select("sample_id").subtract(read(spark, sf_dir, "sentiment_training_data").select("sample_id"))


@R.query("label_summary", """SELECT sentiment_label, count(*) AS n_samples, count(DISTINCT canonical_entity) AS n_entities, count(DISTINCT doc_id) AS n_docs, round(avg(confidence), 6) AS confidence_mean
FROM sentiment_training_data GROUP BY 1""")
def label_summary(spark, sf_dir):
    return read(spark, sf_dir, "sentiment_training_data").groupBy("sentiment_label").agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_distinct("canonical_entity").alias("n_entities"), F.count_distinct("doc_id").alias("n_docs"),
        F.round(F.avg("confidence"), 6).alias("confidence_mean"))


_SHAPE = """{'has_hash_prefix': starts_with(trim(canonical_entity), '#'), 'has_dollar_prefix': starts_with(trim(canonical_entity), '$'),
  'contains_digit': regexp_matches(canonical_entity, '[0-9]'), 'token_count': len(regexp_split_to_array(trim(regexp_replace(canonical_entity, '\\s+', ' ', 'g')), ' ')),
  'is_all_caps': upper(canonical_entity) = canonical_entity AND lower(canonical_entity) <> canonical_entity}"""


@R.query(
    "prompt_json",
    f"""SELECT DISTINCT sample_id, to_json({{'canonical_entity': canonical_entity, 'canonical_key': canonical_key, 'final_type_input': final_type, 'n_docs': n_docs, 'n_rows': n_rows,
  'n_domains': n_domains, 'shape_signals': {_SHAPE}}}) AS prompt FROM sentiment_label_pool
WHERE canonical_entity IS NOT NULL AND canonical_key IS NOT NULL AND final_type IS NOT NULL AND n_docs IS NOT NULL AND n_rows IS NOT NULL AND n_domains IS NOT NULL""",
)
def prompt_json(spark, sf_dir):
    """One compact JSON request a sample, with what the name looks like."""
    pool = read(spark, sf_dir, "sentiment_label_pool").na.drop(subset=["canonical_entity", "canonical_key", "final_type", "n_docs", "n_rows", "n_domains"])
    e = F.col("canonical_entity")
    shape = F.struct(
        F.trim(e).startswith("#").alias("has_hash_prefix"), F.trim(e).startswith("$").alias("has_dollar_prefix"), e.rlike("[0-9]").alias("contains_digit"),
        F.size(F.split(F.trim(F.regexp_replace(e, r"\s+", " ")), " ")).alias("token_count"),
        ((F.upper(e) == e) & (F.lower(e) != e)).alias("is_all_caps"))
    return pool.select("sample_id", F.to_json(F.struct(
        e, "canonical_key", F.col("final_type").alias("final_type_input"), "n_docs", "n_rows", "n_domains", shape.alias("shape_signals"))).alias("prompt")).distinct()


@R.query(
    "prompt_text",
    """SELECT DISTINCT sample_id, 'Entity: ' || coalesce(canonical_entity, '') || chr(10) || 'Type: ' || coalesce(final_type, '') || chr(10) || 'Title: ' || coalesce(title, '') || chr(10) || 'Text: ' ||
  left(coalesce(context_text, ''), 1400) AS prompt FROM sentiment_label_pool""",
)
def prompt_text(spark, sf_dir):
    """The same request as a text template."""
    part = lambda name, c: F.concat(F.lit(name + ": "), F.coalesce(c, F.lit("")))
    return read(spark, sf_dir, "sentiment_label_pool").select("sample_id", F.concat_ws(
        "\n", part("Entity", F.col("canonical_entity")), part("Type", F.col("final_type")), part("Title", F.col("title")),
        part("Text", F.left("context_text", F.lit(fixed.CONTEXT_CHARS)))).alias("prompt")).distinct()


@R.query(
    "low_value_flags",
    f"""SELECT DISTINCT canonical_entity, final_type, coalesce((final_type = 'person' AND {S.isin(S.entity_key('canonical_entity', camel=False), fixed.GENERIC_ACTORS)})
  OR (final_type = 'government_institution' AND {S.isin(S.entity_key('canonical_entity', camel=False), fixed.GENERIC_PLACES)})
  OR (final_type = 'technology' AND {S.isin(S.entity_key('canonical_entity', camel=False), fixed.LOW_VALUE_TECHNOLOGY)}), false) AS low FROM sentiment_label_pool""",
)
def low_value_flags(spark, sf_dir):
    from presswork.functions.entity import low_value

    p = read(spark, sf_dir, "sentiment_label_pool").select("canonical_entity", "final_type").distinct()
    return p.withColumn("low", low_value(F.col("canonical_entity"), F.col("final_type")))
