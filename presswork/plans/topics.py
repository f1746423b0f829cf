"""Queries over topic facts: order lines play the blocks of documents, part brands the topics."""

from pyspark.sql import functions as F

from presswork.operators import sentiment, tables
from presswork.operators import topics as op
from presswork.plans.registry import Registry
from presswork.session import read

R = Registry()

_FACTS = """f AS (SELECT l_orderkey AS doc_id, l_orderkey || ':' || l_linenumber AS block_uid,
  CASE WHEN p_size % 7 = 0 THEN -1 ELSE p_size % 20 END AS topic_id, l_discount * 3.141592653589793 + 0.3071 AS topic_prob, CAST(l_quantity AS BIGINT) AS block_len,
  strftime(l_shipdate, '%Y-%m') AS year_month, CAST(l_suppkey % 40 AS VARCHAR) AS domain FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def facts(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    p = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("doc_id"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("block_uid"),
        F.when(F.col("p_size") % 7 == 0, -1).otherwise(F.col("p_size") % 20).alias("topic_id"),
        (F.col("l_discount") * 3.141592653589793 + 0.3071).alias("topic_prob"), F.col("l_quantity").cast("long").alias("block_len"),
        F.date_format("l_shipdate", "yyyy-MM").alias("year_month"), (F.col("l_suppkey") % 40).cast("string").alias("domain"))


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_DIST = f"""WITH {_FACTS}, g AS (SELECT doc_id, topic_id, count(*) AS n_blocks, avg(topic_prob) AS mean_topic_prob, avg(block_len) AS mean_block_len, CAST(sum(block_len) AS BIGINT) AS sum_topic_text_len FROM f GROUP BY 1, 2),
dd AS (SELECT *, CAST(sum(n_blocks) OVER (PARTITION BY doc_id) AS BIGINT) AS doc_topic_total_blocks, n_blocks / sum(n_blocks) OVER (PARTITION BY doc_id) AS topic_block_share_within_doc FROM g)"""


@R.query(
    "doc_topic_distribution",
    f"""{_DIST} SELECT doc_id, topic_id, n_blocks, round(mean_topic_prob, 6) AS mean_topic_prob, round(mean_block_len, 6) AS mean_block_len, sum_topic_text_len, doc_topic_total_blocks,
  round(topic_block_share_within_doc, 6) AS topic_block_share_within_doc FROM dd""",
)
def doc_topic_distribution(spark, sf_dir):
    return _rounded(op.distribution(facts(spark, sf_dir)))


@R.query(
    "dominant_topic",
    f"""{_DIST} SELECT doc_id, topic_id, n_blocks FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY topic_block_share_within_doc DESC, n_blocks DESC, round(mean_topic_prob, 9) DESC, topic_id) AS rn
  FROM dd WHERE topic_id <> -1) WHERE rn = 1""",
)
def dominant_topic(spark, sf_dir):
    d = op.distribution(facts(spark, sf_dir)).withColumn("mean_topic_prob", F.round("mean_topic_prob", 9))
    return op.dominant(d).select("doc_id", "topic_id", "n_blocks")


@R.query(
    "dominant_topic_with_noise",
    f"""{_DIST} SELECT topic_id, count(*) AS n_docs FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY topic_block_share_within_doc DESC, round(mean_topic_prob, 9) DESC, n_blocks DESC, topic_id) AS rn
  FROM dd) WHERE rn = 1 GROUP BY 1""",
)
def dominant_topic_with_noise(spark, sf_dir):
    d = op.distribution(facts(spark, sf_dir)).withColumn("mean_topic_prob", F.round("mean_topic_prob", 9))
    return op.dominant(d, without_noise=False).groupBy("topic_id").agg(F.count(F.lit(1)).alias("n_docs"))


@R.query("topic_time_panel", f"""WITH {_FACTS} SELECT year_month, topic_id, count(*) AS n_blocks, count(DISTINCT doc_id) AS n_docs, count(DISTINCT domain) AS n_domains,
  round(avg(topic_prob), 6) AS mean_topic_prob FROM f GROUP BY 1, 2""")
def topic_time_panel(spark, sf_dir):
    return _rounded(op.time_panel(facts(spark, sf_dir)))


_SUM = f"""WITH {_FACTS}, t AS (SELECT CAST(i AS INT) - 1 AS topic_id FROM range(25) r(i)), g AS (SELECT topic_id, count(*) AS n_blocks, count(DISTINCT doc_id) AS n_docs, count(DISTINCT domain) AS n_domains,
  avg(topic_prob) AS avg_topic_prob, avg(block_len) AS avg_topic_text_len FROM f GROUP BY 1),
sm AS (SELECT t.topic_id, coalesce(n_blocks, 0) AS n_blocks, coalesce(n_docs, 0) AS n_docs, coalesce(n_domains, 0) AS n_domains, avg_topic_prob, avg_topic_text_len FROM t LEFT JOIN g USING (topic_id))"""


def _summary(spark, sf_dir):
    return op.summary(spark.range(25).select((F.col("id") - 1).cast("int").alias("topic_id")), facts(spark, sf_dir))


@R.query("topic_summary", f"""{_SUM} SELECT topic_id, n_blocks, n_docs, n_domains, round(avg_topic_prob, 6) AS avg_topic_prob, round(avg_topic_text_len, 6) AS avg_topic_text_len,
  topic_id = -1 AS is_noise_topic, topic_id <> -1 AS include_in_analysis FROM sm""")
def topic_summary(spark, sf_dir):
    return _rounded(_summary(spark, sf_dir))


@R.query("topic_representatives", f"""WITH {_FACTS} SELECT topic_id, block_uid, rank FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY topic_prob DESC, block_len DESC, block_uid) AS rank FROM f) WHERE rank <= 5""")
def topic_representatives(spark, sf_dir):
    return op.representatives(facts(spark, sf_dir)).select("topic_id", "block_uid", "rank")


_META = "CASE WHEN topic_id BETWEEN 0 AND 4 THEN 'a' WHEN topic_id BETWEEN 5 AND 9 THEN 'b' WHEN topic_id BETWEEN 10 AND 17 THEN 'c' END"


@R.query("meta_rollup", f"""{_SUM}, r AS (SELECT coalesce({_META}, 'Unassigned') AS meta_group, * FROM sm)
SELECT meta_group, count(*) AS n_topics, CAST(sum(n_docs) AS BIGINT) AS n_docs, round(coalesce(sum(avg_topic_prob * n_docs) / nullif(sum(n_docs), 0), 0), 6) AS weighted_prob FROM r GROUP BY 1""")
def meta_rollup(spark, sf_dir):
    s = _summary(spark, sf_dir)
    groups = s.select("topic_id", F.expr(_META).alias("meta_group")).where("meta_group is not null")
    return _rounded(op.rollup(s, groups))


@R.query("fold_small_groups", f"""WITH {_FACTS}, g AS (SELECT domain, count(*) AS n FROM f GROUP BY 1), t AS (SELECT domain FROM g ORDER BY n DESC, domain LIMIT 8)
SELECT CASE WHEN domain IN (FROM t) THEN domain ELSE 'Other' END AS domain, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY 1""")
def fold_small_groups(spark, sf_dir):
    g = facts(spark, sf_dir).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    return op.fold_small(g, "domain", "n", 8)


@R.query("month_share_smoothed", f"""WITH {_FACTS}, m AS (SELECT year_month, {', '.join(f"CAST(coalesce(sum(block_len) FILTER (topic_id = {k}), 0) AS BIGINT) AS t{k}" for k in range(4))} FROM f GROUP BY 1),
n AS (SELECT year_month, {', '.join(f'coalesce(t{k} / nullif(t0 + t1 + t2 + t3, 0), 0) AS s{k}' for k in range(4))} FROM m)
SELECT year_month, {', '.join(f'round(avg(s{k}) OVER (ORDER BY year_month ROWS 2 PRECEDING), 6) AS s{k}' for k in range(4))} FROM n""")
def month_share_smoothed(spark, sf_dir):
    m = facts(spark, sf_dir).groupBy("year_month").pivot("topic_id", [0, 1, 2, 3]).agg(F.sum("block_len")).na.fill(0)
    total = F.col("0") + F.col("1") + F.col("2") + F.col("3")
    n = m.select("year_month", *[F.coalesce(F.try_divide(str(k), total), F.lit(0.0)).alias(f"s{k}") for k in range(4)])
    for k in range(4):  # one row a month: the panel is small whatever the corpus
        n = sentiment.rolling_mean(n, [], "year_month", f"s{k}")
    return n.select("year_month", *[F.round(f"s{k}_smoothed", 6).alias(f"s{k}") for k in range(4)])


@R.query("mean_of_means", f"""WITH {_FACTS}, e AS (SELECT year_month, domain, topic_id, avg(topic_prob) AS m FROM f GROUP BY ALL)
SELECT year_month, round(avg(m), 6) AS mean_of_means FROM e GROUP BY 1""")
def mean_of_means(spark, sf_dir):
    e = facts(spark, sf_dir).groupBy("year_month", "domain", "topic_id").agg(F.avg("topic_prob").alias("m"))
    return e.groupBy("year_month").agg(F.round(F.avg("m"), 6).alias("mean_of_means"))


@R.query("dimension_left_join", f"""WITH {_FACTS}, s AS (SELECT topic_id, count(*) AS n FROM f WHERE topic_id < 10 GROUP BY 1)
SELECT year_month, coalesce(CAST(s.topic_id AS VARCHAR), 'Other') AS topic, count(*) AS n_blocks FROM f LEFT JOIN s USING (topic_id) GROUP BY ALL""")
def dimension_left_join(spark, sf_dir):
    f = facts(spark, sf_dir)
    s = f.where("topic_id < 10").select("topic_id").distinct().withColumn("topic", F.col("topic_id").cast("string"))
    return tables.left_default(f, s, ["topic_id"], {"topic": "Other"}).groupBy("year_month", "topic").agg(F.count(F.lit(1)).alias("n_blocks"))
