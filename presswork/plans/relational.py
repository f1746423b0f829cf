"""Joins, windows, sets and documents assembled from several tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from presswork.functions import text
from presswork.operators import tables
from presswork.plans import sqltext as S
from presswork.plans.registry import Registry
from presswork.providers.base import parse_reply
from presswork.session import read

R = Registry()


@R.query(
    "null_safe_join",
    """WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS k FROM customer), b AS (SELECT n_name, CASE WHEN n_nationkey = 3 THEN NULL ELSE n_nationkey END AS k FROM nation)
SELECT c_custkey, n_name FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k""",
)
def null_safe_join(spark, sf_dir):
    a = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey")).alias("k"))
    b = read(spark, sf_dir, "nation").select("n_name", F.when(F.col("n_nationkey") != 3, F.col("n_nationkey")).alias("k"))
    return tables.null_safe_join(a, b, ["k"]).select("c_custkey", "n_name")


@R.query(
    "doc_bundles",
    """WITH l AS (SELECT l_orderkey, count(*) AS n_rows, count(DISTINCT l_partkey) AS n_entities, avg(l_discount) AS score, sum(l_quantity) AS qty FROM lineitem GROUP BY 1),
c AS (SELECT l_orderkey, p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
t AS (SELECT l_orderkey, list(p_brand ORDER BY n DESC, p_brand) AS top_companies FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, p_brand) AS rn FROM c) WHERE rn <= 3 GROUP BY 1),
s AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS snippets FROM lineitem WHERE l_linenumber <= 3 AND l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey AS doc_id, strftime(o_orderdate, '%Y-%m') AS year_month, c_mktsegment AS domain, coalesce(n_rows, 0) AS n_rows, coalesce(n_entities, 0) AS n_entities, round(score, 6) AS score,
  coalesce(top_companies, []) AS top_companies, coalesce(snippets, []) AS snippets
FROM orders LEFT JOIN l ON o_orderkey = l.l_orderkey LEFT JOIN t ON o_orderkey = t.l_orderkey LEFT JOIN s ON o_orderkey = s.l_orderkey LEFT JOIN customer ON o_custkey = c_custkey
WHERE len(coalesce(top_companies, [])) + len(coalesce(snippets, [])) >= 2""",
)
def doc_bundles(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    stats = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("l_partkey").alias("n_entities"), F.avg("l_discount").alias("score"))
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    brands = li.select("l_orderkey", "l_partkey").join(part, "l_partkey").groupBy("l_orderkey", "p_brand").agg(F.count(F.lit(1)).alias("n"))
    top = tables.top_n(brands, ["l_orderkey"], [F.desc("n"), F.col("p_brand")], 3, "rn").groupBy("l_orderkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "p_brand"))), lambda x: x["p_brand"]).alias("top_companies"))
    snip = li.where("l_linenumber <= 3 and l_returnflag = 'R'").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("snippets"))
    cust = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    d = o.withColumnRenamed("o_orderkey", "l_orderkey")
    for side in (stats, top, snip):  # all three are grouped by the order: one exchange of it serves all
        d = d.join(side, "l_orderkey", "left")
    d = d.join(cust, "o_custkey", "left").select(
        F.col("l_orderkey").alias("doc_id"), F.date_format("o_orderdate", "yyyy-MM").alias("year_month"), F.col("c_mktsegment").alias("domain"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_entities", F.lit(0)).alias("n_entities"), F.round("score", 6).alias("score"),
        F.coalesce("top_companies", F.array().cast("array<string>")).alias("top_companies"), F.coalesce("snippets", F.array().cast("array<int>")).alias("snippets"))
    return d.where(F.size("top_companies") + F.size("snippets") >= 2)


@R.query(
    "chained_left_joins",
    """SELECT n_name, r_name, coalesce(s.n, 0) AS n_suppliers, coalesce(c.n, 0) AS n_customers, round(coalesce(c.b, 0), 2) AS balance_sent FROM nation JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON s.k = n_nationkey LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n, sum(c_acctbal) AS b FROM customer GROUP BY 1) c ON c.k = n_nationkey""",
)
def chained_left_joins(spark, sf_dir):
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    c = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n_customers"), F.sum("c_acctbal").alias("b"))
    return n.join(s, "n_nationkey", "left").join(c, "n_nationkey", "left").select(
        "n_name", "r_name", F.coalesce("n_suppliers", F.lit(0)).alias("n_suppliers"), F.coalesce("n_customers", F.lit(0)).alias("n_customers"),
        F.round(F.coalesce("b", F.lit(0.0)), 2).alias("balance_sent"))


@R.query(
    "label_log_compaction",
    "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
)
def label_log_compaction(spark, sf_dir):
    return tables.compact_log(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@R.query("manifest_upsert", """WITH old AS (SELECT n_nationkey AS k, n_name AS v FROM nation), new AS (SELECT n_nationkey AS k, upper(n_name) || '!' AS v FROM nation WHERE n_nationkey % 4 = 0)
SELECT * FROM old WHERE k NOT IN (SELECT k FROM new) UNION ALL SELECT * FROM new""")
def manifest_upsert(spark, sf_dir):
    old = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    return tables.upsert(old, old.where("k % 4 = 0").select("k", F.concat(F.upper("v"), F.lit("!")).alias("v")), ["k"])


@R.query("occurrence_numbers", """SELECT doc_id || '||' || block_id || '||' || canonical_entity || '||' || (row_number() OVER (PARTITION BY doc_id, block_id, canonical_entity
  ORDER BY confidence DESC NULLS LAST, clean_block_len, md5(clean_block_text), title NULLS LAST, date NULLS LAST, url NULLS LAST) - 1) AS row_uid, confidence FROM entity_contexts_final""")
def occurrence_numbers(spark, sf_dir):
    w = Window.partitionBy("doc_id", "block_id", "canonical_entity").orderBy(
        F.desc_nulls_last("confidence"), "clean_block_len", F.md5("clean_block_text"), F.asc_nulls_last("title"), F.asc_nulls_last("date"), F.asc_nulls_last("url"))
    return read(spark, sf_dir, "entity_contexts_final").select(
        F.concat_ws("||", "doc_id", "block_id", "canonical_entity", (F.row_number().over(w) - 1).cast("string")).alias("row_uid"), "confidence")


@R.query("type_label_share", """SELECT l_returnflag, l_linestatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 6) AS share, round(avg(l_discount), 6) AS mean_discount,
  sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2""")
def type_label_share(spark, sf_dir):
    g = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 6).alias("mean_discount"), F.sum("l_quantity").alias("qty"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("l_returnflag")), 6))


@R.query("weighted_rollup", """SELECT p_brand, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS weighted_discount, CAST(sum(l_quantity) AS BIGINT) AS weight FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def weighted_rollup(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return read(spark, sf_dir, "lineitem").select("l_partkey", "l_discount", "l_quantity").join(p, "l_partkey").groupBy("p_brand").agg(
        F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 6).alias("weighted_discount"), F.sum("l_quantity").cast("long").alias("weight"))


@R.query("reply_parse", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, least(greatest(value, 0), 1) AS value_clipped, left(event_type, 4) AS reason FROM events""")
def reply_parse(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("reply", F.concat(F.lit("Sure: "), "props", F.lit(" .")))
    return parse_reply(e, "reply", "k long").select(
        "event_id", F.col("parsed.k").alias("k"), text.clamp(F.col("value"), 0.0, 1.0).alias("value_clipped"), F.left("event_type", F.lit(4)).alias("reason"))


@R.query("median_fill", """SELECT c_custkey, coalesce(CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END, (SELECT median(CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END) FROM customer), 0) AS c_acctbal FROM customer""")
def median_fill(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("b"))
    m = c.agg(F.coalesce(F.median("b"), F.lit(0.0)).alias("m"))
    return c.select("c_custkey", F.coalesce(F.col("b"), m.scalar()).alias("c_acctbal"))


@R.query("bubble_sizes", """WITH g AS (SELECT s_nationkey, count(*) AS n, avg(s_acctbal) AS b FROM supplier GROUP BY 1)
SELECT s_nationkey, round(CASE WHEN max(n) OVER () = min(n) OVER () THEN 100 ELSE 100 + 900 * (n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ()) END, 6) AS size,
  round(n / max(n) OVER (), 6) AS relative, bround_b AS balance FROM (SELECT *, round_even(b, 2) AS bround_b FROM g)""")
def bubble_sizes(spark, sf_dir):
    g = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.avg("s_acctbal").alias("b"))
    lo, hi = g.agg(F.min("n")).scalar(), g.agg(F.max("n")).scalar()
    return g.select(
        "s_nationkey", F.round(F.when(hi == lo, 100.0).otherwise(100 + 900 * (F.col("n") - lo) / (hi - lo)), 6).alias("size"),
        F.round(F.col("n") / hi, 6).alias("relative"), F.bround("b", 2).alias("balance"))


@R.query("except_all_plan", "SELECT doc_id FROM news_final_project EXCEPT ALL SELECT doc_id FROM sentences")
def except_all_plan(spark, sf_dir):
    return read(spark, sf_dir, "news_final_project").select("doc_id").exceptAll(read(spark, sf_dir, "sentences").select("doc_id"))


@R.query("distinct_pairs", "SELECT DISTINCT doc_id, domain FROM sentences")
def distinct_pairs(spark, sf_dir):
    return read(spark, sf_dir, "sentences").select("doc_id", "domain").distinct()


@R.query("short_labels", f"""SELECT DISTINCT sample_id, CASE WHEN length(replace(split_part(canonical_key || '||' || final_type, '||', 1), '_', ' ')) > 12
  THEN left(replace(split_part(canonical_key || '||' || final_type, '||', 1), '_', ' '), 11) || '…' ELSE replace(split_part(canonical_key || '||' || final_type, '||', 1), '_', ' ') END AS label,
  {S.squeeze('title')} = '' AS untitled FROM sentiment_label_pool""")
def short_labels(spark, sf_dir):
    return read(spark, sf_dir, "sentiment_label_pool").select(
        "sample_id", text.short_label(F.concat("canonical_key", F.lit("||"), "final_type"), 12).alias("label"),
        (text.squeeze(F.col("title")) == "").alias("untitled")).distinct()


@R.query("evidence_table", """WITH g AS (SELECT c_mktsegment, n_name, count(*) AS n, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
s AS (SELECT c_mktsegment, CAST(sum(n) AS BIGINT) AS n_rows, round(sum(v) / 1000, 2) AS volume FROM g GROUP BY 1 ORDER BY n_rows DESC, c_mktsegment LIMIT 6),
t AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, n_name) AS rk FROM g)
SELECT s.c_mktsegment, s.n_rows, s.volume, string_agg(t.n_name, ', ' ORDER BY rk) AS top_nations FROM s JOIN t ON s.c_mktsegment = t.c_mktsegment AND rk <= 3 GROUP BY ALL""")
def evidence_table(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    g = o.join(c, "o_custkey").join(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey").groupBy("c_mktsegment", "n_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("v"))
    s = g.groupBy("c_mktsegment").agg(F.sum("n").alias("n_rows"), F.round(F.sum("v") / 1000, 2).alias("volume")).orderBy(F.desc("n_rows"), "c_mktsegment").limit(6)
    t = tables.top_n(g, ["c_mktsegment"], [F.desc("n"), F.col("n_name")], 3, "rk").groupBy("c_mktsegment").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "n_name"))), lambda x: x["n_name"]), ", ").alias("top_nations"))
    return s.join(t, "c_mktsegment")
