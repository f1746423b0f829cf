"""Calendar and streaming queries over events, and round trips of sources, sinks and providers."""

import re
import uuid

from pyspark.sql import functions as F

from presswork.functions import fixed, text
from presswork.operators import metrics, sampling, segment, tables
from presswork.operators import sentiment as op
from presswork.plans import sqltext as S
from presswork.plans.registry import Registry
from presswork.providers import base, models
from presswork.session import own_dir, read
from presswork.sources import files
from presswork.streaming import buckets

R = Registry()


def _events(spark, sf_dir):
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


_MONTH = "SELECT strftime(ts, '%Y-%m') AS year_month, count(*) AS n, round(sum(value), 4) AS value_sum FROM events GROUP BY 1"


@R.query("monthly_counts", _MONTH)
def monthly_counts(spark, sf_dir):
    return _events(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM").alias("year_month")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value_sum"))


@R.query("daily_rolling", """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, strftime(day, '%Y-%m-%d') AS day, n, round(avg(n) OVER (PARTITION BY event_type ORDER BY day ROWS 2 PRECEDING), 6) AS n_smoothed FROM d""")
def daily_rolling(spark, sf_dir):
    d = _events(spark, sf_dir).groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return op.rolling_mean(d, ["event_type"], "day", "n").withColumn("n_smoothed", F.round("n_smoothed", 6))


_WINDOW = "SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d') AS window_start, event_type, count(*) AS n_rows, round(sum(value), 4) AS value_sum FROM events GROUP BY 1, 2"


def _shown(df):
    return df.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "event_type", "n_rows", F.round("value_sum", 4).alias("value_sum"))


@R.query("window_counts_batch", _WINDOW)
def window_counts_batch(spark, sf_dir):
    return _shown(buckets.window_counts(_events(spark, sf_dir), "ts", ["event_type"], "1 day", "1 day"))


@R.query("stream_window_counts", _WINDOW)
def stream_window_counts(spark, sf_dir):
    src = read(spark, sf_dir, "events")
    s = buckets.read_files(spark, f"{sf_dir}/events.parquet*", src.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    return _shown(buckets.run_to_table(buckets.window_counts(s, "ts", ["event_type"], "1 day", "3650 days"), "windows", "complete"))


@R.query("stream_sliding_counts", """SELECT strftime(w, '%Y-%m-%d') AS window_start, event_type, count(*) AS n_rows, round(sum(value), 4) AS value_sum
FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL '1 day', ts), time_bucket(INTERVAL '1 day', ts) - INTERVAL '1 day', time_bucket(INTERVAL '1 day', ts) - INTERVAL '2 day']) AS w FROM events) GROUP BY 1, 2""")
def stream_sliding_counts(spark, sf_dir):
    src = read(spark, sf_dir, "events")
    s = buckets.read_files(spark, f"{sf_dir}/events.parquet*", src.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    return _shown(buckets.run_to_table(buckets.window_counts(s, "ts", ["event_type"], "3 days", "3650 days", "1 day"), "sliding", "complete"))


@R.query("stream_dedup", "SELECT DISTINCT event_id FROM events")
def stream_dedup(spark, sf_dir):
    src = read(spark, sf_dir, "events")
    s = buckets.read_files(spark, f"{sf_dir}/events.parquet*", src.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    twice = s.unionByName(s).select("event_id", "ts")
    return buckets.run_to_table(buckets.deduplicated(twice, ["event_id"], "ts", "3650 days"), "dedup").select("event_id")


def _place(spark, name):
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


@R.query("jsonl_round_trip", "SELECT sample_id, min(sentiment_label) AS sentiment_label, max(confidence) AS confidence FROM sentiment_training_data GROUP BY 1")
def jsonl_round_trip(spark, sf_dir):
    """Labels through a log of JSON lines: appended twice, compacted, read."""
    t = read(spark, sf_dir, "sentiment_training_data").groupBy("sample_id").agg(
        F.min("sentiment_label").alias("sentiment_label"), F.max("confidence").alias("confidence"))
    log = _place(spark, "log")
    first, last = t.withColumns({"sentiment_label": F.lit("pending"), "seq": F.lit(0).cast("long")}), t.withColumn("seq", F.lit(1).cast("long"))
    files.append_json_lines(first, log)
    files.append_json_lines(last, log)
    return files.compact_log(spark, log, last.schema, ["sample_id"], "seq", _place(spark, "compact")).drop("seq")


@R.query("csv_round_trip", "SELECT n_nationkey, n_name, 'a \"quoted\", ' || n_name AS note FROM nation")
def csv_round_trip(spark, sf_dir):
    t = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.concat(F.lit('a "quoted", '), "n_name").alias("note"))
    path = _place(spark, "csv")
    files.write_csv(t, path)
    return files.read_csv(spark, path, t.schema)


@R.query("shard_round_trip", "SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_docs, sum(n_chars) AS n_chars FROM documents")
def shard_round_trip(spark, sf_dir):
    path = _place(spark, "shards")
    files.write_shards(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), path, 400)
    return files.read_parquet(spark, path, ["doc_id", "n_chars"]).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("doc_id").alias("n_docs"), F.sum("n_chars").alias("n_chars"))


@R.query("incremental_append", "SELECT event_id, user_id FROM events")
def incremental_append(spark, sf_dir):
    """Half the rows, then all of them twice over: each key is stored once."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id")
    path = _place(spark, "append")
    files.append_missing(e.where("event_id < 5000"), path, ["event_id"])
    files.append_missing(e, path, ["event_id"])
    files.append_missing(e, path, ["event_id"])
    return spark.read.parquet(path)


@R.query("materialized_view", f"SELECT domain, count(*) AS n FROM (SELECT {S.domain('url')} AS domain FROM news_final_project) GROUP BY 1")
def materialized_view(spark, sf_dir):
    from presswork.functions import web

    path = _place(spark, "view")
    build = lambda: read(spark, sf_dir, "news_final_project").groupBy(web.domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))
    files.materialize(spark, path, build)
    return files.materialize(spark, path, build, columns=["domain", "n"])


@R.query("keyword_labels", f"""WITH b AS (SELECT DISTINCT block_uid, clean_block_text AS t FROM entity_mentions_raw), u AS (SELECT block_uid, max(t) AS t FROM b GROUP BY 1)
SELECT block_uid, CASE WHEN {S.words('t', fixed.KEYWORDS)} THEN '1' ELSE '0' END AS label, 0.9 AS confidence, 'ok' AS label_status FROM u""")
def keyword_labels(spark, sf_dir):
    u = read(spark, sf_dir, "entity_mentions_raw").groupBy("block_uid").agg(F.max("clean_block_text").alias("t"))
    pattern = r"(?i)(^|[^\w])(" + "|".join(re.escape(k) for k in fixed.KEYWORDS) + r")([^\w]|$)"
    return base.label_rows(u, "block_uid", "t", base.KeywordLabeler(pattern)).select("block_uid", "label", "confidence", "label_status")


@R.query("classifier_fit_score")
def classifier_fit_score(spark, sf_dir):
    """Quality, at the best threshold, of a classifier of given labels, on entities it was not trained on."""
    s = read(spark, sf_dir, "sentiment_training_data").where("context_text is not null and sentiment_label is not null").select(
        "sample_id", "canonical_key", "context_text", (F.col("sentiment_label") == "negative").cast("double").alias("y")).distinct()
    held = F.pmod(F.xxhash64("canonical_key"), F.lit(5)) == 0
    m = models.fit_classifier(s.where(~held), "context_text", "y")
    p = models.score(m, base.packed(s.where(held), "context_text"))
    return metrics.best_threshold(metrics.threshold_audit(p, "y", "p", 0.20, 0.90, 0.02))


@R.query("topic_kmeans")
def topic_kmeans(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return models.assign_topics(models.fit_topics(e, "embedding", 8), e, "embedding", 0.05).groupBy("topic_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("topic_prob").alias("mean_prob"))


@R.query("embedding_plane")
def embedding_plane(spark, sf_dir):
    return models.project_plane(read(spark, sf_dir, "embeddings"), "embedding").select("vec_id", "x", "y")


def _terms_sql(where: str) -> str:
    banned = ", ".join(S.q(w) for w in models.english_stop_words())
    return f"""w AS (SELECT doc_id, source, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '' AND x NOT IN ({banned})) AS w FROM documents WHERE text IS NOT NULL AND {where}),
g AS (SELECT doc_id, source, list_concat(w, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
  list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS t FROM w)"""


@R.query("ngram_vocab", f"""WITH {_terms_sql("lang = 'en'")}, e AS (SELECT unnest(list_distinct(t)) AS term FROM g)
SELECT term, count(*) AS n FROM e GROUP BY 1 HAVING count(*) >= 10 AND count(*) <= 0.9 * (SELECT count(*) FROM documents WHERE text IS NOT NULL AND lang = 'en')""")
def ngram_vocab(spark, sf_dir):
    return models.ngram_vocabulary(read(spark, sf_dir, "documents").where("lang = 'en'"), "text", 10, 0.9, models.english_stop_words())


@R.query("topic_terms", f"""WITH {_terms_sql("source IS NOT NULL AND lang = 'en'")}, n AS (SELECT source, term, count(*) AS n FROM (SELECT source, unnest(t) AS term FROM g) GROUP BY 1, 2),
a AS (SELECT source, sum(n) AS total FROM n GROUP BY 1), u AS (SELECT term, sum(n) AS uses FROM n GROUP BY 1),
wt AS (SELECT source, term, n.n / total * ln(1 + (SELECT avg(total) FROM a) / uses) AS weight FROM n JOIN a USING (source) JOIN u USING (term)),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(weight, 12) DESC, term) AS rank FROM wt)
SELECT source, term, round(weight, 9) AS weight, rank FROM r WHERE rank <= 10""")
def topic_terms(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where("lang = 'en'")
    return models.class_terms(d, "source", "text", stop=models.english_stop_words()).withColumn("weight", F.round("weight", 9))


@R.query("topic_density")
def topic_density(spark, sf_dir):
    """Rows of each topic that lie in dense parts of it; the rest is noise."""
    e = read(spark, sf_dir, "embeddings")
    t = models.assign_topics(models.fit_topics(e, "embedding", 8), e, "embedding", 0.05)
    return models.density_noise(t, "vec_id", "embedding", "topic_id").groupBy("topic_id", "dense").agg(F.count(F.lit(1)).alias("n"))


@R.query("length_packing", """WITH b AS (SELECT DISTINCT block_uid, length(clean_block_text) AS n FROM entity_mentions_raw WHERE clean_block_text IS NOT NULL)
SELECT CAST(CASE WHEN n <= 80 THEN 0 WHEN n <= 200 THEN 1 WHEN n <= 400 THEN 2 WHEN n <= 800 THEN 3 WHEN n <= 1600 THEN 4 ELSE 5 END AS INT) AS len_range, count(*) AS n_rows, max(n) AS longest FROM b GROUP BY 1""")
def length_packing(spark, sf_dir):
    u = read(spark, sf_dir, "entity_mentions_raw").where("clean_block_text is not null").select("block_uid", "clean_block_text").distinct()
    lens = base.packed(u, "clean_block_text").select("block_uid", "len_range", F.length("clean_block_text").cast("long").alias("n")).distinct()
    return lens.groupBy("len_range").agg(F.count(F.lit(1)).alias("n_rows"), F.max("n").alias("longest"))


@R.query("label_resume", """SELECT 'first' AS run, CAST(0 AS BIGINT) AS n_done_before, count(DISTINCT sample_id) AS n_labelled, count(DISTINCT sample_id) AS n_ok, CAST(0 AS BIGINT) AS n_failed FROM sentiment_training_data WHERE sample_id < 's5'
UNION ALL SELECT 'second', count(DISTINCT sample_id) FILTER (sample_id < 's5'), count(DISTINCT sample_id) FILTER (NOT sample_id < 's5'), count(DISTINCT sample_id) FILTER (NOT sample_id < 's5'), 0 FROM sentiment_training_data""")
def label_resume(spark, sf_dir):
    """A labelling run that broke off and one that goes on from its log, with their progress figures."""
    t = read(spark, sf_dir, "sentiment_training_data").groupBy("sample_id").agg(F.max("context_text").alias("t"))
    log = _place(spark, "labels")
    labeler = base.KeywordLabeler("a")
    runs = [base.label_run(d, "sample_id", "t", labeler, log).withColumn("run", F.lit(n)) for n, d in (("first", t.where("sample_id < 's5'")), ("second", t))]
    return runs[0].unionByName(runs[1]).select("run", "n_done_before", "n_labelled", "n_ok", "n_failed")


@R.query("reply_bools", """SELECT sample_id, CASE WHEN lower(trim(v)) IN ('true', '1', '1.0', 'yes', 'y') THEN true WHEN lower(trim(v)) IN ('false', '0', '0.0', 'no', 'n', '') THEN false END AS keep
FROM (SELECT DISTINCT sample_id, CASE substr(md5(sample_id), 1, 1) WHEN '0' THEN ' True' WHEN '1' THEN 'no' WHEN '2' THEN '1' WHEN '3' THEN '' WHEN '4' THEN 'perhaps' ELSE 'yes ' END AS v FROM sentiment_training_data)""")
def reply_bools(spark, sf_dir):
    h = F.substring(F.md5("sample_id"), 1, 1)
    v = F.when(h == "0", " True").when(h == "1", "no").when(h == "2", "1").when(h == "3", "").when(h == "4", "perhaps").otherwise("yes ")
    return read(spark, sf_dir, "sentiment_training_data").select("sample_id").distinct().select("sample_id", base.as_bool(v).alias("keep"))


@R.query("allocation_rules", """SELECT rule, b AS len_bucket, target FROM (WITH sn AS (SELECT sent_uid, min(sent_len_bucket) AS b FROM sentences GROUP BY 1), w AS (SELECT b, count(*) / sum(count(*)) OVER () AS w FROM sn GROUP BY 1),
f AS (SELECT b, w, floor(w * 300) AS base, w * 300 - floor(w * 300) AS rest FROM w), r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, b) AS k, 300 - sum(base) OVER () AS missing FROM f)
SELECT unnest(['least share gives', 'first gives']) AS rule, b, CAST(greatest(1, base) + CASE WHEN k <= missing THEN 1 ELSE 0 END AS BIGINT) AS target FROM r)""")
def allocation_rules(spark, sf_dir):
    """Rows a stratum by the two allocation rules of the labelling samples."""
    s = read(spark, sf_dir, "sentences").groupBy("sent_uid").agg(F.min("sent_len_bucket").alias("len_bucket"))
    parts = [sampling.allocation(s, ["len_bucket"], 300, rule).select(F.lit(n).alias("rule"), "len_bucket", "target")
             for n, rule in (("least share gives", sampling.nearest_fraction), ("first gives", sampling.first_gives))]
    return parts[0].unionByName(parts[1])


@R.query("source_checks", """SELECT check_name, value FROM (SELECT unnest(['shards', 'first existing', 'rows by shard glob']) AS check_name, CAST(unnest([3, 1, (SELECT count(*) FROM nation)]) AS BIGINT) AS value
UNION ALL SELECT 'strict lines', count(*) FROM nation UNION ALL SELECT 'strict refuses', 1 UNION ALL SELECT 'keys done', count(DISTINCT n_regionkey) FROM nation UNION ALL SELECT 'keys of no log', 0
UNION ALL SELECT 'document entries', count(*) FROM nation UNION ALL SELECT 'bullets', count(*) FROM nation UNION ALL SELECT 'schema probe', 1)""")
def source_checks(spark, sf_dir):
    """Shards, the first of several paths, strict JSON lines, keys of a log, a JSON report read back, bullets."""
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    folder, log, report = (_place(spark, x) for x in ("parts", "strict", "report"))
    n.repartition(3, "n_nationkey").write.option("maxRecordsPerFile", 1_000_000).parquet(folder)
    files.append_json_lines(n, log)
    files.write_json_report(n.agg(F.collect_list(F.struct(*n.columns)).alias("entries")), report)
    broken = _place(spark, "broken")
    spark.createDataFrame([('{"n_nationkey": 1}',), ("{no json",)], "value string").write.text(broken)
    try:
        refused = files.read_json_lines(spark, broken, n.schema, strict=True).collect() is None
    except Exception:
        refused = True
    rows = [
        ("shards", len(files.shards(spark, folder))), ("first existing", int(files.first_existing(spark, [folder + "-none", folder]) == folder)),
        ("rows by shard glob", files.read_parquet(spark, folder + "/*.parquet", ["n_name"]).count()),
        ("strict lines", files.read_json_lines(spark, log, n.schema, strict=True).count()), ("strict refuses", int(refused)),
        ("keys done", files.done_keys(spark, log, n.schema, ["n_regionkey"]).count()),
        ("keys of no log", files.done_keys(spark, log + "-none", n.schema, ["n_regionkey"]).count()),
        ("document entries", len(files.read_json_document(spark, report)["entries"])),
        ("bullets", files.bullets(n, "{n_name}").count("- ")),
        ("schema probe", len(files.with_columns(spark, [folder, log], ["n_name", "n_regionkey"])))]
    return spark.createDataFrame(rows, "check_name string, value long")


@R.query("column_checks", """SELECT n_nationkey AS id, n_name AS label, 'none' AS remark FROM nation""")
def column_checks(spark, sf_dir):
    """The first of several columns, a default for one that is missing, and the required ones."""
    n = read(spark, sf_dir, "nation")
    n = tables.ensure_column(n, "remark", "none", "string")
    n = n.withColumn("label", F.col(tables.first_present(n, ["name", "n_name"])))
    return tables.select_present(tables.require_columns(n, ["n_nationkey", "label"]).withColumnRenamed("n_nationkey", "id"), ["id", "label", "remark", "absent"])


@R.query("noise_shares", "SELECT sent_len_bucket, round(avg(suspect_flag), 6) AS noise_share, round(avg(CAST(p_ai_block >= 0.8 AS INT)), 6) AS pred_share FROM sentences GROUP BY 1")
def noise_shares(spark, sf_dir):
    return read(spark, sf_dir, "sentences").groupBy("sent_len_bucket").agg(
        F.round(F.avg("suspect_flag"), 6).alias("noise_share"), F.round(F.avg((F.col("p_ai_block") >= 0.8).cast("int")), 6).alias("pred_share"))


@R.query("suspect_recomputed", f"SELECT sent_uid, {S.suspect('sentence_text')} AS flag, {S.length_bucket('length(sentence_text)')} AS bucket, count(*) AS n FROM sentences GROUP BY ALL")
def suspect_recomputed(spark, sf_dir):
    s = read(spark, sf_dir, "sentences")
    t = F.col("sentence_text")
    return s.groupBy("sent_uid", text.suspect(t).alias("flag"), text.length_bucket(F.length(t)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@R.query("softmax_scores", """SELECT vec_id, list_position(embedding, list_aggregate(embedding, 'max')) AS best, round(exp(list_aggregate(embedding, 'max')) / list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE)))), 5) AS top_prob FROM embeddings""")
def softmax_scores(spark, sf_dir):
    a = F.transform("embedding", lambda x: x.cast("double"))
    top = F.array_max(a)
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return read(spark, sf_dir, "embeddings").select(
        "vec_id", F.array_position(a, top).alias("best"), F.round(1 / total, 5).alias("top_prob"))
