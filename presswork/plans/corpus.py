"""Queries over articles: profile, segmentation, sentences, rebuilding, text functions."""

from pyspark.sql import functions as F

from presswork.functions import fixed, text, web
from presswork.operators import profile, segment, tables
from presswork.plans import sqltext as S
from presswork.plans.registry import Registry
from presswork.session import read

R = Registry()

_BLOCKS = f"""
d AS (SELECT doc_id, source, {S.blocks('text')} AS bs FROM documents WHERE lang = 'en' AND length(text) BETWEEN 800 AND 60000),
b AS (SELECT doc_id, source, unnest(bs) AS block_text, generate_subscripts(bs, 1) - 1 AS block_id FROM d)"""


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(F.length("text").between(*fixed.DOC_CHARS) & (F.col("lang") == "en")).select("doc_id", "source", "text")


@R.query(
    "block_relevance_by_source",
    f"""WITH {_BLOCKS}
SELECT source, count(*) AS n_blocks, count(DISTINCT doc_id) AS n_docs, round(avg(CAST({S.words('block_text', fixed.KEYWORDS)} AS INT)), 6) AS ai_share,
  round(avg(length(block_text)), 6) AS mean_len FROM b WHERE source IS NOT NULL GROUP BY 1""",
)
def block_relevance_by_source(spark, sf_dir):
    b = segment.blocks(_docs(spark, sf_dir))
    return b.where("source is not null").groupBy("source").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.count_distinct("doc_id").alias("n_docs"),
        F.round(F.avg(text.keyword_flag(F.col("block_text"))), 6).alias("ai_share"), F.round(F.avg("block_len"), 6).alias("mean_len"))


@R.query("segment_blocks", f"WITH {_BLOCKS} SELECT doc_id, block_id, doc_id || ':' || block_id AS block_uid, block_text, length(block_text) AS block_len FROM b")
def segment_blocks(spark, sf_dir):
    return segment.blocks(_docs(spark, sf_dir)).select("doc_id", "block_id", "block_uid", "block_text", "block_len")


_SENTENCES = f"""{_BLOCKS},
p AS (SELECT doc_id, block_id, list_transform(string_split(regexp_replace(block_text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)) AS ps FROM b),
s0 AS (SELECT doc_id, block_id, unnest(ps) AS t, generate_subscripts(ps, 1) - 1 AS sent_id FROM p),
s1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block_id ORDER BY sent_id) AS rn FROM s0 WHERE length(t) >= 15),
s AS (SELECT doc_id, block_id, sent_id, left(t, 800) AS t FROM s1 WHERE rn <= 80)"""


@R.query(
    "sentence_split_suspect",
    f"""WITH {_SENTENCES}
SELECT doc_id, block_id, sent_id, doc_id || ':' || block_id || ':' || sent_id AS sent_uid, length(t) AS sent_len,
  {S.length_bucket('length(t)')} AS sent_len_bucket, {S.suspect('t')} AS suspect_flag FROM s""",
)
def sentence_split_suspect(spark, sf_dir):
    s = segment.sentences(segment.blocks(_docs(spark, sf_dir)))
    return s.select("doc_id", "block_id", "sent_id", "sent_uid", "sent_len", "sent_len_bucket", "suspect_flag")


_UNIQUE = """u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sent_uid ORDER BY sentence_text) AS rn FROM sentences) WHERE rn = 1)"""


def _content(spark, sf_dir):
    return tables.keep_one(read(spark, sf_dir, "sentences"), ["sent_uid"], [F.col("sentence_text")])


@R.query(
    "rebuild_blocks",
    f"""WITH {_UNIQUE}
SELECT doc_id, block_id, string_agg(trim(sentence_text), ' ' ORDER BY sent_id) FILTER (WHERE trim(sentence_text) <> '') AS clean_block_text,
  count(*) AS n_content_sentences, max(p_ai_block) AS p_ai_block FROM u GROUP BY 1, 2""",
)
def rebuild_blocks(spark, sf_dir):
    return segment.ordered_concat(
        _content(spark, sf_dir), ["doc_id", "block_id"], ["sent_id"], "sentence_text", " ",
        F.count(F.lit(1)).alias("n_content_sentences"), F.max("p_ai_block").alias("p_ai_block")).withColumnRenamed("joined", "clean_block_text")


@R.query(
    "rebuild_docs",
    f"""WITH {_UNIQUE}, b AS (SELECT doc_id, block_id, string_agg(trim(sentence_text), ' ' ORDER BY sent_id) FILTER (WHERE trim(sentence_text) <> '') AS t,
  count(*) AS n, max(p_ai_block) AS p FROM u GROUP BY 1, 2),
d AS (SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY block_id) AS clean_doc_text, count(DISTINCT block_id) AS n_clean_blocks,
  sum(n) AS n_content_sentences, max(p) AS max_p_ai_block FROM b GROUP BY 1)
SELECT doc_id, md5(clean_doc_text) AS text_md5, length(clean_doc_text) AS clean_doc_len, n_clean_blocks, CAST(n_content_sentences AS BIGINT) AS n_content_sentences,
  max_p_ai_block FROM d WHERE length(clean_doc_text) >= 200""",
)
def rebuild_docs(spark, sf_dir):
    b = segment.ordered_concat(
        _content(spark, sf_dir), ["doc_id", "block_id"], ["sent_id"], "sentence_text", " ",
        F.count(F.lit(1)).alias("n"), F.max("p_ai_block").alias("p")).withColumnRenamed("joined", "t")
    d = segment.ordered_concat(
        b, ["doc_id"], ["block_id"], "t", "\n\n", F.count_distinct("block_id").alias("n_clean_blocks"),
        F.sum("n").alias("n_content_sentences"), F.max("p").alias("max_p_ai_block"))
    return d.where(F.length("joined") >= 200).select(
        "doc_id", F.md5("joined").alias("text_md5"), F.length("joined").alias("clean_doc_len"), "n_clean_blocks", "n_content_sentences", "max_p_ai_block")


_COLS = ["url", "date", "language", "title", "text"]


@R.query("null_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_count, round(count(*) FILTER ({c} IS NULL) / count(*), 4) AS null_ratio FROM news_final_project"
    for c in _COLS))
def null_profile(spark, sf_dir):
    return profile.null_profile(read(spark, sf_dir, "news_final_project"), _COLS)


def _dup(c, t):
    return f"""WITH p AS (SELECT {c} AS v, count(*) AS n FROM {t} GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(v) AS n_distinct, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS rows_in_duplicates,
  sum(n - 1) / sum(n) AS duplicate_ratio FROM p"""


@R.query("url_duplicates", _dup("url", "news_final_project"))
def url_duplicates(spark, sf_dir):
    return profile.duplicate_profile(read(spark, sf_dir, "news_final_project"), "url")


@R.query("text_duplicates", _dup("md5(text)", "news_final_project"))
def text_duplicates(spark, sf_dir):
    return profile.duplicate_profile(read(spark, sf_dir, "news_final_project").select(F.md5("text").alias("h")), "h")


@R.query(
    "length_describe",
    "SELECT count(n) AS n, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS min, max(n) AS max, "
    + ", ".join(f"round(quantile_cont(n, {p}), 6) AS p{round(p * 100):02d}" for p in profile.QUANTILES)
    + " FROM (SELECT CAST(length(text) AS DOUBLE) AS n FROM news_final_project)",
)
def length_describe(spark, sf_dir):
    d = profile.describe(read(spark, sf_dir, "news_final_project").select(F.length("text").alias("n")), "n")
    return d.select(*[F.round(c, 6).alias(c) if t == "double" and c not in ("min", "max") else F.col(c) for c, t in d.dtypes])


_BELOW, _ABOVE = (200, 500, 800, 1500), (2000, 4000, 8000)


@R.query("length_thresholds", " UNION ALL ".join(
    [f"SELECT 'below_{t}' AS threshold, round(avg(CAST(coalesce(length(text) < {t}, false) AS INT)), 9) AS share FROM documents" for t in _BELOW]
    + [f"SELECT 'above_{t}' AS threshold, round(avg(CAST(coalesce(length(text) > {t}, false) AS INT)), 9) AS share FROM documents" for t in _ABOVE]))
def length_thresholds(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.length("text").alias("n"))
    return profile.threshold_shares(d, "n", _BELOW, _ABOVE).withColumn("share", F.round("share", 9))


def _hist(x, bins, where=""):
    return f"""WITH v AS (SELECT {x} AS x FROM documents WHERE text IS NOT NULL), v2 AS (SELECT x FROM v {where}),
e AS (SELECT min(x) AS lo, max(x) AS hi FROM v2)
SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) / ((hi - lo) / {bins})), {bins - 1}) END AS BIGINT) AS bin, count(*) AS n FROM v2, e GROUP BY 1"""


@R.query("length_histogram", _hist("CAST(length(text) AS DOUBLE)", 50))
def length_histogram(spark, sf_dir):
    return profile.histogram(read(spark, sf_dir, "documents").select(F.length("text").alias("n")), "n", 50)


@R.query("length_histogram_clipped", _hist("CAST(length(text) AS DOUBLE)", 50, "WHERE x <= (SELECT quantile_cont(x, 0.99) FROM v)"))
def length_histogram_clipped(spark, sf_dir):
    return profile.histogram(read(spark, sf_dir, "documents").select(F.length("text").alias("n")), "n", 50, clip=0.99)


@R.query(
    "token_estimates",
    f"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), {S.q(fixed.SPACE_RE2)})) + 1 AS n_tokens, least(len(regexp_extract_all(coalesce(text, ''), {S.q(fixed.SPACE_RE2)})) + 1, 512) AS n_clipped FROM documents",
)
def token_estimates(spark, sf_dir):
    n = text.token_estimate(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", n.alias("n_tokens"), F.least(n, F.lit(512)).alias("n_clipped"))


@R.query(
    "domain_extract",
    f"SELECT doc_id, {S.domain('url')} AS domain, replace({S.netloc('url')}, 'www.', '') AS domain_bare FROM news_final_project",
)
def domain_extract(spark, sf_dir):
    return read(spark, sf_dir, "news_final_project").select(
        "doc_id", web.domain(F.col("url")).alias("domain"), web.domain_bare(F.col("url")).alias("domain_bare"))


@R.query(
    "quarter_buckets",
    f"""SELECT doc_id, CASE WHEN length(date) >= 7 AND regexp_matches(substr(date, 6, 2), '^\\s*[+-]?[0-9]+\\s*$')
    THEN left(date, 4) || 'Q' || CAST(floor((CAST(trim(substr(date, 6, 2)) AS INT) - 1) / 3.0) + 1 AS BIGINT) ELSE 'NA' END AS time_bucket,
  {S.month(S.day('date'))} AS year_month FROM news_final_project""",
)
def quarter_buckets(spark, sf_dir):
    return read(spark, sf_dir, "news_final_project").select(
        "doc_id", web.quarter_bucket(F.col("date")).alias("time_bucket"), web.month(web.day(F.col("date"))).alias("year_month"))


@R.query(
    "dense_doc_ids",
    "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM documents WHERE length(text) BETWEEN 800 AND 60000",
)
def dense_doc_ids(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where(F.length("text").between(*fixed.DOC_CHARS)).select("doc_id")
    return tables.dense_ids(d, ["doc_id"])


@R.query(
    "top_k_tier",
    f"""WITH t AS (SELECT source FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, source LIMIT {fixed.TOP_DOMAINS})
SELECT CASE WHEN source IN (FROM t) THEN source ELSE 'other' END AS domain_tier, count(*) AS n FROM documents GROUP BY 1""",
)
def top_k_tier(spark, sf_dir):
    d = tables.top_tier(read(spark, sf_dir, "documents"), "source", fixed.TOP_DOMAINS, "domain_tier")
    return d.groupBy("domain_tier").agg(F.count(F.lit(1)).alias("n"))


@R.query(
    "value_counts_normalised",
    """SELECT lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM documents WHERE lang IS NOT NULL GROUP BY 1""",
)
def value_counts_normalised(spark, sf_dir):
    g = read(spark, sf_dir, "documents").where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return g.select("lang", "n", F.round(F.col("n") / g.agg(F.sum("n")).scalar(), 9).alias("share"))


@R.query(
    "topic_texts",
    f"""WITH t AS (SELECT block_uid, {S.squeeze("regexp_replace(regexp_replace(coalesce(clean_block_text, ''), chr(13) || chr(10) || '?', chr(10), 'g'), '(https?://|www\\.)[^\\s]+', ' URLTOKEN ', 'g')")} AS topic_text
  FROM (SELECT DISTINCT block_uid, clean_block_text FROM entity_mentions_raw))
SELECT block_uid, topic_text, length(topic_text) AS topic_text_len FROM t WHERE length(topic_text) BETWEEN 80 AND 5000""",
)
def topic_texts(spark, sf_dir):
    d = read(spark, sf_dir, "entity_mentions_raw").select("block_uid", "clean_block_text").distinct()
    t = d.select("block_uid", text.topic_text(F.col("clean_block_text")).alias("topic_text"))
    return t.where(F.length("topic_text").between(*fixed.TOPIC_BLOCK_CHARS)).withColumn("topic_text_len", F.length("topic_text"))


@R.query(
    "compact_contexts",
    f"""SELECT DISTINCT doc_id, block_id, CASE WHEN length({S.squeeze('clean_block_text')}) > 320 THEN rtrim(left({S.squeeze('clean_block_text')}, 320)) || ' ...'
  ELSE {S.squeeze('clean_block_text')} END AS snippet, {S.squeeze('left(clean_block_text, 4000)')} AS ner_text, sha1({S.squeeze('clean_block_text')}) AS text_hash FROM entity_contexts_final""",
)
def compact_contexts(spark, sf_dir):
    c = F.col("clean_block_text")
    return read(spark, sf_dir, "entity_contexts_final").select(
        "doc_id", "block_id", text.compact(c, 320).alias("snippet"), text.ner_text(c).alias("ner_text"),
        text.sha1_hex(text.squeeze(c)).alias("text_hash")).distinct()


@R.query(
    "funnel",
    f"""SELECT 'articles' AS stage, count(*) AS n_rows, count(DISTINCT doc_id) AS n_docs FROM news_final_project
UNION ALL SELECT 'length_kept', count(*), count(DISTINCT doc_id) FROM news_final_project WHERE length(text) BETWEEN 800 AND 60000
UNION ALL SELECT 'sentences', count(*), count(DISTINCT doc_id) FROM sentences
UNION ALL SELECT 'relevant_sentences', count(*), count(DISTINCT doc_id) FROM sentences WHERE pred_ai_block = 1
UNION ALL SELECT 'mentions', count(*), count(DISTINCT doc_id) FROM entity_mentions_final
UNION ALL SELECT 'contexts', count(*), count(DISTINCT doc_id) FROM entity_contexts_final""",
)
def funnel(spark, sf_dir):
    news = read(spark, sf_dir, "news_final_project")
    sent = read(spark, sf_dir, "sentences")
    stages = {
        "articles": news, "length_kept": news.where(F.length("text").between(*fixed.DOC_CHARS)), "sentences": sent,
        "relevant_sentences": sent.where("pred_ai_block = 1"), "mentions": read(spark, sf_dir, "entity_mentions_final"),
        "contexts": read(spark, sf_dir, "entity_contexts_final")}
    out = None
    for name, df in stages.items():
        one = df.agg(F.lit(name).alias("stage"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct("doc_id").alias("n_docs"))
        out = one if out is None else out.unionByName(one)
    return out


@R.query(
    "kpi_table",
    """WITH k AS (SELECT count(*) AS n, count(DISTINCT url) AS u, avg(CAST(text IS NULL OR text = '' AS INT)) AS e FROM news_final_project)
SELECT 'articles' AS metric, format('{:,}', n) AS value FROM k UNION ALL SELECT 'distinct_urls', format('{:,}', u) FROM k
UNION ALL SELECT 'empty_share', printf('%.1f%%', 100 * e) FROM k""",
)
def kpi_table(spark, sf_dir):
    one = read(spark, sf_dir, "news_final_project").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("url").alias("u"),
        F.avg((F.col("text").isNull() | (F.col("text") == "")).cast("int")).alias("e"))
    return tables.long_form(one, [], {
        "articles": F.format_number("n", 0), "distinct_urls": F.format_number("u", 0),
        "empty_share": F.format_string("%.1f%%", F.col("e") * 100)})


@R.query(
    "sentence_flags_by_bucket",
    """SELECT sent_len_bucket, suspect_flag, count(*) AS n, count(DISTINCT domain) AS n_domains, round(avg(p_ai_block), 6) AS mean_p FROM sentences GROUP BY ALL""",
)
def sentence_flags_by_bucket(spark, sf_dir):
    return read(spark, sf_dir, "sentences").groupBy("sent_len_bucket", "suspect_flag").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("domain").alias("n_domains"), F.round(F.avg("p_ai_block"), 6).alias("mean_p"))


@R.query(
    "long_and_short_texts",
    """SELECT * FROM (SELECT doc_id, length(text) AS n, 'longest' AS side FROM documents WHERE text IS NOT NULL ORDER BY n DESC, doc_id LIMIT 20)
UNION ALL SELECT * FROM (SELECT doc_id, length(text) AS n, 'shortest' AS side FROM documents WHERE text IS NOT NULL ORDER BY n, doc_id LIMIT 20)""",
)
def long_and_short_texts(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.length("text").alias("n"))
    top = d.orderBy(F.desc("n"), "doc_id").limit(20).withColumn("side", F.lit("longest"))
    return top.unionByName(d.orderBy("n", "doc_id").limit(20).withColumn("side", F.lit("shortest")))
