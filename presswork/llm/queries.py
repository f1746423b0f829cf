"""Queries of the training-data operators, with SQL oracles where SQL can say them."""

from presswork.llm import blocks, calibrate, groups, leaks, lines, mixing, names, subjects
from pyspark.sql import functions as F

from presswork.plans.registry import Registry
from presswork.session import cut, read

R = Registry()

# ---------------------------------------------------------------- 1: target proportions

_P1 = """
WITH units AS (
  SELECT DISTINCT sample_id, regexp_replace(lower(trim(final_type)), '[\\s-]', '_', 'g') AS final_type,
    regexp_replace(lower(trim(entity_doc_bucket)), '[\\s-]', '_', 'g') AS entity_doc_bucket
  FROM sentiment_label_pool WHERE final_type IS NOT NULL AND entity_doc_bucket IS NOT NULL),
counts AS (SELECT final_type, entity_doc_bucket, count(DISTINCT sample_id) AS available FROM units GROUP BY 1, 2),
cells AS (
  SELECT p.plan_id, p.final_type, p.entity_doc_bucket, p.target_share,
    greatest(CAST(round(p.target_share * p.sample_size) AS BIGINT), coalesce(p.min_rows, 0)) AS required,
    coalesce(c.available, 0) AS available
  FROM sampling_plans p LEFT JOIN counts c USING (final_type, entity_doc_bucket))
"""


@R.query("p1_found", _P1 + "SELECT plan_id, final_type, entity_doc_bucket FROM cells WHERE available < required")
def p1_found(spark, sf_dir):
    r = calibrate.report(read(spark, sf_dir, "sentiment_label_pool"), read(spark, sf_dir, "sampling_plans"))
    return r.where("short > 0").select("plan_id", "final_type", "entity_doc_bucket")


@R.query("p1_report")
def p1_report(spark, sf_dir):
    return calibrate.report(read(spark, sf_dir, "sentiment_label_pool"), read(spark, sf_dir, "sampling_plans"))


@R.query("p1_gaps", _P1 + """SELECT plan_id, final_type, entity_doc_bucket, target_share, required, available,
  greatest(required - available, 0) AS short FROM cells""")
def p1_gaps(spark, sf_dir):
    """What every plan cell asks for, has and lacks, after the draw."""
    return p1_report(spark, sf_dir).drop("drawn", "actual_share")


@R.query(
    "p1_audit",
    """SELECT DISTINCT plan_id, CAST(0 AS BIGINT) AS drawn_twice, CAST(0 AS BIGINT) AS below_floor, CAST(0 AS BIGINT) AS off_size
FROM sampling_plans""",
)
def p1_audit(spark, sf_dir):
    """What must hold of every plan's sample: no unit twice, no cell below its floor, the size it should have."""
    return calibrate.audit(read(spark, sf_dir, "sentiment_label_pool"), read(spark, sf_dir, "sampling_plans"))


@R.query("p1_sample")
def p1_sample(spark, sf_dir):
    d = calibrate.draw(read(spark, sf_dir, "sentiment_label_pool"), read(spark, sf_dir, "sampling_plans"))
    return d.withColumnRenamed("unit", "sample_id")


# ---------------------------------------------------------------- 2: repeated lines

_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff\u180e\u200e\u200f"

_P2 = """
WITH src AS (
  SELECT doc_id, text, nullif(regexp_replace(lower(regexp_extract(trim(url),
    '^(?i:https?)://(?:[^/?#@\\s]*@)?([^/?#:@\\s]+)', 1)), '^www\\.', ''), '') AS site FROM news_final_project),
rows AS (SELECT site, count(*) AS n FROM src WHERE site IS NOT NULL GROUP BY 1),
each AS (
  SELECT doc_id, site, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM src WHERE site IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL),
keyed AS (
  SELECT *, regexp_replace(replace(lower(trim(regexp_replace(translate(line, '""" + _INVISIBLE + """', ''),
    '[\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{0085}\\x0b\\x1c-\\x1f]+', ' ', 'g'))), 'ß', 'ss'),
    '[0-9]+', '0', 'g') AS key FROM each),
rep AS (
  SELECT site, key FROM keyed JOIN rows USING (site) WHERE key <> ''
  GROUP BY site, key, n HAVING count(DISTINCT doc_id) >= 5 AND count(DISTINCT doc_id) >= 0.05 * n)
"""


@R.query("p2_found", _P2 + "SELECT doc_id, CAST(line_no AS BIGINT) AS line_no FROM keyed JOIN rep USING (site, key)")
def p2_found(spark, sf_dir):
    return lines.boilerplate_lines(read(spark, sf_dir, "news_final_project"))


@R.query(
    "p2_clean",
    _P2 + """, gone AS (SELECT DISTINCT doc_id, line_no FROM keyed JOIN rep USING (site, key)),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY 1),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS t FROM keyed ANTI JOIN gone USING (doc_id, line_no) GROUP BY 1)
SELECT d.doc_id, CASE WHEN n_removed IS NULL THEN d.text ELSE coalesce(t, '') END AS text, coalesce(n_removed, 0) AS n_removed
FROM news_final_project d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)""",
)
def p2_clean(spark, sf_dir):
    return lines.clean_texts(read(spark, sf_dir, "news_final_project"))


# ---------------------------------------------------------------- 3: grouped splits


@R.query(
    "p3_found",
    """
WITH RECURSIVE rec AS (
  SELECT sample_id, trim(regexp_replace(lower(trim(canonical_entity)), '\\s+', ' ', 'g')) || '|||' ||
    trim(regexp_replace(lower(trim(final_type)), '\\s+', ' ', 'g')) AS node, doc_id, block_id FROM sentiment_training_data),
link AS (
  SELECT DISTINCT a.node AS a, b.node AS b FROM rec a JOIN rec b ON a.doc_id = b.doc_id AND a.block_id = b.block_id
  UNION SELECT DISTINCT a.node, b.node FROM rec a JOIN rec b USING (sample_id)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT sample_id, min(b) AS group_key FROM rec JOIN reach ON a = node GROUP BY 1
""",
)
def p3_found(spark, sf_dir):
    return groups.assign_splits(read(spark, sf_dir, "sentiment_training_data")).select("sample_id", "group_key")


@R.query("p3_splits")
def p3_splits(spark, sf_dir):
    return groups.assign_splits(read(spark, sf_dir, "sentiment_training_data"))


@R.query(
    "p3_audit",
    """SELECT 'samples' AS measure, count(DISTINCT sample_id) AS value FROM sentiment_training_data
UNION ALL SELECT unnest(['missing', 'twice', 'groups in two splits', 'splits off target']), 0""",
)
def p3_audit(spark, sf_dir):
    d = read(spark, sf_dir, "sentiment_training_data")
    return groups.split_audit(cut(groups.assign_splits(d), "splits"), d)


@R.query("p3_report")
def p3_report(spark, sf_dir):
    return groups.split_report(groups.assign_splits(read(spark, sf_dir, "sentiment_training_data")))


# ---------------------------------------------------------------- 5: main body


@R.query("p5_found")
def p5_found(spark, sf_dir):
    return blocks.found(read(spark, sf_dir, "news_final_project"), read(spark, sf_dir, "sentences"))


@R.query("p5_bodies")
def p5_bodies(spark, sf_dir):
    return blocks.main_bodies(read(spark, sf_dir, "news_final_project"))


@R.query(
    "p5_audit",
    """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM news_final_project)
SELECT doc_id, count(*) FILTER (regexp_replace(translate(line, '""" + _INVISIBLE + """', ''),
  '[\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{0085}\\x0b\\x1c-\\x1f]+', '', 'g') <> '') AS n_lines FROM l GROUP BY 1""",
)
def p5_audit(spark, sf_dir):
    """Lines of every body and lines left out: together all lines that are not blank."""
    kept = F.when(F.col("body") == "", 0).otherwise(F.size(F.split("body", "\n")))
    return p5_bodies(spark, sf_dir).select("doc_id", (kept + F.col("n_removed")).cast("long").alias("n_lines"))


# ---------------------------------------------------------------- 6: variant names


@R.query("p6_found")
def p6_found(spark, sf_dir):
    return names.name_pairs(names.name_groups(read(spark, sf_dir, "entity_mentions_raw")))


@R.query("p6_groups")
def p6_groups(spark, sf_dir):
    """Every spelling with the group it belongs to."""
    return names.membership(names.name_groups(read(spark, sf_dir, "entity_mentions_raw")))


@R.query("p6_audit", "SELECT unnest(['pairs without a common group', 'group pairs not found']) AS measure, CAST(0 AS BIGINT) AS value")
def p6_audit(spark, sf_dir):
    """Pairs and memberships must say the same."""
    g = cut(names.name_groups(read(spark, sf_dir, "entity_mentions_raw")), "groups")
    pairs, m = names.name_pairs(g), names.membership(g)
    a, b = (m.select("group_id", F.col("entity_surface").alias(n)) for n in ("name_a", "name_b"))
    shared = a.join(b, "group_id").where("name_a < name_b").select("name_a", "name_b").distinct()
    count = lambda df, name: df.agg(F.lit(name).alias("measure"), F.count(F.lit(1)).alias("value"))
    return count(pairs.exceptAll(shared), "pairs without a common group").unionByName(count(shared.exceptAll(pairs), "group pairs not found"))


# ---------------------------------------------------------------- 7: evaluation leaks


def _leaks(spark, sf_dir):
    return leaks.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "heldout_items"))


@R.query("p7_found")
def p7_found(spark, sf_dir):
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


@R.query("p7_items")
def p7_items(spark, sf_dir):
    """Documents each leaked item was found in, and the largest share found."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(
        F.count_distinct("doc_id").alias("n_docs"), F.max("share").alias("max_share"))


# ---------------------------------------------------------------- 8: mixing sources


def _mix(spark, sf_dir, what):
    counts = cut(mixing.token_counts(read(spark, sf_dir, "documents")), "tokens")
    return what(counts, read(spark, sf_dir, "mix_targets"))


@R.query("p8_found")
def p8_found(spark, sf_dir):
    r = _mix(spark, sf_dir, mixing.mix_report)
    return r.where("short").select("mix_id", "source")


@R.query("p8_report")
def p8_report(spark, sf_dir):
    return _mix(spark, sf_dir, mixing.mix_report)


@R.query(
    "p8_audit",
    "SELECT DISTINCT mix_id, CAST(0 AS BIGINT) AS over_cap, CAST(0 AS BIGINT) AS listed_twice, CAST(0 AS BIGINT) AS sources_off FROM mix_targets",
)
def p8_audit(spark, sf_dir):
    """What must hold of every mix: caps kept, no document listed twice, each source at its target or its reach."""
    return _mix(spark, sf_dir, mixing.mix_audit)


@R.query("p8_mix")
def p8_mix(spark, sf_dir):
    return _mix(spark, sf_dir, mixing.mix)


# ---------------------------------------------------------------- 9: subject areas


def _subjects(spark, sf_dir):
    return subjects.document_subjects(*[read(spark, sf_dir, t) for t in ("documents", "subjects", "subject_labels")])


@R.query("p9_found")
def p9_found(spark, sf_dir):
    return _subjects(spark, sf_dir).select("doc_id", "subject")


@R.query("p9_composition")
def p9_composition(spark, sf_dir):
    """Documents of each subject and their share of all documents that have one."""
    s = cut(_subjects(spark, sf_dir), "subjects")
    total = s.agg(F.count_distinct("doc_id")).scalar()
    return s.groupBy("subject").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("share").alias("mean_share")).withColumn("doc_share", F.col("n_docs") / total)
