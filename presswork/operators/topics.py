"""Topic tables over (document, topic, probability) facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presswork.operators.tables import keep_one, top_n


def distribution(facts: DataFrame) -> DataFrame:
    """Blocks, mean probability and length of each topic of each document, and its share there."""
    g = facts.groupBy("doc_id", "topic_id").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.avg("topic_prob").alias("mean_topic_prob"), F.avg("block_len").alias("mean_block_len"),
        F.sum("block_len").alias("sum_topic_text_len"))
    total = F.sum("n_blocks").over(Window.partitionBy("doc_id"))  # a document's topics, few rows
    return g.withColumn("doc_topic_total_blocks", total).withColumn(
        "topic_block_share_within_doc", F.col("n_blocks") / F.col("doc_topic_total_blocks"))


def dominant(dist: DataFrame, without_noise: bool = True) -> DataFrame:
    """The topic with the largest share, then most blocks, then highest probability, then smallest id."""
    d = dist.where("topic_id <> -1") if without_noise else dist
    order = [F.desc("topic_block_share_within_doc")]
    order += [F.desc("n_blocks"), F.desc("mean_topic_prob")] if without_noise else [F.desc("mean_topic_prob"), F.desc("n_blocks")]
    return keep_one(d, ["doc_id"], [*order, F.col("topic_id")])


def time_panel(facts: DataFrame) -> DataFrame:
    return facts.groupBy("year_month", "topic_id").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("domain").alias("n_domains"),
        F.avg("topic_prob").alias("mean_topic_prob"))


def summary(topics: DataFrame, facts: DataFrame) -> DataFrame:
    """One row a known topic, also without facts: counts 0, means null."""
    g = facts.groupBy("topic_id").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("domain").alias("n_domains"),
        F.avg("topic_prob").alias("avg_topic_prob"), F.avg("block_len").alias("avg_topic_text_len"))
    return topics.join(g, "topic_id", "left").na.fill(0, ["n_blocks", "n_docs", "n_domains"]).withColumns({
        "is_noise_topic": F.col("topic_id") == -1, "include_in_analysis": F.col("topic_id") != -1})


def representatives(facts: DataFrame, n: int = 5) -> DataFrame:
    return top_n(facts, ["topic_id"], [F.desc("topic_prob"), F.desc("block_len"), F.col("block_uid")], n, "rank")


def rollup(table: DataFrame, group_of: DataFrame, default: str = "Unassigned") -> DataFrame:
    """Topics to groups with the means weighted by documents; topics without a group go to the default.

    ``group_of`` maps each topic once; it is as large as the topic list, not the corpus.
    """
    j = table.join(group_of, "topic_id", "left").withColumn("meta_group", F.coalesce("meta_group", F.lit(default)))
    return j.groupBy("meta_group").agg(
        F.count(F.lit(1)).alias("n_topics"), F.sum("n_docs").alias("n_docs"),
        F.coalesce(F.try_divide(F.sum(F.col("avg_topic_prob") * F.col("n_docs")), F.sum("n_docs")), F.lit(0.0)).alias("weighted_prob"))


def fold_small(table: DataFrame, name: str, size: str, keep: int, other: str = "Other") -> DataFrame:
    """The ``keep`` largest groups; the others become one."""
    top = table.orderBy(F.desc(size), name).limit(keep).select(F.col(name).alias("_k"))
    j = table.join(F.broadcast(top), F.col(name) == F.col("_k"), "left")
    return j.groupBy(F.coalesce("_k", F.lit(other)).alias(name)).agg(F.sum(size).alias(size))
