"""Sentiment cubes: one parametrised aggregation for any set of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.functions.fixed import SENTIMENTS


def pseudo_probabilities(df: DataFrame, label: str = "sentiment_label", confidence: str = "confidence") -> DataFrame:
    """Three probabilities from a label and its confidence, the rest shared evenly: a stand-in for a model's output."""
    rest = (1 - F.col(confidence)) / 2
    return df.withColumns({f"prob_{s}": F.when(F.col(label) == s, F.col(confidence)).otherwise(rest) for s in SENTIMENTS})


def margin(columns: list[str]) -> Column:
    """Largest less second largest of some columns."""
    a = F.sort_array(F.array(*columns), asc=False)
    return a[0] - a[1]


def hard_mode(counts: dict[str, Column]) -> Column:
    """Label of the largest count; the first in the order given wins a tie."""
    names = list(counts)
    out = None
    for i, n in enumerate(names[:-1]):
        top = None
        for m in names[i + 1:]:
            c = counts[n] >= counts[m]
            top = c if top is None else top & c
        out = F.when(top, n) if out is None else out.when(top, n)
    return out.otherwise(names[-1])


def cube(df: DataFrame, keys: list[str], row_key: str = "sample_id", label: str = "sentiment_label") -> DataFrame:
    """Rows, documents, domains, mean confidence and probabilities, label counts and scores a group.

    Null keys form groups. ``impact_score`` is index times directional confidence times
    ln(1 + documents).
    """
    base = df.groupBy(*keys).agg(
        F.count(row_key).alias("n_rows"), F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("domain").alias("n_domains"),
        F.avg("confidence").alias("confidence_mean"),
        *[F.avg(f"prob_{s}").alias(f"prob_{s}_mean") for s in SENTIMENTS],
        *[F.count_if(F.col(label) == s).alias(s) for s in SENTIMENTS])
    si = F.col("prob_positive_mean") - F.col("prob_negative_mean")
    dc = 1 - F.col("prob_mixed_or_unclear_mean")
    return base.withColumns({
        "hard_label_mode": hard_mode({s: F.col(s) for s in SENTIMENTS}), "sentiment_index": si, "directional_confidence": dc,
        "impact_score": si * dc * F.log1p("n_docs"), "abs_sentiment_index": F.abs(si)})


def ranking(table: DataFrame, least_docs: int, least_rows: int, order: Column, n: int, *ties: str) -> DataFrame:
    return table.where((F.col("n_docs") >= least_docs) & (F.col("n_rows") >= least_rows)).orderBy(order, *ties).limit(n)


def evidence(df: DataFrame, key: str) -> DataFrame:
    """Evidence, impact and coverage share of each value of ``key``."""
    g = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("doc_id").alias("n_docs"),
        *[F.avg(f"prob_{s}").alias(f"prob_{s}_mean") for s in SENTIMENTS])
    si = F.col("prob_positive_mean") - F.col("prob_negative_mean")
    dc = 1 - F.col("prob_mixed_or_unclear_mean")
    ev = F.log1p("n_docs") * dc
    total = g.agg(F.sum("n_docs")).scalar()
    return g.select(
        key, "n_rows", "n_docs", si.alias("sentiment_index"), ev.alias("evidence_score"), (ev * si).alias("impact"),
        (F.col("n_docs") / total).alias("coverage_share"))


def exposure(df: DataFrame, key: str) -> DataFrame:
    """0.5 document share + 0.3 mean confidence + 0.2 size of the mean sentiment."""
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count_distinct("doc_id").alias("n_docs"), F.avg("confidence").alias("mean_confidence"),
        F.avg(F.col("prob_positive") - F.col("prob_negative")).alias("mean_sentiment"))
    total = g.agg(F.sum("n_docs")).scalar()
    return g.select(
        key, "n_docs", "mean_confidence", "mean_sentiment",
        (0.5 * F.col("n_docs") / total + 0.3 * F.col("mean_confidence") + 0.2 * F.abs("mean_sentiment")).alias("exposure_score"))


def rolling_mean(df: DataFrame, by: list[str], order: str, value: str, rows: int = 3) -> DataFrame:
    """Mean over the last rows of each panel, gaps not filled; panels are calendar tables, not raw rows."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(rows - 1), 0)
    return df.withColumn(f"{value}_smoothed", F.avg(value).over(w))
