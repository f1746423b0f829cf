"""Thresholds, confusion and quality of scored rows, each from one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _safe(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def threshold_audit(scored: DataFrame, label: str, score: str, low: float, high: float, step: float) -> DataFrame:
    """Counts and quality at every threshold of the grid.

    Rows fall into the grid's steps once; cumulated step counts give every threshold, so
    the cost does not grow with the grid.
    """
    n = int(round((high - low) / step)) + 1
    grid = [round(low + i * step, 10) for i in range(n)]
    # the number of thresholds at or under the score
    step_of = sum((F.when(F.col(score) >= t, 1).otherwise(0) for t in grid), F.lit(0))
    per = scored.select(step_of.alias("k"), F.col(label).alias("y")).groupBy("k").agg(
        F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") != 1).alias("q"))
    spark = scored.sparkSession
    g = spark.createDataFrame([(i + 1, t) for i, t in enumerate(grid)], "i int, threshold double")
    one = per.agg(F.collect_list(F.struct("k", "p", "q")).alias("steps"))  # at most one entry a step and one below all
    over = lambda f, test: F.aggregate(
        F.col("steps"), F.lit(0).cast("long"), lambda acc, e: acc + F.when(test(e["k"]), e[f]).otherwise(0))
    out = g.withColumn("steps", one.scalar()).select(
        "threshold", over("p", lambda k: k >= F.col("i")).alias("tp"), over("q", lambda k: k >= F.col("i")).alias("fp"),
        over("p", lambda k: k < F.col("i")).alias("fn"), over("q", lambda k: k < F.col("i")).alias("tn"))
    precision, recall = _safe(F.col("tp"), F.col("tp") + F.col("fp")), _safe(F.col("tp"), F.col("tp") + F.col("fn"))
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return out.select(
        "threshold", "tp", "fp", "fn", "tn", precision.alias("precision"), recall.alias("recall"),
        _safe(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
        _safe(F.col("tp") + F.col("tn"), total).alias("accuracy"), _safe(F.col("tp") + F.col("fp"), total).alias("positive_rate"))


def best_threshold(audit: DataFrame) -> DataFrame:
    """Best f1, the lowest threshold on ties."""
    return audit.orderBy(F.desc(F.round("f1", 12)), "threshold").limit(1)


def confusion(df: DataFrame, truth: str, guess: str, labels: tuple[str, ...]) -> DataFrame:
    """Every pair of the fixed labels with its count, zeros included; other labels are left out."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], "true_label string, pred_label string")
    n = df.groupBy(F.col(truth).alias("true_label"), F.col(guess).alias("pred_label")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, ["true_label", "pred_label"], "left").na.fill(0, ["n"])


def class_report(df: DataFrame, truth: str, guess: str, labels: tuple[str, ...]) -> DataFrame:
    """Precision, recall, f1 and support of each label, and their macro and weighted means."""
    c = confusion(df, truth, guess, labels)
    tp = c.groupBy(F.col("true_label").alias("label")).agg(
        F.sum(F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0)).alias("tp"), F.sum("n").alias("support"))
    pp = c.groupBy(F.col("pred_label").alias("label")).agg(F.sum("n").alias("predicted"))
    each = tp.join(pp, "label").select(
        "label", "support", _safe(F.col("tp"), F.col("predicted")).alias("precision"), _safe(F.col("tp"), F.col("support")).alias("recall"),
        _safe(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"))
    w = lambda m: _safe(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m)
    macro = each.agg(F.lit("macro avg").alias("label"), F.sum("support").alias("support"), *[F.avg(m).alias(m) for m in ("precision", "recall", "f1")])
    weighted = each.agg(F.lit("weighted avg").alias("label"), F.sum("support").alias("support"), *[w(m) for m in ("precision", "recall", "f1")])
    return each.unionByName(macro).unionByName(weighted)


def class_weights(df: DataFrame, label: str, labels: tuple[str, ...]) -> DataFrame:
    """Inverse frequencies with mean 1; a label without rows counts as one row."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(x,) for x in labels], "label string")
    n = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    inv = grid.join(n, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"), (1.0 / F.greatest(F.coalesce("n", F.lit(1)), F.lit(1))).alias("inv"))
    return inv.select("label", "n", (F.col("inv") / F.avg("inv").over(Window.partitionBy())).alias("weight"))
