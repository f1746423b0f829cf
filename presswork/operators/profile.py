"""Profiles of a table: nulls, duplicates, lengths, histograms, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.operators.tables import dense_ids, long_form

QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null count and rounded ratio a column, in one pass."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    out = long_form(one, ["_n"], {c: F.col(c) for c in columns}, "column_name", "null_count")
    return out.select("column_name", "null_count", F.round(F.coalesce(F.try_divide("null_count", "_n"), F.lit(0.0)), 4).alias("null_ratio"))


def duplicate_profile(df: DataFrame, column: str) -> DataFrame:
    """Rows, distinct values, rows in repeated groups, share of rows beyond the first of each group.

    Counted from one count per value: a hot value is one partial row a task.
    """
    per = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(column).alias("n_distinct"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)), F.lit(0)).alias("rows_in_duplicates"),
        F.coalesce(F.try_divide(F.sum(F.col("n") - 1), F.sum("n")), F.lit(0.0)).alias("duplicate_ratio"))


def describe(df: DataFrame, column: str, by: list[str] | None = None, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """count, mean, sample deviation, extremes and exact interpolated quantiles.

    Quantiles keep a count of each distinct value; for columns of very many different
    values :func:`ranked_quantiles` sorts in parallel instead.
    """
    c = F.col(column).cast("double")
    one = df.groupBy(*(by or [])).agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"),
        F.percentile(c, list(quantiles)).alias("_q"))  # one count of values for all quantiles
    return one.select("*", *[F.col("_q")[i].alias(f"p{round(q * 100):02d}") for i, q in enumerate(quantiles)]).drop("_q")


def ranked_quantiles(df: DataFrame, column: str, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(quantile, value): exact interpolated quantiles by a parallel range sort, whatever the number of values.

    Null values do not count; a column without values has null quantiles.
    """
    x = df.select(F.col(column).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    ids = dense_ids(x.withColumn("_tie", F.monotonically_increasing_id()), ["_x", "_tie"], "_place")
    n = ids.agg(F.count(F.lit(1))).scalar()
    want = df.sparkSession.createDataFrame([(float(q),) for q in quantiles], "quantile double").withColumn("_at", F.col("quantile") * (n - 1))
    ends = want.select("quantile", "_at", F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("_place")).distinct()
    got = ids.join(F.broadcast(ends), "_place").groupBy("quantile", "_at").agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("_at") - F.floor("_at"))
    return want.select("quantile").join(got.select("quantile", value.alias("value")), "quantile", "left")


def threshold_shares(df: DataFrame, column: str, below: tuple[int, ...], above: tuple[int, ...]) -> DataFrame:
    """Share of rows under and over thresholds; null values are neither."""
    c = F.col(column)
    one = df.agg(
        *[F.avg(F.coalesce(c < t, F.lit(False)).cast("int")).alias(f"below_{t}") for t in below],
        *[F.avg(F.coalesce(c > t, F.lit(False)).cast("int")).alias(f"above_{t}") for t in above])
    return long_form(one, [], {n: F.col(n) for n in one.columns}, "threshold", "share")


def histogram(df: DataFrame, column: str, bins: int, clip: float | None = None, log: bool = False) -> DataFrame:
    """Equal-width bins from least to largest value, the last one closed; optionally clipped to a quantile or log1p-scaled."""
    c = F.col(column).cast("double")
    x = df.where(c.isNotNull()).select((F.log1p(c) if log else c).alias("x"))
    if clip is not None:
        x = x.where(F.col("x") <= x.agg(F.percentile("x", clip)).scalar())
    lo, hi = x.agg(F.min("x")).scalar(), x.agg(F.max("x")).scalar()
    width = (hi - lo) / bins
    b = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1))).cast("long")
    return x.select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
