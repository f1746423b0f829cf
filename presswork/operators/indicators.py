"""Pattern indicators and keyword evidence over texts, all in one scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presswork.operators.tables import long_form


def add_indicators(df: DataFrame, body: str, patterns: dict[str, tuple[str, ...]], prefix: str) -> DataFrame:
    """A boolean column a category: any of its patterns in the lower-case text."""
    t = F.lower(F.coalesce(F.col(body), F.lit("")))
    return df.withColumns({prefix + k: t.rlike("|".join(p)) for k, p in patterns.items()})


def count_indicators(df: DataFrame, prefix: str, least: int) -> DataFrame:
    """Rows and share of each indicator with at least ``least`` rows; empty input gives no rows."""
    names = [c for c in df.columns if c.startswith(prefix)]
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c)).alias(c) for c in names])
    out = long_form(one, ["_n"], {c[len(prefix):]: F.col(c) for c in names}, "category", "n")
    return out.where(F.col("n") >= least).select("category", "n", F.try_divide("n", "_n").alias("share"))


def keyword_matrix(df: DataFrame, group: str, body: str, words: dict[str, tuple[str, ...]]) -> DataFrame:
    """Evidence of each category in each group: rows that contain a keyword, added over the keywords, and its share of the group's largest."""
    t = F.lower(F.coalesce(F.col(body), F.lit("")))
    hits = {k: sum((t.contains(w).cast("int") for w in ws), F.lit(0)) for k, ws in words.items()}
    one = df.where(F.col(group).isNotNull()).groupBy(group).agg(*[F.sum(h).cast("long").alias(k) for k, h in hits.items()])
    out = long_form(one, [group], {k: F.col(k) for k in words}, "category", "evidence")
    top = F.max("evidence").over(Window.partitionBy(group))  # one row a category
    return out.withColumn("evidence_share", F.coalesce(F.try_divide("evidence", top), F.lit(0.0)))
