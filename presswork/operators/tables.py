"""Columns, keys, duplicates, joins and sets: the table work around every stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.session import cut


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def ensure_column(df: DataFrame, name: str, default: object, dtype: str) -> DataFrame:
    """The column as it is, or the default where the table has none."""
    return df if name in df.columns else df.withColumn(name, F.lit(default).cast(dtype))


def select_present(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def first_present(df: DataFrame, candidates: list[str]) -> str:
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"none of {candidates}")


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first by ``order``; the order must be total to be repeatable.

    Spark prunes inside the partitions before the shuffle (window group limit), so a hot
    key sends a row a task, not all its rows.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return out.withColumnRenamed("_rn", rank) if rank else out.drop("_rn")


def dense_ids(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """Ids 0, 1, 2 ... in key order without a single-task sort.

    Rows are ranged and sorted in parallel and numbered inside their range; the ranges'
    sizes, one row a partition, give the offsets.
    """
    key = F.struct(*order)
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    local = ranged.select(
        "*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_i"))
    placed = cut(local, "ids")
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_k"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_o"))  # one row a partition
    return placed.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_o") + F.col("_i")).drop("_p", "_i", "_o")


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over all rows up to each one in key order, without a single-task window.

    The order must be total. Ranges are summed in parallel; one row a partition carries them on.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).select("*", F.spark_partition_id().alias("_p"))
    placed = cut(ranged, "totals")
    sizes = placed.groupBy("_p").agg(F.sum(value).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))  # one row a partition
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_o") + F.sum(value).over(inside)).drop("_p", "_o")


def left_default(left: DataFrame, right: DataFrame, keys: list[str], defaults: dict[str, object]) -> DataFrame:
    """Left join with the right side's missing values filled; null keys match nothing."""
    out = left.join(right, keys, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equality join in which a null key matches a null key; keys come from the left."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = None
    for k in keys:
        e = left[k].eqNullSafe(F.col(f"_r_{k}"))
        on = e if on is None else on & e
    return left.join(r, on, how).drop(*[f"_r_{k}" for k in keys])


def top_tier(df: DataFrame, column: str, k: int, name: str, other: str = "other") -> DataFrame:
    """The column's value when it is among the ``k`` commonest, else ``other``; ties go by value."""
    top = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n")).orderBy(
        F.desc("_n"), column).limit(k).select(F.col(column).alias("_top"))
    # at most k rows are broadcast
    return df.join(F.broadcast(top), F.col(column) == F.col("_top"), "left").withColumn(
        name, F.coalesce("_top", F.lit(other))).drop("_top")


def compact_log(log: DataFrame, keys: list[str], sequence: list[str]) -> DataFrame:
    """Last row a key wins, by the ingest sequence."""
    return keep_one(log, keys, [F.col(c).desc_nulls_last() for c in sequence])


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``current`` without a change, and the changes."""
    return current.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes, allowMissingColumns=True)


def long_form(df: DataFrame, ids: list[str], values: dict[str, Column], key: str = "metric", value: str = "value") -> DataFrame:
    """One row a named value."""
    items = F.array(*[F.struct(F.lit(k).alias(key), v.alias(value)) for k, v in values.items()])
    return df.select(*ids, F.explode(items).alias("_x")).select(*ids, f"_x.{key}", f"_x.{value}")
