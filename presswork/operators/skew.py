"""Per-key results that do not depend on how unevenly rows spread over the keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def heavy_keys(df: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Key values that hold at least ``share`` of all rows: never more than 1/share of them.

    One map-side combined count, so the hottest key costs one partial row a task.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") >= counts.agg(F.sum("_n")).scalar() * share).select(*keys)


def salted_aggregate(
    df: DataFrame,
    keys: list[str],
    distinct: str,
    best: Column,
    heavy_share: float = 0.01,
    salts: int = 64,
) -> DataFrame:
    """Rows, distinct values and the best row of each key, in two salted stages.

    Rows of heavy keys (at least ``heavy_share`` of all rows) get one of ``salts`` salts,
    taken from the hash of ``distinct``, so equal values meet under one salt and the
    distinct counts of the salts add up exactly. Stage one makes partial results per
    (key, salt), stage two merges them per key. Light keys keep salt 0.

    Result: ``keys``, ``n_rows``, ``n_distinct`` (nulls are not counted), ``best`` (largest
    ``best`` struct). Nulls in a key form a group of their own; an empty input gives no
    rows; further columns of the input are ignored.
    """
    if not 0 < heavy_share <= 1 or salts < 1:
        raise ValueError("heavy_share must be in (0, 1] and salts positive")
    rows = df.select(*keys, F.col(distinct).alias("_d"), best.alias("_best"))
    hot = heavy_keys(rows, keys, heavy_share).select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.lit(True).alias("_hot"))
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_h_{k}"))
        on = same if on is None else on & same
    spread = F.coalesce(F.when(F.col("_d").isNotNull(), F.xxhash64("_d")), F.xxhash64("_best"))
    salted = rows.join(F.broadcast(hot), on, "left").select(
        *keys, "_d", "_best", F.when(F.col("_hot"), F.pmod(spread, F.lit(salts))).otherwise(F.lit(0)).cast("int").alias("_salt")
    )
    by_value = salted.groupBy(*keys, "_salt", "_d").agg(F.count(F.lit(1)).alias("_n"), F.max("_best").alias("_best"))
    partial = by_value.groupBy(*keys, "_salt").agg(
        F.sum("_n").alias("_n"), F.count("_d").alias("_nd"), F.max("_best").alias("_best")
    )
    return partial.groupBy(*keys).agg(
        F.sum("_n").alias("n_rows"), F.sum("_nd").alias("n_distinct"), F.max("_best").alias("best")
    )


def key_results(contexts: DataFrame, fields: tuple[str, ...] = ("canonical_entity", "domain")) -> DataFrame:
    """Rows, documents and best context for every value of every field, in one scan.

    The best context is the most confident, then the longest, then the one with the
    smallest document and block id, then the largest text; nulls lose each comparison.
    """
    long = contexts.select(
        F.explode(F.array(*[F.struct(F.lit(f).alias("key_field"), F.col(f).alias("key_value")) for f in fields])).alias("k"),
        "doc_id", "confidence", "clean_block_len", "block_id", "clean_block_text",
    ).select("k.key_field", "k.key_value", "doc_id", "confidence", "clean_block_len", "block_id", "clean_block_text")
    best = F.struct(
        F.col("confidence").alias("confidence"),
        F.col("clean_block_len").alias("len"),
        (-F.col("doc_id")).alias("neg_doc"),
        (-F.col("block_id")).alias("neg_block"),
        F.col("clean_block_text").alias("text"),
    )
    out = salted_aggregate(long, ["key_field", "key_value"], "doc_id", best)
    return out.select(
        "key_field", "key_value", "n_rows", F.col("n_distinct").alias("n_docs"),
        F.col("best.confidence").alias("best_confidence"),
        (-F.col("best.neg_doc")).alias("best_doc_id"),
        (-F.col("best.neg_block")).alias("best_block_id"),
        F.col("best.text").alias("best_context"),
    )


def dominant_keys(results: DataFrame, share: float = 0.03) -> DataFrame:
    """Key values that hold at least ``share`` of all rows; a null is no value."""
    total = results.groupBy("key_field").agg(F.sum("n_rows").alias("_total"))
    return (
        results.join(F.broadcast(total), "key_field")
        .where(F.col("key_value").isNotNull() & (F.col("n_rows") >= F.col("_total") * share))
        .select("key_field", "key_value")
    )
