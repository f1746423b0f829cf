"""Samples, allocations and splits that repeat: every draw orders by a hash of seed and key."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.functions import fixed
from presswork.operators.tables import dense_ids, null_safe_join, running_total, top_n
from presswork.session import cut

#: Strata whose sizes may be brought to the driver.
MAX_STRATA = 100_000
#: Rows of one stratum that one task sorts.
SORTED_ROWS = 500_000


def draw_key(*keys: str, seed: int = 42) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def simple_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(draw_key(key, seed=seed), key).limit(n)


def strata_weights(df: DataFrame, strata: list[str]) -> DataFrame:
    """Rows and share of each stratum; the total is one number, not a join of the rows."""
    n = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n_rows"))
    return n.select(*strata, "n_rows", (F.col("n_rows") / n.agg(F.sum("n_rows")).scalar()).alias("weight"))


def largest_remainder(weights: list[float], total: int) -> list[int]:
    """Whole numbers near ``weight * total``, at least 1, that add up to ``total``.

    Too many: strata of small weight give first, but none falls under 1. Too few: the
    largest fractions receive, round after round. With fewer units than strata every
    stratum keeps its 1 and the sum is larger than asked.
    """
    raw = [w * total for w in weights]
    base = [max(1, math.floor(x)) for x in raw]
    up = sorted(range(len(raw)), key=lambda i: (weights[i], i))
    while sum(base) > total and any(b > 1 for b in base):
        for i in up:
            if sum(base) <= total:
                break
            if base[i] > 1:
                base[i] -= 1
    down = sorted(range(len(raw)), key=lambda i: (-(raw[i] - math.floor(raw[i])), i))
    k = 0
    while down and sum(base) < total:
        base[down[k % len(down)]] += 1
        k += 1
    return base


def nearest_fraction(weights: list[float], total: int) -> list[int]:
    """As above, but the stratum of least weight above 1 gives first, and each missing row goes to the one now furthest below its share."""
    raw = [w * total for w in weights]
    base = [max(1, math.floor(x)) for x in raw]
    while sum(base) > total and any(b > 1 for b in base):
        i = min((i for i in range(len(base)) if base[i] > 1), key=lambda j: (weights[j], j))
        base[i] -= 1
    while base and sum(base) < total:
        i = max(range(len(base)), key=lambda j: (raw[j] - base[j], -j))
        base[i] += 1
    return base


def first_gives(weights: list[float], total: int) -> list[int]:
    """As above, but where the stratum of least weight has only 1 left, the first one above 1 gives."""
    raw = [w * total for w in weights]
    base = [max(1, math.floor(x)) for x in raw]
    least = min(range(len(weights)), key=lambda i: (weights[i], i), default=0)
    while sum(base) > total:
        able = [i for i in range(len(base)) if base[i] > 1]
        if not able:
            break
        base[least if base[least] > 1 else able[0]] -= 1
    while base and sum(base) < total:
        base[max(range(len(base)), key=lambda j: (raw[j] - base[j], -j))] += 1
    return base


def rounded_with_floor(weights: list[float], total: int, floor: int = 20) -> list[int]:
    """Half-even rounded shares, at least ``floor``; the largest stratum absorbs the difference while above the floor."""
    base = [max(floor, round(w * total)) for w in weights]
    while sum(base) > total and base:
        i = max(range(len(base)), key=lambda j: (base[j], -j))
        if base[i] <= floor:
            break
        base[i] -= 1
    if base and sum(base) < total:
        i = max(range(len(base)), key=lambda j: (base[j], -j))
        base[i] += total - sum(base)
    return base


def allocation(df: DataFrame, strata: list[str], total: int, rule=largest_remainder) -> DataFrame:
    """Rows to draw from each stratum. Only stratum sizes reach the driver (checked bound)."""
    w = strata_weights(df, strata)
    rows = w.orderBy(*strata).limit(MAX_STRATA + 1).collect()
    if len(rows) > MAX_STRATA:
        raise ValueError(f"more than {MAX_STRATA} strata")
    got = rule([r["weight"] for r in rows], total)
    schema = w.select(*strata, "n_rows").withColumn("target", F.lit(0).cast("long")).schema
    return df.sparkSession.createDataFrame([(*[r[s] for s in strata], r["n_rows"], g) for r, g in zip(rows, got)], schema)


def stratified_sample(df: DataFrame, strata: list[str], key: str, targets: DataFrame, seed: int = 42, rows: int = SORTED_ROWS) -> DataFrame:
    """The first ``target`` rows of each stratum by hash order; strata without a target give none.

    Taken in two exact steps: the first rows of each part of a stratum, then the first of
    those. A stratum has a part for every ``rows`` rows it has, so one that holds most of
    the table is sorted by many tasks.
    """
    sizes = targets if "n_rows" in targets.columns else targets.join(df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n_rows")), strata)
    parts = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / rows)).cast("long")
    t = F.broadcast(sizes.select(*strata, F.col("target").alias("_target"), parts.alias("_parts")))  # one row a stratum, bounded above
    order = [draw_key(key, seed=seed), F.col(key)]
    part = F.pmod(F.xxhash64(key), F.col("_parts")).alias("_part")
    first = lambda d, by: d.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rn <= _target").drop("_rn")
    return first(first(df.join(t, strata).select("*", part), [*strata, "_part"]), strata).drop("_part", "_parts", "_target")


def ranked(df: DataFrame, strata: list[str], order: list[Column], name: str) -> DataFrame:
    """Rank from 1 of each row in its stratum, without gathering a stratum in one task.

    Rows are numbered over all strata by a parallel range sort; a stratum's rank starts at
    its smallest number.
    """
    keyed = df.withColumns({f"_o{i}": c for i, c in enumerate(order)})
    numbered = dense_ids(keyed, [*strata, *[f"_o{i}" for i in range(len(order))]], "_id")
    start = numbered.groupBy(*strata).agg(F.min("_id").alias("_start"))
    on = null_safe_join(numbered, start, strata)
    return on.withColumn(name, F.col("_id") - F.col("_start") + 1).drop("_id", "_start", *[f"_o{i}" for i in range(len(order))])


def capped_sample(df: DataFrame, entity: list[str], key: str, cap: int, total: int, seed: int = 42) -> DataFrame:
    """At most ``cap`` rows an entity, then at most ``total`` rows."""
    return simple_sample(top_n(df, entity, [draw_key(key, seed=seed), F.col(key)], cap), key, total, seed)


def quota_pool(df: DataFrame, tier: str, entity: list[str], key: str, total: int, shares: dict[str, float],
               caps: dict[str, int], seed: int = 42) -> DataFrame:
    """Tier quotas with caps an entity, filled up from the unused rows."""
    parts = None
    for name, share in shares.items():
        p = capped_sample(df.where(F.col(tier) == name), entity, key, caps[name], round(share * total), seed)
        parts = p if parts is None else parts.unionByName(p)
    used = parts.select(key)
    rest = df.join(used, key, "left_anti").orderBy(draw_key(key, seed=seed), key).limit(total)
    first = parts.withColumn("_o", F.lit(0)).unionByName(rest.withColumn("_o", F.lit(1)))
    return first.orderBy("_o", draw_key(key, seed=seed), key).limit(total).drop("_o")


def typed_pools(df: DataFrame, kind: str, targets: dict[str, int], tier: str, entity: list[str], key: str, shares: dict[str, float],
                caps: dict[str, dict[str, int]], seed: int = 42) -> DataFrame:
    """A quota pool for every listed kind, united: no kind takes another one's place."""
    pools = [quota_pool(df.where(F.col(kind) == k), tier, entity, key, n, shares, {t: c[k] for t, c in caps.items()}, seed) for k, n in targets.items()]
    return reduce(DataFrame.unionByName, pools)


def stratified_split(df: DataFrame, strata: list[str], key: str, share: float, seed: int = 42) -> DataFrame:
    """``split`` is valid for the rounded share of each stratum in hash order, else train."""
    n = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    on = null_safe_join(ranked(df, strata, [draw_key(key, seed=seed), F.col(key)], "_rank"), n, strata)
    return on.withColumn("split", F.when(F.col("_rank") <= F.bround(F.col("_n") * share, 0), "valid").otherwise("train")).drop("_n", "_rank")


def group_split(df: DataFrame, group: str, label: str, share: float, seed: int = 42, kind: str | None = None, docs: str | None = None,
                least_rows: int = 0) -> DataFrame:
    """Whole groups to valid or train; strata are the group's commonest kind, commonest label and document bucket.

    Without ``kind`` or ``docs`` that part of the stratum is the same for all (rows stand for
    documents). Ties go to the smallest value; each stratum gives at least one group. While the valid
    part has fewer than ``least_rows`` rows, further groups join it in hash order.
    """
    stats = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), (F.count_distinct(docs) if docs else F.count(F.lit(1))).alias("n_docs"))
    for c, name in (((kind, "main_type"),) if kind else ()) + ((label, "main_label"),):
        per = df.groupBy(group, F.col(c).alias("_v")).agg(F.count(F.lit(1)).alias("_n")).where("_v is not null")
        stats = null_safe_join(stats, per.groupBy(group).agg(F.min_by("_v", F.struct(-F.col("_n"), F.col("_v"))).alias(name)), [group], "left")
    n = F.col("n_docs")
    bucket = F.when(n >= fixed.HEAD_DOCS, "head").when(n >= fixed.MID_DOCS, "mid").otherwise("tail")
    s = stats.withColumn("stratum", F.concat_ws(
        "|||", *([F.coalesce("main_type", F.lit("nan"))] if kind else []), F.coalesce("main_label", F.lit("nan")), bucket))
    k = s.groupBy("stratum").agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * share, 0).cast("int")).alias("_k"))
    drawn = ranked(s, ["stratum"], [draw_key(group, seed=seed), F.col(group)], "_rank").join(k, "stratum").withColumn("_in", F.col("_rank") <= F.col("_k"))
    drawn = cut(drawn.drop("_rank", "_k"), "groups")
    missing = least_rows - F.coalesce(drawn.agg(F.sum(F.when(F.col("_in"), F.col("n_rows")))).scalar(), F.lit(0))
    rest = running_total(drawn.where("not _in").withColumn("_draw", draw_key(group, seed=seed)), ["_draw", group], "n_rows", "_total").drop("_draw")
    more = rest.withColumn("split", F.when(F.col("_total") - F.col("n_rows") < missing, "valid").otherwise("train")).drop("_total")
    return drawn.where("_in").withColumn("split", F.lit("valid")).unionByName(more).drop("_in")


def two_pools(df: DataFrame, strata: list[str], key: str, total: int, special: Column, share: float, seed: int = 42) -> DataFrame:
    """A general stratified pool and one of special rows only, united, each key once, at most ``total`` rows.

    Both quotas are allocated over the rows they draw from, so neither stays unfilled.
    """
    rest = df.where(special)
    general = stratified_sample(df, strata, key, allocation(df, strata, round(total * (1 - share))), seed)
    extra = stratified_sample(rest, strata, key, allocation(rest, strata, round(total * share)), seed + 1)
    both = general.unionByName(extra).dropDuplicates([key])
    return simple_sample(both, key, total, seed)
