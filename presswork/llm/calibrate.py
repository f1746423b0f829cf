"""Samples whose category shares follow given targets.

Units are calibrated to the margins of every category (say, each type and each size
bucket) by Newton iterations on the dual of exponential tilting; the only statistics it
needs are unit counts per category cell, which one distributed aggregation makes. Cells
that run out and cells held at their floor are fixed, and the others are calibrated anew to
what is left of the sample. The inclusion probabilities are then used by the pivotal
method, run in bounded blocks that are merged level by level up to the whole plan, so no
task ever holds a whole category and the sample has the size it should.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.session import cut

#: Plan rows are collected to the driver; more than this is refused.
MAX_PLAN_ROWS = 200_000
#: Units one task's pivotal block may hold.
BLOCK = 20_000


def category(c: Column) -> Column:
    """A category as the pool means it: trimmed, lower case, ``_`` for space and hyphen."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s-]", "_")


def tilt(counts: np.ndarray, design: np.ndarray, target: np.ndarray, tol: float = 1e-9, steps: int = 100, start: np.ndarray | None = None) -> np.ndarray:
    """Inclusion probabilities of the cells, by Newton's method on the tilting dual.

    ``counts`` has the units of each cell, ``design`` (cells x constraints) its category
    indicators and ``target`` the wanted totals. Cell probabilities have the form
    ``min(1, d * exp(design @ lambda))``, where d is ``start`` or the same for all; the dual's gradient is ``totals - target`` and its
    Hessian the weighted moment matrix of the cells not held at 1. Targets above what the
    cells can give end with those cells at probability 1.
    """
    counts, design, target = counts.astype(float), design.astype(float), target.astype(float)
    pi = np.zeros(len(counts))
    has = counts > 0
    reach = design.T @ counts
    live = (target > 0) & (reach > 0)
    none = (design[:, target <= 0] > 0).any(axis=1)  # a constraint of 0 lets none of its cells in
    free = has & ~none
    goal = np.minimum(target, reach)
    a, t = design[:, live], goal[live]
    if not free.any() or not live.any():
        return pi
    d = np.maximum(start, 1e-12) if start is not None else np.full(len(counts), min(1.0, t.sum() / max(a[free].sum(axis=1) @ counts[free], 1e-12)))
    lam = np.zeros(a.shape[1])

    def at(x: np.ndarray) -> np.ndarray:
        return np.where(free, np.minimum(1.0, d * np.exp(np.clip(a @ x, -60, 60))), 0.0)

    def gap(x: np.ndarray) -> np.ndarray:
        return a.T @ (counts * at(x)) - t

    for _ in range(steps):
        p, g = at(lam), gap(lam)
        if np.abs(g).max() <= tol * max(1.0, t.max()):
            break
        inner = free & (p < 1.0)
        h = a[inner].T @ (a[inner] * (counts[inner] * p[inner])[:, None])
        h += np.eye(len(lam)) * (1e-12 + 1e-10 * np.trace(h))
        step = np.linalg.lstsq(h, -g, rcond=None)[0]
        step = np.clip(step, -5, 5)
        size, now = 1.0, np.abs(g).sum()
        while size > 1e-4 and np.abs(gap(lam + size * step)).sum() > now:
            size /= 2
        lam = lam + size * step
    pi = at(lam)
    pi[free & (pi > 1 - 1e-9)] = 1.0
    return pi


def calibrated(available: np.ndarray, share: np.ndarray, floor: np.ndarray, margins: list[np.ndarray], size: float) -> np.ndarray:
    """Expected units of each cell of one plan.

    ``margins`` has one array for each category, the cells' values. Floors come first (a
    cell has all its units if they are fewer), then cells too small for their share, which
    leave it unfilled. The other cells are calibrated to their margins less what floors take
    beyond their share, so that the sample keeps its size. A cell that runs out on the way,
    or that would fall below its floor, is fixed and the rest calibrated again: each turn
    fixes a cell.
    """
    available, share = available.astype(float), share.astype(float)
    floor, want = np.minimum(floor, available).astype(float), share * size
    small = available <= np.maximum(want, floor)
    fixed = small | (want <= floor)
    n = np.where(small, available, np.where(fixed, floor, 0.0))
    used = np.where(small, np.maximum(want, n), n)  # what a cell takes of the size, filled or not
    while not fixed.all():
        free = ~fixed
        left = min(max(size * min(1.0, share.sum()) - used[fixed].sum(), 0.0), available[free].sum())
        design, target = [], []
        for values in margins:
            kinds = np.unique(values[free])
            goal = np.array([max(want[values == v].sum() - used[(values == v) & fixed].sum(), 0.0) for v in kinds])
            design.append(np.array([(values == v)[free] for v in kinds], dtype=float))
            target.append(goal * left / goal.sum() if goal.sum() > 0 else np.zeros(len(kinds)))
        base = want[free] * left / max(want[free].sum(), 1e-12) / available[free]
        now = available[free] * tilt(available[free], np.concatenate(design).T, np.maximum(np.concatenate(target), 1e-9), start=np.minimum(base, 1.0))
        at = np.flatnonzero(free)
        low, full = at[now < floor[free] - 1e-9], at[now >= available[free] - 1e-9]
        if len(low):
            n[low], fixed[low] = floor[low], True
        elif len(full) and len(full) < len(at):
            n[full], fixed[full] = available[full], True
        else:
            n[at], fixed[at] = now, True
        used[fixed & ~small] = n[fixed & ~small]
    whole = np.abs(n - np.round(n)) < 1e-6
    return np.where(whole, np.round(n), n)


def required(target_share: Column, size: Column, min_rows: Column) -> Column:
    """Rows a plan cell asks for: its rounded share of the sample, or its floor if larger."""
    return F.greatest(F.round(target_share * size).cast("long"), F.coalesce(min_rows, F.lit(0)))


def pool_units(pool: DataFrame, unit: str, cats: list[str]) -> DataFrame:
    """One row for each (unit, cell): repeated units count once, a null category is no cell."""
    clean = pool.select(F.col(unit).alias("unit"), *[category(F.col(c)).alias(c) for c in cats])
    return clean.na.drop().distinct()


def cell_report(pool: DataFrame, plans: DataFrame, unit: str = "sample_id",
                cats: tuple[str, ...] = ("final_type", "entity_doc_bucket")) -> pd.DataFrame:
    """Calibrated inclusion probability and gap for every plan cell.

    The pool is only counted per cell, and only for cells some plan names, so what reaches
    the driver is bounded by the plan table (checked against ``MAX_PLAN_ROWS``). Plan rows
    without plan_id, size or share are left out, a null floor is 0; of cells a plan lists
    twice the larger share and floor hold.
    """
    cats = list(cats)
    named = plans.where("plan_id is not null and sample_size is not null and target_share is not null")
    p = named.select("plan_id", "sample_size", *[category(F.col(c)).alias(c) for c in cats],
                     F.col("target_share").cast("double").alias("target_share"),
                     required(F.col("target_share"), F.col("sample_size"), F.col("min_rows")).alias("required"),
                     F.coalesce("min_rows", F.lit(0)).cast("long").alias("floor"))
    n = p.count()
    if n > MAX_PLAN_ROWS:
        raise ValueError(f"{n} plan rows; at most {MAX_PLAN_ROWS} are supported")
    counts = (
        pool_units(pool, unit, cats)
        .join(F.broadcast(p.select(*cats).distinct()), cats, "left_semi")
        .groupBy(*cats).agg(F.count(F.lit(1)).alias("available"))
    )
    rows = p.join(counts, cats, "left").na.fill(0, ["available"]).toPandas()
    rows["prob"] = 0.0
    rows["floor"] = rows["floor"].fillna(0)
    for _, g in rows.groupby("plan_id", dropna=False):
        cells = g.groupby(cats, sort=True, dropna=False).agg(
            available=("available", "first"), floor=("floor", "max"), share=("target_share", "max"))
        ok = ~cells.index.to_frame().isna().any(axis=1).to_numpy()
        cells = cells[ok]  # a null category is no cell
        if not len(cells):
            continue
        n = calibrated(cells["available"].to_numpy(), cells["share"].to_numpy(), cells["floor"].to_numpy(),
                       [cells.index.get_level_values(c).to_numpy() for c in cats], float(g["sample_size"].max()))
        by = dict(zip(cells.index, n / np.maximum(cells["available"].to_numpy(), 1)))
        rows.loc[g.index, "prob"] = [by.get(k, 0.0) for k in zip(*[g[c] for c in cats])]
    return rows


def pivotal(prob: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Ordered pivotal sampling: duels of neighbours until at most one unit is undecided.

    ``u`` holds one uniform number for each unit. Expected values equal ``prob`` and the
    sum never changes, so with a whole-number sum every unit ends at 0 or 1.
    """
    p = prob.astype(float).copy()
    p[p <= 1e-9], p[p >= 1 - 1e-9] = 0.0, 1.0
    i = -1
    for j in np.flatnonzero((p > 0) & (p < 1)):
        if i < 0:
            i = j
            continue
        a, b = p[i], p[j]
        s = a + b
        if s < 1:
            stay, p_stay, p_go = (j, s, 0.0) if u[j] < b / s else (i, s, 0.0)
        else:
            stay, p_stay, p_go = (j, s - 1, 1.0) if u[j] < (1 - b) / (2 - s) else (i, s - 1, 1.0)
        go = i if stay == j else j
        p[go], p[stay] = p_go, p_stay
        i = stay
        if p[i] <= 1e-9 or p[i] >= 1 - 1e-9:
            p[i] = round(p[i])
            i = -1
    return p


def draw(pool: DataFrame, plans: DataFrame, unit: str = "sample_id",
         cats: tuple[str, ...] = ("final_type", "entity_doc_bucket"), seed: int = 42, block: int = BLOCK,
         cells: pd.DataFrame | None = None) -> DataFrame:
    """The units drawn for every plan: plan_id, unit, categories and inclusion probability.

    Units with probability 1 are taken as they are; the others meet in pivotal blocks of
    about ``block`` units of one plan cell. Each block leaves at most one undecided unit,
    and the undecided ones meet again, until one a cell remains; those of a plan's cells then
    meet too. A cell of any size, and one that holds most of the pool, is thus split over
    many tasks. Draws repeat for
    a given ``seed``. An empty pool or plan table gives no rows. ``cells`` saves the count
    where :func:`cell_report` was already asked.
    """
    cats = list(cats)
    cells = cell_report(pool, plans, unit, tuple(cats)) if cells is None else cells
    cells = cells[cells["prob"] > 0].drop_duplicates(["plan_id", *cats])
    spark = pool.sparkSession
    schema = "plan_id long, " + ", ".join(f"{c} string" for c in cats) + ", prob double, blocks long"
    rows = [(int(r.plan_id), *[getattr(r, c) for c in cats], float(r.prob), max(1, math.ceil(r.available / block)))
            for r in cells.itertuples()]
    small = F.broadcast(spark.createDataFrame(rows, schema))  # at most MAX_PLAN_ROWS rows
    units = pool_units(pool, unit, cats).join(small, cats)
    sure = units.where(F.col("prob") >= 1 - 1e-12).select("plan_id", "unit", *cats, "prob")
    if not rows or all(r[-2] >= 1 - 1e-12 for r in rows):
        return sure
    u = F.pmod(F.xxhash64(F.lit(seed), "plan_id", "unit"), F.lit(1 << 40)) / float(1 << 40)
    todo = units.where(F.col("prob") < 1 - 1e-12).select(
        "plan_id", "unit", *cats, "prob", "blocks", u.alias("u"), F.col("prob").alias("p"),
        F.pmod(F.xxhash64(F.lit(seed + 1), "unit"), F.col("blocks")).alias("block"))
    shape = todo.schema

    def duel(g: pd.DataFrame, by: list[str] | None = None) -> pd.DataFrame:
        g = g.sort_values([*(by or []), "u", "unit"], kind="stable")
        g["p"] = pivotal(g["p"].to_numpy(), np.random.default_rng(int(g["u"].iloc[0] * (1 << 40))).random(len(g)))
        return g

    done, left = [], max(r[-1] for r in rows)
    while True:
        out = todo.groupBy("plan_id", *cats, "block").applyInPandas(lambda g: duel(g), shape)
        out = cut(out, "pivotal")
        done.append(out.where(F.col("p") >= 1))
        todo = out.where((F.col("p") > 0) & (F.col("p") < 1))
        if left == 1:
            break
        left = math.ceil(left / block)
        todo = todo.withColumn("block", (F.col("block") / block).cast("long") if left > 1 else F.lit(0).cast("long"))

    def last(g: pd.DataFrame) -> pd.DataFrame:
        """One undecided unit a cell at most: neighbouring cells meet, so margins stay close."""
        g = duel(g.sort_values(cats, kind="stable"), cats)
        g["p"] = np.where((g["p"] > 1e-6) & (g["p"] < 1 - 1e-6), g["u"] < g["p"], g["p"] >= 0.5).astype(float)
        return g

    done.append(todo.groupBy("plan_id").applyInPandas(last, shape).where(F.col("p") >= 1))
    res = sure
    for d in done:
        res = res.unionByName(d.select("plan_id", "unit", *cats, "prob"))
    return res


def report(pool: DataFrame, plans: DataFrame, unit: str = "sample_id",
           cats: tuple[str, ...] = ("final_type", "entity_doc_bucket"), seed: int = 42) -> DataFrame:
    """Per plan cell: wanted, available and drawn rows, shares, and the rows it falls short.

    ``required`` is the larger of the floor and the rounded share of the sample. A cell is
    short by what it lacks of that although all its units were drawn; a cell drawn below
    ``required`` with units to spare made room for the floors of others.
    """
    cats = list(cats)
    cells = cell_report(pool, plans, unit, tuple(cats))
    drawn = draw(pool, plans, unit, tuple(cats), seed, cells=cells).groupBy("plan_id", *cats).agg(F.count(F.lit(1)).alias("drawn"))
    spark = pool.sparkSession
    schema = ("plan_id long, " + ", ".join(f"{c} string" for c in cats)
              + ", target_share double, required long, available long")
    rows = [(int(r.plan_id), *[getattr(r, c) for c in cats], float(r.target_share), int(r.required), int(r.available))
            for r in cells.itertuples()]
    out = spark.createDataFrame(rows, schema).join(drawn, ["plan_id", *cats], "left").na.fill(0, ["drawn"])
    total = out.groupBy("plan_id").agg(F.sum("drawn").alias("_total"))
    lacks = F.when(F.col("drawn") == F.col("available"), F.greatest(F.col("required") - F.col("drawn"), F.lit(0))).otherwise(F.lit(0))
    return out.join(F.broadcast(total), "plan_id").select(
        "plan_id", *cats, "target_share", "required", "available", "drawn",
        F.coalesce(F.try_divide("drawn", "_total"), F.lit(0.0)).alias("actual_share"), lacks.alias("short"))


def audit(pool: DataFrame, plans: DataFrame, unit: str = "sample_id",
          cats: tuple[str, ...] = ("final_type", "entity_doc_bucket"), seed: int = 42) -> DataFrame:
    """Per plan: (unit, cell) pairs drawn twice, cells below their reachable floor, and rows off the size.

    A sample is no larger than its plan says unless the floors ask for more, and smaller
    only by what small cells lack. All three counts are 0 for a right sample.
    """
    cats = list(cats)
    cells = cell_report(pool, plans, unit, tuple(cats))
    drawn = draw(pool, plans, unit, tuple(cats), seed, cells=cells)
    n = drawn.groupBy("plan_id", *cats).agg(F.count(F.lit(1)).alias("drawn"), (F.count(F.lit(1)) - F.count_distinct("unit")).alias("again"))
    spark = pool.sparkSession
    rows = [(int(r.plan_id), *[getattr(r, c) for c in cats], float(r.target_share * r.sample_size), int(min(r.floor, r.available)), int(r.available))
            for r in cells.drop_duplicates(["plan_id", *cats]).itertuples()]
    schema = "plan_id long, " + ", ".join(f"{c} string" for c in cats) + ", share double, least long, available long"
    each = spark.createDataFrame(rows, schema).join(n, ["plan_id", *cats], "left").na.fill(0, ["drawn", "again"])
    lack = F.greatest(F.col("share") - F.col("available"), F.lit(0.0))
    total = each.groupBy("plan_id").agg(
        F.sum("again").alias("drawn_twice"), F.count_if(F.col("drawn") < F.col("least")).alias("below_floor"), F.sum("drawn").alias("n"),
        F.greatest(F.sum("share"), F.sum("least")).alias("most"),
        (F.sum("share") - F.sum(lack)).alias("least"))
    off = F.greatest(F.col("n") - F.col("most"), F.col("least") - F.col("n"), F.lit(0.0))
    return total.select("plan_id", "drawn_twice", "below_floor", F.floor(off).alias("off_size"))
