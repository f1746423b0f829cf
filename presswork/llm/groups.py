"""Train, validation and test splits that keep tied records together.

Records are tied by entity or by passage; ties carry on through other records. The
components are found by alternating large-star and small-star steps (every step is a
minimum per node and a join, so a hot node is a hot join key that adaptive execution can
split, never a collected group). Components then go to splits by grouped iterative
stratification.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.session import cut, forget

#: Components with at least 1/BIG of all records are placed one by one on the driver: at most BIG of them.
BIG = 2_000
#: Small components are placed in blocks of about this many.
BLOCK = 50_000
#: Edges of one node that one task may join; a node with more is spread.
HOT = 1_000_000
#: Distinct label values a stratification may use (their totals come to the driver).
MAX_LABELS = 100_000
#: Sorts behind every entity key; marks records without an entity (fixed value).
NO_ENTITY = "\uffff"


def _clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(c)), r"(?U)\s+", " "))


def entity_key(entity: Column, kind: Column) -> Column:
    """``entity|||type``, each trimmed, lower case, inner spaces squeezed; null without an entity."""
    e = F.nullif(_clean(entity), F.lit(""))
    return F.concat(e, F.lit("|||"), F.coalesce(_clean(kind), F.lit("")))


def tied_records(df: DataFrame) -> DataFrame:
    """(sample_id, node, tie): a record's node is its entity key, each tie a shared passage or sample.

    A record without an entity is a node of its own and tied by its passage only; a record
    with a null doc_id or block_id has no passage. Records with a null sample_id are left out.
    """
    own = F.concat(F.lit(NO_ENTITY), F.col("sample_id"))
    rec = df.where(F.col("sample_id").isNotNull()).select(
        "sample_id",
        F.coalesce(entity_key(F.col("canonical_entity"), F.col("final_type")), own).alias("node"),
        F.concat(F.lit("p"), F.col("doc_id").cast("string"), F.lit(":"), F.col("block_id").cast("string")).alias("passage"),
    )
    ties = F.explode(F.filter(F.array("passage", F.concat(F.lit("s"), "sample_id")), lambda t: t.isNotNull()))
    return rec.select("sample_id", "node", ties.alias("tie")).distinct()


def _edges(ties: DataFrame) -> DataFrame:
    pairs = ties.select("tie", "node").distinct()
    low = pairs.groupBy("tie").agg(F.min("node").alias("low"))
    return pairs.join(low, "tie").where(F.col("node") != F.col("low")).select(
        F.col("node").alias("u"), F.col("low").alias("v")).distinct()


def _with_low(rows: DataFrame, low: DataFrame, hot: int) -> DataFrame:
    """``rows`` joined with the one row of ``low`` for their ``u``; the many rows of a hub are spread over salts.

    There can be no more hubs than one for each ``hot`` edges, so their table is small.
    """
    hubs = low.where(F.col("n") > hot).select("u", F.ceil(F.col("n") / hot).cast("int").alias("salts"))
    salted = rows.join(F.broadcast(hubs), "u", "left").withColumn(
        "salt", F.when(F.col("salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("v"), F.col("salts")).cast("int"))).drop("salts")
    each = low.select("u", "m", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / hot).cast("int") - 1)).alias("salt"))
    return salted.join(each, ["u", "salt"]).drop("salt")


def _large_star(e: DataFrame, hot: int) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
    return _with_low(both.where(F.col("v") > F.col("u")), low, hot).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame, hot: int) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    rest = _with_low(e, low, hot).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _settled(e: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none: the edges are stars."""
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out")))).alias("x"))
    return ends.groupBy("x.node").agg(F.sum("x.out").alias("n"), F.min("x.out").alias("low")).where(
        (F.col("n") > 1) | ((F.col("n") > 0) & (F.col("low") == 0))).isEmpty()


def components(edges: DataFrame, hot: int = HOT) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node of its component.

    Each round is written to the shared folder, so lost executors cost one round at most;
    the rounds end when the edges are stars, after a number that grows with the logarithm
    of the longest chain. The result reads a table that :func:`forget` can delete.
    """
    e = cut(edges.where("u > v").unionByName(edges.where("u < v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    while not _settled(e):
        nxt = cut(_small_star(_large_star(e, hot), hot), "edges")
        forget(e)
        e = nxt
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out._presswork_path = e._presswork_path
    return out


def group_keys(df: DataFrame) -> DataFrame:
    """(sample_id, group_key): one row for each distinct sample_id; group_key is its group's smallest entity key.

    A group without any entity is named by its smallest sample_id. Repeated rows and
    repeated sample_ids give one row; an empty table gives none.
    """
    ties = tied_records(df)
    comp = components(_edges(ties))
    node = ties.groupBy("sample_id").agg(F.min("node").alias("node"))
    key = F.coalesce("root", "node")
    out = node.join(comp, "node", "left").select("sample_id", F.ltrim(key, F.lit(NO_ENTITY)).alias("group_key"))
    out._presswork_reads = comp
    return out


def place(sizes: np.ndarray, labels: Sequence[dict[int, float]], want: np.ndarray, want_n: np.ndarray) -> np.ndarray:
    """Split of each component by grouped iterative stratification.

    ``labels`` has each component's labels and their counts; ``want`` (splits x labels) and
    ``want_n`` (splits) are what each split still needs. The label with the fewest
    outstanding records goes first; its components, largest first, each go to the split
    that needs most of it, then most records, then comes first. Both needs shrink.
    """
    out = np.full(len(sizes), -1)
    want, want_n = want.astype(float).copy(), want_n.astype(float).copy()
    order = np.argsort(-np.asarray(sizes), kind="stable")
    left: dict[int, float] = defaultdict(float)
    by_label: dict[int, list[int]] = defaultdict(list)
    for i in order:
        for j, n in labels[i].items():
            if n > 0:
                left[j] += n
                by_label[j].append(i)
    heap = [(n, j) for j, n in left.items()]
    heapq.heapify(heap)

    def put(i: int, s: int) -> None:
        out[i] = s
        want_n[s] -= sizes[i]
        for j, n in labels[i].items():
            want[s, j] -= n
            left[j] -= n
            if left[j] > 0:
                heapq.heappush(heap, (left[j], j))

    while heap:
        n, j = heapq.heappop(heap)
        if n != left[j] or n <= 0:
            continue  # an older entry
        for i in by_label[j]:
            if out[i] < 0:
                put(i, max(range(len(want_n)), key=lambda s: (round(want[s, j], 9), round(want_n[s], 9), -s)))
        left[j] = 0
    for i in order:
        if out[i] < 0:
            put(i, int(np.argmax(want_n)))
    return out


def portion(shares: np.ndarray, before: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Records each split (row) takes of the next ``n`` of every label (column) after ``before``.

    Record r belongs to the split in whose part of [0, 1) the fraction of r times the golden
    ratio lies: a sequence so even that any run of records, and the single records of many
    blocks together, keep the shares.
    """
    edges = np.cumsum(shares, axis=0)[:-1]
    out = np.zeros((len(shares), len(n)))
    for j, (r, k) in enumerate(zip(before, n)):
        if k > 0:
            x = (np.arange(r, r + k) + 0.5) * 0.6180339887498949 % 1.0
            out[:, j] = np.bincount(np.searchsorted(edges[:, j], x, side="right"), minlength=len(shares))
    return out


def assign_splits(
    df: DataFrame,
    label_cols: tuple[str, ...] = ("final_type", "sentiment_label"),
    shares: tuple[tuple[str, float], ...] = (("train", 0.8), ("validation", 0.1), ("test", 0.1)),
    big: int = BIG,
    block: int = BLOCK,
) -> DataFrame:
    """(sample_id, group_key, split) with the shares met as far as whole groups allow.

    Groups with at least 1/``big`` of all records are placed first, on the driver (never
    more than ``big`` groups). The others, which no longer matter one by one, are placed in
    hashed blocks, each block towards its part of what is still needed; parts are counted
    on from block to block, so that a label with less than one record a block reaches every
    split too. Repeated samples count once, with their smallest label; null labels count
    for no label.
    """
    found = group_keys(df)
    keys = cut(found, "groups")
    forget(found._presswork_reads)
    lab = df.where(F.col("sample_id").isNotNull()).groupBy("sample_id").agg(*[F.min(_clean(F.col(c))).alias(c) for c in label_cols])
    rec = keys.join(lab, "sample_id").select(
        "sample_id", "group_key", F.filter(F.array(*[F.concat(F.lit(f"{c}="), F.col(c)) for c in label_cols]), lambda x: x.isNotNull()).alias("ls"))
    per_label = rec.select("group_key", F.explode("ls").alias("label")).groupBy("group_key", "label").agg(F.count(F.lit(1)).alias("n"))
    sizes = rec.groupBy("group_key").agg(F.count(F.lit(1)).alias("size"))
    vec = per_label.groupBy("group_key").agg(F.sort_array(F.collect_list(F.struct("label", "n"))).alias("labels"))  # at most MAX_LABELS long
    comp = cut(sizes.join(vec, "group_key", "left"), "components")
    totals = comp.select(F.explode("labels").alias("x")).groupBy("x.label").agg(F.sum("x.n").alias("n")).orderBy("label").limit(MAX_LABELS + 1).collect()
    if len(totals) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    pos = {r["label"]: i for i, r in enumerate(totals)}
    total = np.array([r["n"] for r in totals], dtype=float)
    n_rec = comp.agg(F.sum("size")).first()[0] or 0
    splits = [s for s, _ in shares]
    p = np.array([x for _, x in shares])
    want, want_n = p[:, None] * total[None, :], p * n_rec
    limit = max(1.0, n_rec / big)

    def counts(labels: Iterable) -> list[dict[int, float]]:
        return [{pos[x["label"]]: x["n"] for x in ls} if ls is not None else {} for ls in labels]

    large = comp.where(F.col("size") >= limit).orderBy(F.desc("size"), "group_key").toPandas()
    own = counts(large["labels"])
    at = place(large["size"].to_numpy(), own, want, want_n)
    for ls, s, n in zip(own, at, large["size"]):
        want_n[s] -= n
        for j, k in ls.items():
            want[s, j] -= k
    spark = df.sparkSession
    head = spark.createDataFrame([(k, splits[s]) for k, s in zip(large["group_key"], at)], "group_key string, split string")
    small = comp.where(F.col("size") < limit)
    n_small = small.count()
    if n_small:
        blocks = max(1, -(-n_small // block))

        def parts(need: np.ndarray) -> np.ndarray:
            need = np.maximum(need, 0.0)
            return np.where(need.sum(axis=0) > 0, need / np.maximum(need.sum(axis=0), 1e-12), p[:, None])

        of_label, of_all = parts(want), parts(want_n[:, None])

        def in_block(g: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("group_key")
            x = counts(g["labels"])
            here, done = np.zeros(len(pos)), np.zeros(len(pos))
            for ls in x:
                for j, n in ls.items():
                    here[j] += n
            at = before["label"].map(pos)
            done[at.dropna().to_numpy(dtype=int)] = before.loc[at.notna(), "before"].to_numpy(dtype=float)
            so_far = before.loc[before["label"] == "", "before"].to_numpy(dtype=float)
            need_n = portion(of_all, so_far, np.array([float(g["size"].sum())]))[:, 0]
            s = place(g["size"].to_numpy(), x, portion(of_label, done, here), need_n)
            return pd.DataFrame({"group_key": g["group_key"], "split": [splits[i] for i in s]})

        small = small.withColumn("b", F.pmod(F.xxhash64("group_key"), F.lit(blocks)))
        # one row a block and label; the empty label stands for all records
        each = small.select("b", F.explode(F.concat(
            F.array(F.struct(F.lit("").alias("label"), F.col("size").alias("n"))), F.coalesce("labels", F.expr("cast(array() as array<struct<label:string,n:bigint>>)")))).alias("x"))
        order = Window.partitionBy("label").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        running = each.groupBy("b", "x.label").agg(F.sum("x.n").alias("n")).select("b", "label", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
        placed = small.groupBy("b").cogroup(running.groupBy("b")).applyInPandas(in_block, "group_key string, split string")
        head = head.unionByName(placed)
    return keys.join(head, "group_key").select("sample_id", "group_key", "split")


def split_audit(splits: DataFrame, samples: DataFrame, shares: tuple[tuple[str, float], ...] = (("train", 0.8), ("validation", 0.1), ("test", 0.1))) -> DataFrame:
    """(measure, value): what must hold of splits of ``samples``.

    Samples missing, samples that stand in the result twice, groups in two splits, and
    splits whose size is off target by more than the largest group; all but the first are 0.
    """
    spark = splits.sparkSession
    named = samples.where(F.col("sample_id").isNotNull()).select("sample_id").distinct()
    n = splits.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    per = splits.groupBy("group_key").agg(F.count(F.lit(1)).alias("n"), F.min("split").alias("a"), F.max("split").alias("b"))
    most, total = per.agg(F.max("n")).scalar(), splits.agg(F.count(F.lit(1))).scalar()
    want = spark.createDataFrame(list(shares), "split string, share double")
    off = want.join(splits.groupBy("split").agg(F.count(F.lit(1)).alias("n")), "split", "left").na.fill(0, ["n"]).where(
        F.abs(F.col("n") - F.col("share") * total) > most + 1)
    count = lambda df, name: df.agg(F.lit(name).alias("measure"), F.count(F.lit(1)).alias("value"))
    out = count(named, "samples")
    for df, name in ((named.join(n, "sample_id", "left_anti"), "missing"), (n.where("n > 1"), "twice"), (per.where("a <> b"), "groups in two splits"), (off, "splits off target")):
        out = out.unionByName(count(df, name))
    return out


def split_report(splits: DataFrame, shares: tuple[tuple[str, float], ...] = (("train", 0.8), ("validation", 0.1), ("test", 0.1))) -> DataFrame:
    """Records, groups and actual share of every split beside its target."""
    spark = splits.sparkSession
    want = spark.createDataFrame(list(shares), "split string, target_share double")
    got = splits.groupBy("split").agg(F.count(F.lit(1)).alias("n_samples"), F.count_distinct("group_key").alias("n_groups"))
    total = got.agg(F.sum("n_samples")).scalar()
    return want.join(got, "split", "left").na.fill(0).select(
        "split", "target_share", "n_samples", "n_groups",
        F.coalesce(F.try_divide(F.col("n_samples"), total), F.lit(0.0)).alias("actual_share"))
