"""Combining sources to target weights by balanced sampling.

Each listed source of a mix contributes ``target_share`` of the token budget. A source is
repeated as often as needed, up to its cap; the fractional part of the repetition is an
inclusion probability, and the documents that get the extra copy are drawn by the cube
method: the probabilities move through the null space of the balance constraints (documents
and tokens) until at most a few units of a block are undecided. Blocks are merged level by
level; only the last handful of a source lands by a plain draw.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.session import cut, spread

#: Vocabulary of the default tokenizer; its path is a parameter of every function that counts.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that tokenizer splits text before merging (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Largest vocabulary file sent to the tasks.
MAX_VOCABULARY = 64_000_000
#: Mix rows shipped to the driver; more is refused.
MAX_MIX_ROWS = 200_000
#: Documents one task's flight may hold.
BLOCK = 20_000


def _encoding(path: str):
    if not os.path.exists(path):
        raise FileNotFoundError(f"tokenizer vocabulary {path}")
    if os.path.getsize(path) > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary of more than {MAX_VOCABULARY} bytes")
    with open(path, "rb") as f:
        return _of_ranks(f.read())


@lru_cache(maxsize=2)
def _of_ranks(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of every row as delivered; a null text has no tokens.

    The vocabulary file need only be on the driver, which sends it (at most
    ``MAX_VOCABULARY`` bytes) to the tasks.
    """
    _encoding(vocabulary)  # refuses a missing or too large file
    with open(vocabulary, "rb") as f:
        shipped = documents.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _of_ranks(shipped.value)
        for b in batches:
            b["tokens"] = [len(enc.encode_ordinary(t)) if t else 0 for t in b["text"]]
            yield b[["doc_id", "source", "tokens"]]

    return spread(documents.select("doc_id", "source", "text")).mapInPandas(count, "doc_id long, source string, tokens long")


def mix_table(counts: DataFrame, mixes: DataFrame) -> DataFrame:
    """Per mix and source: tokens wanted, tokens at hand, whole copies and the fraction above them.

    A repeated (mix, source) adds up its shares and keeps the larger cap. A source without
    tokens can reach nothing; rows with a null key, share or ratio are left out and a null
    cap is 0. The table has at most as many rows as ``mixes``.
    """
    total = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0))).scalar()
    per = counts.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    named = mixes.where("mix_id is not null and source is not null and target_share is not null and budget_ratio is not null")
    want = named.groupBy("mix_id", "source").agg(
        F.sum("target_share").alias("target_share"), F.max("budget_ratio").alias("budget_ratio"),
        F.greatest(F.coalesce(F.max("max_repeats"), F.lit(0)), F.lit(0)).alias("max_repeats"))
    t = want.join(per, "source", "left").na.fill(0, ["tokens", "docs"])
    target = F.col("target_share") * F.col("budget_ratio") * total
    reach = F.least(target, F.col("max_repeats") * F.col("tokens"))
    copies = F.coalesce(F.try_divide(reach, F.col("tokens")), F.lit(0.0))
    return t.select(
        "mix_id", "source", "target_share", "max_repeats", "tokens", "docs", target.alias("target_tokens"),
        (F.col("max_repeats") * F.col("tokens")).alias("reachable_tokens"),
        F.floor(copies).alias("whole"), (copies - F.floor(copies)).alias("frac"))


def flight(p: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Flight phase of the cube method for two constraints: sum of p and of p times tokens stay.

    Three undecided units at a time move along the null space of their constraints until
    one of them is decided; at most two units are left.
    """
    p = p.astype(float).copy()
    p[p < 1e-9], p[p > 1 - 1e-9] = 0.0, 1.0
    todo = list(np.flatnonzero((p > 0) & (p < 1))[::-1])
    rng = np.random.default_rng(len(p) * 1_000_003 + int(tokens.sum()) % 1_000_003)
    coin = rng.random(2 * len(todo) + 8)
    held: list[int] = []
    n = 0
    while True:
        while len(held) < 3 and todo:
            held.append(todo.pop())
        if len(held) < 3:
            if len(held) == 2 and tokens[held[0]] == tokens[held[1]]:
                u = (1.0, -1.0)
            else:
                return p
        else:
            a, b, c = (float(tokens[k]) for k in held)
            u = (c - b, a - c, b - a)
            if a == b == c:
                u = (1.0, -1.0, 0.0)
        up = min((1 - p[k]) / v if v > 0 else p[k] / -v for k, v in zip(held, u) if v)
        down = min(p[k] / v if v > 0 else (1 - p[k]) / -v for k, v in zip(held, u) if v)
        step = up if coin[n] < down / (up + down) else -down
        n += 1
        keep = []
        for k, v in zip(held, u):
            x = p[k] + step * v
            p[k] = 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x
            if 0 < p[k] < 1:
                keep.append(k)
        held = keep


def landing(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The last undecided units: duel of two keeping the document total, then a plain draw."""
    p = p.copy()
    rest = list(np.flatnonzero((p > 0) & (p < 1)))
    while rest:
        i = rest.pop()
        if not rest:
            p[i] = float(u[i] < p[i])
            break
        j = rest[-1]
        s = p[i] + p[j]
        if s <= 1:
            win, lose = (i, j) if u[i] * s < p[i] else (j, i)
            p[win], p[lose] = s, 0.0
        else:
            win, lose = (i, j) if u[i] * (2 - s) < 1 - p[j] else (j, i)
            p[win], p[lose] = 1.0, s - 1
        rest[-1:] = [k for k in (i, j) if 1e-9 < p[k] < 1 - 1e-9]
        for k in (i, j):
            if k not in rest:
                p[k] = round(p[k])
    return p


def mix(counts: DataFrame, mixes: DataFrame, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """(mix_id, doc_id, source, tokens, copies) of every document used at least once.

    Whole copies need no draw; the fractional copy is drawn in flights over blocks of about
    ``block`` documents of one mix and source, so a source that holds most documents is
    spread over many tasks. Null sources belong to no mix, documents without tokens carry
    no weight but may be drawn, empty tables give no rows.
    """
    rows = mix_table(counts, mixes).collect() if mixes.count() <= MAX_MIX_ROWS else None
    if rows is None:
        raise ValueError(f"more than {MAX_MIX_ROWS} mix rows")
    spark = counts.sparkSession
    small = [(r["mix_id"], r["source"], int(r["whole"]), float(r["frac"]), max(1, math.ceil(r["docs"] / block)))
             for r in rows if r["docs"]]
    plan = F.broadcast(spark.createDataFrame(small, "mix_id long, source string, whole long, frac double, blocks long"))
    units = counts.join(plan, "source").withColumn("frac", F.when(F.col("frac") > 1e-9, F.col("frac")).otherwise(0.0))
    whole = units.where(F.col("frac") == 0).select("mix_id", "doc_id", "source", "tokens", F.col("whole").alias("copies"))
    todo = units.where(F.col("frac") > 0).select(
        "mix_id", "doc_id", "source", "tokens", "whole", F.col("frac").alias("p"),
        (F.pmod(F.xxhash64(F.lit(seed), "mix_id", "doc_id"), F.lit(1 << 40)) / float(1 << 40)).alias("u"), "blocks",
        F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.col("blocks")).alias("block"))

    def fly(last: bool):
        def go(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values(["u", "doc_id"], kind="stable")
            p = flight(g["p"].to_numpy(), g["tokens"].to_numpy())
            g["p"] = landing(p, g["u"].to_numpy()) if last else p
            return g

        return go

    left = max([b for *_, b in small], default=1)
    done = []
    while True:
        out = todo.groupBy("mix_id", "source", "block").applyInPandas(fly(left == 1), todo.schema)
        if left == 1:
            done.append(out)
            break
        out = cut(out, "flight")
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(out.where(~open_))
        left = math.ceil(2 * left / block)
        todo = out.where(open_).withColumn("block", F.pmod(F.xxhash64(F.lit(seed + left), "doc_id"), F.lit(left)).cast("long"))
    res = whole
    for d in done:
        res = res.unionByName(d.select("mix_id", "doc_id", "source", "tokens", (F.col("whole") + F.col("p").cast("long")).alias("copies")))
    return res.where(F.col("copies") > 0)


def mix_report(counts: DataFrame, mixes: DataFrame, seed: int = 42) -> DataFrame:
    """Per mix and source: target, reachable and drawn tokens, actual share of the mix, shortfall.

    A source is short if every one of its documents was drawn as often as allowed and the
    drawn tokens still lie below the target.
    """
    used = mix(counts, mixes, seed).groupBy("mix_id", "source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("drawn_tokens"), F.count(F.lit(1)).alias("docs_used"),
        F.sum("copies").alias("copies_used"))
    out = mix_table(counts, mixes).join(used, ["mix_id", "source"], "left").na.fill(0, ["drawn_tokens", "docs_used", "copies_used"])
    total = out.groupBy("mix_id").agg(F.sum("drawn_tokens").alias("_all"))
    drawn = F.col("drawn_tokens")
    return out.join(F.broadcast(total), "mix_id").select(
        "mix_id", "source", "target_share", "target_tokens", "reachable_tokens", "drawn_tokens", "docs_used", "copies_used",
        F.coalesce(F.try_divide("drawn_tokens", "_all"), F.lit(0.0)).alias("actual_share"),
        ((drawn >= F.col("reachable_tokens")) & (drawn < F.col("target_tokens"))).alias("short"))


def mix_audit(counts: DataFrame, mixes: DataFrame, seed: int = 42) -> DataFrame:
    """Per mix: documents used beyond their cap, documents listed twice, and sources off what they can reach.

    A source is off by more than the landing explains if its drawn tokens differ from the
    smaller of target and reach by more than two of its longest documents.
    """
    drawn = mix(counts, mixes, seed)
    table = mix_table(counts, mixes)
    each = drawn.join(table.select("mix_id", "source", "max_repeats"), ["mix_id", "source"]).groupBy("mix_id", "source", "doc_id").agg(
        F.sum("copies").alias("copies"), F.max("max_repeats").alias("cap"), F.count(F.lit(1)).alias("n"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    per = each.groupBy("mix_id", "source").agg(
        F.count_if(F.col("copies") > F.col("cap")).alias("over_cap"), F.count_if(F.col("n") > 1).alias("listed_twice"), F.sum("tokens").alias("drawn"))
    longest = counts.groupBy("source").agg(F.max("tokens").alias("longest"))
    due = F.least("target_tokens", "reachable_tokens")
    return table.join(per, ["mix_id", "source"], "left").join(longest, "source", "left").na.fill(0, ["over_cap", "listed_twice", "drawn", "longest"]).groupBy("mix_id").agg(
        F.sum("over_cap").alias("over_cap"), F.sum("listed_twice").alias("listed_twice"),
        F.count_if(F.abs(F.col("drawn") - due) > 2 * F.col("longest") + 1).alias("sources_off"))
