"""Articles to blocks to sentences and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.functions import fixed
from presswork.functions.text import length_bucket, squeeze, suspect, text
from presswork.session import spread


def blocks_array(c: Column, least: int = fixed.BLOCK_MIN_CHARS, most: int | None = fixed.BLOCKS_PER_DOC) -> Column:
    """Paragraph blocks of a text: split at blank lines or, where that gives two or fewer, at every line end.

    ``most`` blocks are kept, the pipeline's limit; None keeps all.
    """
    t = F.btrim(F.regexp_replace(text(c), "\r\n?", "\n"), F.lit(" \t\n\r\f"))
    full = lambda a: F.filter(a, lambda x: F.btrim(x, F.lit(" \t\n\r\f")) != "")
    by_blank = full(F.split(t, r"\n[ \t\r\f\x0b]*\n"))
    # bound once by the outer transform, so the text is split at blank lines a single time
    parts = F.transform(F.array(by_blank), lambda b: F.when(F.size(b) <= 2, full(F.split(t, "\n"))).otherwise(b))[0]
    kept = F.filter(F.transform(parts, squeeze), lambda x: F.length(x) >= least)
    return kept if most is None else F.slice(kept, 1, most)


def blocks(docs: DataFrame, body: str = "text", most: int | None = fixed.BLOCKS_PER_DOC) -> DataFrame:
    """One row a block: ``block_id`` numbers the kept blocks from 0, ``block_uid`` is ``doc:block``."""
    keep = [c for c in docs.columns if c not in (body, "block_id", "block_uid", "block_text", "block_len")]
    out = spread(docs).select(*keep, F.posexplode(blocks_array(F.col(body), most=most)).alias("block_id", "block_text"))
    return out.select(
        *keep, F.col("block_id").cast("long").alias("block_id"),
        F.concat_ws(":", "doc_id", "block_id").alias("block_uid"), "block_text",
        F.length("block_text").cast("long").alias("block_len"))


def sentences(blocks_df: DataFrame, body: str = "block_text", most: int | None = fixed.SENTENCE_CHARS[1],
              a_block: int | None = fixed.SENTENCES_PER_BLOCK) -> DataFrame:
    """Sentences of blocks. ``sent_id`` is the place before short ones drop, so gaps are normal.

    A sentence keeps ``most`` characters and a block ``a_block`` sentences, the pipeline's
    limits; None keeps all.
    """
    least = fixed.SENTENCE_CHARS[0]
    parts = F.split(F.regexp_replace(text(F.col(body)), r"([.!?])\s+", "$1\u0001"), "\u0001")
    cut = F.transform(parts, lambda x, i: F.struct(i.cast("long").alias("sent_id"), F.trim(x).alias("t")))
    kept = F.filter(cut, lambda s: F.length(s["t"]) >= least)
    kept = kept if a_block is None else F.slice(kept, 1, a_block)
    keep = [c for c in blocks_df.columns if c != body]
    out = blocks_df.select(*keep, F.explode(kept).alias("s"))
    t = F.col("s.t") if most is None else F.left(F.col("s.t"), F.lit(most))
    return out.select(
        *keep, F.col("s.sent_id").alias("sent_id"), F.concat_ws(":", "block_uid", "s.sent_id").alias("sent_uid"),
        t.alias("sentence_text"), F.length(t).cast("long").alias("sent_len"), length_bucket(F.length(t)).alias("sent_len_bucket"),
        suspect(t).alias("suspect_flag"))


def ordered_concat(df: DataFrame, keys: list[str], order: list[str], body: str, mark: str, *aggs: Column) -> DataFrame:
    """Texts of a group in order, blank ones skipped, joined by ``mark`` as ``joined``; groups may have null keys.

    A group is one block or document, so its size is that of a document.
    """
    item = F.struct(*order, F.trim(text(F.col(body))).alias("_t"))
    parts = F.filter(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["_t"]), lambda x: x != "")
    return df.groupBy(*keys).agg(F.array_join(parts, mark).alias("joined"), *aggs)
