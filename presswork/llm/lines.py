"""Lines one site repeats over many of its documents.

Every line's documents are kept as a compressed bitmap: only the 64-bit words that hold a
bit are stored, as rows (site, line, word number, bits). Rows are numbered within a task
in the order of their site, so that a site's documents lie side by side: words fill, and
most of the work on a bitmap is done before anything is shuffled. Variant spellings of a
line are united by OR-ing their words, cardinalities are exact bit counts, and a document's
line is removed when the bitmap of its site and line has the document's bit. All of it is
JVM-side hash aggregation; the hottest line of the hottest site is spread over its words,
so no task ever gathers the documents of a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.session import cut, spread

#: Characters without width that a line may carry unseen, as a Java pattern (fixed values).
#: The look-ahead turns plain text away before the class is searched.
INVISIBLE = r"(?![ -~\n])[\u00ad\u180e\u200b-\u200f\u2060\ufeff]"
#: White space other than the plain space and the line end, no-break kinds included (fixed values).
ODD_SPACE = r"\t\x0b-\r\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def site_of(url: Column) -> Column:
    """Host of an http(s) url in lower case without one leading ``www.``; null if there is none."""
    host = F.lower(F.regexp_extract(F.trim(url), r"(?i)^https?://(?:[^/?#@\s]*@)?([^/?#:@\s]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def line_keys(text: Column) -> Column:
    """The keys of a text's lines in order: case, spacing, invisible characters and digits apart.

    The text is normalised as a whole, then split: few long regex runs instead of many short ones.
    """
    t = F.regexp_replace(F.lower(text), INVISIBLE, "")
    t = F.regexp_replace(t, f"(?![!-~\\n])(?: [ {ODD_SPACE}]+|[{ODD_SPACE}][ {ODD_SPACE}]*)", " ")
    t = F.regexp_replace(F.replace(t, F.lit("\u00df"), F.lit("ss")), "[0-9]+", "0")
    return F.split(t, "\n")


def _hash2(c: Column, name: str) -> list[Column]:
    """128 bits in two columns; enough that two lines never share them."""
    return [F.xxhash64(c).alias(f"{name}1"), F.xxhash64(F.lit("line"), c).alias(f"{name}2")]


def site_rows(news: DataFrame) -> DataFrame:
    """Rows of each site, empty texts included."""
    return news.select(site_of(F.col("url")).alias("site")).where(F.col("site").isNotNull()).groupBy("site").agg(
        F.count(F.lit(1)).alias("rows"))


def lines_of(news: DataFrame) -> DataFrame:
    """Non-blank lines of texts with a site: doc_id, line_no, site, hashes, word and bit.

    Rows with a null text, url or doc_id have no lines here. A row's number holds for one
    run only, so the result must be written (:func:`cut`) before it is used twice.
    """
    src = news.select(F.col("doc_id").cast("long").alias("doc_id"), site_of(F.col("url")).alias("site"), "text").where(
        F.col("site").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    numbered = spread(src).sortWithinPartitions("site", "doc_id").withColumn("row", F.monotonically_increasing_id())
    pairs = F.arrays_zip(line_keys(F.col("text")).alias("key"),
                         F.transform(F.split("text", "\n"), lambda x: F.xxhash64(x)).alias("variant"))
    each = numbered.select("doc_id", "site", "row", F.posexplode(pairs).alias("line_no", "l")).where(F.col("l.key").rlike("[^ ]"))
    return each.select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"), "site",
        *_hash2(F.trim("l.key"), "k"), F.col("l.variant").alias("variant"),
        F.shiftright("row", 6).alias("word"),
        F.expr("shiftleft(1L, cast(row & 63 as int))").alias("bit"))


def line_bitmaps(lines: DataFrame) -> DataFrame:
    """Bitmap words of every line of every site, variants united.

    The variants' own bitmaps are built first, mostly inside the task that numbered the
    documents, and then OR-ed.
    """
    keys = ["site", "k1", "k2", "word"]
    variants = lines.groupBy(*keys, "variant").agg(F.bit_or("bit").alias("bits"))
    return variants.groupBy(*keys).agg(F.bit_or("bits").alias("bits"), F.count(F.lit(1)).alias("n_variants"))


def repeated(news: DataFrame, min_docs: int = 5, min_share: float = 0.05) -> DataFrame:
    """Lines of a site that at least ``min_docs`` and ``min_share`` of its rows carry."""
    return _repeated(line_bitmaps(cut(lines_of(news), "lines")), news, min_docs, min_share)


def _repeated(maps: DataFrame, news: DataFrame, min_docs: int, min_share: float) -> DataFrame:
    cards = maps.groupBy("site", "k1", "k2").agg(F.sum(F.bit_count("bits").cast("long")).alias("docs")).where(
        F.col("docs") >= min_docs)
    return cards.join(site_rows(news), "site").where(F.col("docs") >= F.col("rows") * min_share)


def boilerplate_lines(news: DataFrame, min_docs: int = 5, min_share: float = 0.05) -> DataFrame:
    """(doc_id, line_no) of every repeated line, found by looking its document up in the bitmap.

    Ties at a threshold count as repeated. Empty tables give no rows; a document that
    carries a line twice counts once and loses both.
    """
    lines = cut(lines_of(news), "lines")  # 128-bit line hashes, no text
    maps = cut(line_bitmaps(lines), "bitmaps")  # counted and looked up
    keep = _repeated(maps, news, min_docs, min_share).select("site", "k1", "k2")
    hit = maps.join(keep, ["site", "k1", "k2"], "left_semi").select("site", "k1", "k2", "word", "bits")
    return (
        lines.join(hit, ["site", "k1", "k2", "word"])
        .where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
        .select("doc_id", "line_no")
    )


def clean_texts(news: DataFrame, min_docs: int = 5, min_share: float = 0.05) -> DataFrame:
    """Every row with its text less the repeated lines, and how many were taken out.

    Rows without a site or text pass unchanged; a null text stays null.
    """
    gone = boilerplate_lines(news, min_docs, min_share).groupBy("doc_id").agg(F.collect_set("line_no").alias("_gone"))
    out = news.select("doc_id", "text").join(gone, "doc_id", "left")
    kept = F.expr("array_join(filter(split(text, '\n'), (x, i) -> not array_contains(_gone, cast(i as bigint))), '\n')")
    return out.select(
        "doc_id", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.coalesce(F.size("_gone"), F.lit(0)).alias("n_removed"))
