"""Sources and sinks: Parquet, CSV, JSON lines, shards, manifests, cached tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import islice

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(f"none of {paths}")


def shards(spark: SparkSession, folder: str, suffix: str = ".parquet") -> list[str]:
    """Sorted shard paths of a folder."""
    fs, p = _fs(spark, folder)
    return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().endswith(suffix))


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A file, a folder of shards or a glob; only the named columns reach the scan."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_vectors(spark: SparkSession, path: str, column: str, rows: int | None = None, size: int | None = None) -> DataFrame:
    """A table with a vector column; refused if it has another number of rows, or vectors of another length, than named."""
    df = spark.read.parquet(path)
    n, bad = df.agg(F.count(F.lit(1)), F.count_if(F.size(column) != size) if size else F.lit(0)).first()
    if rows is not None and n != rows:
        raise ValueError(f"{path} has {n} rows, not {rows}")
    if bad:
        raise ValueError(f"{bad} vectors of {path} have not {size} numbers")
    return df


def record_batches(df: DataFrame, size: int) -> Iterator[list[Row]]:
    """The rows in lists of at most ``size``, one partition at a time on the driver."""
    rows = df.toLocalIterator(prefetchPartitions=True)
    while batch := list(islice(rows, size)):
        yield batch


def with_columns(spark: SparkSession, paths: list[str], columns: list[str]) -> list[str]:
    """Those of the paths (globs too) that are Parquet tables with all the columns; only schemas are read."""
    out = []
    for p in paths:
        try:
            if set(columns) <= set(spark.read.parquet(p).columns):
                out.append(p)
        except AnalysisException:
            continue
        except Exception as e:  # other formats fail while their footer is read
            if "is not a Parquet file" not in str(e) and "CANNOT_READ_FILE_FOOTER" not in str(e):
                raise
    return out


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: StructType, strict: bool = False) -> DataFrame:
    """JSON lines. Tolerant: blank and broken lines vanish. Strict: the first broken line fails the read."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    wide = StructType([*schema.fields, StructField("_bad", StringType())])
    # parsed from text lines: pruned to no column, a JSON scan would count broken lines too
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where(F.col("r._bad").isNull()).select(*[F.col("r").getField(f.name).alias(f.name) for f in schema.fields])


def read_json_document(spark: SparkSession, path: str) -> dict:
    """A small configuration or report file."""
    fs, p = _fs(spark, path)
    if fs.getFileStatus(p).getLen() > 64 << 20:
        raise ValueError("a JSON document of more than 64 MB is data; read it as JSON lines")
    return json.loads("".join(r["value"] for r in spark.read.option("wholetext", True).text(path).toLocalIterator()))


def done_keys(spark: SparkSession, path: str, schema: StructType, keys: list[str]) -> DataFrame:
    """Keys already in a log; an absent log has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], StructType([f for f in schema.fields if f.name in keys]))
    return read_json_lines(spark, path, schema).select(*keys).distinct()


def write_shards(df: DataFrame, path: str, rows_per_file: int = 200_000, mode: str = "overwrite") -> None:
    """Parquet in zstd, no file with more than the given rows."""
    df.write.mode(mode).option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One headed CSV part; for result tables that fit a task."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_json_report(df: DataFrame, path: str) -> dict:
    """A one-row table as a JSON document."""
    rows = df.limit(2).toJSON().collect()
    if len(rows) != 1:
        raise ValueError("a report has exactly one row")
    df.sparkSession.createDataFrame([(rows[0],)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return json.loads(rows[0])


def append_missing(df: DataFrame, path: str, keys: list[str]) -> int:
    """Appends only rows whose keys the table lacks; running it twice changes nothing. Returns the rows added."""
    spark = df.sparkSession
    new = df.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti") if exists(spark, path) else df
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def compact_log(spark: SparkSession, path: str, schema: StructType, keys: list[str], sequence: str, target: str) -> DataFrame:
    """A log of JSON lines to Parquet, the last row a key wins."""
    w = Window.partitionBy(*keys).orderBy(F.col(sequence).desc_nulls_last())
    out = read_json_lines(spark, path, schema).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    out.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Finished versions of a manifest, oldest first: a version counts once its ``_SUCCESS`` mark is written."""
    if not exists(spark, path):
        return []
    fs, p = _fs(spark, path)
    found = sorted(s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().startswith("v-"))
    return [v for v in found if exists(spark, v + "/_SUCCESS")]


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The newest finished version of a manifest."""
    done = _versions(spark, path)
    if not done:
        raise FileNotFoundError(path)
    return spark.read.parquet(done[-1])


def manifest_upsert(spark: SparkSession, path: str, entries: DataFrame, keys: list[str], keep: int = 2) -> DataFrame:
    """Replaces the manifest rows of the given keys in a new version.

    Readers see the old version until the new one is finished, so a crash at any point
    leaves a whole manifest; the ``keep`` newest versions stay. One writer at a time.
    """
    done = _versions(spark, path)
    if done:
        old = spark.read.parquet(done[-1])
        entries = old.join(entries.select(*keys), keys, "left_anti").unionByName(entries)
    n = int(done[-1].rsplit("v-", 1)[1]) + 1 if done else 0
    entries.coalesce(1).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{path}/v-{n:012d}")
    for v in done[:len(done) + 1 - keep]:
        fs, p = _fs(spark, v)
        fs.delete(p, True)
    return read_manifest(spark, path)


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame], reuse: bool = True, columns: list[str] | None = None) -> DataFrame:
    """The stored table if it is there and has the columns, else the built one, stored."""
    if reuse and exists(spark, path + "/_SUCCESS"):
        df = spark.read.parquet(path)
        if not columns or set(columns) <= set(df.columns):
            return df
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def bullets(df: DataFrame, template: str, n: int = 50) -> str:
    """At most ``n`` rows as Markdown bullets."""
    return "\n".join("- " + template.format(**r.asDict()) for r in df.limit(n).toLocalIterator())
