"""Session helpers shared by every operator: settings, lineage cuts and fan-out."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "presswork", cores: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` as the cluster names it.

    Where the session names none, a temporary folder serves sessions whose executors are
    this very process (``local``); on a cluster its absence is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = getattr(spark, "_presswork_shared", None)
        if not named:
            folder = tempfile.mkdtemp(prefix="presswork-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            named = spark._presswork_shared = "file://" + folder
    return named.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jp = spark._jvm.org.apache.hadoop.fs.Path(path)
    jp.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jp, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the virtual machine may be gone already
        pass


def own_dir(spark: SparkSession) -> str:
    """This application's folder for intermediate tables; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/presswork/{spark.sparkContext.applicationId}"
    sc = spark.sparkContext
    if getattr(sc, "_presswork_dir", None) != path:
        atexit.register(_delete_at_exit, spark, path)
        sc._presswork_dir = path
    return path


def cut(df: DataFrame, what: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    The copy is plain Parquet on storage every executor reaches, so the loss of an
    executor costs nothing, and later joins see its true size. :func:`forget` deletes it
    as soon as nothing reads it; what a returned frame still reads goes with the application.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._presswork_path = path
    return out


def forget(df: DataFrame | None) -> None:
    """Delete the table behind a frame made by :func:`cut`, once nothing reads it."""
    path = getattr(df, "_presswork_path", None)
    if path:
        _delete(df.sparkSession, path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give Python-heavy work at least one partition a core when the scan has fewer.

    Large inputs already come in many splits and are left alone (no shuffle).
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df  # already shuffled; asking it for partitions would run those stages
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *[F.col(k) for k in keys]) if keys else df.repartition(want)


def fan_out(df: DataFrame, *keys: str) -> DataFrame:
    """Spread few bytes that cost much Python time over all cores.

    The fixed number keeps adaptive execution from joining the partitions by their size.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *[F.col(k) for k in keys])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per context, however the driver came to import it."""
    sc = spark.sparkContext
    if getattr(sc, "_presswork_shipped", False):
        return
    home = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="presswork-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "presswork.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(home.rglob("*")):
            if f.is_file() and "__pycache__" not in f.parts:
                z.write(f, f.relative_to(home.parent))
    sc.addPyFile(str(target))  # copied to every executor by Spark itself
    sc._presswork_shipped = True
