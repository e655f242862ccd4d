"""Session helpers: shared scratch folder, durable tables and checked broadcasts."""
from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its row count was measured and lies below this.
BROADCAST_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only in a session of one machine that names none, as in tests, is a local
    temporary folder chosen instead; on a cluster that is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        else:
            folder = tempfile.mkdtemp(prefix="isomere-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            base = "file://" + folder
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def durable(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back.

    Cuts lineage like a checkpoint, but columnar and compressed; the files
    outlive any executor. ``release`` removes them, and so does the end of the
    application.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/isomere/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._isomere_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes the files of a table made by ``durable``; other tables are left alone."""
    path = getattr(df, "_isomere_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marks ``df`` for broadcast if it has at most ``limit`` rows; ``df`` must be cheap to count."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def plan_bytes(df: DataFrame) -> int:
    """Spark's estimate of the size of ``df``, from the sizes of the files that it reads; no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_isomere_shipped", False):
        return
    top = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="isomere-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    to = Path(folder) / "isomere_package.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f"{top.name}/{f.relative_to(top)}")
    sc.addPyFile(str(to))
    sc._isomere_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows anew if the scan has fewer tasks than there are cores, as with one small file; else leaves ``df`` alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
