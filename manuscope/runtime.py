"""Session helpers shared by all operators: lineage cuts, size-checked broadcasts, output schemas."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes as Spark estimates them from its files, that is ever broadcast.
BROADCAST_BYTES = 16 << 20

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` if the session names one.

    Only where the setting is absent and all tasks run in one process (tests, a laptop) a temporary folder is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext._jsc.sc().isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="manuscope-")
        _made.append(named)
        spark.sparkContext.setCheckpointDir(named)
        return named
    return named


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back.

    This ends the lineage in files that outlive any executor; columns stay prunable and the
    optimizer learns the true size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_bytes(df: DataFrame) -> int:
    """Size of a table as the optimizer knows it (exact for a table made by :func:`cut`)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Adds a broadcast hint if the table's known size is within ``limit``, else leaves the join to Spark."""
    return F.broadcast(df) if stored_bytes(df) <= limit else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan of few small files, dealt to all cores; one with enough tasks as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan._jdf.queryExecution().toRdd().getNumPartitions() < cores else scan


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def forget(spark: SparkSession) -> None:
    """Deletes what :func:`cut` wrote in this session, wherever it lies; call it once results are written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        at = jvm.org.apache.hadoop.fs.Path(_made.pop())
        at.getFileSystem(conf).delete(at, True)


def _clean() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        try:
            return forget(spark)
        except Exception:  # the JVM may be gone by now
            pass
    for path in _made:
        local = urlparse(path)
        if local.scheme in ("", "file") and os.path.isdir(local.path):
            shutil.rmtree(local.path, ignore_errors=True)


atexit.register(_clean)
