"""What every operator needs from the session: tables, shared storage and shipped code."""

from __future__ import annotations

import io
import os
import sys
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent
#: Used only where the cluster names no folder of its own, as in tests.
DEFAULT_SHARED = "file:///tmp/checkpoints/marginalia"
#: Rows of one task where each costs Python time; a task takes well under a minute.
ROWS_PER_TASK = 25_000


def tasks_for(spark: SparkSession, rows: int, *, rows_per_task: int = ROWS_PER_TASK) -> int:
    """How many tasks ``rows`` are dealt to: as many as there are cores, or more where a task would get too many rows."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // rows_per_task), 1)


def table(spark: SparkSession, sf_dir: str, name: str, *, spread: bool = False, by: str | None = None) -> DataFrame:
    """One of the tables in ``sf_dir``, read through Spark whatever the store.

    ``spread`` deals its rows out evenly, ``by`` so that equal values of a column
    share a task; either way in tasks of :data:`ROWS_PER_TASK` rows.  How many
    splits a file gives says nothing of that: a split without the middle of a row
    group is empty, so one large row group is one task whatever its size.  The
    rows of each split are counted from the footers.  Where splits are as many as
    the cores and none is too large, ``spread`` leaves rows where they lie, as a
    shuffle would hold them all on disk once more.  It changes where rows lie,
    never which there are.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if not spread and by is None:
        return df
    held = [row["count"] for row in df.groupBy(F.spark_partition_id()).count().collect()]
    if by is None and len(held) >= spark.sparkContext.defaultParallelism and max(held) <= ROWS_PER_TASK:
        return df
    return df.repartition(tasks_for(spark, sum(held)), *([by] if by else []))


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process (or one machine's test cluster in one JVM)."""
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, as ``spark.checkpoint.dir`` names it.

    Only a local session may do without: on a cluster no folder of one machine will do.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or DEFAULT_SHARED).rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(target.getParent())
    files.deleteOnExit(target)
    return path


def release(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; frames that read them are done with."""
    forget(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")


def forget(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that no later read needs."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and reread it; ``options`` are those of the Parquet writer.

    Cuts the lineage with a table that outlives any executor; the reread frame
    has the same schema, and counting it costs only file footers.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.options(**options).parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held._scratch = path
    return held


def drop(*tables: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for these frames, once nothing reads them any more."""
    for df in tables:
        forget(df.sparkSession, df._scratch)


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, whoever asks for it first.

    A local session's workers inherit a PYTHONPATH that names its folder and
    nothing is sent; otherwise a zip goes out once per application, as folders
    of the driver need not exist elsewhere.
    """
    root = str(PACKAGE.parent)
    if is_local(spark) and root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    context = spark.sparkContext
    if getattr(context, "_marginalia_shipped", False):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(PACKAGE.rglob("*")):
            if path.is_file() and "__pycache__" not in path.parts:
                archive.write(path, str(path.relative_to(PACKAGE.parent)))
    local = Path(os.environ.get("TMPDIR", "/tmp")) / f"marginalia-{uuid.uuid4().hex}.zip"
    local.write_bytes(data.getvalue())
    context.addPyFile(str(local))
    sys.path[:] = [p for p in sys.path if not p.endswith(local.name)]
    context._marginalia_shipped = True
