"""Bibliography files as DataFrames, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia import runtime
from marginalia.core import library as _library

_DECODED = T.StructType().add("text", T.StringType()).add("diagnostics", T.ArrayType(T.StringType()))


def read_bibliography(spark: SparkSession, path: str) -> DataFrame:
    """path, format, bibtex and diagnostics of ``.bib``, ``.yaml`` and ``.yml`` files."""
    runtime.ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    decoded = files.select("path", suffix.alias("format"), F.udf(_library.decode, _DECODED, useArrow=True)("content").alias("d"))
    known = F.when(F.col("format").isin("bib", "yaml", "yml"), F.col("format")).otherwise(F.raise_error(F.concat(F.lit("unsupported bibliography extension "), F.col("format"))))
    return decoded.select("path", known.alias("format"), F.col("d.text").alias("bibtex"), F.col("d.diagnostics").alias("diagnostics"))


#: Sources in one file at most: a reader holds a file and its parsed entries in memory at once.
SOURCES_PER_FILE = 5_000


def write_bibliography(df: DataFrame, folder: str, source: str = "bibtex", *, extension: str | None = None, per_file: int = SOURCES_PER_FILE) -> None:
    """The sources as text files below ``folder``; with an ``extension`` such that :func:`read_bibliography` knows them.

    A file holds sources of one partition, one below the other, ``per_file`` at most.
    """
    writer = df.select(F.col(source).alias("value")).write.mode("errorifexists").option("maxRecordsPerFile", per_file)
    if extension is None:
        writer.text(folder)
        return
    writer.text(folder)
    # Spark's part files end in .txt: each gets the extension by a rename in the store.
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in store.listStatus(path(folder)):
        name = status.getPath().getName()
        if name.startswith("part-"):
            store.rename(status.getPath(), path(folder, f"{name.rsplit('.', 1)[0]}.{extension}"))
        else:
            store.delete(status.getPath(), False)
