"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two aggregations and two joins; what it keeps is one edge per
linked node at most, written to the shared folder so that the lineage stays
short and an executor can be lost at any time.  Nothing is collected but a
count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia import runtime


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point neighbours at the smallest node around: the larger ones, or the node and its smaller ones."""
    around = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    if large:
        joined = around.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        joined = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return joined.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """``(a, b)`` pairs of long node ids to ``(node, root)`` for every linked node but the roots."""
    spark = edges.sparkSession
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    path = runtime.scratch(spark, "edges")
    now.write.parquet(path)
    sign = None
    for _ in range(most_rounds):
        held = spark.read.schema("a bigint, b bigint").parquet(path)
        told = held.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(told) == sign or not told[0]:
            return held.select(F.col("a").alias("node"), F.col("b").alias("root"))
        sign = tuple(told)
        following = runtime.scratch(spark, "edges")
        _star(_star(held, large=True), large=False).write.parquet(following)
        runtime.forget(spark, path)
        path = following
    raise RuntimeError("components did not settle")
