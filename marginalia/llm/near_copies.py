"""SimHash near-dedup of texts by exact Jaccard similarity, for the pipeline.

Two texts are linked if their sets of five-word shingles have a Jaccard
similarity of 4/5 at least; every such pair ends in one component.  Equal texts
are one node, aggregated before anything is shuffled, and its row goes to a table
bucketed by node: texts move once, and later joins bring node ids to them.  Two
steps make the links:

1. SimHash fingerprints of the same shingles and their pigeonring candidates
   (:mod:`marginalia.llm.simhash`) give pairs of nodes, each verified on the
   whole sets.  This settles most copies, and large groups of them cheaply.
2. Similarity 4/5 reaches further than any radius for which fingerprints can be
   searched, so nodes that are still in different components go through a join
   that misses none.  Prefix filter: in any one order of all shingles, two sets
   of which 4/5 agree share one of each set's first ``n - ceil(4 n / 5) + 1``, so
   those are the join keys; the order puts shingles last that are common in a
   sample of texts, which changes the work and never the result.  Length and
   positional filters drop pairs that cannot reach the overlap, and what is left
   is verified on the whole sets.

Before a pair is verified, parity bitmaps of both sets are compared: each differing
bit is a shingle that only one of them has, so no pair that counts is dropped.

In buckets over ``hot_bucket`` nodes, nodes are first compared with hubs only.
Where that leaves a bucket in several components, pairs between different
components are compared: what texts share a key and are not near costs pairs.

Defined results: a text of five words or fewer is one shingle; texts without a
word, null ones too, are copies of each other; rows are told apart by all their
columns, not by id; an empty table gives none.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia import runtime
from marginalia.llm import simhash
from marginalia.llm.components import components

WORDS = 5
#: Texts whose shingles are counted, in expectation, and the uses from which a shingle is common.
SAMPLE_ROWS, COMMON_USES = 20_000, 4
#: Hubs through which the nodes of one fingerprint are linked.
SALTS = 1024
#: Bits of a parity bitmap, and the columns that hold them.
MARKS = 1024
_MARKS = [f"mark{k}" for k in range(MARKS // 64)]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles of the whole text."""
    return np.unique(simhash.shingle_hashes(text, WORDS))


def prefix(held: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles of which a set that is similar enough shares one: common ones last, else by hash."""
    n = len(held)
    if len(common):
        at = np.minimum(np.searchsorted(common, held), len(common) - 1)
        known = common[at] == held
        held = np.concatenate([held[~known], held[known]])
    return held[: n - (4 * n + 4) // 5 + 1]


def common_shingles(texts: DataFrame) -> np.ndarray:
    """Sorted shingles that several of a sample of different texts hold."""
    spot = F.pmod("node", F.lit(1 << 20)) / float(1 << 20)
    sample = texts.filter(spot < SAMPLE_ROWS / max(1, texts.count())).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py()).view(np.int64))], names=["key"])

    found = sample.mapInArrow(run, "key bigint").groupBy("key").count().filter(F.col("count") >= COMMON_USES).select("key").toArrow()
    return np.sort(found.column(0).to_numpy().view(np.uint64)) if found.num_rows else np.zeros(0, np.uint64)


def node_of(text: Column) -> Column:
    """The node of a row: its text, null as empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def bucketed(df: DataFrame, label: str, key: str) -> DataFrame:
    """``df`` written to the shared folder in buckets of ``key``, as joins on it deal rows, and reread."""
    spark = df.sparkSession
    path, name = runtime.scratch(spark, label), f"{label}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).saveAsTable(name)
    held = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files and the frame that reads them stay
    held._scratch = path
    return held


def first_rows(docs: DataFrame) -> DataFrame:
    """One row per different text: node, ``copies``, ``place`` in the order of rows, and ``first``, the row itself.

    An id comes before none, smaller ones first, then hashes of the columns decide.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"), F.xxhash64(*columns).alias("whole"))
    rows = docs.select(node_of(F.col("text")).alias("node"), place.alias("place"), F.struct(*columns).alias("first"))
    return bucketed(rows.groupBy("node").agg(F.count("*").alias("copies"), F.min("place").alias("place"), F.min_by("first", "place").alias("first")), "firsts", "node")


def nodes_of(firsts: DataFrame, common: np.ndarray) -> DataFrame:
    """Each node's short id, number of shingles, fingerprint, parity bitmap and join keys.

    Ids number the rows of this written table: in shuffles they pack better than hashes.
    """
    shared = firsts.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
            size, fp, marks, keys = [], [], [], []
            for text in batch.column(1):
                held = simhash.shingle_hashes(text.as_py(), WORDS)
                fp.append(simhash.fold(held))
                held = np.unique(held)
                size.append(len(held))
                odd = np.bincount((held & np.uint64(MARKS - 1)).astype(np.int64), minlength=MARKS) & 1
                marks.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                keys.append(prefix(held, shared.value).view(np.int64) if len(held) else np.zeros(0, np.int64))
            edges = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(keys)))
            bits = [pa.array(x) for x in np.stack(marks).T.copy()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int32()), pa.array(np.array(fp, np.uint64).view(np.int64)), *bits, lists], names=["node", "n", "fp", *_MARKS, "keys"])

    marked = ", ".join(f"{m} bigint" for m in _MARKS)
    made = firsts.select("node", "first.text").mapInArrow(run, f"node bigint, n int, fp bigint, {marked}, keys array<bigint>")
    return runtime.materialize(made.withColumn("id", F.monotonically_increasing_id()), "nodes")


def _possible() -> Column:
    """Whether the overlap after a shared key at these places can still be large enough."""
    left = 1 + F.least(F.col("n_a") - F.col("at_a") - 1, F.col("n_b") - F.col("at_b") - 1)
    return (F.lit(9) * left >= 4 * (F.col("n_a") + F.col("n_b"))) & (5 * F.col("n_a") >= 4 * F.col("n_b")) & (5 * F.col("n_b") >= 4 * F.col("n_a"))


def _side(table: DataFrame, side: str, *more: str) -> DataFrame:
    return table.select("key", F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("at").alias(f"at_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in more])


def _marked(nodes: DataFrame, side: str) -> DataFrame:
    return nodes.select(F.col("id").alias(side), F.col("node").alias(f"node_{side}"), F.col("n").alias(f"n_{side}"), *[F.col(m).alias(f"{m}_{side}") for m in _MARKS])


def verified(pairs: DataFrame, nodes: DataFrame, firsts: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) of node ids that are similar enough, by their whole sets."""
    apart = sum((F.bit_count(F.col(f"{m}_a").bitwiseXOR(F.col(f"{m}_b"))) for m in _MARKS), F.lit(0))
    marked = pairs.select("a", "b").distinct().join(_marked(nodes, "a"), "a").join(_marked(nodes, "b"), "b")
    pairs = runtime.materialize(marked.filter(9 * apart <= F.col("n_a") + F.col("n_b")).select("a", "b", "node_a", "node_b"), "candidates")
    # Either side's texts lie in buckets of their node: only ids go to the first
    # side, and only its texts, compressed, go on to the second.
    left = firsts.select(F.col("node").alias("node_a"), F.col("first.text").alias("text_a")).join(pairs.hint("shuffle_hash"), "node_a")

    def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            held = [squeeze.compress((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(held, pa.binary())], names=["a", "b", "node_b", "held"])

    sent = left.select("a", "b", "node_b", "text_a").mapInArrow(shortened, "a bigint, b bigint, node_b bigint, held binary")
    both = sent.hint("shuffle_hash").join(firsts.select(F.col("node").alias("node_b"), F.col("first.text").alias("text_b")), "node_b")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, expand = Recent(), zstandard.ZstdDecompressor()
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            good = []
            for a, b, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                p = sets.get(a, lambda: shingles(expand.decompress(held.as_py()).decode("utf-8", "surrogatepass")))
                q = sets.get(b, lambda: shingles(text.as_py()))
                good.append(9 * len(np.intersect1d(p, q, assume_unique=True)) >= 4 * (len(p) + len(q)))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    near = runtime.materialize(both.select("a", "b", "held", "text_b").mapInArrow(judged, "a bigint, b bigint"), "near")
    runtime.drop(pairs)
    return near


class Recent:
    """The sets made last, of up to ``most`` shingles in all."""

    def __init__(self, most: int = 4_000_000):
        self.most, self.size = most, 0
        self.held: dict[int, np.ndarray] = {}

    def get(self, node: int, make) -> np.ndarray:
        found = self.held.pop(node, None)
        if found is None:
            found = make()
            self.size += len(found)
        self.held[node] = found  # the latest comes last
        while self.size > self.most and len(self.held) > 1:
            self.size -= len(self.held.pop(next(iter(self.held))))
        return found


def by_fingerprint(nodes: DataFrame, most_bits: int) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints are equal or within ``most_bits``.

    Each node asks for one of its own fingerprint, through ``SALTS`` hubs a
    fingerprint at most so that none is asked for by too many, and one node of
    each fingerprint for the smallest of those near it.  Large groups of copies
    make no more pairs than nodes, and what that leaves apart is joined by the
    second step.
    """
    sub, whole = Window.partitionBy("fp", "salt"), Window.partitionBy("fp")
    salted = nodes.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS))).withColumn("hub", F.min("node").over(sub))
    salted = runtime.materialize(salted.select("fp", "node", "hub"), "hubs")
    hubs = salted.filter("hub = node").select("fp", "hub").withColumn("first", F.min("hub").over(whole))  # at most SALTS a fingerprint
    same = salted.filter("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")).union(hubs.filter("first <> hub").select(F.col("first").alias("a"), F.col("hub").alias("b")))
    first = runtime.materialize(hubs.filter("first = hub").select("fp", "first"), "firsts")
    one, other = first.select(F.col("fp").alias("a"), F.col("first").alias("node_a")), first.select(F.col("fp").alias("b"), F.col("first").alias("node_b"))
    far = simhash.links(first.select("fp"), most_bits=most_bits).join(one, "a").join(other, "b")
    return same.union(far.groupBy(F.greatest("node_a", "node_b").alias("b")).agg(F.min(F.least("node_a", "node_b")).alias("a")).select("a", "b"))


def _rooted(table: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """``table`` with the component of each node, itself where it is not linked."""
    plain = table.drop("root")
    return runtime.materialize(plain.join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node")), label)


def _stars(hot: DataFrame, spokes: int) -> DataFrame:
    """Pairs of each node of a bucket with a hub, and of the hubs with the bucket's own: about ``spokes`` a hub.

    Hubs are the nodes in which the key comes first.  They have the fewest rarer
    shingles, so where a bucket holds copies with edits they are those edited
    least, to which most others are near.
    """
    best = F.min_by(F.struct("node", "root"), F.struct("at", "node"))
    salted = hot.withColumn("salt", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / spokes)))
    told = salted.withColumn("hub", best.over(Window.partitionBy("key", "salt")))
    hubs = told.filter("hub.node = node").drop("hub").withColumn("hub", best.over(Window.partitionBy("key")))
    both = told.select("node", "root", "hub").union(hubs.select("node", "root", "hub")).filter("hub.root <> root")
    return both.select(F.col("hub.node").alias("a"), F.col("node").alias("b"))


def links(nodes: DataFrame, firsts: DataFrame, hot_bucket: int = 64, most_bits: int = 2) -> DataFrame:
    """Pairs (a, b) of nodes within which all similar nodes are connected."""
    near = verified(by_fingerprint(nodes.select(F.col("id").alias("node"), "fp"), most_bits), nodes, firsts)
    rooted = nodes.select(F.col("id").alias("node"), "n", "keys").join(components(near), "node", "left")
    spread = rooted.select("node", "n", F.coalesce("root", "node").alias("root"), F.posexplode("keys").alias("at", "key"))
    bucket = Window.partitionBy("key")
    shared = runtime.materialize(spread.withColumn("size", F.count("*").over(bucket)).filter("size > 1"), "buckets")
    cold, hot = shared.filter(F.col("size") <= hot_bucket), shared.filter(F.col("size") > hot_bucket)
    pairs = _side(cold, "a", "root").join(_side(cold, "b", "root"), "key").filter("a < b AND root_a <> root_b").filter(_possible()).select("a", "b")
    near = near.union(verified(pairs.union(_stars(hot, hot_bucket)), nodes, firsts))
    if hot.limit(1).count():
        again = runtime.materialize(hot.drop("root").join(components(near), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
        mixed = again.withColumn("low", F.min("root").over(bucket)).withColumn("high", F.max("root").over(bucket)).filter("low <> high")
        rest = _side(mixed, "a", "root").join(_side(mixed, "b", "root"), "key").filter("a < b AND root_a <> root_b").filter(_possible()).select("a", "b")
        near = near.union(verified(rest, nodes, firsts))
        runtime.drop(again)
    runtime.drop(shared)
    return near


def named_nodes(docs: DataFrame, hot_bucket: int, most_bits: int) -> tuple[DataFrame, DataFrame]:
    """The first rows of all texts, and (node, copies, place, component) of each."""
    runtime.ship(docs.sparkSession)
    firsts = first_rows(docs)
    nodes = nodes_of(firsts, common_shingles(firsts.select("node", "first.text")))
    rooted = components(links(nodes, firsts, hot_bucket, most_bits)).withColumnRenamed("node", "id")
    named = nodes.select("node", "id").join(rooted, "id", "left").select("node", F.coalesce("root", "id").alias("component"))
    names = runtime.materialize(firsts.select("node", "copies", "place").join(named.hint("shuffle_hash"), "node"), "names")
    runtime.drop(nodes)
    return firsts, names


def classes(docs: DataFrame, *, hot_bucket: int = 64, most_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` with ``component``, equal for near copies and never null."""
    _, names = named_nodes(docs, hot_bucket, most_bits)
    told = docs.withColumn("node", node_of(F.col("text")))
    return simhash.named_by(told, names.select("node", "copies", "component"), "node").select(*docs.columns, "component")


def first_of_each(docs: DataFrame, *, hot_bucket: int = 64, most_bits: int = 2) -> DataFrame:
    """One row of each component of near copies, the first in the order of rows."""
    firsts, names = named_nodes(docs, hot_bucket, most_bits)
    kept = names.groupBy("component").agg(F.min_by("node", "place").alias("node")).select("node")
    return firsts.select("node", "first").join(kept.hint("shuffle_hash"), "node", "left_semi").select("first.*")
