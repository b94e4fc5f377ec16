"""SimHash near-duplicate detection with pigeonring candidate filtering.

Each text becomes one 64-bit fingerprint.  Equal fingerprints are aggregated
first, so a group of copies is one row however large.  Between different
fingerprints, the 64 bits are cut into ``most_bits + 1`` segments in a ring.
Two fingerprints within ``most_bits`` must have a segment from which every
chain of l consecutive segments differs in at most ``l * most_bits / segments``
bits.  The first segment of such a chain is equal, and the second differs in
one bit at most, so one of its halves is equal: those bits are the join key.
Chains are then checked for every length before the full Hamming distance.

A bucket with more than ``hot_bucket`` fingerprints is not joined with itself.
Its members go through bit masks instead: fingerprints that agree outside a
mask of ``most_bits`` bits are linked, at most ``2 ** most_bits`` share a mask,
and the cost stays linear in the bucket.

Links are reduced to components by star rounds in the shared folder.

Defined results: null and empty texts have fingerprint zero and link like any
other; rows with a null id take their fingerprint's component (null where no
row has an id); repeated rows repeat their result; an empty table gives none;
other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia import runtime
from marginalia.llm.components import components

BITS = 64
#: Keys of more than one row in so many are joined apart: there are no more of them than this.
HOT_SHARES = 256
_CHUNK = 1 << 16


def shingle_hashes(text: str | None, words_per_shingle: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of the whole text, repeats included; fewer words are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), len(words)
    digest = xxhash.xxh64_intdigest
    if n <= words_per_shingle:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = words_per_shingle - 1
    return np.array([digest(joined[i:j], seed) for i, j in zip(starts[: n - k].tolist(), ends[k:].tolist())], np.uint64)


def fold(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; zero for none."""
    seen = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        seen += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * seen > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, *, words_per_shingle: int = 3, seed: int = 42) -> int:
    """Bits set in over half of the shingles' XXH64, over the whole text."""
    return fold(shingle_hashes(text, words_per_shingle, seed))


def fingerprints(docs: DataFrame, *, words_per_shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row."""
    runtime.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t.as_py(), words_per_shingle=words_per_shingle, seed=seed) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def segments(most_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of the ring's segments."""
    edges = [round(BITS * i / (most_bits + 1)) for i in range(most_bits + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _bits(fp: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))


def _keys(most_bits: int) -> Column:
    """Slot and key of each bucket a fingerprint lies in: a segment and half of the next."""
    ring, out, fp = segments(most_bits), [], F.col("fp")
    for i, (first, width) in enumerate(ring):
        after, room = ring[(i + 1) % len(ring)]
        low = room // 2
        for half, (at, size) in enumerate(((after, low), (after + low, room - low))):
            key = F.shiftleft(_bits(fp, first, width), size).bitwiseOR(_bits(fp, at, size))
            out.append(F.struct(F.lit(2 * i + half).alias("slot"), key.alias("key")))
    return F.array(*out)


def _chained(apart: Column, slot: Column, most_bits: int) -> Column:
    """Whether every chain from the slot's segment keeps its proportional budget."""
    ring = segments(most_bits)
    cost = [F.bit_count(_bits(apart, first, width)) for first, width in ring]
    kept = F.lit(False)
    for i in range(len(ring)):
        spent, inside = F.lit(0), F.lit(True)
        for length in range(1, len(ring) + 1):
            spent = spent + cost[(i + length - 1) % len(ring)]
            inside = inside & (spent <= length * most_bits // len(ring))
        kept = kept | ((F.floor(slot / 2) == i) & inside)
    return kept


def links(fps: DataFrame, *, most_bits: int = 2, hot_bucket: int = 1000) -> DataFrame:
    """Pairs ``(a, b)`` of distinct fingerprints within ``most_bits`` that connect all such pairs.

    Every such pair is there once, but for members of hot buckets: those that
    agree outside a mask are linked to the smallest of them, which leaves the
    components as they are.
    """
    if most_bits < 1:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    keyed = fps.select("fp", F.explode(_keys(most_bits)).alias("k")).select("fp", "k.slot", "k.key")
    sizes = keyed.groupBy("slot", "key").agg(F.count("*").alias("size")).filter("size > 1")
    shared = runtime.materialize(keyed.join(sizes, ["slot", "key"]), "buckets")
    cold = shared.filter(F.col("size") <= hot_bucket)
    left, right = cold.select("slot", "key", F.col("fp").alias("a")), cold.select("slot", "key", F.col("fp").alias("b"))
    apart = F.col("a").bitwiseXOR(F.col("b"))
    near = left.join(right, ["slot", "key"]).filter("a < b").filter(_chained(apart, F.col("slot"), most_bits)).filter(F.bit_count(apart) <= most_bits).select("a", "b")
    # Hot buckets: agreement outside a mask, at most 2 ** most_bits fingerprints each.
    hot = shared.filter(F.col("size") > hot_bucket).select("fp").distinct()
    bits = F.sequence(F.lit(0), F.lit(BITS - 1))
    masks = hot
    names = [f"bit{i}" for i in range(most_bits)]
    for i, name in enumerate(names):
        masks = masks.withColumn(name, F.explode(bits if not i else F.expr(f"filter(sequence(0, {BITS - 1}), x -> x > {names[i - 1]})")))
    mask = F.lit(0).cast("bigint")
    for name in names:
        mask = mask.bitwiseOR(F.expr(f"shiftleft(1L, {name})"))
    same = masks.select("fp", mask.alias("mask"), F.col("fp").bitwiseAND(F.bitwise_not(mask)).alias("rest")).groupBy("mask", "rest").agg(F.array_sort(F.collect_set("fp")).alias("all")).filter(F.size("all") > 1)
    dense = same.select(F.col("all")[0].alias("a"), F.explode(F.slice("all", 2, 1 << most_bits)).alias("b"))
    return near.union(dense).distinct()


def classes(docs: DataFrame, *, most_bits: int = 2, words_per_shingle: int = 3, seed: int = 42, hot_bucket: int = 1000) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) of every row."""
    told = runtime.materialize(fingerprints(docs, words_per_shingle=words_per_shingle, seed=seed), "fingerprints")
    fps = told.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    rooted = components(links(fps.select("fp"), most_bits=most_bits, hot_bucket=hot_bucket))
    member = rooted.union(rooted.select(F.col("root").alias("node"), "root").distinct())
    linked = runtime.materialize(fps.join(member, fps["fp"] == member["node"]).select("fp", "root", "least"), "linked")
    roots = runtime.materialize(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("copies")), "roots")
    named = named_by(linked, roots, "root").select("fp", "component_id")
    by_fp = runtime.materialize(fps.join(named, "fp", "left").select("fp", "copies", F.coalesce("component_id", "least").alias("component_id")), "classes")
    return named_by(told, by_fp, "fp").select("doc_id", "fp", "component_id")


def named_by(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """``rows`` (a written table) with the columns of ``names``, one row per ``key`` and ``copies`` in ``rows``.

    At most ``HOT_SHARES`` keys hold more than that share of all rows each, so
    those names go out as a broadcast, and no key of the shuffled join is hotter.
    """
    hot = F.col("copies") * HOT_SHARES > rows.count()
    often, seldom = F.broadcast(names.filter(hot).drop("copies")), names.filter(~hot).drop("copies")
    return rows.join(often, key).unionByName(rows.join(often.select(key), key, "left_anti").join(seldom, key))


def pairs_by_force(values: list[int], most_bits: int) -> set[tuple[int, int]]:
    """Every pair of distinct values within ``most_bits``: the definition, for tests."""
    return {(a, b) for a, b in itertools.combinations(sorted(set(values)), 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= most_bits}
