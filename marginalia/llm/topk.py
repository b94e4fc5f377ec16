"""Exact top-k by inner product with block-at-a-time pruning.

Quantised vectors are stored in blocks that are ranges of ids: ids, a forward
index (the block's term matrix, in the narrowest integers that hold it) and each
term's extremes.  Queries are stored in groups.  For a query, the summed term
maxima of a block bound its best score.  Four steps, none of which pairs rows:

1. bounds: groups meet the extremes of all blocks, 1/256 of the data, and name
   the few blocks of highest bounds;
2. seeds: scoring those gives each query k scores, so a floor under its k-th;
3. survivors: bounds again, now against the floors; only pairs of a group and a
   block that some query's bound reaches go on;
4. cells of one group and some of its surviving blocks are scored in order of
   bound until the next falls below the k-th score.  Cells return k rows per
   query, and a window ranks those.

A cell holds ``blocks_per_cell`` blocks and one group of queries, whatever the
input's size.  Where vectors have no order by id, no bound is below a floor and
every block is scored; :func:`survivors` tells how many go on.

Defined results: rows whose id or vector is null, or whose vector has a null or
non-finite component, take no part; vectors of another length than the query's
score nothing against it; rows that repeat an id and vector compete once; equal
scores go to the smaller id; an empty table gives none; other columns are
ignored.  Quantised components are held within 2**62 and sums beyond 64 bits wrap.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia import runtime

_PACKED = "block bigint, dim int, n int, width int, ids binary, terms binary, low binary, high binary"
_STORED = ["block", "dim", "n", "width", "ids", "terms"]
#: Blocks whose extremes are compared at a time, and blocks that seed a group's floors.
_CHUNK, _SEEDS = 4096, 4


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector (doubles) of the rows that take part."""
    chosen = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return chosen.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & ~F.coalesce(odd, F.lit(False)))


def pack(rows: DataFrame, size: int, scale: float = 256.0) -> DataFrame:
    """Blocks of up to ``size`` consecutive rows as they lie in their partition, by vector length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, list[tuple[int, np.ndarray]]] = {}
        name = TaskContext.get().partitionId() << 32

        def emit(dim: int):
            nonlocal name
            part = sorted({(i, v.tobytes()) for i, v in held.pop(dim)})
            ids = np.array([i for i, _ in part], np.int64)
            terms = np.frombuffer(b"".join([t for _, t in part]), np.int64).reshape(len(ids), dim)
            width = next((w for w in (2, 4) if not terms.size or np.abs(terms).max() < 1 << (8 * w - 1)), 8)
            name += 1
            values = [name, dim, len(ids), width, ids.tobytes(), terms.astype(f"<i{width}").tobytes(), terms.min(axis=0).tobytes(), terms.max(axis=0).tobytes()]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32()] + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=[x.split()[0] for x in _PACKED.split(", ")])

        for batch in batches:
            for row_id, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = vector.values.to_numpy(zero_copy_only=False)
                terms = np.clip(np.floor(scale * values), -(2.0**62), 2.0**62).astype(np.int64)
                held.setdefault(len(terms), []).append((row_id, terms))
                if len(held[len(terms)]) >= size:
                    yield emit(len(terms))
        for dim in list(held):
            yield emit(dim)

    return rows.mapInArrow(run, _PACKED)


class Block:
    """Ids and terms of stored vectors."""

    def __init__(self, dim: int, n: int, ids: bytes, terms: bytes, width: int = 8, block: int = 0):
        self.block, self.dim, self.ids = block, dim, np.frombuffer(ids, np.int64)
        self.terms = np.frombuffer(terms, f"<i{width}").reshape(n, dim).astype(np.int64)

    def extremes(self) -> tuple[np.ndarray, np.ndarray]:
        return self.terms.min(axis=0), self.terms.max(axis=0)


def _blocks(table: pa.Table) -> list[Block]:
    return [Block(dim, n, ids, terms, width, block) for block, dim, n, width, ids, terms in zip(*(table.column(c).to_pylist() for c in _STORED))]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T: in doubles while no sum can leave their integers."""
    reach = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if reach < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def bounds(queries: Block, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The summed term maxima of each query (rows) in each block (columns) of these extremes."""
    return _product(np.maximum(queries.terms, 0), high) + _product(np.minimum(queries.terms, 0), low)


LEAST = np.iinfo(np.int64).min


def search(queries: Block, blocks: list[Block], k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query row, id, score) of the k best in ``blocks`` per query, and how many query-blocks were scored.

    Scores below a query's ``floor`` may be left out.
    """
    blocks = [b for b in blocks if b.dim == queries.dim and len(b.ids)]
    none = np.zeros(0, np.int64)
    if not blocks:
        return none, none, none, 0
    low, high = (np.stack(x) for x in zip(*(b.extremes() for b in blocks)))
    bound = bounds(queries, low, high)
    order = np.argsort(-bound, axis=1, kind="stable")
    nq = len(queries.ids)
    kth = np.full(nq, LEAST) if floor is None else floor.copy()
    top_q, top_id, top_s, scored = none, none, none, 0
    for step in range(len(blocks)):
        turn = order[:, step]
        live = np.flatnonzero(bound[np.arange(nq), turn] >= kth)
        if not len(live):
            break
        found = [(top_q, top_id, top_s)]
        for at in np.unique(turn[live]):
            mine, block = live[turn[live] == at], blocks[at]
            scored += len(mine)
            score = _product(queries.terms[mine], block.terms)
            own = queries.ids[mine][:, None] == block.ids
            least = kth[mine]
            if score.shape[1] > k + own.sum(axis=1).max(initial=0):  # rows that are the query's own don't count
                most = k + int(own.sum(axis=1).max(initial=0))
                least = np.maximum(least, np.partition(score, -most, axis=1)[:, -most])
            q, d = np.nonzero((score >= least[:, None]) & ~own)
            found.append((mine[q], block.ids[d], score[q, d]))
        q, i, s = (np.concatenate(x) for x in zip(*found))
        by = np.lexsort((i, -s, q))
        q, i, s = q[by], i[by], s[by]
        fresh = np.ones(len(q), bool)
        fresh[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1]) | (s[1:] != s[:-1])
        q, i, s = q[fresh], i[fresh], s[fresh]
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        top_q, top_id, top_s = q[place < k], i[place < k], s[place < k]
        last = place == k - 1
        kth[q[last]] = np.maximum(kth[q[last]], s[last])
    return top_q, top_id, top_s, scored


def _meeting(groups: DataFrame, blocks: DataFrame, n_groups: int, work, schema: str) -> DataFrame:
    """Each group with the extremes of all blocks, some thousands at a time: ``work(queries table, extremes table)``."""
    n_chunks = max(1, math.ceil(blocks.count() / _CHUNK))
    asks = groups.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
    held = blocks.select("block", "dim", "low", "high").withColumn("chunk", F.pmod(F.xxhash64("block"), F.lit(n_chunks)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    return asks.groupBy("g", "chunk").cogroup(held.groupBy("g", "chunk")).applyInArrow(work, schema)


def _sliced(queries: Block, right: pa.Table, width: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(block names, bounds) of the blocks of the queries' length, some at a time."""
    same = right.filter(pa.array(np.asarray(right.column("dim")) == queries.dim, pa.bool_()))
    for at in range(0, same.num_rows, width):
        part = same.slice(at, width)
        low, high = (np.stack([np.frombuffer(x, np.int64) for x in part.column(c).to_pylist()]) for c in ("low", "high"))
        yield np.asarray(part.column("block")), bounds(queries, low, high)


def seeds(groups: DataFrame, blocks: DataFrame, n_groups: int, k: int) -> DataFrame:
    """``groups`` with ``floor``, the k-th score of each query in the blocks of its group's highest bounds."""

    def name(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.table({"g": pa.array([], pa.int32()), "block": pa.array([], pa.int64()), "bound": pa.array([], pa.float64())})]
        for queries in _blocks(left):
            for names, bound in _sliced(queries, right):
                total = bound.astype(np.float64).sum(axis=0)
                top = np.argsort(-total, kind="stable")[:_SEEDS]
                out.append(pa.table({"g": pa.array([left.column("g")[0].as_py()] * len(top), pa.int32()), "block": names[top], "bound": total[top]}))
        return pa.concat_tables(out)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        floors, stored = [], _blocks(right)
        for queries in _blocks(left):
            q, _, s, _ = search(queries, stored, k)
            floor = np.full(len(queries.ids), LEAST)
            times = np.bincount(q, minlength=len(floor))
            np.minimum.at(held := np.full(len(floor), np.iinfo(np.int64).max), q, s)
            floor[times >= k] = held[times >= k]
            floors.append(floor.tobytes())
        return left.append_column("floor", pa.array(floors, pa.binary()))

    named = _meeting(groups, blocks, n_groups, name, "g int, block bigint, bound double")
    best = Window.partitionBy("g").orderBy(F.desc("bound"), "block")
    chosen = named.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= _SEEDS).select("g", "block").distinct()
    held = blocks.select(*_STORED).join(chosen.hint("broadcast") if n_groups <= 10_000 else chosen, "block").select("g", *_STORED)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in groups.schema.fields) + ", floor binary"
    return runtime.materialize(groups.groupBy("g").cogroup(held.groupBy("g")).applyInArrow(score, schema), "armed")


def survivors(armed: DataFrame, blocks: DataFrame, n_groups: int) -> DataFrame:
    """Pairs (g, block) in which some query's bound reaches its floor."""

    def keep(left: pa.Table, right: pa.Table) -> pa.Table:
        out: set[int] = set()
        for queries, floor in zip(_blocks(left), left.column("floor").to_pylist()):
            least = np.frombuffer(floor, np.int64)[:, None]
            for names, bound in _sliced(queries, right):
                out |= set(names[(bound >= least).any(axis=0)].tolist())
        return pa.table({"g": pa.array([left.column("g")[0].as_py()] * len(out) if out else [], pa.int32()), "block": pa.array(sorted(out), pa.int64())})

    return runtime.materialize(_meeting(armed, blocks, n_groups, keep, "g int, block bigint"), "survivors")


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 512, group_rows: int = 16_384, blocks_per_cell: int = 64) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best other rows."""
    spark = vectors.sparkSession
    runtime.ship(spark)
    ranged = usable(vectors, id_col, vector_col).repartitionByRange("id").sortWithinPartitions("id")
    blocks = runtime.materialize(pack(ranged, block_rows), "blocks")
    asked = runtime.materialize(usable(vectors.filter(is_query), id_col, vector_col).distinct(), "queries")
    n_groups = max(1, math.ceil(asked.count() / group_rows))
    # Neighbouring ids share a group, as they share blocks.
    groups = runtime.materialize(pack(asked.repartitionByRange(n_groups, "id").sortWithinPartitions("id"), group_rows).drop("low", "high"), "groups")
    n_groups, n_cells = max(1, groups.count()), max(1, math.ceil(blocks.count() / blocks_per_cell))
    groups = groups.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(n_groups)).cast("int"))  # about one packed group each
    armed = seeds(groups, blocks, n_groups, k)
    cell = F.pmod(F.xxhash64("block"), F.lit(n_cells)).cast("int")
    alive = survivors(armed, blocks, n_groups).withColumn("cell", cell)
    held = blocks.select(*_STORED).join(alive, "block")
    asks = armed.join(alive.select(F.col("g").alias("g"), F.col("cell").alias("cell")).distinct(), "g")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        stored, out = _blocks(right), []
        for queries, floor in zip(_blocks(left), left.column("floor").to_pylist()):
            q, i, s, _ = search(queries, stored, k, np.frombuffer(floor, np.int64))
            keys = np.array([hash_of(t.tobytes()) for t in queries.terms], np.int64)
            out.append(pa.table({"query_id": queries.ids[q], "qkey": keys[q], "vec_id": i, "score": s}))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "qkey", "vec_id", "score")})

    found = asks.groupBy("g", "cell").cogroup(held.groupBy("g", "cell")).applyInArrow(run, "query_id bigint, qkey bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def hash_of(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) - (1 << 63)
