"""Vector best-fit packing of tokenised documents into training sequences.

Two steps.  :func:`piece_table` tokenises whole texts in Arrow batches and cuts
only documents longer than a sequence.  :func:`pack` deals the small piece rows
(no token ids travel) evenly to groups of ``group_rows`` rows and packs each
group by vector best fit: every open bin has a residual vector of tokens,
documents and attention cost; a piece goes to the feasible bin that its rule
prefers, and opens a bin only when no bin can take it under every constraint.

A group's size does not depend on the input, so neither does a task's memory.
Packing groups apart costs at most the unfilled last bins of each group, well
below one in a thousand sequences at the default size.

Defined results: a null text is the empty text, whose only token is the end
id; repeated rows and equal or null ids are packed each for itself; an empty
table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import functools
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia import runtime

_PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_ADJACENT_SPACE = re.compile(r"\s\s")
#: Without two adjacent white-space characters the look-ahead branch of the
#: vocabulary's own pattern never decides anything, so it can be left out and
#: the remaining alternatives run on a plain automaton.
_PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


@functools.cache
def _codecs(vocabulary: str, end_of_text: str):
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    special = {end_of_text: len(ranks)}
    make = functools.partial(tiktoken.Encoding, mergeable_ranks=ranks, special_tokens=special)
    return make("whole", pat_str=public_tokenizers.PATTERN), make("plain", pat_str=_PLAIN_PATTERN)


def encode(text: str, vocabulary: str, end_of_text: str = "<|endoftext|>") -> np.ndarray:
    """Byte-level BPE ids of a whole text, as unsigned 32-bit integers."""
    whole, plain = _codecs(vocabulary, end_of_text)
    codec = whole if _ADJACENT_SPACE.search(text) else plain
    return codec.encode_to_numpy(text, allowed_special="all")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def cut(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: one when it fits, else full pieces behind a shorter first."""
    if n_tokens <= capacity:
        return [(0, n_tokens)]
    first = n_tokens % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n_tokens, capacity)]


def piece_table(docs: DataFrame, *, vocabulary: str | None = None, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row per piece of every document; ``keep_ids`` adds the ids themselves."""
    runtime.ship(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()
    schema = _PIECE + (", ids array<int>" if keep_ids else "")
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * keep_ids
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([encode(text.as_py() or "", vocabulary), end])
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    row = (doc_id, piece, start, length, zlib.crc32(part.astype("<u4").tobytes()))
                    rows.append(row + ((part.astype(np.int32),) if keep_ids else ()))
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(tokenise, schema)


@dataclass(frozen=True)
class Capacity:
    """What one sequence may hold, and how much each dimension weighs in the choice.

    ``documents`` and ``attention`` default to what ``tokens`` already implies
    (each piece has at least one token, and squares sum to no more than the
    square of the sum), so they cost no sequence unless set lower.
    """

    tokens: int = 2048
    documents: int | None = None
    attention: float | None = None
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)
    rule: str = "norm"

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or float(self.tokens) ** 2])


def demands(lengths: np.ndarray) -> np.ndarray:
    """Tokens, documents and attention cost of each piece."""
    lengths = lengths.astype(np.float64)
    return np.stack([lengths, np.ones_like(lengths), lengths * lengths], axis=1)


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Bin and token offset of each piece, longest first, under every capacity.

    Rule ``norm`` takes the bin whose weighted residual after placing is
    smallest; rule ``dot`` the one whose residual has the largest weighted
    product with the piece's demand.
    """
    if capacity.rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {capacity.rule!r}")
    limit = capacity.vector()
    need = demands(lengths)
    if (need > limit).any():
        raise ValueError("a piece exceeds the capacity of a sequence")
    share = need / limit
    weights = np.asarray(capacity.weights, dtype=np.float64)
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left = np.empty((3, 1024))  # residual of open bins, as shares
    names = np.empty(1024, np.int64)
    used = np.zeros(len(lengths) + 1, np.int64)
    n_open = n_bins = 0
    smallest = share.min(axis=0) if len(lengths) else share
    slack = 1e-9
    for at in order:
        want = share[at]
        best = -1
        if n_open:
            rest = left[:, :n_open] - want[:, None]
            fits = (rest >= -slack).all(axis=0)
            if fits.any():
                if capacity.rule == "norm":
                    score = np.where(fits, weights @ (rest * rest), np.inf)
                    best = int(score.argmin())
                else:
                    score = np.where(fits, weights @ (left[:, :n_open] * want[:, None]), -np.inf)
                    best = int(score.argmax())
        if best < 0:
            if n_open == left.shape[1]:
                left, names = np.concatenate([left, np.empty_like(left)], axis=1), np.concatenate([names, np.empty_like(names)])
            best, left[:, n_open], names[n_open] = n_open, 1.0, n_bins
            n_open, n_bins = n_open + 1, n_bins + 1
        left[:, best] -= want
        name = names[best]
        bins[at], offsets[at] = name, used[name]
        used[name] += lengths[at]
        if (left[:, best] < smallest - slack).any():  # nothing fits any more
            n_open -= 1
            left[:, best], names[best] = left[:, n_open], names[n_open]
    return bins, offsets


def pack(pieces: DataFrame, *, capacity: Capacity | None = None, group_rows: int = 16_384) -> DataFrame:
    """``pieces`` (with a ``length``) plus ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    runtime.ship(spark)
    capacity = capacity or Capacity()
    stored = runtime.materialize(pieces, "pieces")
    groups = max(1, math.ceil(stored.count() / group_rows))
    schema = T.StructType([*stored.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        bins, offsets = best_fit(table.column("length").to_numpy(), capacity)
        ids = bins + (TaskContext.get().partitionId() << 32)
        yield from table.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets)).to_batches()

    # Dealt in turn, not by key: groups are even however often an id or a length occurs.
    return stored.repartition(groups).mapInArrow(fit, schema)


def pack_documents(docs: DataFrame, *, vocabulary: str | None = None, capacity: Capacity | None = None) -> DataFrame:
    """Tokenise, cut and pack whole documents."""
    capacity = capacity or Capacity()
    return pack(piece_table(docs, vocabulary=vocabulary, capacity=capacity.tokens), capacity=capacity)
