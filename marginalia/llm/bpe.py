"""Word-level BPE by contiguous rank arrays, exact to the public vocabulary file.

A text is cut at special tokens, normalised and split into words.  Letter
classes, lower case and composition differ between Unicode versions, so text
beyond the Latin blocks is normalised and split by the tokenizers library's own
classes, made from the vocabulary file's description.  A word not seen lately is encoded alone: its parts stay in one array beside the rank of
each adjacent pair; the smallest rank is found by scanning, its right boundary
deleted, and the two neighbouring ranks looked up again.  Scanning is quadratic
in the parts of a word, so words longer than ``SHORT`` parts go through a heap
over a linked list that merges in the same order.

Worker caches hold at most ``CACHE`` words.  Rows are independent: no shuffle.

Defined results: a null text is the empty text, with no ids; repeated rows give
repeated results, an empty table none, and other columns are ignored.
"""

from __future__ import annotations

import array
import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from marginalia import runtime

SHORT = 64
CACHE = 200_000
_NONE = 1 << 60
_BITS = 20
_MASK = (1 << _BITS) - 1
#: The vocabulary's words for texts of the first two Latin blocks and their extensions,
#: where the standard library's classes need only these numerals moved.
_LATIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_²³¹¼½¾]+|[\\d²³¹¼½¾]|(?:[^\\w\\s]|_)+")
_BEYOND_LATIN = re.compile("[^\x00-ɏ]")
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def _byte_characters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def _normalizer(spec: dict):
    """The library's normaliser that a vocabulary file describes."""
    kind = spec["type"]
    if kind == "Sequence":
        return normalizers.Sequence([_normalizer(part) for part in spec["normalizers"]])
    if kind == "Replace":
        return normalizers.Replace(Regex(spec["pattern"]["Regex"]), spec["content"])
    return {"NFC": normalizers.NFC, "Lowercase": normalizers.Lowercase}[kind]()


def _splitter(spec: dict):
    """The library's splitter by pattern that a vocabulary file describes; bytes are mapped later."""
    parts = spec["pretokenizers"] if spec["type"] == "Sequence" else [spec]
    split = next(part for part in parts if part["type"] == "Split")
    return pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), split["behavior"].lower(), invert=split["invert"])


class WordBPE:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.text_of = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of.update({i: t for t, i in self.special.items()})
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._normal, self._split = _normalizer(spec["normalizer"]), _splitter(spec["pre_tokenizer"])
        symbols = _byte_characters()
        self._inner = [vocab[s] for s in symbols]
        self._final = [vocab[s + self.end] for s in symbols]
        #: Pair of ids to rank and merged id, each two numbers packed in one.
        self._merge: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self._merge[vocab[left] << _BITS | vocab[right]] = rank << _BITS | vocab[left + right]
        self._known: dict[str, tuple[bytes, str]] = {}

    def word(self, word: str) -> list[int]:
        """Ids of one word."""
        raw = word.encode("utf-8", "surrogatepass")
        parts = [self._inner[b] for b in raw[:-1]]
        parts.append(self._final[raw[-1]])
        return self._scan(parts) if len(parts) <= SHORT else self._queue(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        rank = self._merge.get
        ranks = [rank(a << _BITS | b, _NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == _NONE:
                break
            at = ranks.index(low)
            merged = parts[at] = low & _MASK
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] << _BITS | merged, _NONE)
            if at < len(ranks):
                ranks[at] = rank(merged << _BITS | parts[at + 1], _NONE)
        return parts

    def _queue(self, parts: list[int]) -> list[int]:
        n, rank = len(parts), self._merge.get
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n and (found := rank(pair := parts[a] << _BITS | parts[b])) is not None:
                heapq.heappush(heap, (found >> _BITS, a, pair, found & _MASK))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, pair, merged = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or parts[i] << _BITS | parts[j] != pair:
                continue
            parts[i], alive[j] = merged, False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p, live in zip(parts, alive) if live]

    def _learn(self, word: str) -> tuple[bytes, str]:
        if len(self._known) >= CACHE:
            self._known.clear()
        ids = self.word(word)
        learnt = self._known[word] = (array.array("I", ids).tobytes(), self.decode(ids))
        return learnt

    def words(self, text: str) -> list[str]:
        """Normalised words of a text between special tokens."""
        if _BEYOND_LATIN.search(text) or _ODD_SPACE.search(text):
            return [word for word, _ in self._split.pre_tokenize_str(self._normal.normalize_str(text))]
        # The pattern drops white space and no word spans it, so runs need no collapsing;
        # these blocks hold no combining marks, so they are composed as they stand.
        return _LATIN_WORDS.findall(text.lower() if "İ" not in text else "".join([c.lower() for c in text]))

    def encode_decode(self, text: str) -> tuple[bytes, str]:
        """Little-endian unsigned 32-bit ids, and the text that decoding them gives."""
        pieces = self._cut.split(text) if self._cut and "<|" in text else [text]
        ids, texts = [], []
        for k, piece in enumerate(pieces):
            if k % 2:
                i = self.special[piece]
                ids.append(array.array("I", [i]).tobytes())
                texts.append(piece)
                continue
            known, learn = self._known.get, self._learn
            found = [known(word) or learn(word) for word in self.words(piece)]
            ids += [pair[0] for pair in found]
            texts += [pair[1] for pair in found]
        return b"".join(ids), " ".join(texts)

    def encode(self, text: str) -> list[int]:
        return array.array("I", self.encode_decode(text)[0]).tolist()

    def decode(self, ids: list[int]) -> str:
        """Token texts joined by spaces, as a vocabulary without a decoder has it."""
        return " ".join([self.text_of[i] for i in ids])


@functools.cache
def codec(path: str) -> WordBPE:
    return WordBPE(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, *, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, digests of ids and decoded text, and the ids if kept."""
    runtime.ship(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32())] * keep_ids
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, decoded = bpe.encode_decode(text.as_py() or "")
                row = (doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                rows.append(row + ((array.array("I", ids).tolist(),) if keep_ids else ()))
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)
