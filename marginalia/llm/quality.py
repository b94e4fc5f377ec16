"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts (:func:`statistics`) are binned by quantiles; trees
grow level by level on gradient histograms under logistic loss; the fitted
forest is flattened into arrays (feature, threshold, children, value) that
numpy walks for a whole batch at once.

Fitting takes at most ``sample_rows`` labelled rows in expectation, chosen by a
hash of the id (the documented bound on what reaches the driver).  Scoring is a
map over Arrow batches with the arrays in its closure: nothing is shuffled.

Defined results: a null text is the empty text and gets a score too; a null id
counts as held out; labels that are null or conflict are settled by leaving out
nulls and taking the larger; with no labels, or one class, the score is that
class's smoothed share.  Repeated rows give repeated results, an empty table
none; columns other than doc_id and text are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia import runtime
from marginalia.llm.langid import held_out

STATISTICS = (
    "log_bytes", "mean_word", "distinct_words", "upper", "digits", "stops", "symbols", "exclaim", "bars", "newlines",
    "repeated_lines", "line_words", "longest_line", "top_word", "top_ten_words", "repeated_pairs", "beyond_ascii",
    "capital_words", "marked_words", "short_words", "longest_word", "plain_line_ends", "spaces", "bytes_per_word",
)
_SYMBOLS = np.frombuffer(b"#$%&*+/<=>@\\^_`{|}~[]", np.uint8)
_STOPS = np.frombuffer(b".,;:?", np.uint8)


def statistics(text: str | None) -> list[float]:
    """The named statistics of one whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    w = max(1, len(words))
    often = Counter(words)
    lines = [line for line in text.split("\n") if line.strip()]
    k = max(1, len(lines))
    sizes = [len(line) for line in lines] or [0]
    top = sorted(often.values(), reverse=True)[:10] or [0]
    pairs = len(set(zip(words, words[1:])))
    marked = sum([x[-1] in "#$%&*|!" for x in words])
    return [
        np.log1p(len(raw)),
        sum(map(len, words)) / w,
        len(often) / w,
        seen[65:91].sum() / n,
        seen[48:58].sum() / n,
        seen[_STOPS].sum() / n,
        seen[_SYMBOLS].sum() / n,
        seen[33] / w,
        seen[124] / w,
        seen[10] / w,
        1 - len(set(lines)) / k,
        w / k,
        max(sizes) / max(1, len(text)),
        top[0] / w,
        sum(top) / w,
        1 - pairs / max(1, len(words) - 1),
        seen[128:].sum() / n,
        sum(map(str.isupper, words)) / w,
        marked / w,
        sum([len(x) < 3 for x in words]) / w,
        np.log1p(max(map(len, often), default=0)),
        sum([line[-1] not in ".!?" for line in lines]) / k,
        seen[32] / n,
        n / w,
    ]


@dataclass
class Forest:
    """Trees side by side in flat arrays; a leaf's children are itself."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                right = x[rows, self.feature[node]] > self.threshold[node]
                node = np.where(right, self.right[node], self.left[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def fit_forest(x: np.ndarray, y: np.ndarray, *, trees: int = 120, depth: int = 5, rate: float = 0.1, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Forest:
    """Boost ``trees`` trees on binned features; deterministic for the same rows in order."""
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    base = float(np.log(share / (1 - share)))
    empty = np.zeros(0, np.int64)
    if len(y) < 2 * least or y.min() == y.max():
        return Forest(base, empty, np.zeros(0), empty, empty, np.zeros(0), empty, 0)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    n_features = x.shape[1]
    flat = binned + np.arange(n_features) * bins
    margin = np.full(len(y), base)
    parts: list[list] = []  # feature, threshold, left, right, value
    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        root = len(parts)
        roots.append(root)
        parts.append([0, np.inf, root, root, 0.0])
        level = [(root, np.arange(len(y)))]
        for d in range(depth + 1):
            following = []
            for node, rows in level:
                g, h = grad[rows].sum(), hess[rows].sum()
                parts[node][4] = -rate * g / (h + ridge)
                split = _best_split(flat[rows], grad[rows], hess[rows], n_features, bins, least, ridge) if d < depth and len(rows) >= 2 * least else None
                if split is None:
                    margin[rows] += parts[node][4]
                    continue
                f, cut = split
                goes = binned[rows, f] > cut
                a, b = len(parts), len(parts) + 1
                parts += [[0, np.inf, a, a, 0.0], [0, np.inf, b, b, 0.0]]
                parts[node][:4] = [f, cuts[f][cut], a, b]
                following += [(a, rows[~goes]), (b, rows[goes])]
            level = following
    columns = list(zip(*parts))
    return Forest(base, *(np.array(c, t) for c, t in zip(columns, (np.int64, np.float64, np.int64, np.int64, np.float64))), np.array(roots), depth)


def _best_split(flat, grad, hess, n_features, bins, least, ridge):
    """(feature, last bin on the left) of the largest gain, or None."""
    cells = n_features * bins
    spread = flat.ravel()
    g = np.bincount(spread, np.repeat(grad, n_features), cells).reshape(n_features, bins).cumsum(axis=1)
    h = np.bincount(spread, np.repeat(hess, n_features), cells).reshape(n_features, bins).cumsum(axis=1)
    c = np.bincount(spread, minlength=cells).reshape(n_features, bins).cumsum(axis=1)
    all_g, all_h, all_c = g[:, -1:], h[:, -1:], c[:, -1:]
    gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
    gain[(c < least) | (all_c - c < least)] = -np.inf
    gain[:, -1] = -np.inf
    at = int(gain.argmax())
    return divmod(at, bins) if gain.flat[at] > 1e-6 else None


def statistics_table(docs: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, any ``keep`` columns, and the array of statistics of every row."""
    runtime.ship(docs.sparkSession)
    chosen = docs.select("text", F.col("doc_id").cast("bigint").alias("doc_id"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:]) + ", statistics array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.array([statistics(text.as_py()) for text in batch.column(0)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], rows], names=[*batch.schema.names[1:], "statistics"])

    return chosen.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, *, learn: Column | None = None, sample_rows: int = 20_000, **settings) -> Forest:
    """Learn ``labels.quality`` from the texts of labelled rows that ``learn`` admits."""
    told = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    told = told.filter(learn) if learn is not None else told
    n = told.count()
    if n > sample_rows:
        told = told.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * sample_rows / n))
    told = told.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # At most sample_rows ids in expectation, so this side's size has a bound.
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(told), "doc_id")
    rows = statistics_table(texts, keep=("quality",)).groupBy("doc_id").agg(F.min_by("statistics", F.xxhash64("statistics")).alias("statistics"), F.max("quality").alias("quality")).toArrow().sort_by("doc_id")
    x = np.array(rows.column("statistics").to_pylist(), np.float64).reshape(-1, len(STATISTICS))
    return fit_forest(x, np.array(rows.column("quality").to_pylist(), np.float64), **settings)


def classify(docs: DataFrame, forest: Forest, *, keep: tuple[str, ...] = (), cut: float = 0.3) -> DataFrame:
    """doc_id, any ``keep`` columns, score and predicted of every row."""
    runtime.ship(docs.sparkSession)
    chosen = docs.select("text", F.col("doc_id").cast("bigint").alias("doc_id"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:]) + ", score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(text.as_py()) for text in batch.column(0)], np.float64).reshape(-1, len(STATISTICS))
            score = forest.scores(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score), pa.array((score >= cut).astype(np.int32))], names=[*batch.schema.names[1:], "score", "predicted"])

    return chosen.mapInArrow(run, schema)


__all__ = ["Forest", "STATISTICS", "classify", "fit", "fit_forest", "held_out", "statistics", "statistics_table"]
