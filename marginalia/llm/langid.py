"""Language identification of whole texts, with spans for mixed-language text.

Each word's script, found in a table of code-point ranges, narrows the learned
languages to those written in it; letter trigrams then score the word under
each candidate, and a Viterbi pass with a penalty for switching labels every
word, so a text falls into spans.  The language that holds most letters is the
document's.

The model is fitted on at most ``rows_per_language`` documents of each
language in expectation, chosen by a hash of the id (the documented bound);
trigram counts are summed by Spark.  Every language that labels a row is
learned, one row of sizes each.  Of each language's trigrams the
``grams_per_language`` most used are kept, whatever the other languages have;
the scripts a language is written in are counted apart and all kept.  Scoring is
a map over Arrow batches: nothing is shuffled.  Within a batch the Viterbi steps
run over many documents at once, longest first.

Defined results: null text, or text without a letter (Unicode category L;
numerals are none), is ``und`` with score 0; so is any text where no language
was learned.  Letters in no learned script score every language alike.
Repeated rows give repeated results, an empty table none; a null id counts as
not held out; columns other than doc_id, text and (for learning) lang are
ignored.  Ties go to the language that sorts first.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia import runtime

#: First code points of script ranges (fixed values); a range lasts to the next.
SCRIPT_RANGES = [
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"),
    (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"),
    (0x0780, "Other"), (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"),
    (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"),
    (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"),
    (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1C80, "Cyrillic"),
    (0x1C90, "Georgian"), (0x1CC0, "Other"), (0x1D00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x2DE0, "Cyrillic"),
    (0x2E00, "Other"), (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Bopomofo"),
    (0x3130, "Hangul"), (0x3190, "Other"), (0x31F0, "Kana"), (0x3200, "Other"),
    (0x3400, "Han"), (0xA000, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"),
    (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD800, "Other"),
    (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"),
    (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF21, "Latin"), (0xFF66, "Kana"),
    (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"), (0x32000, "Other"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})
_STARTS = [first for first, _ in SCRIPT_RANGES]
_SCRIPT_AT = [SCRIPTS.index(name) for _, name in SCRIPT_RANGES]
#: A word is a letter and the letters and marks (vowel signs, accents) after it.
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: The same where a text stays in the first two Latin blocks and their extensions.
_LATIN_WORD = re.compile(r"[^\W\d_²³¹¼½¾]+")
_BEYOND_LATIN = re.compile("[^\x00-ɏ]")
#: Rows of an Arrow batch that are labelled and handed on at a time.
_SLICE = 1024
UNDETERMINED = "und"
_BARRED = -1e4


def words_of(text: str) -> list[str]:
    """Lower-cased words, over the whole text."""
    low = text.lower()
    return (_WORD if _BEYOND_LATIN.search(low) else _LATIN_WORD).findall(low)


def script_of(word: str) -> int:
    return _SCRIPT_AT[max(0, bisect_right(_STARTS, ord(word[0])) - 1)]


def grams_of(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + 3] for i in range(len(word))]


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's text leaves ``remainder``; the null id's text is empty."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


@dataclass
class Model:
    """Trigram log-probabilities per language, and the scripts each is written in."""

    languages: list[str]
    grams: dict[str, int]
    scores: np.ndarray  # (grams + 1, languages); the last row is for unseen grams
    allowed: np.ndarray  # (scripts, languages)
    penalty: float = 12.0
    usual: np.ndarray | None = None  # (languages, 3): least per-letter score of long texts, spread of a letter, letters seen
    index: dict[str, int] = field(default_factory=dict, repr=False)
    table: np.ndarray | None = field(default=None, repr=False)

    def emission(self, words: list[str]) -> np.ndarray:
        """A row of scores per word, from a bounded cache of distinct words."""
        fresh = list(set(words) - self.index.keys())
        if self.table is None or len(self.index) + len(fresh) > 300_000:
            self.index, fresh = {}, list(set(words))
            self.table = np.zeros((0, len(self.languages)), np.float32)
        if fresh:
            for word in fresh:
                self.index[word] = len(self.index)
            self.table = np.concatenate([self.table, self._score(fresh)])
        return self.table[np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))]

    def _score(self, words: list[str]) -> np.ndarray:
        unseen, find = len(self.grams), self.grams.get
        ids = [find(g, unseen) for w in words for g in grams_of(w)]
        starts = np.concatenate([[0], np.cumsum([len(w) for w in words])[:-1]])
        out = np.add.reduceat(self.scores[ids], starts, axis=0)
        allowed = self.allowed[[script_of(w) for w in words]]
        known = allowed.any(axis=1, keepdims=True)
        return np.where(known, np.where(allowed, out, _BARRED), 0).astype(np.float32)


def fit(docs: DataFrame, *, learn: Column | None = None, rows_per_language: int = 3000, grams_per_language: int = 20_000, ranges: bool = False) -> Model:
    """Learn from text and lang of the rows that ``learn`` admits (null: all).

    ``ranges`` scores the sample once more for the model's ``usual`` range.
    """
    spark = docs.sparkSession
    runtime.ship(spark)
    usable = F.col("lang").isNotNull() & F.col("text").isNotNull()
    rows = docs.filter(usable & learn if learn is not None else usable).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    sizes = rows.groupBy("lang").count().collect()  # one row per language
    if not sizes:
        return Model([], {}, np.zeros((1, 0)), np.zeros((len(SCRIPTS), 0), bool))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, rows_per_language / r["count"]))])
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.filter(spot < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                mine = by.setdefault(lang, Counter())
                for word, n in Counter(words_of(text.as_py())).items():
                    mine[f"\0{script_of(word)}"] += n * len(word)
                    for gram in grams_of(word):
                        mine[gram] += n
            flat = [(lang, gram, n) for lang, mine in by.items() for gram, n in mine.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in flat], pa.string()), pa.array([r[1] for r in flat], pa.string()), pa.array([r[2] for r in flat], pa.int64())], names=["lang", "gram", "n"])

    counts = sample.select("lang", "text").mapInArrow(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = runtime.materialize(counts.withColumn("script", F.col("gram").startswith("\0")), "grams")
    used = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    most = counts.filter(~F.col("script")).withColumn("place", F.row_number().over(used)).filter(F.col("place") <= grams_per_language)
    kept = counts.filter("script").select("lang", "gram", "n").union(most.select("lang", "gram", "n")).orderBy("lang", "gram").toArrow()
    languages = sorted({r["lang"] for r in sizes})
    place = {lang: k for k, lang in enumerate(languages)}
    grams: dict[str, int] = {}
    cells: list[tuple[int, int, int]] = []
    letters = np.zeros((len(SCRIPTS), len(languages)))
    for lang, gram, n in zip(*(kept.column(c).to_pylist() for c in ("lang", "gram", "n"))):
        if gram[0] == "\0":
            letters[int(gram[1:]), place[lang]] += n
        else:
            cells.append((grams.setdefault(gram, len(grams)), place[lang], n))
    table = np.full((len(grams) + 1, len(languages)), 0.5)
    for g, k, n in cells:
        table[g, k] += n
    with np.errstate(invalid="ignore", divide="ignore"):
        allowed = np.nan_to_num(letters / letters.sum(axis=0)) >= 0.02
    model = Model(languages, grams, np.log(table / table.sum(axis=0)), allowed)
    if ranges:
        model.usual = usual_range(sample, model)
    return model


def usual_range(sample: DataFrame, model: Model) -> np.ndarray:
    """Per language of ``sample``: the least usual per-letter score of a long text, and the spread of one letter's.

    The least is six quartile ranges below the median text; the spread is that
    of words around their text, for texts of few letters.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, (words, emission, _) in zip(batch.column(0).to_pylist(), label_texts((t.as_py() for t in batch.column(1)), model)):
                own = emission[:, model.languages.index(lang)].astype(np.float64)
                sizes = np.fromiter(map(len, words), np.int64, len(words))
                used = (own != 0) & (own > _BARRED)
                own, sizes = own[used], sizes[used]
                if len(own):
                    mean = own.sum() / sizes.sum()
                    rows.append((lang, mean, float(((own - mean * sizes) ** 2).sum()), int(sizes.sum())))
            columns = list(zip(*rows)) if rows else [[]] * 4
            kinds = [pa.string(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "mean", "off", "letters"])

    scored = sample.select("lang", "text").mapInArrow(score, "lang string, mean double, off double, letters bigint")
    out = np.zeros((len(model.languages), 3))
    for r in scored.groupBy("lang").agg(F.percentile_approx("mean", [0.25, 0.5, 0.75], 10_000).alias("q"), F.sum("off").alias("off"), F.sum("letters").alias("letters")).collect():
        low, middle, high = r["q"]
        out[model.languages.index(r["lang"])] = (middle - 6 * (high - low), np.sqrt(r["off"] / r["letters"]), r["letters"])
    return out


def viterbi(emission: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word; documents lie one after another in ``emission``.

    Step t moves all documents longer than t at once: with documents sorted by
    length these are a leading block of the state matrix.
    """
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    steps = int(lengths[0]) if len(lengths) else 0
    running = np.searchsorted(-lengths, -np.arange(steps), side="left")
    labels = np.zeros(len(emission), np.int16)
    if not steps:
        return labels
    n = int(running[0])
    state = emission[starts[:n]].astype(np.float64)
    begin = np.concatenate([[0], np.cumsum(running)])
    source = np.empty(begin[-1], np.int16)
    switched = np.empty((begin[-1], emission.shape[1]), bool)
    lanes = np.arange(n)
    for t in range(1, steps):
        a = running[t]
        now, top = state[:a], state[:a].argmax(axis=1)
        peak = now[lanes[:a], top][:, None]
        moved = peak - penalty > now
        span = slice(begin[t], begin[t] + a)
        source[span], switched[span] = top, moved
        state[:a] = np.where(moved, -penalty, now - peak) + emission[starts[:a] + t]
    at = state.argmax(axis=1)
    labels[starts[:n] + lengths[:n] - 1] = at
    for t in range(steps - 1, 0, -1):
        a = running[t]
        mine = at[:a]
        at[:a] = np.where(switched[begin[t] + lanes[:a], mine], source[begin[t] : begin[t] + a], mine)
        labels[starts[:a] + t - 1] = at[:a]
    return labels


def label_texts(texts: Iterable[str | None], model: Model, most_cells: int = 2_000_000) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """(words, emission rows, labels) of each text, some documents at a time."""
    held: list[list[str]] = []
    cells = 0

    def flush():
        lengths = np.array([len(w) for w in held], np.int64)
        emission = model.emission([w for words in held for w in words])
        labels = viterbi(emission, lengths, model.penalty)
        at = 0
        for words in held:
            yield words, emission[at : at + len(words)], labels[at : at + len(words)]
            at += len(words)

    for text in texts:
        held.append(words_of(text) if text and model.languages else [])
        cells += len(held[-1]) * max(1, len(model.languages))
        if cells > most_cells:
            yield from flush()
            held, cells = [], 0
    if held:
        yield from flush()


def decide(words: list[str], emission: np.ndarray, labels: np.ndarray, model: Model) -> tuple[str, float]:
    """The language with most letters, and its share of letters times its posterior."""
    if not words:
        return UNDETERMINED, 0.0
    letters = np.bincount(labels, weights=np.fromiter(map(len, words), np.int64, len(words)), minlength=len(model.languages))
    best = int(letters.argmax())
    total = emission.sum(axis=0, dtype=np.float64)
    certain = 1.0 / np.exp(np.clip(total - total[best], -700, 700)).sum()
    return model.languages[best], round(float(letters[best] / letters.sum()) * max(float(certain), 0.5 if letters[best] * 2 > letters.sum() else 0.0), 6)


def evidence(words: list[str], emission: np.ndarray, labels: np.ndarray, model: Model) -> float:
    """The share of letters of the language with most, or 0 where its words do not look like it.

    Letters in scripts of no learned language count for none; where they are
    the larger part, nothing stands out.  The words' per-letter score must lie
    in the range usual for the language, four spreads wider for few letters.
    """
    if not words:
        return 0.0
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    known = emission.any(axis=1)
    if 2 * sizes[known].sum() < sizes.sum():
        return 0.0
    letters = np.bincount(labels[known], weights=sizes[known], minlength=len(model.languages))
    best = int(letters.argmax())
    mine = known & (labels == best)
    least, spread, seen = model.usual[best]
    score = emission[mine, best].sum(dtype=np.float64) / letters[best]
    return float(letters[best] / sizes.sum()) if seen and score >= least - 4 * spread / np.sqrt(letters[best]) else 0.0


def identify(docs: DataFrame, model: Model, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, any ``keep`` columns, lang_pred and score of every row; evidence too if the model has ranges."""
    runtime.ship(docs.sparkSession)
    named = [F.col("text"), F.col("doc_id").cast("bigint").alias("doc_id"), *[F.col(k) for k in keep]]
    chosen = docs.select(*named)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:]) + ", lang_pred string, score double"
    if model.usual is not None:
        schema += ", evidence double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, _SLICE) for whole in batches for at in range(0, whole.num_rows, _SLICE)):
            got = [(*decide(*x, model), 0.0 if model.usual is None else evidence(*x, model)) for x in label_texts((t.as_py() for t in batch.column(0)), model)]
            more = {"lang_pred": pa.array([g[0] for g in got], pa.string()), "score": pa.array([g[1] for g in got], pa.float64())}
            if model.usual is not None:
                more["evidence"] = pa.array([g[2] for g in got], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *more.values()], names=[*batch.schema.names[1:], *more])

    return chosen.mapInArrow(run, schema)


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """One row per run of words with one label: doc_id, span, first_word, last_word, lang."""
    runtime.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, (words, _, labels) in zip(batch.column(0).to_pylist(), label_texts((t.as_py() for t in batch.column(1)), model)):
                edges = [0, *(np.flatnonzero(np.diff(labels)) + 1), len(words)] if words else []
                rows += [(doc_id, k, int(a), int(b) - 1, model.languages[labels[a]]) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "span", "first_word", "last_word", "lang"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, span int, first_word bigint, last_word bigint, lang string")
