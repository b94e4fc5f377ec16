"""The corpus pipeline: language ID, quality, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import runtime
from marginalia.llm import langid, near_copies, packing, quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose first language holds a smaller share of its letters, or does not look like it, is rejected.
LEAST_LANGUAGE_SHARE = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters or without a language that stands out.

    That is: most letters are in scripts of learned languages, and the words of
    the language with most letters score in the range usual for that language.
    Null and empty texts go.  Rows are judged each for itself: repeated rows and
    null ids share a verdict, an empty table gives none, further columns are
    dropped.  Where no row names a language there is nothing to judge by, and
    every document with a letter stays.
    """
    model = langid.fit(docs, learn=~langid.held_out(3, 1), ranges=True)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    told = langid.identify(docs, model, keep=("text", "lang", "source", "n_chars"))
    return told.filter(F.col("evidence") >= LEAST_LANGUAGE_SHARE).select(*COLUMNS)


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier predicts to be of low quality.

    Null texts are judged as empty ones.  Rows are judged each for itself:
    repeated rows and null ids share a verdict, an empty table gives none,
    further columns are dropped.  Without any label of 0 and 1 among the rows to
    learn from, every document scores the share of good labels (a half without
    labels) and stays unless that is below the cut.
    """
    forest = quality.fit(docs, runtime.table(spark, sf_dir, "labels"), learn=~quality.held_out(5, 0))
    return quality.classify(docs, forest, keep=("text", "lang", "source", "n_chars")).filter("predicted = 1").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate component, that with the smallest id.

    Near copies are texts whose five-word shingles have a Jaccard similarity of
    0.8 at least; all such pairs are found, by SimHash candidates first and an
    exact join for what lies beyond their radius.  Rows are told apart by all
    their columns, not by their id: copies without an id go like others, and a
    different text that repeats an id stays.  An id comes before none, then
    hashes of the text and of the row decide.  Null and empty texts are copies
    of each other; an empty table gives none; further columns are dropped.
    """
    return near_copies.first_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into training sequences.

    Null texts are packed as empty ones, whose only token is the end id; repeated
    rows and null ids are packed each for itself; an empty table gives none.
    """
    return packing.pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", judge_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("best_fit_packing", pack_sequences),
]

#: Models are learnt and fingerprints hashed on the way, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again by the next."""
    docs = runtime.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = runtime.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
