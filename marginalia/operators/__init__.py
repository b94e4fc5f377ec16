"""Relational operators over sources, entries and citations, as DataFrame code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from marginalia import functions as B
from marginalia import runtime
from marginalia.core import cite as _cite
from marginalia.core import library as _library


def _unfolded(df: DataFrame, rows: Column, source: str, outer: bool) -> DataFrame:
    """A row per element of ``rows`` beside the other columns.

    The generator is an outer one whose empty row is dropped by its position: an
    inner one lets the optimizer test the size of ``rows`` in a filter of its
    own, which parses every source once more, below any repartition.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c != source]
    at = df.select(*others, F.posexplode_outer(rows).alias("_at", "_row"))
    return (at if outer else at.filter("_at IS NOT NULL")).select(*others, "_row.*")


def explode_entries(df: DataFrame, source: str = "bibtex", *, fields=("key", "title", "doi", "volume"), recovery: str = "error", outer: bool = True) -> DataFrame:
    """A row per entry beside the row's other columns; ``outer`` keeps rows without entries."""
    return _unfolded(df, B.entries(source, fields=fields, recovery=recovery), source, outer)


def explode_blocks(df: DataFrame, source: str = "bibtex", *, outer: bool = False) -> DataFrame:
    """A row per raw block beside the row's other columns."""
    return _unfolded(df, B.raw_blocks(source), source, outer)


def explode_fields(df: DataFrame, source: str = "bibtex", *, columns=None, outer: bool = False) -> DataFrame:
    """A row per raw field beside the row's other columns; ``columns`` names the parts wanted."""
    return _unfolded(df, B.raw_fields(source, columns=columns), source, outer)


def plain_value(*columns: str) -> Column:
    """Letters and digits of the columns in lower case; empty where none of them has any."""
    parts = [F.lower(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[^\p{L}\p{N}]", "")) for c in columns]
    joined = F.concat_ws("\x1f", *parts)
    return F.when(F.length(F.replace(joined, F.lit("\x1f"), F.lit(""))) > 0, joined).otherwise("")


def duplicate_value(rule: str, *, key: str = "key", doi: str = "doi", abstract: str = "abstract", title: str = "title", author: str = "author", number: str = "number") -> Column:
    """What two entries share if they are duplicates under a rule; empty for none.

    ``key`` compares whole keys without case, ``doi`` letters and digits,
    ``abstract`` the first hundred of them, ``citation`` the first author's
    family name, the title and the number.
    """
    if rule == "key":
        return F.coalesce(F.lower(F.col(key)), F.lit(""))
    if rule == "doi":
        return plain_value(doi)
    if rule == "abstract":
        return F.substring(plain_value(abstract), 1, 100)
    if rule != "citation":
        raise ValueError(f"unknown duplicate rule {rule!r}")
    first = F.trim(F.split(F.trim(F.col(author)), r"\s+and\s+")[0])
    bare = F.split(F.regexp_replace(first, "[{}]", ""), r"\s+")
    family = F.when(first.contains(","), F.split(first, ",")[0]).otherwise(F.when(F.size(bare) > 1, F.array_join(F.slice(bare, 2, F.greatest(F.size(bare) - 1, F.lit(1))), " ")).otherwise(bare[0]))
    plain = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]", ""))
    whole = F.concat_ws(":", plain(family), plain(F.col(title)), plain(F.coalesce(F.col(number).cast("string"), F.lit("0"))))
    return F.when((F.length(F.coalesce(F.col(author), F.lit(""))) > 0) & (F.length(F.coalesce(F.col(title), F.lit(""))) > 0), whole).otherwise("")


def dedupe_entries(entries: DataFrame, by: Sequence[str], order: str, *, value: Column | None = None) -> DataFrame:
    """First row of each group of equal ``by`` values (or ``value``); rows with an empty value all stay.

    One aggregation: the first row of a group is combined before the shuffle, so
    a value that very many rows share is no hot task.  Equal orders go to the
    smaller row, a null order comes last.
    """
    names = entries.columns
    whole = F.struct(*[F.col(f"`{c}`") for c in names])
    shared = value if value is not None else plain_value(*by)
    told = entries.select(whole.alias("_row"), shared.alias("_value"), F.struct(F.col(order).isNull().alias("last"), F.col(order).alias("at"), F.xxhash64(*[F.col(f"`{c}`") for c in names]).alias("then")).alias("_place"))
    # A row without a value is a group of its own.
    alone = F.when(F.col("_value") == "", F.monotonically_increasing_id())
    return told.withColumn("_alone", alone).groupBy("_value", "_alone").agg(F.min_by("_row", "_place").alias("_row")).select("_row.*")


def letters(position: Column) -> Column:
    """a to z for positions from zero, then aa, ab and on."""
    place, marks, code = position.cast("bigint"), F.lit(None).cast("string"), None
    below, step = 0, 26
    for width in range(1, 8):
        digits = F.lpad(F.conv((place - F.lit(below)).cast("string"), 10, 26), width, "0")
        shown = F.translate(digits, "0123456789ABCDEFGHIJKLMNOP", "abcdefghijklmnopqrstuvwxyz")
        code = (code if code is not None else F).when(place < F.lit(below + step), shown)
        below, step = below + step, step * 26
    return code.otherwise(marks)


def disambiguate(citations: DataFrame, by: Sequence[str], order: str, column: str = "suffix") -> DataFrame:
    """Letters for each row of a group of more than one, by ``order``; empty alone."""
    ordered, whole = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*by)
    return citations.withColumn(column, F.when(F.count("*").over(whole) > 1, letters(F.row_number().over(ordered) - 1)).otherwise(F.lit("")))


def number_citations(citations: DataFrame, document: str, key: str, order: str, column: str = "number") -> DataFrame:
    """Numbers by first citation within each document; a null key or document counts like any other."""
    first = citations.groupBy(F.col(document).alias("_doc"), F.col(key).alias("_key")).agg(F.min(order).alias("_first"))
    numbered = first.withColumn(column, F.row_number().over(Window.partitionBy("_doc").orderBy(F.col("_first").asc_nulls_last(), "_key"))).drop("_first")
    same = F.col(document).eqNullSafe(F.col("_doc")) & F.col(key).eqNullSafe(F.col("_key"))
    return citations.join(numbered, same).drop("_doc", "_key")


def number_by_sort(entries: DataFrame, document: str, by: Sequence[str], position: str, column: str = "number") -> DataFrame:
    """Numbers by the bibliography's sort within each document, ties by position."""
    return entries.withColumn(column, F.row_number().over(Window.partitionBy(document).orderBy(*_sort_keys(by), F.col(position))))


def citation_positions(citations: DataFrame, document: str, key: str, order: str, column: str = "position") -> DataFrame:
    """Whether each citation is the first of its key in the document or a subsequent one."""
    nth = F.row_number().over(Window.partitionBy(document, key).orderBy(order))
    return citations.withColumn(column, F.when(nth == 1, "first").otherwise("subsequent"))


def _sort_keys(by: Sequence[str]) -> list[Column]:
    return [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in by]


def sort_entries(entries: DataFrame, by: Sequence[str], position: str) -> DataFrame:
    """Rows by several keys (``-`` in front: descending), missing values last, ties by position."""
    return entries.orderBy(*_sort_keys(by), F.col(position))


def assign_keys(entries: DataFrame, base: Sequence[str], within: Sequence[str], order: str, column: str = "new_key") -> DataFrame:
    """Keys from lower-cased columns, numbered from one where they collide."""
    plain = entries.withColumn("_base", F.lower(F.regexp_replace(F.concat_ws("", *base), r"[^\p{L}\p{N}]", "")))
    group = Window.partitionBy(*within, "_base")
    suffix = F.when(F.count("*").over(group) > 1, F.row_number().over(group.orderBy(order)).cast("string")).otherwise("")
    return plain.withColumn(column, F.concat("_base", suffix)).drop("_base")


def lookup(citations: DataFrame, entries: DataFrame, on: Sequence[str]) -> DataFrame:
    """Each citation with its entry's columns, null where the key is missing."""
    return citations.join(entries, list(on), "left")


def missing_references(citations: DataFrame, entries: DataFrame, on: Sequence[str]) -> DataFrame:
    return citations.join(entries, list(on), "left_anti")


def render_documents(citations: DataFrame, libraries: DataFrame, *, style: str = "apa", recovery: str = "error") -> DataFrame:
    """All citations of each document, in order, against its library.

    ``citations(doc_id, ord, key, locator)`` and ``libraries(doc_id, bibtex)``
    give ``doc_id, ord, text, html, bibliography, error``; the first row of a
    document carries the bibliography of what it cites.  A document is one group.

    Every citation gives a row.  Where a document has no library or several, a
    library that does not parse, or a key that is null or missing, its rows are
    null but for the reason in ``error``.  Rows without ``ord`` come last.
    """
    runtime.ship(citations.sparkSession)
    of, strict = _cite.style(style), B._strict(recovery)
    shown = T.StructType().add("ord", T.IntegerType()).add("text", T.StringType()).add("html", T.StringType()).add("bibliography", T.StringType()).add("error", T.StringType())

    def rendered(rows: list[tuple], sources: list[str | None]) -> list[tuple]:
        if len(sources) != 1:
            raise LookupError("the document has no library" if not sources else f"the document has {len(sources)} libraries")
        if any(key is None for _, key, _ in rows):
            raise LookupError("a citation has no key")
        library = _library.parse_bibtex(sources[0] or "", strict)
        done, listed = _cite.render_document(library, [(str(i), [_cite.Cite(key, at)]) for i, (_, key, at) in enumerate(rows)], of)
        return [(r.text, r.html, None if i else listed.text, None) for i, (_, r) in enumerate(done)]

    def run(cited: list[dict], held: list[dict]) -> list[tuple]:
        rows = sorted([(c["ord"], c["key"], c["locator"]) for c in cited], key=lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2] or ""))
        try:
            out = rendered(rows, [h["bibtex"] for h in held]) if rows else []
        except (_library.ParseFailure, LookupError) as error:
            reason = f'missing reference "{error.args[0]}"' if isinstance(error, KeyError) else str(error)
            out = [(None, None, None, reason)] * len(rows)
        return [(row[0], *told) for row, told in zip(rows, out)]

    # Documents are rows of one aggregation and many go to Python at once: a group of its own for each costs more than its rendering.
    cite = F.struct(F.col("ord").cast("int").alias("ord"), F.col("key").cast("string").alias("key"), F.col("locator").cast("string").alias("locator"))
    library = F.struct(F.col("bibtex").cast("string").alias("bibtex"))
    cited = citations.select(F.col("doc_id").cast("bigint").alias("doc_id"), cite.alias("cite"))
    held = libraries.select(F.col("doc_id").cast("bigint").alias("doc_id"), library.alias("library"))
    each = cited.unionByName(held, allowMissingColumns=True).groupBy("doc_id").agg(F.collect_list("cite").alias("cites"), F.collect_list("library").alias("libraries"))
    return _unfolded(each, B._apply_rows(run, shown, "cites", "libraries"), "cites", False).drop("libraries")
