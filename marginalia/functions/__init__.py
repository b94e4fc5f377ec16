"""The column functions: parse, inspect, cite, bibliography, format, edit.

Each capability is one deterministic Arrow UDF that returns a wide struct; the
narrow functions read its fields, so Catalyst evaluates a source once per
capability.  A worker keeps recently parsed sources, so a literal source beside
a column of keys is parsed once.
"""

from __future__ import annotations

import dataclasses
import functools
import inspect
import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from marginalia import runtime
from marginalia.core import cite as _cite
from marginalia.core import library as _library
from marginalia.core import scan as _scan
from marginalia.core import tidy as _tidy

_TEXTS = T.ArrayType(T.StringType())
REPORT = T.StructType().add("ok", T.BooleanType()).add("entry_count", T.IntegerType()).add("keys", _TEXTS).add("diagnostics", _TEXTS)
RECOVERY = T.StructType([*REPORT, T.StructField("strict_ok", T.BooleanType())])
RENDERED = T.StructType().add("text", T.StringType()).add("html", T.StringType())
CITED = T.StructType().add("citation", RENDERED).add("bibliography", RENDERED)
_WARNING = T.StructType().add("code", T.StringType()).add("rule", T.StringType()).add("message", T.StringType())
TIDIED = T.StructType().add("ok", T.BooleanType()).add("bibtex", T.StringType()).add("count", T.IntegerType()).add("warnings", T.ArrayType(_WARNING)).add("error", T.StringType())
_ATOM = T.StructType().add("value", T.StringType()).add("value_mode", T.StringType())
BLOCK = T.StructType().add("block_no", T.IntegerType()).add("kind", T.StringType()).add("raw", T.StringType()).add("value", T.StringType()).add("key", T.StringType()).add("error", T.StringType()).add("span_start", T.IntegerType()).add("span_end", T.IntegerType())
FIELD = T.StructType().add("entry_no", T.IntegerType()).add("key", T.StringType()).add("kind", T.StringType()).add("field_no", T.IntegerType()).add("name", T.StringType()).add("value", T.StringType()).add("value_mode", T.StringType()).add("atoms", T.ArrayType(_ATOM)).add("span_start", T.IntegerType()).add("span_end", T.IntegerType())


def _column(given) -> Column:
    """A column as it is, a name as that column, anything else as a literal."""
    return given if isinstance(given, Column) else F.col(given) if isinstance(given, str) else F.lit(given)


def _strict(recovery: str) -> bool:
    if recovery not in ("error", "report"):
        raise ValueError(f"recovery must be 'error' or 'report', not {recovery!r}")
    return recovery == "error"


#: A worker keeps parsed sources of up to so many characters only: 64 of them are small beside a batch of rows.
KEPT_LENGTH = 20_000


def _keeping(parse: Callable) -> Callable:
    """``parse``, with recent results kept for sources of :data:`KEPT_LENGTH` at most, and the last one whatever its length."""
    short, last = functools.lru_cache(maxsize=64)(parse), functools.lru_cache(maxsize=1)(parse)

    @functools.wraps(parse)
    def read(source: str, *how):
        if len(source) <= KEPT_LENGTH:
            return short(source, *how)
        return last(source, *how)

    read.short, read.last = short, last
    return read


@_keeping
def _parsed(source: str, strict: bool) -> _library.Library | str:
    try:
        return _library.parse_bibtex(source, strict)
    except _library.ParseFailure as error:
        return str(error)


def _apply(work: Callable, returns: T.DataType, *columns) -> Column:
    if session := SparkSession.getActiveSession():
        runtime.ship(session)
    return F.udf(work, returns, useArrow=True)(*map(_column, columns))


#: Sources whose rows are held as Python objects at a time.
_TOGETHER = 256


def _apply_rows(read: Callable[..., list[tuple]], row: T.StructType, *columns) -> Column:
    """The rows that ``read`` makes of each row's values as an array of structs; null where the first of them is null.

    Columns of whole batches become Arrow arrays: value by value, their conversion takes longer than the reading.
    """
    names, kinds = row.names, [to_arrow_type(f.dataType) for f in row]
    schema = pa.list_(pa.struct([pa.field(n, k) for n, k in zip(names, kinds)]))

    def held(given: list[list]) -> pa.Array:
        offsets, rows = [], []
        for values in zip(*given):
            offsets.append(None if values[0] is None else len(rows))
            if values[0] is not None:
                rows += read(*values)
        parts = zip(*rows) if rows else [[]] * len(names)
        values = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(parts, kinds)], names=names)
        return pa.ListArray.from_arrays(pa.array([*offsets, len(rows)], pa.int32()), values).cast(schema)

    def work(*given: pa.Array) -> pa.Array:
        parts = [held([x.slice(at, _TOGETHER).to_pylist() for x in given]) for at in range(0, len(given[0]), _TOGETHER)]
        return pa.concat_arrays(parts) if parts else pa.array([], schema)

    if session := SparkSession.getActiveSession():
        runtime.ship(session)
    return F.arrow_udf(work, T.ArrayType(row))(*map(_column, columns))


# ---- parse and inspect ---------------------------------------------------


def _report(strict: bool) -> Callable:
    def work(source):
        if source is None:
            return (None, None, None, None)
        got = _parsed(source, strict)
        return (False, None, None, got.split("\n")) if isinstance(got, str) else (True, len(got.records), got.keys(), got.diagnostics)

    return work


def parse_report(bibtex, *, recovery: str = "error") -> Column:
    """ok, entry_count, keys and diagnostics of each source; four nulls for null."""
    return _apply(_report(_strict(recovery)), REPORT, bibtex).alias("parse_report")


def recovery_report(bibtex) -> Column:
    """The report of a reading with recovery, and whether a strict reading takes the source too: both from one scan."""

    def work(source):
        if source is None:
            return (None, None, None, None, None)
        try:
            got = _library.parse_bibtex(source, False)
        except _library.ParseFailure as error:
            return (False, None, None, str(error).split("\n"), error.valid)
        return (True, len(got.records), got.keys(), got.diagnostics, got.valid)

    return _apply(work, RECOVERY, bibtex).alias("recovery_report")


def entry_count(bibtex, *, recovery: str = "error") -> Column:
    return parse_report(bibtex, recovery=recovery)["entry_count"].alias("entry_count")


def can_parse(bibtex, *, recovery: str = "error") -> Column:
    return parse_report(bibtex, recovery=recovery)["ok"].alias("can_parse")


def has_diagnostics(bibtex, *, recovery: str = "error") -> Column:
    return (F.size(parse_report(bibtex, recovery=recovery)["diagnostics"]) > 0).alias("has_diagnostics")


def keys(bibtex, *, recovery: str = "error") -> Column:
    return parse_report(bibtex, recovery=recovery)["keys"].alias("keys")


def diagnostics(bibtex, *, recovery: str = "error") -> Column:
    return parse_report(bibtex, recovery=recovery)["diagnostics"].alias("diagnostics")


def _projected(fields) -> tuple[str, ...]:
    if isinstance(fields, str):
        raise TypeError("fields must be an iterable of names, not a string")
    fields = tuple(fields)
    for name in fields:
        if name not in _library.PROJECTIONS:
            raise ValueError(f'unsupported projection field "{name}"')
    return fields


def entries(bibtex, *, fields=("key", "title", "doi", "volume"), recovery: str = "error") -> Column:
    """Projection rows of each source; null where it does not parse."""
    fields, strict = _projected(fields), _strict(recovery)

    def work(source):
        got = None if source is None else _parsed(source, strict)
        return None if got is None or isinstance(got, str) else [tuple(r.project(f) for f in fields) for r in got.records]

    row = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    return _apply(work, T.ArrayType(row), bibtex).alias("entries")


def to_entry_json(bibtex, *, recovery: str = "error") -> Column:
    """A JSON array of normalised entries, each with id and key."""
    strict = _strict(recovery)

    def work(source):
        got = None if source is None else _parsed(source, strict)
        return None if got is None or isinstance(got, str) else got.to_json()

    return _apply(work, T.StringType(), bibtex).alias("to_entry_json")


@_keeping
def _parsed_yaml(source: str) -> _library.Library | str:
    try:
        return _library.parse_yaml(source)
    except _library.ParseFailure as error:
        return str(error)


def yaml_report(yaml) -> Column:
    """ok, entry_count, keys and diagnostics of each YAML source; four nulls for null."""

    def work(source):
        if source is None:
            return (None, None, None, None)
        got = _parsed_yaml(source)
        return (False, None, None, got.split("\n")) if isinstance(got, str) else (True, len(got.records), got.keys(), got.diagnostics)

    return _apply(work, REPORT, yaml).alias("yaml_report")


def yaml_entries(yaml, *, fields=("key", "title", "doi", "volume")) -> Column:
    """Projection rows of each YAML source; null where it does not parse."""
    fields = _projected(fields)

    def work(source):
        got = None if source is None else _parsed_yaml(source)
        return None if got is None or isinstance(got, str) else [tuple(r.project(f) for f in fields) for r in got.records]

    row = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    return _apply(work, T.ArrayType(row), yaml).alias("yaml_entries")


def yaml_to_entry_json(yaml) -> Column:
    """A JSON array of a YAML source's normalised entries."""

    def work(source):
        got = None if source is None else _parsed_yaml(source)
        return None if got is None or isinstance(got, str) else got.to_json()

    return _apply(work, T.StringType(), yaml).alias("yaml_to_entry_json")


def select_keys(bibtex, selector: str, *, recovery: str = "error") -> Column:
    """Keys of the entries that a selector such as ``article > periodical[volume]`` admits."""
    _library.select(_library.Library([], []), selector)
    strict = _strict(recovery)

    def work(source):
        got = None if source is None else _parsed(source, strict)
        return None if got is None or isinstance(got, str) else [r.key for r in _library.select(got, selector)]

    return _apply(work, _TEXTS, bibtex).alias("select_keys")


# ---- cite ----------------------------------------------------------------


def _both(rendered: _cite.Rendered | None):
    return None if rendered is None else (rendered.text, rendered.html)


def _citing(bibtex, wanted, render: Callable, returns: T.DataType, style: str, locale: str, recovery: str) -> Column:
    of, strict, language = _cite.style(style), _strict(recovery), _cite.locale(locale)

    def work(source, keys):
        if source is None or keys is None:
            return None
        got = _parsed(source, strict)
        return None if isinstance(got, str) else render(got, keys, of, language)

    return _apply(work, returns, bibtex, wanted)


def cite_rendered(bibtex, key, *, style="apa", locale="en-US", recovery="error") -> Column:
    """Text and HTML of the citation of one key; null for a missing key."""
    return _citing(bibtex, key, lambda lib, k, of, to: _both(_cite.cite_group(lib, [_cite.Cite(k)], of, language=to)), RENDERED, style, locale, recovery).alias("cite_rendered")


def cite(bibtex, key, *, style="apa", locale="en-US", recovery="error") -> Column:
    return cite_rendered(bibtex, key, style=style, locale=locale, recovery=recovery)["text"].alias("cite")


def cite_html(bibtex, key, *, style="apa", locale="en-US", recovery="error") -> Column:
    return cite_rendered(bibtex, key, style=style, locale=locale, recovery=recovery)["html"].alias("cite_html")


def cite_each_rendered(bibtex, keys, *, style="apa", locale="en-US", recovery="error") -> Column:
    """A citation per key of a list; null if any key is null or missing."""

    def render(lib, wanted, of, to):
        got = None if any(k is None for k in wanted) else _cite.cite_each(lib, list(wanted), of, to)
        return None if got is None else [_both(r) for r in got]

    return _citing(bibtex, keys, render, T.ArrayType(RENDERED), style, locale, recovery).alias("cite_each_rendered")


def cite_each(bibtex, keys, *, style="apa", locale="en-US", recovery="error") -> Column:
    return cite_each_rendered(bibtex, keys, style=style, locale=locale, recovery=recovery)["text"].alias("cite_each")


def cite_each_html(bibtex, keys, *, style="apa", locale="en-US", recovery="error") -> Column:
    return cite_each_rendered(bibtex, keys, style=style, locale=locale, recovery=recovery)["html"].alias("cite_each_html")


def cite_group_rendered(bibtex, keys, *, style="apa", locale="en-US", recovery="error") -> Column:
    """One citation of all keys of a list; empty for none."""

    def render(lib, wanted, of, to):
        return None if any(k is None for k in wanted) else _both(_cite.cite_group(lib, [_cite.Cite(k) for k in wanted], of, language=to))

    return _citing(bibtex, keys, render, RENDERED, style, locale, recovery).alias("cite_group_rendered")


def cite_group(bibtex, keys, *, style="apa", locale="en-US", recovery="error") -> Column:
    return cite_group_rendered(bibtex, keys, style=style, locale=locale, recovery=recovery)["text"].alias("cite_group")


def cite_group_html(bibtex, keys, *, style="apa", locale="en-US", recovery="error") -> Column:
    return cite_group_rendered(bibtex, keys, style=style, locale=locale, recovery=recovery)["html"].alias("cite_group_html")


def full_bibliography_rendered(bibtex, *, style="apa", locale="en-US", recovery="error") -> Column:
    """Text and HTML of all entries' bibliography."""
    return _citing(bibtex, F.lit(""), lambda lib, _, of, to: tuple(_cite.bibliography(lib.records, of, to)), RENDERED, style, locale, recovery).alias("full_bibliography_rendered")


def full_bibliography_text(bibtex, *, style="apa", locale="en-US", recovery="error") -> Column:
    return full_bibliography_rendered(bibtex, style=style, locale=locale, recovery=recovery)["text"].alias("full_bibliography_text")


def full_bibliography_html(bibtex, *, style="apa", locale="en-US", recovery="error") -> Column:
    return full_bibliography_rendered(bibtex, style=style, locale=locale, recovery=recovery)["html"].alias("full_bibliography_html")


def cite_and_list(bibtex, keys, *, style="apa", locale="en-US", recovery="error") -> Column:
    """One citation of all keys of a list, null if any is null or missing, and all entries' bibliography: from one reading."""

    def render(lib, wanted, of, to):
        if any(k is None for k in wanted):
            return None, tuple(_cite.bibliography(lib.records, of, to))
        cited, listed = _cite.cite_and_list(lib, [_cite.Cite(k) for k in wanted], of, to)
        return _both(cited), tuple(listed)

    return _citing(bibtex, keys, render, CITED, style, locale, recovery).alias("cite_and_list")


# ---- format and edit -----------------------------------------------------


def tidy_bibtex_report(bibtex, **options) -> Column:
    """ok, bibtex, count, warnings and error of formatting; a null struct for null."""
    chosen = _tidy.TidyOptions.check(**options)

    def work(source):
        if source is None:
            return None
        try:
            got = _tidy.tidy(source, chosen)
        except _tidy.TidySyntaxError as error:
            return (False, None, None, None, error.display())
        return (True, got.bibtex, got.count, [(w.code.lower(), w.rule, w.message) for w in got.warnings], None)

    return _apply(work, TIDIED, bibtex).alias("tidy_bibtex_report")


def tidy_bibtex(bibtex, **options) -> Column:
    return tidy_bibtex_report(bibtex, **options)["bibtex"].alias("tidy_bibtex")


@functools.lru_cache(maxsize=64)
def _chosen(options: str) -> _tidy.TidyOptions:
    """Options given as JSON."""
    return _tidy.TidyOptions.check(**json.loads(options))


#: The formatting functions take the options by name, and say so.
_OPTIONS = [inspect.Parameter(f.name, inspect.Parameter.KEYWORD_ONLY, default=f.default) for f in dataclasses.fields(_tidy.TidyOptions)]
for _function in (tidy_bibtex, tidy_bibtex_report):
    _function.__signature__ = inspect.Signature([inspect.Parameter("bibtex", inspect.Parameter.POSITIONAL_OR_KEYWORD), *_OPTIONS], return_annotation=Column)


def _blocks(source: str) -> list[tuple]:
    blocks = _scan.scan(source)
    at = _scan.byte_spans(source, [p for b in blocks for p in (b.start, b.end)])
    return [(i, b.kind, b.raw, b.value, b.key, b.error, at[b.start], at[b.end]) for i, b in enumerate(blocks)]


#: What each column of a field row is, from (entry number, entry, field number, field, byte positions).
_FIELD_PARTS = {
    "entry_no": lambda i, e, k, f, at: i,
    "key": lambda i, e, k, f, at: e.key,
    "kind": lambda i, e, k, f, at: e.kind,
    "field_no": lambda i, e, k, f, at: k,
    "name": lambda i, e, k, f, at: f.name,
    "value": lambda i, e, k, f, at: f.value,
    "value_mode": lambda i, e, k, f, at: f.mode,
    "atoms": lambda i, e, k, f, at: [(a.value, a.mode) for a in f.atoms],
    "span_start": lambda i, e, k, f, at: at[f.start],
    "span_end": lambda i, e, k, f, at: at[f.end],
}


def _field_rows(source: str, wanted: tuple[str, ...] = tuple(_FIELD_PARTS)) -> list[tuple]:
    found = [b.entry for b in _scan.scan(source) if b.entry]
    spans = any(w.startswith("span") for w in wanted)
    at = _scan.byte_spans(source, [p for e in found for f in e.fields for p in (f.start, f.end)]) if spans else {}
    parts = [_FIELD_PARTS[w] for w in wanted]
    return [tuple([part(i, e, k, f, at) for part in parts]) for i, e in enumerate(found) for k, f in enumerate(e.fields)]


def raw_blocks(bibtex) -> Column:
    """Blocks of each raw source with kinds and byte spans."""
    return _apply_rows(_blocks, BLOCK, bibtex).alias("raw_blocks")


def raw_fields(bibtex, *, columns=None) -> Column:
    """Fields of each raw source, duplicates included, with byte spans of their inner text.

    ``columns`` names the parts of :data:`FIELD` to build; all by default.
    """
    wanted = tuple(_FIELD_PARTS) if columns is None else tuple(columns)
    if bad := [w for w in wanted if w not in _FIELD_PARTS]:
        raise ValueError(f"unknown field column {bad[0]!r}")
    row = T.StructType([FIELD[w] for w in wanted])
    return _apply_rows(lambda source: _field_rows(source, wanted), row, bibtex).alias("raw_fields")


def set_field(bibtex, key, field, value) -> Column:
    """Each source with one field's value replaced; null where it cannot be."""

    def work(source, key, field, value):
        try:
            return None if None in (source, key, field, value) or _scan.refused(value) else _scan.set_field(source, key, field, value)
        except (KeyError, IndexError, ValueError):
            return None

    return _apply(work, T.StringType(), bibtex, key, field, value).alias("set_field")


NAMES = (
    "entry_count", "can_parse", "has_diagnostics", "keys", "entries", "diagnostics", "parse_report", "recovery_report", "to_entry_json",
    "cite", "cite_html", "cite_rendered", "cite_each", "cite_each_html", "cite_each_rendered", "cite_group", "cite_group_html", "cite_group_rendered", "cite_and_list",
    "full_bibliography_text", "full_bibliography_html", "full_bibliography_rendered", "tidy_bibtex", "tidy_bibtex_report",
    "yaml_report", "yaml_entries", "yaml_to_entry_json", "select_keys", "raw_blocks", "raw_fields", "set_field",
)


class Namespace:
    """``column.bib.cite("key")``: the functions with the column as their source."""

    def __init__(self, column: Column):
        self._column = column

    def __getattr__(self, name: str):
        if name not in NAMES:
            raise AttributeError(name)
        return functools.partial(globals()[name], self._column)


def install() -> None:
    """Give every column the ``bib`` namespace."""
    Column.bib = property(Namespace)


def register(spark: SparkSession, prefix: str = "bib_") -> None:
    """All functions for SQL, and three table functions.

    Wide functions are Arrow UDFs that take their options as arguments
    (``strict``, or ``style`` and ``strict``); narrow ones are SQL functions
    over their fields: ``bib_cite(source, key, style => 'ieee')``.  Formatting takes
    its options as JSON: ``bib_tidy_bibtex(source, '{"sort": ["-year"]}')``.
    """
    runtime.ship(spark)

    def report(source, strict):
        return _report(strict)(source)

    def as_json(source, strict):
        got = None if source is None else _parsed(source, strict)
        return None if got is None or isinstance(got, str) else got.to_json()

    def listed(source, strict):
        got = None if source is None else _parsed(source, strict)
        return None if got is None or isinstance(got, str) else [tuple(r.project(f) for f in ("key", "entry_type", "title", "doi", "volume")) for r in got.records]

    def rendering(render):
        def work(source, wanted, style, strict):
            got = None if source is None or wanted is None else _parsed(source, strict)
            return None if got is None or isinstance(got, str) else render(got, wanted, _cite.style(style))

        return work

    def each(lib, wanted, of):
        got = None if any(k is None for k in wanted) else _cite.cite_each(lib, list(wanted), of)
        return None if got is None else [_both(r) for r in got]

    def group(lib, wanted, of):
        return None if any(k is None for k in wanted) else _both(_cite.cite_group(lib, [_cite.Cite(k) for k in wanted], of))

    def formatted(source, options):
        if source is None:
            return None
        try:
            got = _tidy.tidy(source, _chosen(options or "{}"))
        except _tidy.TidySyntaxError as error:
            return (False, None, None, None, error.display())
        return (True, got.bibtex, got.count, [(w.code.lower(), w.rule, w.message) for w in got.warnings], None)

    def selected(source, selector, strict):
        got = None if source is None or selector is None else _parsed(source, strict)
        return None if got is None or isinstance(got, str) else [r.key for r in _library.select(got, selector)]

    def edited(source, key, name, value):
        try:
            return None if None in (source, key, name, value) else _scan.set_field(source, key, name, value)
        except (KeyError, IndexError, ValueError):
            return None

    def as_yaml(source):
        got = None if source is None else _parsed_yaml(source)
        return None if got is None or isinstance(got, str) else got.to_json()

    row = T.StructType([T.StructField(f, T.StringType()) for f in ("key", "entry_type", "title", "doi", "volume")])
    wide = {
        "select_keys_of": (selected, _TEXTS),
        "set_field": (edited, T.StringType()),
        "yaml_to_entry_json": (as_yaml, T.StringType()),
        "parse_report_of": (report, REPORT),
        "to_entry_json_of": (as_json, T.StringType()),
        "entries_of": (listed, T.ArrayType(row)),
        "cite_of": (rendering(lambda lib, k, of: _both(_cite.cite_group(lib, [_cite.Cite(k)], of))), RENDERED),
        "cite_each_of": (rendering(each), T.ArrayType(RENDERED)),
        "cite_group_of": (rendering(group), RENDERED),
        "full_bibliography_of": (rendering(lambda lib, _, of: tuple(_cite.bibliography(lib.records, of))), RENDERED),
        "tidy_bibtex_report_of": (formatted, TIDIED),
    }
    for name, (work, returns) in wide.items():
        spark.udf.register(prefix + name, F.udf(work, returns, useArrow=True))
    source, strict, styled = "s STRING", "strict BOOLEAN DEFAULT true", "style STRING DEFAULT 'apa', strict BOOLEAN DEFAULT true"
    options = "options STRING DEFAULT '{}'"
    one, many = f"{source}, k STRING, {styled}", f"{source}, k ARRAY<STRING>, {styled}"
    narrow = {
        "parse_report": (f"{source}, {strict}", f"{prefix}parse_report_of(s, strict)"),
        "entry_count": (f"{source}, {strict}", f"{prefix}parse_report_of(s, strict).entry_count"),
        "can_parse": (f"{source}, {strict}", f"{prefix}parse_report_of(s, strict).ok"),
        "keys": (f"{source}, {strict}", f"{prefix}parse_report_of(s, strict).keys"),
        "diagnostics": (f"{source}, {strict}", f"{prefix}parse_report_of(s, strict).diagnostics"),
        "has_diagnostics": (f"{source}, {strict}", f"size({prefix}parse_report_of(s, strict).diagnostics) > 0"),
        "entries": (f"{source}, {strict}", f"{prefix}entries_of(s, strict)"),
        "to_entry_json": (f"{source}, {strict}", f"{prefix}to_entry_json_of(s, strict)"),
        "cite_rendered": (one, f"{prefix}cite_of(s, k, style, strict)"),
        "cite": (one, f"{prefix}cite_of(s, k, style, strict).text"),
        "cite_html": (one, f"{prefix}cite_of(s, k, style, strict).html"),
        "cite_each_rendered": (many, f"{prefix}cite_each_of(s, k, style, strict)"),
        "cite_each": (many, f"{prefix}cite_each_of(s, k, style, strict).text"),
        "cite_each_html": (many, f"{prefix}cite_each_of(s, k, style, strict).html"),
        "cite_group_rendered": (many, f"{prefix}cite_group_of(s, k, style, strict)"),
        "cite_group": (many, f"{prefix}cite_group_of(s, k, style, strict).text"),
        "cite_group_html": (many, f"{prefix}cite_group_of(s, k, style, strict).html"),
        "full_bibliography_rendered": (f"{source}, {styled}", f"{prefix}full_bibliography_of(s, '', style, strict)"),
        "full_bibliography_text": (f"{source}, {styled}", f"{prefix}full_bibliography_of(s, '', style, strict).text"),
        "full_bibliography_html": (f"{source}, {styled}", f"{prefix}full_bibliography_of(s, '', style, strict).html"),
        "tidy_bibtex": (f"{source}, {options}", f"{prefix}tidy_bibtex_report_of(s, options).bibtex"),
        "tidy_bibtex_report": (f"{source}, {options}", f"{prefix}tidy_bibtex_report_of(s, options)"),
        "select_keys": (f"{source}, selector STRING, {strict}", f"{prefix}select_keys_of(s, selector, strict)"),
    }
    for name, (arguments, body) in narrow.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({arguments}) RETURN {body}")

    class Blocks:
        def eval(self, source: str):
            yield from _blocks(source) if source is not None else ()

    class Fields:
        def eval(self, source: str):
            yield from _field_rows(source) if source is not None else ()

    class Entries:
        def eval(self, source: str):
            yield from listed(source, True) or ()

    for name, work, returns in (("blocks", Blocks, BLOCK), ("fields", Fields, FIELD), ("entry_rows", Entries, row)):
        spark.udtf.register(prefix + name, F.udtf(work, returnType=returns))
