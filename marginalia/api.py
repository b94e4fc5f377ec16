"""Local objects for single documents; no Spark job is started by them."""

from __future__ import annotations

import functools
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

from marginalia.core import cite as _cite
from marginalia.core import library as _library
from marginalia.core import scan as _scan
from marginalia.core.tidy import TidyOptions, TidyResult, TidySyntaxError, tidy

Cite = _cite.Cite


class BibliographyError(Exception):
    """Base of what reading and rendering raise."""


class MissingReferenceError(BibliographyError, KeyError):
    pass


class TidyError(BibliographyError, TidySyntaxError):
    """A source that cannot be formatted."""


class Library:
    """Normalised entries in source order."""

    def __init__(self, inner: _library.Library):
        self._inner = inner

    @classmethod
    def read(cls, path: str | Path, *, recovery: str = "error") -> Library:
        suffix = Path(path).suffix.lower().lstrip(".")
        if not suffix:
            raise ValueError("bibliography path has no extension")
        if suffix not in ("bib", "yaml", "yml"):
            raise ValueError(f'unsupported bibliography extension "{suffix}"')
        text, notes = _library.decode(Path(path).read_bytes())
        notes = [f"{path}: {note}" for note in notes]
        got = cls.parse_yaml(text) if suffix != "bib" else cls.parse_bibtex(text, recovery=recovery)
        got._inner.diagnostics[:0] = notes
        return got

    @classmethod
    def parse_bibtex(cls, source: str, *, recovery: str = "error") -> Library:
        if recovery not in ("error", "report"):
            raise ValueError(f"recovery must be 'error' or 'report', not {recovery!r}")
        try:
            return cls(_library.parse_bibtex(source, recovery == "error"))
        except _library.ParseFailure as error:
            raise BibliographyError(str(error)) from None

    @classmethod
    def parse_yaml(cls, source: str) -> Library:
        try:
            return cls(_library.parse_yaml(source))
        except _library.ParseFailure as error:
            raise BibliographyError(str(error)) from None

    @property
    def diagnostics(self) -> list[str]:
        return list(self._inner.diagnostics)

    def keys(self) -> list[str]:
        return self._inner.keys()

    def values(self) -> list[_library.Record]:
        return list(self._inner.records)

    def get(self, key: str, default=None):
        return self._inner.find(key) or default

    def __getitem__(self, key: str) -> _library.Record:
        if (found := self._inner.find(key)) is None:
            raise KeyError(key)
        return found

    def __contains__(self, key: str) -> bool:
        return self._inner.find(key) is not None

    def __len__(self) -> int:
        return len(self._inner.records)

    def is_empty(self) -> bool:
        return not self._inner.records

    def get_many(self, keys: Iterable[str]) -> list[_library.Record]:
        if isinstance(keys, str):
            raise TypeError("keys must be an iterable of keys, not a string")
        return [self[k] for k in keys]

    def select(self, selector: str) -> list[_library.Record]:
        return _library.select(self._inner, selector)

    def project(self, fields: Iterable[str], *, keys: Iterable[str] | None = None) -> list[dict[str, str | None]]:
        if isinstance(fields, str):
            raise TypeError("fields must be an iterable of names, not a string")
        fields = list(fields)
        for name in fields:
            if name not in _library.PROJECTIONS:
                raise ValueError(f'unsupported projection field "{name}"')
        records = self.values() if keys is None else self.get_many(keys)
        return [{f: r.project(f) for f in fields} for r in records]

    def to_dicts(self) -> list[dict]:
        return [r.normal() for r in self._inner.records]


@functools.lru_cache(maxsize=32)
def _told(xml: str) -> tuple[str | None, str | None]:
    """Id and title of an independent style, which is read and checked once."""
    from marginalia.core.csl import XmlStyle

    told = XmlStyle(xml).info()
    return told.get("id"), told.get("title")


@dataclass(frozen=True)
class Style:
    """A style by a bundled name, or read from the XML of an independent one."""

    name: str
    id: str | None = None
    title: str | None = None

    @classmethod
    def load(cls, name: str) -> Style:
        if name.lstrip().startswith("<"):
            raise ValueError(f"unknown bundled style {name!r}")
        return cls(_cite.style(name), name, _cite.title(name))

    @classmethod
    def from_xml(cls, xml: str) -> Style:
        return cls(xml, *_told(xml))

    @classmethod
    def from_path(cls, path: str | Path) -> Style:
        return cls.from_xml(Path(path).read_text(encoding="utf-8"))

    @staticmethod
    def names() -> tuple[str, ...]:
        return (*_cite.STYLES, *_cite.SOURCES)


@dataclass(frozen=True)
class Locale:
    """A bundled language of rendering."""

    name: str

    @property
    def code(self) -> str:
        return self.name

    @classmethod
    def load(cls, name: str) -> Locale:
        return cls(_cite.locale(name))

    @staticmethod
    def names() -> tuple[str, ...]:
        return _cite.LOCALES


class CitationGroup(tuple):
    """Several cites that are rendered as one citation."""

    def __new__(cls, cites: Iterable[str | Cite]):
        if isinstance(cites, (str, Cite)):
            raise TypeError("a group is made of several keys or cites")
        held = [Cite(c) if isinstance(c, str) else c for c in cites]
        if not held:
            raise ValueError("a citation has one item at least")
        if bad := [c for c in held if not isinstance(c, Cite)]:
            raise TypeError(f"not a key or a cite: {bad[0]!r}")
        return super().__new__(cls, held)


@dataclass(frozen=True)
class Citation:
    """An identified citation of a key, a :class:`Cite`, or several."""

    id: str
    group: str | Cite | CitationGroup

    def __post_init__(self):
        if isinstance(self.group, (list, set, dict)):
            raise TypeError("several cites are given as a CitationGroup")

    def cites(self) -> list[Cite]:
        out = [Cite(c) if isinstance(c, str) else c for c in ((self.group,) if isinstance(self.group, (str, Cite)) else CitationGroup(self.group))]
        for c in out:
            if c.label not in _cite.LOCATORS:
                raise ValueError(f'unknown locator label "{c.label}"')
        return out


@dataclass
class RenderedDocument:
    citations: dict[str, _cite.Rendered]
    bibliography: _cite.Bibliography
    citation_order: list[str] = field(default_factory=list)

    @property
    def bibliography_text(self) -> str:
        return self.bibliography.text

    @property
    def bibliography_html(self) -> str:
        return self.bibliography.html

    def __getitem__(self, name: str) -> _cite.Rendered:
        return self.citations[name]

    def __iter__(self):
        return iter(self.citation_order)

    def __len__(self) -> int:
        return len(self.citation_order)


class Document:
    """A library under a style and a locale."""

    def __init__(self, library: Library, style: str | Style = "apa", locale: str | Locale = "en-US"):
        self.library, self.style = library, _cite.style(style.name if isinstance(style, Style) else style)
        self.locale = _cite.locale(locale.name if isinstance(locale, Locale) else locale)

    def render(self, citations: Iterable[Citation]) -> RenderedDocument:
        return self._rendered(citations)

    def _rendered(self, citations: Iterable[Citation], listed_only: bool = False) -> RenderedDocument:
        citations = list(citations)
        order = [c.id for c in citations]
        if len(set(order)) < len(order):
            raise ValueError("citation ids must be unique")
        try:
            done, shown = _cite.render_document(self.library._inner, [(c.id, c.cites()) for c in citations], self.style, self.locale, listed_only)
        except KeyError as error:
            raise MissingReferenceError(error.args[0]) from None
        return RenderedDocument(dict(done), shown, order)

    def cited_bibliography(self, *citations: Citation | Iterable[Citation]) -> _cite.Bibliography:
        given = [c for x in citations for c in ([x] if isinstance(x, Citation) else x)]
        return self._rendered(given, listed_only=True).bibliography

    def full_bibliography(self) -> _cite.Bibliography:
        return _cite.bibliography(self.library.values(), self.style, self.locale)


class EntryMap:
    """The raw entries of a source by key; keys may repeat."""

    def __init__(self, entries: list[_scan.Entry]):
        self._entries = entries

    def get_all(self, key: str) -> list[_scan.Entry]:
        return [e for e in self._entries if e.key == key]

    def get_unique(self, key: str) -> _scan.Entry:
        found = self.get_all(key)
        if not found:
            raise KeyError(key)
        if len(found) > 1:
            raise BibliographyError(f'key "{key}" occurs {len(found)} times')
        return found[0]

    __getitem__ = get_unique

    def __contains__(self, key: str) -> bool:
        return bool(self.get_all(key))

    def __iter__(self):
        return iter(dict.fromkeys(e.key for e in self._entries))

    def __len__(self) -> int:
        return len(set(e.key for e in self._entries))

    def values(self) -> list[_scan.Entry]:
        return list(self._entries)


class BibDocument:
    """A raw source that is inspected and edited without losing anything.

    A source is scanned once, and what is shown of it belongs to that scan.
    """

    def __init__(self, source: str):
        self.source = source
        self._scanned: tuple[str | None, list[_scan.Block]] = (None, [])

    @classmethod
    def read(cls, path: str | Path) -> BibDocument:
        return cls(_library.decode(Path(path).read_bytes())[0])

    parse = classmethod(lambda cls, source: cls(source))

    def _blocks(self) -> list[_scan.Block]:
        if self._scanned[0] is not self.source:
            self._scanned = self.source, _scan.scan(self.source)
        return self._scanned[1]

    @property
    def blocks(self) -> list[_scan.Block]:
        return list(self._blocks())

    @property
    def failed_blocks(self) -> list[_scan.Block]:
        return [b for b in self._blocks() if b.kind == "failed"]

    @property
    def comments(self) -> list[str]:
        return [b.value or "" for b in self._blocks() if b.kind == "comment"]

    @property
    def preamble(self) -> str:
        return " # ".join([b.value or "" for b in self._blocks() if b.kind == "preamble"])

    @property
    def strings(self) -> dict[str, str]:
        return dict(sorted({b.key: b.value or "" for b in self._blocks() if b.kind == "string" and b.key}.items()))

    @property
    def entries(self) -> EntryMap:
        return EntryMap([b.entry for b in self._blocks() if b.entry])

    def occurrences(self, key: str) -> list[_scan.Entry]:
        return [b.entry for b in self._blocks() if b.entry and b.entry.key == key]

    def occurrence_keys(self) -> list[str]:
        return [b.entry.key for b in self._blocks() if b.entry]

    def unique_keys(self) -> list[str]:
        return list(dict.fromkeys(self.occurrence_keys()))

    def __getitem__(self, key: str) -> _scan.Entry:
        found = self.occurrences(key)
        if not found:
            raise KeyError(key)
        if len(found) > 1:
            raise BibliographyError(f'key "{key}" occurs {len(found)} times')
        return found[0]

    def __contains__(self, key: str) -> bool:
        return bool(self.occurrences(key))

    def __len__(self) -> int:
        return len(self.unique_keys())

    def set_field(self, key: str, name: str, value: str, occurrence: int = 0) -> None:
        self.source = _scan.set_field(self.source, key, name, value, occurrence, self._blocks())

    def to_bibtex(self) -> str:
        return self.source

    def write(self, path: str | Path) -> None:
        Path(path).write_text(self.source, encoding="utf-8")

    def tidy(self, **options) -> TidyResult:
        try:
            return tidy(self.source, TidyOptions.check(**options))
        except TidySyntaxError as error:
            raise TidyError(error.message, error.line, error.column, error.byte, error.character) from None


def tidy_file(path: str | Path, *, output: str | Path | None = None, **options) -> TidyResult:
    """Format a file, and write the result if ``output`` is given."""
    got = BibDocument.read(path).tidy(**options)
    if output is not None:
        Path(output).write_text(got.bibtex, encoding="utf-8")
    return got


def cite(path: str | Path, citation: str | Cite | CitationGroup, style: str | Style = "apa", locale: str | Locale = "en-US") -> _cite.Rendered:
    return Document(Library.read(path), style, locale).render([Citation("1", citation)])["1"]


def full_bibliography(path: str | Path, style: str | Style = "apa", locale: str | Locale = "en-US") -> _cite.Bibliography:
    return Document(Library.read(path), style, locale).full_bibliography()


__all__ = ["BibDocument", "BibliographyError", "Citation", "CitationGroup", "Cite", "Document", "EntryMap", "Library", "Locale", "MissingReferenceError", "RenderedDocument", "Style", "TidyError", "TidyOptions", "TidyResult", "TidySyntaxError", "cite", "full_bibliography", "tidy", "tidy_file"]
