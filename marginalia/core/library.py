"""Normalised entries of a BibTeX, BibLaTeX or YAML source, with recovery."""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from dataclasses import dataclass, field

from marginalia.core.scan import Atom, Block, byte_spans, entry_fault, scan
from marginalia.core.tidy import ACCENTS, ESCAPES, LONG_MONTHS, MONTHS

#: Entry types and, where one is implied, the type of their container (fixed values).
TYPES = {
    "article": ("Article", "Periodical"), "book": ("Book", None), "mvbook": ("Book", None), "booklet": ("Book", None), "inbook": ("Chapter", "Book"), "bookinbook": ("Chapter", "Book"),
    "suppbook": ("Chapter", "Book"), "incollection": ("Anthos", "Anthology"), "collection": ("Anthology", None), "inproceedings": ("Article", "Proceedings"), "conference": ("Article", "Proceedings"),
    "proceedings": ("Proceedings", None), "mvproceedings": ("Proceedings", None), "phdthesis": ("Thesis", None), "mastersthesis": ("Thesis", None), "thesis": ("Thesis", None), "techreport": ("Report", None),
    "report": ("Report", None), "manual": ("Reference", None), "reference": ("Reference", None), "inreference": ("Entry", "Reference"), "online": ("Web", None), "electronic": ("Web", None), "www": ("Web", None),
    "unpublished": ("Manuscript", None), "patent": ("Patent", None), "periodical": ("Periodical", None), "dataset": ("Repository", None), "software": ("Repository", None), "artwork": ("Artwork", None),
    "audio": ("Audio", None), "video": ("Video", None), "movie": ("Video", None), "legislation": ("Legislation", None), "jurisdiction": ("Case", None), "misc": ("Misc", None),
}
DATE_FIELDS = {"month", "year", "day", "endyear", "endmonth", "endday"}
_CHECKED = DATE_FIELDS | {"date", "urldate", "origdate", "eventdate"}
_LETTERS = {v.rstrip("{}"): k for k, v in ESCAPES.items() if v.startswith("\\") and v[1:2].isalpha()}
_COMBINING = {v: k for k, v in ACCENTS.items()} | {"v": "\u030c", "u": "\u0306", "H": "\u030b", ".": "\u0307", "r": "\u030a", "k": "\u0328", "d": "\u0323", "b": "\u0331"}


class ParseFailure(ValueError):
    """A source that has no usable reading under the recovery mode asked for."""

    #: Whether a strict reading takes the source (which one with recovery refuses if it is stray text only).
    valid = False


#: What makes LaTeX differ from plain text.
_MARKED = re.compile(r"[\\{}~\n]|--")
_ACCENT = re.compile(r"\\([`'^~\"=.]|[cvuHrkdb](?![A-Za-z]))\s*(?:\{\s*\\?([A-Za-z]?)\s*\}|\\?([A-Za-z]))")
_COMMAND = re.compile(r"\\([A-Za-z]+)\s*(?:\{\})?")
_ESCAPED = re.compile(r"\\([#$%&_{}@])")
_BRACES = re.compile("[{}]")
_PARTS = re.compile(r"[{}]|\sand\s")


def plain(value: str) -> str:
    """LaTeX to Unicode: accents, special letters, dashes; braces dropped."""
    return _unmarked(value) if _MARKED.search(value) else value.strip()


@functools.lru_cache(maxsize=2048)
def _unmarked(value: str) -> str:
    if "\\" in value:
        value = _ACCENT.sub(lambda m: unicodedata.normalize("NFC", (m[2] or m[3]) + _COMBINING[m[1]]), value)
        value = _COMMAND.sub(lambda m: _LETTERS.get("\\" + m[1], ""), value)
        value = _ESCAPED.sub(lambda m: m[1] if m[1] not in "{}" else "", value)
    value = value.replace("{-}", "-").replace("---", "—").replace("--", "–").replace("~", "\xa0")
    return _BRACES.sub("", value).replace("\n", " ").strip()


@dataclass
class Name:
    family: str
    given: str = ""
    suffix: str = ""

    def initials(self) -> str:
        return _initials(self.given)


@functools.lru_cache(maxsize=2048)
def _initials(given: str) -> str:
    return " ".join(["-".join([p[0] + "." for p in part.split("-") if p]) for part in given.split()])


def names(value: str) -> list[Name]:
    """People of an author list."""
    return [Name(*parts) for parts in _name_parts(value)] if value else []


@functools.lru_cache(maxsize=2048)
def _name_parts(value: str) -> list[tuple[str, str, str]]:
    """Family and given name and suffix of each."""
    out, depth, start = [], 0, 0
    parts = []
    for found in _PARTS.finditer(value):
        depth += (found[0] == "{") - (found[0] == "}")
        if found[0] not in "{}" and depth == 0:
            parts.append(value[start : found.start()])
            start = found.end()
    for part in [*parts, value[start:]]:
        text = plain(part)
        if not text:
            continue
        if part.strip().startswith("{") and part.strip().endswith("}") and part.count("{") == 1:
            out.append((text, "", ""))
        elif "," in text:
            pieces = [p.strip() for p in text.split(",")]
            out.append((pieces[0], pieces[-1], ", ".join(pieces[1:-1])))
        else:
            tokens = text.split()
            low = next((i for i, t in enumerate(tokens[:-1]) if t[0].islower()), len(tokens) - 1)
            out.append((" ".join(tokens[low:]), " ".join(tokens[:low]), ""))
    return out


@dataclass
class Record:
    """One normalised entry."""

    key: str
    entry_type: str
    fields: dict[str, str]
    authors: list[Name] = field(default_factory=list)
    editors: list[Name] = field(default_factory=list)
    parents: list[Record] = field(default_factory=list)
    #: Values of several parts, such as an address and the day it was read.
    rich: dict = field(default_factory=dict)

    @property
    def title(self) -> str | None:
        return self.fields.get("title")

    @property
    def doi(self) -> str | None:
        return self.fields.get("doi")

    @property
    def volume(self) -> str | None:
        return self.fields.get("volume") or next((p.fields["volume"] for p in self.parents[:1] if "volume" in p.fields), None)

    @property
    def year(self) -> str | None:
        return self.fields.get("date", "")[:4] or None

    def project(self, name: str) -> str | None:
        return {"key": self.key, "entry_type": self.entry_type, "type": self.entry_type, "title": self.title, "doi": self.doi, "volume": self.volume}[name]

    def normal(self, top: bool = True) -> dict:
        out: dict = {"type": self.entry_type.lower()}
        if top:
            out |= {"id": self.key, "key": self.key}
        out |= {k: v for k, v in self.fields.items() if k not in ("doi", "isbn", "issn", "pages", "url", "serial")}
        for role, people in (("author", self.authors), ("editor", self.editors)):
            if people:
                shown = [", ".join([x for x in (n.family, n.suffix, n.given) if x]) for n in people]
                out[role] = shown[0] if len(shown) == 1 else shown
        serial = {k: self.fields[k] for k in ("doi", "isbn", "issn", "serial") if k in self.fields}
        out |= ({"serial-number": serial} if serial else {}) | ({"page-range": self.fields["pages"].replace("–", "-")} if "pages" in self.fields else {}) | ({"url": self.fields["url"]} if "url" in self.fields else {})
        out |= {k: _plain_data(v) for k, v in self.rich.items()}
        if self.parents:
            held = [p.normal(False) for p in self.parents]
            out["parent"] = held[0] if len(held) == 1 else held
        return dict(sorted(out.items()))


def _plain_data(value):
    """Nested data with dates as text, in one order."""
    if isinstance(value, dict):
        return {str(k): _plain_data(v) for k, v in sorted(value.items(), key=lambda kv: str(kv[0]))}
    return [_plain_data(v) for v in value] if isinstance(value, list) else value if isinstance(value, (str, int, float, bool)) or value is None else str(value)


#: One encoder: json.dumps makes one for every text that is not in its default form.
_JSON = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"))
PROJECTIONS = ("key", "entry_type", "type", "title", "doi", "volume")


@dataclass
class Library:
    records: list[Record]
    diagnostics: list[str]
    #: Whether a strict reading takes the source as well.
    valid: bool = field(default=True, repr=False, compare=False)

    def keys(self) -> list[str]:
        return [r.key for r in self.records]

    @functools.cached_property
    def _by_key(self) -> dict[str, Record]:
        return {r.key: r for r in reversed(self.records)}  # the first of a key counts

    def find(self, key: str) -> Record | None:
        return self._by_key.get(key)

    def to_json(self) -> str:
        return _JSON.encode([r.normal() for r in self.records])


def _valid(name: str, value: str) -> bool:
    low = value.strip().lower()
    if name.endswith("month"):
        return low in MONTHS or low in LONG_MONTHS or low.isascii() and low.isdigit() and len(low) < 4 and 1 <= int(low) <= 12
    if name.endswith("day"):
        return low.isascii() and low.isdigit() and len(low) < 4 and 1 <= int(low) <= 31
    return bool(_YEAR.fullmatch(low))


_YEAR = re.compile(r"-?[0-9]{1,4}")
_DATE = re.compile(r"(-?\d{4}(-\d{2}(-\d{2})?)?[~?%]?)(/(\.\.|-?\d{4}(-\d{2}(-\d{2})?)?[~?%]?)?)?|-?\d{1,4}", re.A)


_MONTH_WORDS = {m: m for m in MONTHS}
_MONTH_NUMBERS = {m: i + 1 for i, m in enumerate(MONTHS)}


@dataclass
class _Source:
    """The blocks of a source and what parsing found wrong with them."""

    text: str
    blocks: list[Block]
    problems: list[str] = field(default_factory=list)

    def span(self, b: Block) -> str:
        at = byte_spans(self.text, [b.start, b.end])
        return f"{at[b.start]}..{at[b.end]}"


def _resolved(source: _Source, entries: list[Block], literal: bool) -> tuple[dict[str, tuple[str, dict[str, str]]], list[str]]:
    """Fields of each entry with abbreviations replaced, and those that are unknown; ``literal`` takes values as they stand."""
    macros = _MONTH_WORDS
    if not literal and any(b.kind == "string" for b in source.blocks):
        macros = macros | {b.key: b.value or "" for b in source.blocks if b.kind == "string" and b.key and not b.fault}
    unknown: list[str] = []

    def expand(atoms: list[Atom], key: str) -> str | None:
        out = []
        for a in atoms:
            if a.mode != "Bare" or a.value.isdigit():
                out.append(a.value)
            elif a.value.lower() in macros:
                out.append(macros[a.value.lower()])
            else:
                unknown.append(f'unknown abbreviation "{a.value}" in entry "{key}"')
                return None
        return "".join(out)

    raw: dict[str, tuple[str, dict[str, str]]] = {}
    for b in entries:
        found: dict[str, str] = {}
        parts = None if literal else b.entry.parts
        for name, value, which, _, _ in parts or ():
            if (name := name.lower()) not in found:
                if not which:
                    value = expand(value, b.entry.key)
                elif which == 4 and not value.isdigit():
                    value = expand([Atom(value, "Bare", value)], b.entry.key)
                if value is not None:
                    found[name] = value
        for f in b.entry.fields if parts is None else ():
            name = f.name.lower()
            if name in found:
                continue
            atoms = f.atoms
            # Most values are one operand that stands for itself.
            value = f.value if literal else atoms[0].value if len(atoms) == 1 and (f.mode != "Bare" or f.value.isdigit()) else expand(atoms, b.entry.key)
            if value is not None:
                found[name] = value
        raw[b.entry.key] = (b.entry.kind.lower(), found)
    return raw, unknown


def parse_bibtex(source: str, strict: bool = True) -> Library:
    """Normalise a source; under ``strict`` any defect fails, else it is reported and left out.

    Recovery goes in stages, each only where the one before left a defect:
    blocks that are none, stray text and repeated keys go; entries that are not
    valid by themselves go; string definitions go and values are taken as they
    stand, abbreviations included.  Typed fields whose value cannot be read go last.
    """
    told = _Source(text := source.removeprefix("\ufeff"), scan(text))
    problems, entries, seen, stray = told.problems, [], set(), 0
    for b in told.blocks:
        if b.kind == "whitespace":
            continue
        stray += not strict and b.kind == "other" and not b.raw.startswith("@")  # which a strict reading lets pass
        if b.kind == "failed":
            problems.append(f"parse error at {told.span(b)}: {b.error}" if strict else f"ignored malformed BibTeX block at {told.span(b)}: {b.error}")
        elif b.kind == "other":
            problems += [f"ignored raw BibTeX text at {told.span(b)}"] if not strict else [f"parse error at {told.span(b)}: no block"] if b.raw.startswith("@") else []
        elif b.entry and b.entry.key in seen:
            problems.append(f'parse error at {told.span(b)}: duplicate key "{b.entry.key}"' if strict else f'ignored duplicate BibTeX entry key "{b.entry.key}" at {told.span(b)}')
        elif b.entry:
            seen.add(b.entry.key)
            entries.append(b)
    faulty = {id(b): fault for b in entries if (fault := entry_fault(b.entry))}
    strings = [b for b in told.blocks if b.kind == "string"]
    raw, unknown = _resolved(told, [b for b in entries if id(b) not in faulty], False)
    first = [f"parse error at {told.span(b)}: {faulty.get(id(b)) or b.fault}" for b in told.blocks if b.fault or id(b) in faulty] if faulty or strings else []
    first += [f"parse error: {x}" for x in unknown]
    if strict:
        problems += first
    elif first:
        if faulty:
            problems += [f'ignored BibTeX entry "{b.entry.key}" at {told.span(b)} because syntax validation failed: {faulty[id(b)]}' for b in entries if id(b) in faulty]
        else:
            problems.append(f"syntax recovery could not pre-filter BibTeX entries after {first[0]}")
        if unknown or any(b.fault for b in strings):
            problems += [f'ignored string definition "{b.key or ""}" at {told.span(b)} during literal recovery' for b in strings]
            raw, _ = _resolved(told, [b for b in entries if id(b) not in faulty], True)
    for key, (_, found) in raw.items():
        for name, value in [x for x in found.items() if x[0] in _CHECKED]:
            if name in DATE_FIELDS and not _valid(name, plain(value)):
                problems.append(f'parse error in entry "{key}": invalid {name} "{value}"' if strict else f'ignored BibTeX field "{name}" in entry "{key}" because value "{value.strip()}" is not valid for normalization')
                del found[name]
            elif name not in DATE_FIELDS and not _DATE.fullmatch(plain(value)):
                problems.append(f'parse error in entry "{key}": invalid {name} "{value}"' if strict else f'ignored BibTeX field "{name}" in entry "{key}" because type conversion failed: invalid date "{value.strip()}"')
                del found[name]
    valid = not first and len(problems) == stray
    if strict and problems:
        raise ParseFailure("\n".join(problems))
    _inherit(raw)
    records = [_record(key, kind, found) for key, (kind, found) in raw.items() if kind not in ("xdata", "set")]
    if not strict and text.strip() and not records and problems:
        failure = ParseFailure("non-strict recovery failed:\n" + "\n".join(problems))
        failure.valid = valid
        raise failure
    return Library(records, problems, valid)


def _inherit(raw: dict[str, tuple[str, dict[str, str]]]) -> None:
    """Fields from ``xdata`` and ``crossref``, through chains of any length; a circle ends where it began."""
    if not any("xdata" in found or "crossref" in found for _, found in raw.values()):
        return
    done: set[str] = set()

    def links(key: str) -> list[str]:
        found = raw[key][1]
        named = [*found.get("xdata", "").split(","), found.get("crossref", "")]
        return [k for k in dict.fromkeys(x.strip() for x in named) if k in raw and k != key]

    for start in raw:
        path, opened = [start], {start}
        while path:
            key = path[-1]
            waiting = next((k for k in links(key) if k not in done and k not in opened), None) if key not in done else None
            if waiting is not None:
                path.append(waiting)
                opened.add(waiting)
                continue
            path.pop()
            if key in done:
                continue
            done.add(key)
            kind, found = raw[key]
            for link in links(key):
                cross = link == found.get("crossref", "").strip() and kind.startswith("in")
                for name, value in raw[link][1].items():
                    if name not in ("xdata", "crossref", "ids", "options"):
                        found.setdefault("booktitle" if cross and name == "title" else name, value)


_RESOLVER = re.compile(r"^https?://(dx\.)?doi\.org/")
_DASHES = re.compile(r"\s*[-–]+\s*")


_OWN = ("title", "doi", "isbn", "url", "note", "edition", "publisher", "abstract")


def _record(key: str, kind: str, found: dict[str, str]) -> Record:
    entry_type, parent_type = TYPES.get(kind, ("Misc", None))
    text = {n: plain(v) for n, v in found.items()}
    read = text.get
    own: dict[str, str] = {n: text[n] for n in _OWN if n in text and text[n]}
    if (doi := own.get("doi")) and doi.startswith("http"):
        own["doi"] = _RESOLVER.sub("", doi)
    if "url" in found:
        own["url"] = found["url"].replace("\\_", "_").strip()
    if "institution" in text or "school" in text:
        own["organization"] = read("institution") or text["school"]
    if "location" in text or "address" in text:
        own["location"] = read("location") or text["address"]
    if whole := read("date"):
        own["date"] = whole
    elif year := read("year"):
        month = read("month", "").lower()
        number = _MONTH_NUMBERS.get(month[:3]) or (int(month) if month.isdigit() else None)
        own["date"] = f"{year}-{number:02d}" if number else year
    if pages := read("pages"):
        own["pages"] = _DASHES.sub("–", pages)
    parents: list[Record] = []
    container = read("journaltitle") or read("journal") or read("booktitle") or read("maintitle")
    carried = {n: text[n] for n in ("volume", "issue", "issn") if n in text and text[n]}
    if number := read("number"):
        carried["issue"] = number
    authors, editors = names(found.get("author", "")), names(found.get("editor", ""))
    if parent_type and container or read("maintitle"):
        parents.append(Record("", parent_type or "Book", {"title": container or text["maintitle"], **carried}, [], editors))
        editors = []
    else:
        own.update(carried)
    return Record(key, entry_type, own, authors, editors, parents)


#: What libyaml takes otherwise than the reader in Python does: tabs, directives and line ends but ``\\n``.
_ODD_YAML = re.compile("[\t\r\x85\u2028\u2029\ufeff%]")


def _yaml(source: str):
    """The data of a YAML text, by libyaml where both read alike; what that refuses goes to the reader in Python, which also says why."""
    import yaml

    try:
        if yaml.__with_libyaml__ and not _ODD_YAML.search(source):
            return yaml.load(source, yaml.CSafeLoader)
    except yaml.YAMLError:
        pass
    try:
        return yaml.safe_load(source)
    except yaml.YAMLError as error:
        raise ParseFailure(f"parse error: {error}") from None


def parse_yaml(source: str) -> Library:
    """A YAML map of keys to entries."""
    data = _yaml(source) or {}

    def shown(value) -> str:
        return str(value.get("value", "") if isinstance(value, dict) else value)

    def record(key: str, item: dict) -> Record:
        serial = item.get("serial-number") or {}
        serial = serial if isinstance(serial, dict) else {"serial": str(serial)}
        own = {k: shown(v) for k, v in item.items() if k not in ("type", "author", "editor", "parent", "serial-number", "page-range") and v is not None}
        own |= {k: str(v) for k, v in serial.items()} | ({"pages": str(item["page-range"]).replace("-", "–")} if "page-range" in item else {})
        rich = {k: v for k, v in item.items() if isinstance(v, (dict, list)) and k not in ("author", "editor", "parent", "serial-number")}
        people: dict[str, list[Name]] = {}
        for role in ("author", "editor"):
            given = item.get(role) or []
            people[role] = []
            for x in given if isinstance(given, list) else [given]:
                people[role] += names(x) if isinstance(x, str) else [Name(x.get("name", ""), x.get("given-name", ""), x.get("suffix", ""))]
        parents = item.get("parent") or []
        return Record(key, str(item.get("type", "misc")).title(), own, people["author"], people["editor"], [record("", p) for p in (parents if isinstance(parents, list) else [parents])], rich)

    if not isinstance(data, dict):
        raise ParseFailure("parse error: a bibliography is a map of keys to entries")
    if bad := [k for k, v in data.items() if not isinstance(v, (dict, type(None)))]:
        raise ParseFailure(f'parse error: entry "{bad[0]}" is not a map')
    return Library([record(str(k), v or {}) for k, v in data.items()], [])


def decode(content: bytes) -> tuple[str, list[str]]:
    """UTF-8, else Windows-1252 with a diagnostic."""
    try:
        return content.decode("utf-8"), []
    except UnicodeDecodeError:
        return content.decode("cp1252", "replace"), ["decoded the source as Windows-1252-compatible text because it is not valid UTF-8"]


def select(library: Library, selector: str) -> list[Record]:
    """Records that a selector admits: types, ``*``, ``!``, ``&``, ``|``, ``>`` and ``[field]``."""
    tokens = re.findall(r"[a-z-]+|[*!&|>()\[\],]", selector.lower())
    if "".join(tokens) != re.sub(r"\s", "", selector.lower()) or not tokens:
        raise ValueError(f"invalid selector: {selector}")
    at = 0

    def peek():
        return tokens[at] if at < len(tokens) else None

    def take(expected=None):
        nonlocal at
        token = peek()
        if token is None or expected and token != expected:
            raise ValueError(f"invalid selector: {selector}")
        at += 1
        return token

    def either():
        left = both()
        while peek() == "|":
            take()
            left = (lambda a, b: lambda r: a(r) or b(r))(left, both())
        return left

    def both():
        left = path()
        while peek() == "&":
            take()
            left = (lambda a, b: lambda r: a(r) and b(r))(left, path())
        return left

    def path():
        left = one()
        if peek() == ">":
            take()
            return (lambda a, b: lambda r: a(r) and any(b(p) for p in r.parents))(left, path())
        return left

    def one():
        token = take()
        if token == "!":
            return (lambda a: lambda r: not a(r))(one())
        if token == "(":
            test = either()
            take(")")
        elif token == "*":
            test = lambda r: True
        elif token.isalpha() or "-" in token:
            test = (lambda t: lambda r: r.entry_type.lower() == t)(token)
        else:
            raise ValueError(f"invalid selector: {selector}")
        while peek() == "[":
            take()
            names_ = [take()]
            while peek() == ",":
                take()
                names_.append(take())
            take("]")
            test = (lambda a, ns: lambda r: a(r) and all(n in r.fields or n == "author" and r.authors or n == "editor" and r.editors for n in ns))(test, names_)
        return test

    test = either()
    if peek() is not None:
        raise ValueError(f"invalid selector: {selector}")
    return [r for r in library.records if test(r)]
