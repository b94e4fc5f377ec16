"""BibTeX formatting: options, value transforms, duplicates, keys, sorting and layout."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass, fields as dataclass_fields

from marginalia.core.scan import SPACE, Atom, Block, Entry, Field, scan

#: Default orders, templates, months, and words left out of keys.
DEFAULT_FIELDS = "title shorttitle author year month day journal booktitle location on publisher address series volume number pages doi isbn issn url urldate copyright category note metadata".split()
DEFAULT_KEY = "[auth:required:lower][year:required][veryshorttitle:lower][duplicateNumber]"
RULES = ("doi", "key", "abstract", "citation")
MERGES = ("first", "last", "combine", "overwrite")
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
LONG_MONTHS = "january february march april may june july august september october november december".split()
FUNCTION_WORDS = frozenset("a about above across against along among an and around at before behind below beneath beside between beyond but by down during except for from in inside into like near nor of off on onto or since so the through to toward under until up upon with within without yet".split())
VERBATIM = frozenset("url doi eprint file verba-c pdf".split())
ESCAPES = {
    "#": r"\#", "$": r"\$", "%": r"\%", "&": r"\&", "@": r"\@", "*": r"\textasteriskcentered", "_": r"\_", "|": r"\vert{}", "\xa0": "~",
    "Å": r"\AA{}", "Æ": r"\AE{}", "Ð": r"\DH{}", "Ø": r"\O{}", "Þ": r"\TH{}", "ß": r"\ss{}", "å": r"\aa{}", "æ": r"\ae{}", "ð": r"\dh{}", "ø": r"\o{}", "þ": r"\th{}", "ɛ": r"\varepsilon{}",
}
ACCENTS = {"\u0300": "`", "\u0301": "'", "\u0302": "^", "\u0303": "~", "\u0308": '"', "\u0327": "c", "\u0304": "="}


def latex_of(char: str) -> str | None:
    """LaTeX for one character: from the table, or its letter under a decomposed accent."""
    if char in ESCAPES:
        return ESCAPES[char]
    if "À" <= char <= "ÿ" or char == "ū":
        parts = unicodedata.normalize("NFD", char)
        if len(parts) == 2 and parts[1] in ACCENTS:
            return f"\\{ACCENTS[parts[1]]}{{{'\\i' if parts[0] == 'i' else parts[0]}}}"
    return None


@dataclass(frozen=True)
class TidyOptions:
    """The 27 options; ``check`` turns what callers may pass into these."""

    omit: tuple[str, ...] = ()
    curly: bool = False
    numeric: bool = False
    months: bool = False
    space: int = 2
    tab: bool = False
    align: int | bool | None = 14
    blank_lines: bool = False
    sort: tuple[str, ...] | None = None
    duplicates: tuple[str, ...] | None = None
    merge: str | None = None
    strip_enclosing_braces: bool = False
    drop_all_caps: bool = False
    escape: bool = True
    sort_fields: tuple[str, ...] | None = None
    strip_comments: bool = False
    trailing_commas: bool = False
    encode_urls: bool = False
    tidy_comments: bool = True
    remove_empty_fields: bool = False
    remove_duplicate_fields: bool = True
    generate_keys: str | None = None
    max_authors: int | None = None
    lowercase: bool = True
    enclosing_braces: tuple[str, ...] | None = None
    remove_braces: tuple[str, ...] | None = None
    wrap: int | None = None

    @classmethod
    def check(cls, **given) -> TidyOptions:
        known = {f.name: f.default for f in dataclass_fields(cls)}
        out = {}
        lists = {"sort": ("key",), "sort_fields": tuple(DEFAULT_FIELDS), "enclosing_braces": ("title",), "remove_braces": ("title",)}
        for name, value in given.items():
            if name not in known:
                raise ValueError(f"unknown tidy option {name!r}")
            if name in lists:
                value = None if value is None or value is False else lists[name] if value is True else _strings(name, value) or lists[name] * (name in ("sort", "sort_fields"))
            elif name == "omit":
                value = () if value is None else _strings(name, value)
            elif name == "duplicates":
                value = None if value is None else tuple(dict.fromkeys(_strings(name, value)))
                if bad := [v for v in value or () if v not in RULES]:
                    raise ValueError(f"unknown duplicate rule {bad[0]!r}")
            elif name == "merge":
                if value is not None and value not in MERGES:
                    raise ValueError(f"unknown merge strategy {value!r}")
            elif name == "generate_keys":
                if not (value is None or isinstance(value, (bool, str))):
                    raise TypeError("generate_keys must be a string or a boolean")
                value = DEFAULT_KEY if value is True else value or None
                if value:
                    parse_template(value)
            elif name in ("space", "align", "wrap", "max_authors"):
                switch = {"align": 14, "wrap": 80}.get(name)
                if value is True and name == "space":
                    raise TypeError("space must be an integer")
                if value is True and switch:
                    value = switch
                elif switch and value is False or value is None and name != "space":
                    value = None
                elif isinstance(value, bool) or not isinstance(value, int):
                    raise TypeError(f"{name} must be an integer")
                elif value < 0:
                    raise ValueError(f"{name} must not be negative")
            elif not isinstance(value, bool):
                raise TypeError(f"{name} must be a boolean")
            out[name] = value
        return cls(**out)


def _strings(name: str, value) -> tuple[str, ...]:
    if isinstance(value, str) or not isinstance(value, Iterable):
        raise TypeError(f"{name} must be an iterable of strings")
    value = tuple(value)
    if not all(isinstance(v, str) for v in value):
        raise TypeError(f"{name} must be an iterable of strings")
    return value


class TidySyntaxError(ValueError):
    def __init__(self, message: str, line: int, column: int, byte: int, character: int):
        super().__init__(message)
        self.message, self.line, self.column, self.byte, self.character = message, line, column, byte, character

    def display(self) -> str:
        return f"line {self.line}:{self.column}: {self.message}"


@dataclass
class Warning_:
    code: str
    rule: str | None
    message: str


@dataclass
class TidyResult:
    bibtex: str
    warnings: list[Warning_]
    count: int


_PLAIN = re.compile("[A-Za-z0-9]+")


def alpha_num(text: str) -> str:
    if text.isascii():
        return "".join(_PLAIN.findall(text)).lower()
    return "".join([c.lower() for c in text if c.isalnum()])


# ---- values -------------------------------------------------------------


def _month(value: str) -> str | None:
    low = value.strip(SPACE).lower().rstrip(".")
    if low.isascii() and low.isdigit() and 1 <= int(low) <= 12:
        return MONTHS[int(low) - 1]
    return low[:3] if low in MONTHS or low in LONG_MONTHS else None


#: What may have another form in LaTeX, and what is left alone: commands, mathematics.
_ODD = re.compile(rf"\\.|\$[^$]*\$|[{re.escape(''.join(c for c in ESCAPES if c.isascii()))}]|[^\x00-\x7f]", re.S)


@functools.lru_cache(maxsize=1024)
def _escaped_part(part: str) -> str:
    return part if len(part) > 1 else latex_of(part) or part


def escape_text(text: str) -> str:
    """Special and accented characters as LaTeX, but for mathematics and commands."""
    return _ODD.sub(lambda m: m[0] if len(m[0]) > 1 else _escaped_part(m[0]), text)


def _lower_caps(text: str) -> str:
    if any(c.islower() for c in text):
        return text
    roman = re.compile(r"^(?=[MDCLXVI])M*(C[MD]|D?C{0,3})(X[CL]|L?X{0,3})(I[XV]|V?I{0,3})$")
    return re.sub(r"[^\W\d_]+", lambda m: m[0] if roman.match(m[0]) and len(m[0]) > 1 else m[0][0] + m[0][1:].lower(), text)


def _outer(text: str) -> bool:
    """Whether one pair of braces encloses the whole text."""
    if not (text.startswith("{") and text.endswith("}")):
        return False
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "{") - (c == "}")
        if not depth:
            return i == len(text) - 1
    return False


def _flatten(text: str) -> str:
    """Without braces, but for arguments of commands."""
    out, keep = [], []
    for part in re.findall(r"\\+[A-Za-z]+\s*\{|\\.\{|\\.|[{}]|[^\\{}]+", text, re.S):
        if part == "{":
            keep.append(False)
        elif part == "}":
            if keep and keep.pop():
                out.append(part)
        else:
            if part.endswith("{") and len(part) > 1:
                keep.append(True)
            out.append(part)
    return "".join(out)


def unwrap(text: str) -> str:
    """White space collapsed; two line breaks or more are a paragraph."""
    if "\n" not in text:
        return " ".join(text.strip(SPACE).split())
    parts = [" ".join(p.split()) for p in re.split(r"\n[ \t]*\n\s*", text.strip(SPACE))]
    return "\n\n".join(parts)


def _wrapped(text: str, width: int) -> list[str]:
    lines: list[str] = []
    for word in text.split(" "):
        if lines and len(f"{lines[-1]} {word}".encode()) <= width:
            lines[-1] += f" {word}"
        else:
            lines.append(word)
    return lines


def _inner_value(name: str, value: str, o: TidyOptions) -> str:
    if o.drop_all_caps and name not in VERBATIM:
        value = _lower_caps(value)
    if o.encode_urls and name == "url":
        value = re.sub(r"\\?_", r"\\%5F", value)
    if o.escape and name not in VERBATIM:
        value = escape_text(value)
    if name == "pages":
        value = re.sub(r"(?<=\d)-(?=\d)", "--", value)
    if o.max_authors is not None and name == "author":
        people = value.split(" and ")
        if len(people) > o.max_authors:
            value = " and ".join(people[: o.max_authors] + ["others"])
    if o.strip_enclosing_braces and _outer(value) and not re.search("[{}]", value[1:-1]):
        value = value[1:-1]
    if o.remove_braces and name in {x.lower() for x in o.remove_braces}:
        value = _flatten(value)
    if o.enclosing_braces and name in {x.lower() for x in o.enclosing_braces} and not _outer(value):
        value = "{" + value + "}"
    return value


def render_value(f: Field, o: TidyOptions, indent: str) -> str:
    """A field's value in its final form, delimiters included."""
    name = f.name.lower()
    if f.mode == "Expression":
        return " # ".join([a.raw for a in f.atoms])
    value = f.value
    if o.months and name == "month" and (short := _month(value)):
        return short
    bare_month = name == "month" and f.mode == "Bare"
    if o.numeric and re.fullmatch("[1-9][0-9]*", value.strip(SPACE)):
        return value.strip(SPACE)
    braced = f.mode == "Braced" or o.curly and not bare_month
    if f.mode == "Bare" and not (o.curly and not bare_month):
        return value
    value = _inner_value(name, value, o)
    if not braced:
        return f'"{value}"'
    value = unwrap(value)
    paragraphs = value.split("\n\n")
    room = o.wrap
    if len(paragraphs) > 1 or room and len(f"{indent}{name:<{o.align or 0}}= {{{value}}},".encode()) > room:
        inner = indent * 2
        body = [f"\n{inner}".join(_wrapped(p, room - len(inner) - 1) if room else [p]) for p in paragraphs]
        return "{\n" + inner + f"\n\n{inner}".join(body) + f"\n{indent}}}"
    return "{" + value + "}"


# ---- keys ---------------------------------------------------------------


def parse_template(template: str) -> list[str | tuple[str, int | None, list[str]]]:
    """Text, and (marker, number, modifiers) for each bracket."""
    out: list = []
    for text, inside in re.findall(r"([^\[]+|\[(?![^\]]*\]))|\[([^\]]*)\]", template):
        if text:
            out.append(text)
            continue
        marker, *modifiers = inside.split(":")
        number = re.search(r"\d+", marker)
        marker = re.sub(r"\d+", "N", marker)
        if not marker:
            raise ValueError("Token parse error")
        if marker not in ("auth", "authEtAl", "authors", "authorsN", "veryshorttitle", "shorttitle", "title", "fulltitle", "year", "duplicateLetter", "duplicateNumber") and not re.fullmatch("[A-Z]+", marker):
            raise ValueError(f"Invalid citation key token: {marker}")
        if bad := [m for m in modifiers if m not in ("required", "lower", "upper", "capitalize")]:
            raise ValueError(f"Invalid modifier: {bad[0]}")
        out.append((marker, int(number[0]) if number else None, modifiers))
    return out


@functools.lru_cache(maxsize=64)
def _template_parts(template: str) -> tuple:
    return tuple(parse_template(template))


def last_name(person: str) -> str:
    """The family name: before the comma, or all but the first token, lower-case prefixes aside."""
    person = re.sub(r"[{}]", "", person).strip()
    if "," in person:
        tokens = person.split(",")[0].split()
    else:
        tokens = person.split()
        tokens = tokens[1:] or tokens
    while len(tokens) > 1 and tokens[0][:1].islower():
        tokens = tokens[1:]
    return "".join(tokens)


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[ .,:;]+", re.sub(r"[{}\\]", "", text)) if w]


def _marker(entry: Entry, marker: str, number: int | None, index: int | None) -> str:
    if marker.startswith("auth"):
        people = [last_name(p) for p in re.split(r"\s+and\s+", (entry.get("author") or "").strip()) if p]
        if marker == "auth":
            return people[0] if people else ""
        if marker == "authEtAl":
            return "".join(people) if len(people) < 3 else people[0] + "EtAl"
        if marker == "authors":
            return "".join(people)
        return "".join(people[:number]) + ("EtAl" if len(people) > (number or 0) else "")
    if marker == "year":
        return entry.get("year") or (entry.get("date") or "")[:4]
    if marker == "duplicateLetter":
        return chr(96 + index) if index else ""
    if marker == "duplicateNumber":
        return str(index) if index else ""
    title = entry.get("title") or entry.get("booktitle") or ""
    content = [w for w in _words(title) if w.lower() not in FUNCTION_WORDS] if marker.endswith("shorttitle") else []
    if marker == "veryshorttitle":
        return content[0] if content else ""
    if marker == "shorttitle":
        return " ".join(content[:3])
    if marker == "title":
        return "".join([w[:1].upper() + w[1:] if w.lower() not in FUNCTION_WORDS else w for w in _words(title)])
    if marker == "fulltitle":
        return "".join(_words(title))
    return entry.get(marker) or ""


_UNSAFE = re.compile(rf"[{{}},\\#%~()\"'=.:;\[\]_{SPACE}]")


def _fill(entry: Entry, parts: list, index: int | None) -> str | None:
    out = []
    for part in parts:
        if isinstance(part, str):
            out.append(part)
            continue
        marker, number, modifiers = part
        value = _marker(entry, marker, number, index)
        if "required" in modifiers and not value:
            return None
        for m in modifiers:
            value = value.lower() if m == "lower" else value.upper() if m == "upper" else " ".join([w[:1].upper() + w[1:] for w in value.split(" ")]) if m == "capitalize" else value
        out.append(value)
    return _UNSAFE.sub("", "".join(out))


def key_plan(entries: list[Entry], template: str) -> list[str]:
    """Each entry's key by the template; colliding keys are numbered from one."""
    parts = list(_template_parts(template))
    if not any(isinstance(p, tuple) and p[0].startswith("duplicate") for p in parts):
        parts.append(("duplicateLetter", None, []))
    plain = [_fill(e, parts, None) for e in entries]
    times: dict[str, int] = {}
    for k in plain:
        if k:
            times[k] = times.get(k, 0) + 1
    seen: dict[str, int] = {}
    out = []
    for entry, key in zip(entries, plain):
        if not key:
            out.append(entry.key)
        elif times[key] == 1:
            out.append(key)
        else:
            seen[key] = seen.get(key, 0) + 1
            out.append(_fill(entry, parts, seen[key]) or entry.key)
    return out


# ---- duplicates ---------------------------------------------------------


def duplicate_value(entry: Entry, rule: str, key: str) -> str | None:
    """What two entries share if they are duplicates under a rule."""
    if rule == "key":
        return key.lower() or None
    if rule == "doi":
        return alpha_num(entry.get("doi") or "") or None
    if rule == "abstract":
        return alpha_num(entry.get("abstract") or "")[:100] or None
    title, author = entry.get("title"), entry.get("author")
    if not title or not author:
        return None
    first = re.split(r"\s+and\s+", author.strip())[0]
    return f"{alpha_num(last_name(first))}:{alpha_num(title)}:{alpha_num(entry.get('number') or '0')}"


def fold_duplicates(entries: list[Entry], keys: list[str], o: TidyOptions) -> tuple[list[bool], list[Warning_]]:
    """Fold each duplicate into the first entry of its chain, in order; which are gone, and warnings."""
    if o.duplicates is None and o.merge is None:
        rules: list[tuple[str, bool]] = []
    else:
        rules = [(r, o.merge is not None) for r in (o.duplicates if o.duplicates is not None else ("doi", "citation", "abstract"))]
    rules += [("key", False)] if rules and "key" not in [r for r, _ in rules] else []
    gone, warned = [False] * len(entries), []
    root = list(range(len(entries)))
    first: dict[tuple[str, str], int] = {}
    for i, entry in enumerate(entries):
        for rule, merging in rules:
            value = duplicate_value(entry, rule, keys[i])
            if value is None:
                continue
            at = first.setdefault((rule, value), i)
            if at == i:
                continue
            while root[at] != at:
                at = root[at]
            if at == i:
                continue
            action = "removed" if merging else "detected"
            said = {
                "key": f"The citation key {keys[i]} has already been used.",
                "doi": f"Entry {keys[i]} has an identical DOI to entry {keys[at]}.",
                "citation": f"Entry {keys[i]} has similar content to entry {keys[at]}.",
                "abstract": f"Entry {keys[i]} has a similar abstract to entry {keys[at]}.",
            }
            warned.append(Warning_("DUPLICATE_ENTRY", rule, f"Duplicate {action}. {said[rule]}"))
            if merging and not gone[i]:
                gone[i], root[i] = True, at
                _merge(entries[at], entry, o.merge)
                if o.merge == "last":
                    keys[at] = keys[i]
    return gone, warned


def _merge(kept: Entry, other: Entry, how: str) -> None:
    mine = {f.name.lower(): k for k, f in enumerate(kept.fields)}
    if how == "last":
        kept.key, kept.fields = other.key, list(other.fields)
    elif how in ("combine", "overwrite"):
        for f in other.fields:
            at = mine.get(f.name.lower())
            if at is None:
                mine[f.name.lower()] = len(kept.fields)
                kept.fields.append(f)
            elif how == "overwrite":
                kept.fields[at] = f


# ---- layout -------------------------------------------------------------


def _fields(entry: Entry, o: TidyOptions) -> list[Field]:
    drop, seen, out = {x.lower() for x in o.omit}, set(), []
    for f in entry.fields:
        low = f.name.lower()
        if low in drop or o.remove_duplicate_fields and low in seen or o.remove_empty_fields and not f.value.strip(SPACE):
            continue
        seen.add(low)
        out.append(f)
    if o.sort_fields:
        place = {name.lower(): k for k, name in reversed(list(enumerate(o.sort_fields)))}
        out.sort(key=lambda f: place.get(f.name.lower(), len(place)))
    return out


def render_entry(entry: Entry, key: str, o: TidyOptions) -> str:
    indent = "\t" if o.tab else " " * o.space
    lines = []
    for f in _fields(entry, o):
        name = f.name.lower() if o.lowercase else f.name
        if f.mode == "Missing":
            lines.append(indent + name)
        elif o.align:
            lines.append(f"{indent}{name}{' ' * max(1, o.align - len(name.encode()))}= {render_value(f, o, indent)}")
        else:
            lines.append(f"{indent}{name} = {render_value(f, o, indent)}")
    head = f"@{entry.kind.lower() if o.lowercase else entry.kind}{{{key}"
    if not lines:
        return head + (",\n}" if key else "\n}")
    return head + ("," if key else "") + "\n" + ",\n".join(lines) + ("," if o.trailing_commas else "") + "\n}"


def sort_value(entry: Entry | None, block: Block, name: str, key: str) -> str | None:
    if name == "special":
        return "0" if block.kind in ("string", "preamble") or entry and entry.kind.lower() == "xdata" else "1"
    if entry is None:
        return None
    value = key if name == "key" else entry.kind if name == "type" else entry.get(name)
    if value is None or value == "":
        return None
    if name == "month" and (short := _month(value)):
        return f"0:{MONTHS.index(short) + 1:02d}"
    value = value.strip(SPACE)
    return f"0:{value:0>50}" if value.isascii() and value.isdigit() else f"1:{value.lower()}"


def tidy(source: str, options: TidyOptions | None = None) -> TidyResult:
    """The formatted source, warnings, and the number of parsed entries."""
    o = options or TidyOptions()
    text = source.replace("\r\n", "\n").replace("\r", "\n")
    blocks = scan(text)
    for b in blocks:
        if b.kind == "failed":
            before = text[: b.start]
            raise TidySyntaxError(b.error, before.count("\n") + 1, len(before) - (before.rfind("\n") + 1) + 1, len(before.encode("utf-8", "surrogatepass")), len(before))
    entries = [b.entry for b in blocks if b.entry]
    warnings = [Warning_("MISSING_KEY", None, f"{e.kind.lower()} entry does not have a citation key.") for e in entries if not e.key]
    keys = key_plan(entries, o.generate_keys) if o.generate_keys else [e.key for e in entries]
    gone, found = fold_duplicates(entries, keys, o)
    order = {id(e): i for i, e in enumerate(entries)}
    groups: list[tuple[list[tuple[str, str]], Block | None]] = []  # rendered parts, and the block they travel with
    waiting: list[tuple[str, str]] = []
    special = o.sort is not None and any(s.lstrip("-") == "special" for s in o.sort)
    for b in blocks:
        if b.kind == "whitespace":
            waiting.append(("gap", b.raw))
        elif b.kind in ("comment", "other"):
            if not o.strip_comments:
                raw = b.raw if not o.tidy_comments else re.sub(r"^@\s*(\w+)\s*(?=[{(])", lambda m: f"@{m[1].lower()}", b.raw.strip(SPACE))
                waiting.append(("comment", raw))
        elif b.entry:
            i = order[id(b.entry)]
            if gone[i]:
                waiting.append(("gone", ""))
            else:
                groups.append(([*waiting, ("entry", render_entry(b.entry, keys[i], o))], b))
                waiting = []
        else:
            raw = re.sub(r"^@\s*(\w+)\s*(?=[{(])", lambda m: f"@{m[1].lower()}", b.raw)
            if o.sort and not special:
                waiting.append(("entry", raw))
            else:
                groups.append(([*waiting, ("entry", raw)], b))
                waiting = []
    for name in reversed(o.sort or ()):
        plain, down = name.lstrip("-"), name.startswith("-")
        valued = [(sort_value(b.entry, b, plain, keys[order[id(b.entry)]] if b.entry else ""), (parts, b)) for parts, b in groups]
        known = sorted([v for v in valued if v[0] is not None], key=lambda v: v[0], reverse=down)
        groups = [g for _, g in known] + [g for v, g in valued if v is None]
    return TidyResult(_layout([p for parts, _ in groups for p in parts] + waiting, o), warnings + found, len(entries))


def _layout(parts: list[tuple[str, str]], o: TidyOptions) -> str:
    out: list[str] = []
    last, gap = "", ""
    for kind, text in parts:
        if kind in ("gap", "gone"):
            gap, last = text, last if kind == "gap" else kind
            continue
        if kind == "comment" and not o.tidy_comments:
            out.append((gap[1:] if gap.startswith("\n") and out else gap) + text + ("" if text.endswith("\n") else "\n"))
        else:
            blank = o.blank_lines and out and not (last == "comment" or kind == "comment" and last == "comment") or last == kind == "comment" and gap.count("\n") > 1
            out.append("\n" * bool(blank) + text + "\n")
        last, gap = kind, ""
    return "".join(out)
