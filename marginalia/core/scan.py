"""Lossless scanner of raw BibTeX: blocks, entries, fields and their spans.

Concatenating ``raw`` of all blocks gives the source back.  Spans count UTF-8
bytes; inside this module positions are characters.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

#: Unicode White_Space (fixed values).
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES = re.compile(f"[{SPACE}]+")
_OPENER = re.compile(rf"@[{SPACE}]*+([^\n{{(@,=%\"#}})]*+)[{SPACE}]*+([{{(])")
_LINE_AT = re.compile(rf"\n[ \t]*@")
_MARKS = re.compile(r'[{}()"%,=\\]')
_BARE = re.compile(r"[A-Za-z0-9_:./\-]+")
_NAME = re.compile("[^\"%'(),={}\\n]+\\Z")
_IDENTIFIER = re.compile(rf"[^{SPACE}\"#%'(),={{}}]+\Z")
_FIELD_NAME = re.compile(r"[^=,]*")
_BRACES = re.compile(r"\\.|[{}]", re.S)
_QUOTES = re.compile(r'\\.|[{}"]', re.S)
_KEY_END = re.compile("[,=]")
_NO_KEY = re.compile(rf"[{SPACE}\"#%~$]")
_OPENS = re.compile("[@%]")
_COMMENT = re.compile(r"@comment\b", re.I)
_PROPER = re.compile(rf"[^:<\->@{{}}\"#'(),=%\\~{SPACE}\x00-\x1f][^@{{}}\"#'(),=%\\~{SPACE}\x00-\x1f]*\Z")


def _values(plain: str, deep: str) -> tuple[str, str]:
    """Patterns of a braced value, up to four levels deep, and of a quoted one; ``plain`` is what marks nothing, ``deep`` what is skipped."""
    inner = rf"(?:{plain}{deep})*+"
    for _ in range(3):
        inner = rf"(?:{plain}{deep}|\{{{inner}\}})*+"
    quoted = plain.replace("{}", '"{}')
    return rf"\{{{inner}\}}", rf'"(?:{quoted}{deep}|\{{(?:{plain}{deep})*+\}})*+"'


#: What holds no end of a block: whole values and what lies between them, with and without escapes.
_WITHIN = {}
for _escapes, _braced, _quoted in ((True, *_values(r"[^{}\\]++", r"|\\.")), (False, *_values("[^{}]++", ""))):
    _WITHIN[_escapes] = re.compile(rf'(?:[^{{}}"%\\]++|{_braced}|{_quoted})*+', re.S)
#: A field with one value as most are written, and the comma after it.
_BRACED, _QUOTED = _values(r"[^{}\\]++", r"|\\.")
_SIMPLE = re.compile(rf"([A-Za-z][\w:\-]*+)[{SPACE}]*+=[{SPACE}]*+({_BRACED}|{_QUOTED}|[A-Za-z0-9_:./\-]++)[{SPACE}]*+(?:,[{SPACE}]*+|\Z)", re.S | re.A)

#: The parts of an entry that is written plainly: its head up to the comma behind the key, a field with one value, one with several.
#: A backslash stands before nothing that marks an end, so that readings with and without escapes agree.
_PLAIN_BRACED, _PLAIN_QUOTED = _values(r"[^{}\\]++", r"|\\[^{}\\]")[0], _values(r"[^{}\\]++", r'|\\[^{}"\\]')[1]
_PLAIN_VALUE, _PLAIN_END = rf"(?:{_PLAIN_BRACED}|{_PLAIN_QUOTED}|[A-Za-z0-9_:./\-]++)", rf"[{SPACE}]*+(?:,[{SPACE}]*+|(?=\}}))"
_PLAIN_NAME = rf"([A-Za-z][\w:\-]*+)[{SPACE}]*+=[{SPACE}]*+"
_PLAIN_HEAD = re.compile(rf"@([A-Za-z]++)\{{[{SPACE}]*+([^{SPACE}\"#%~$,={{}}()\\@]++)[{SPACE}]*+,[{SPACE}]*+")
_PLAIN_FIELD = re.compile(rf"{_PLAIN_NAME}(?:\{{({_PLAIN_BRACED[2:-2]})\}}|\"({_PLAIN_QUOTED[1:-1]})\"|([A-Za-z0-9_:./\-]++)){_PLAIN_END}", re.S | re.A)
_PLAIN_ATOM = re.compile(rf"\{{({_PLAIN_BRACED[2:-2]})\}}|\"({_PLAIN_QUOTED[1:-1]})\"|([A-Za-z0-9_:./\-]++)", re.S)
_PLAIN_SUM = re.compile(rf"{_PLAIN_NAME}(?={_PLAIN_VALUE}(?:[{SPACE}]*+#[{SPACE}]*+{_PLAIN_VALUE})++({_PLAIN_END}))", re.S | re.A)


@dataclass(slots=True)
class Atom:
    value: str
    mode: str  # Braced, Quoted or Bare
    raw: str


@dataclass(slots=True)
class Field:
    name: str
    value: str
    mode: str  # Bare, Braced, Expression, Missing or Quoted
    atoms: list[Atom]
    start: int  # of the inner text
    end: int
    outer_start: int  # with delimiters
    outer_end: int


class Entry:
    """A raw entry.  Of one written so plainly that nothing can be wrong with it, ``parts`` are what was read, and fields are made when asked for.

    A part is name, value, kind of value (2 braced, 3 quoted, 4 bare; 0 for several operands, which are given instead), start and end.
    """

    __slots__ = ("kind", "key", "parts", "_text", "_fields")

    def __init__(self, kind: str, key: str, fields: list[Field] | None = None, parts: list[tuple] | None = None, text: str = ""):
        self.kind, self.key, self.parts, self._text = kind, key, parts, text
        self._fields = fields if fields is not None or parts is not None else []

    @property
    def fields(self) -> list[Field]:
        if self._fields is None:
            self._fields = [_plain_field(self._text, *part) for part in self.parts]
            self.parts, self._text = None, ""  # fields may be changed from here on
        return self._fields

    @fields.setter
    def fields(self, fields: list[Field]) -> None:
        self._fields, self.parts, self._text = fields, None, ""

    def __eq__(self, other) -> bool:
        return isinstance(other, Entry) and (self.kind, self.key, self.fields) == (other.kind, other.key, other.fields)

    def __repr__(self) -> str:
        return f"Entry(kind={self.kind!r}, key={self.key!r}, fields={self.fields!r})"

    def get(self, name: str) -> str | None:
        low = name.lower()
        return next((f.value for f in self.fields if f.name.lower() == low), None)

    def get_all(self, name: str) -> list[Field]:
        low = name.lower()
        return [f for f in self.fields if f.name.lower() == low]

    def get_unique(self, name: str) -> Field:
        found = self.get_all(name)
        if len(found) != 1:
            raise KeyError(name) if not found else ValueError(f'field "{name}" occurs {len(found)} times')
        return found[0]


@dataclass(slots=True)
class Block:
    kind: str  # whitespace, comment, preamble, string, entry, failed or other
    start: int
    end: int
    raw: str
    key: str | None = None
    value: str | None = None
    error: str | None = None
    entry: Entry | None = None
    fault: str | None = None  # what keeps a string definition from being one


class Malformed(ValueError):
    pass


def _search_end(text: str, at: int, opener: str, escapes: bool, keyed: bool) -> int:
    """Position after the delimiter that closes a block opened just before ``at``, or -1."""
    closer = "}" if opener == "{" else ")"
    depth, quoted = 0, False
    quote_depth = 0
    within = _WITHIN[escapes] if opener == "{" else None
    while True:
        if within and keyed and not depth and not quoted:
            at = within.match(text, at).end()
        if not (found := _MARKS.search(text, at)):
            return -1
        mark, at = found[0], found.end()
        if mark == "\\":
            at += escapes
        elif mark == "%" and depth == 0 and not quoted and (found.start() == 0 or text[found.start() - 1] != "\\"):
            line = text.find("\n", at)
            at = len(text) if line < 0 else line
        elif quoted:
            quote_depth = max(0, quote_depth + (mark == "{") - (mark == "}"))
            if mark == '"' and quote_depth == 0:
                quoted = False
        elif mark == closer and depth == 0:
            return at
        elif not keyed:
            keyed = mark in ",="
        elif mark == '"' and depth == 0:
            quoted, quote_depth = True, 0
        elif mark == "{":
            depth += 1
        elif mark == "}":
            depth = max(0, depth - 1)


class Ends:
    """Where the blocks of one text end, in time in proportion to the text however many are asked for.

    Ends are searched for directly until a few blocks have none.  Looking on to the
    end of the text for every further one would cost squares, so from then on a table
    answers: from the last mark back, each state's end follows from those of the
    marks after it.
    """

    def __init__(self, text: str):
        self.text = text
        self.places: list[int] = []
        self.tables: dict[tuple[bool, str], tuple[list[int], list[int]]] = {}
        self.searches = 8  # in vain, before the table is made

    def after(self, at: int, opener: str, escapes: bool, keyed: bool = False) -> int:
        """Position after the closing delimiter of the block whose inside begins at ``at``, or -1."""
        if self.searches > 0:
            end = _search_end(self.text, at, opener, escapes, keyed)
            self.searches -= end < 0
            return end
        if (escapes, opener) not in self.tables:
            self._tabulate(escapes)
        inside = self.tables[escapes, opener][0 if keyed else 1]
        end = inside[bisect_left(self.places, at)]
        return -1 if end < 0 else self.places[end] + 1

    def both(self, at: int, opener: str, keyed: bool) -> list[int]:
        """The ends with and without escapes, in order; they differ only behind a backslash."""
        end = self.after(at, opener, True, keyed)
        if self.text.find("\\", at, end if end >= 0 else len(self.text)) < 0:
            return [end] if end > 0 else []
        return sorted({e for e in (end, self.after(at, opener, False, keyed)) if e > 0})

    def _tabulate(self, escapes: bool) -> None:
        text = self.text
        marks = [(m.start(), m[0]) for m in _MARKS.finditer(text)]
        self.places = places = [p for p, _ in marks]
        n = len(marks)
        none = [-1] * (n + 2)
        closed, quote = none[:], none[:]  # the brace that closes a level, the quote that ends a string
        inside = {"{": (none[:], none[:]), "(": (none[:], none[:])}
        for i in range(n - 1, -1, -1):
            place, mark = marks[i]
            if mark == "\\":
                onward = i + 1 + (escapes and i + 1 < n and places[i + 1] == place + 1)
                for table in (closed, quote, *inside["{"], *inside["("]):
                    table[i] = table[onward]
                continue
            level = closed[i + 1] if mark == "{" else -1  # the brace that closes this one
            beyond = level + 1 if level >= 0 else n + 1
            closed[i] = i if mark == "}" else closed[beyond] if mark == "{" else closed[i + 1]
            quote[i] = i if mark == '"' else quote[beyond] if mark == "{" else quote[i + 1]
            if mark == "%" and (place == 0 or text[place - 1] != "\\"):
                line = text.find("\n", place)
                onward = n if line < 0 else bisect_left(places, line)
                for opener in "{(":
                    for table in inside[opener]:
                        table[i] = table[onward]
                continue
            for opener, closer in ("{}", "()"):
                keyed, bare = inside[opener]
                if mark == closer:
                    keyed[i] = bare[i] = i
                    continue
                bare[i] = keyed[i + 1] if mark in ",=" else bare[i + 1]
                keyed[i] = keyed[quote[i + 1] + 1 if quote[i + 1] >= 0 else n + 1] if mark == '"' else keyed[beyond] if mark == "{" else keyed[i + 1]
        for opener in "{(":
            self.tables[escapes, opener] = inside[opener]


def _skip(text: str, at: int) -> int:
    """Past white space and ``%`` comments."""
    while True:
        if found := _SPACES.match(text, at):
            at = found.end()
        if at < len(text) and text[at] == "%":
            line = text.find("\n", at)
            at = len(text) if line < 0 else line + 1
            continue
        return at


def _braced_end(text: str, at: int) -> int:
    depth = 0
    for found in _BRACES.finditer(text, at):
        if found[0] == "{":
            depth += 1
        elif found[0] == "}":
            depth -= 1
            if not depth:
                return found.end()
    return -1


def _quoted_end(text: str, at: int) -> int:
    depth = 0
    for found in _QUOTES.finditer(text, at + 1):
        depth += (found[0] == "{") - (found[0] == "}")
        if found[0] == '"' and depth <= 0:
            return found.end()
    return -1


def atoms_of(text: str, at: int, name: str) -> tuple[list[Atom], int, int]:
    """Operands of a ``#`` expression from ``at``: (atoms, start, end)."""
    atoms: list[Atom] = []
    start = at
    while True:
        if found := _PLAIN_ATOM.match(text, at):
            which, (first, last) = found.lastindex, found.span(found.lastindex)
            value, end = found[which], last + (which < 3)
            atoms.append(Atom(value, "Bare", value) if which == 3 else Atom(value, "Braced" if which == 1 else "Quoted", text[first - 1 : end]))
        elif at < len(text) and text[at] in '{"':
            mode, find = ("Braced", _braced_end) if text[at] == "{" else ("Quoted", _quoted_end)
            end = find(text, at)
            if end < 0:
                raise Malformed(f'field "{name}" is missing a separator')
            atoms.append(Atom(text[at + 1 : end - 1], mode, text[at:end]))
        else:
            found = _BARE.match(text, at)
            if not found:
                break
            end = found.end()
            atoms.append(Atom(found[0], "Bare", found[0]))
        at = _skip(text, end)
        if at < len(text) and text[at] == "#":
            at = _skip(text, at + 1)
            continue
        return atoms, start, end
    return atoms, start, at


def _entry(kind: str, body: str, offset: int) -> Entry:
    """Key and fields of an entry's body; ``offset`` is where the body lies in the source."""
    mark = _KEY_END.search(body)
    entry = Entry(kind, "")
    if mark and mark[0] == ",":
        entry.key, at = body[: mark.start()].strip(SPACE), mark.end()
    elif mark:
        at = 0
    else:
        entry.key, at = body.strip(SPACE), len(body)
    if _NO_KEY.search(entry.key):
        raise Malformed(f'entry key "{entry.key}" is invalid')
    while (at := _skip(body, at)) < len(body):
        if body[at] == ",":
            at += 1
            continue
        simple = _SIMPLE.match(body, at)
        while simple:
            raw, start, end = simple[2], offset + simple.start(2), offset + simple.end(2)
            if raw[0] in '{"':
                inner, mode = raw[1:-1], "Braced" if raw[0] == "{" else "Quoted"
                entry.fields.append(Field(simple[1], inner.strip(SPACE), mode, [Atom(inner, mode, raw)], start + 1, end - 1, start, end))
            else:
                entry.fields.append(Field(simple[1], raw, "Bare", [Atom(raw, "Bare", raw)], start, end, start, end))
            at = simple.end()
            simple = _SIMPLE.match(body, at)
        if at >= len(body) or body[at] in ",%":
            continue
        found = _FIELD_NAME.match(body, at)
        name, at = found[0].strip(SPACE), found.end()
        if at < len(body) and body[at] == "=":
            if not name:
                raise Malformed("field name is empty")
            if not _NAME.match(name):
                raise Malformed("field name contains invalid character" if len(name.split()) < 2 else f'field "{name.split()[0]}" is missing a separator')
            at = _skip(body, at + 1)
            atoms, start, end = atoms_of(body, at, name)
            if not atoms:
                entry.fields.append(Field(name, "", "Missing", [], offset + at, offset + at, offset + at, offset + at))
            elif len(atoms) == 1:
                mode = atoms[0].mode
                inner = (offset + start + 1, offset + end - 1) if mode != "Bare" else (offset + start, offset + end)
                entry.fields.append(Field(name, atoms[0].value.strip(SPACE), mode, atoms, *inner, offset + start, offset + end))
            else:
                entry.fields.append(Field(name, body[start:end], "Expression", atoms, offset + start, offset + end, offset + start, offset + end))
            at = _skip(body, end)
            if at < len(body) and body[at] != ",":
                raise Malformed(f'field "{name}" is missing a separator')
        elif name:
            if not _NAME.match(name):
                raise Malformed(f'field "{name}" is missing \'=\'')
            entry.fields.append(Field(name, "", "Missing", [], offset + at, offset + at, offset + at, offset + at))
    return entry


def _opens(text: str, at: int) -> re.Match | None:
    found = _OPENER.match(text, at)
    return found if found and _IDENTIFIER.match(found[1].strip(SPACE)) else None


def _string_parts(body: str) -> tuple[str, str, list[Atom], str | None]:
    """Name, value text and operands of the body of a string definition, and why it is none."""
    name, equals, value = body.partition("=")
    name = name.strip(SPACE)
    if not equals:
        return name, value, [], "the definition has no value"
    try:
        atoms, _, end = atoms_of(value, _skip(value, 0), name)
    except Malformed as error:
        atoms, fault = [], str(error)
    else:
        rest = value[_skip(value, end) :].strip(SPACE).removeprefix(",").strip(SPACE)
        fault = "the value is malformed" if not atoms or rest else None
    return name, value, atoms, fault if identifier(name) else "the name is not an identifier"


def identifier(name: str) -> bool:
    """Whether a name can stand before ``=``: no delimiters or white space, and no mark of comparison in front."""
    return bool(_PROPER.match(name))


def entry_fault(entry: Entry) -> str | None:
    """Why an entry that the scanner takes is not valid, or None."""
    if not entry.key:
        return "the entry has no key"
    if entry.parts is not None:
        return None
    for f in entry.fields:
        if not identifier(f.name):
            return f'field name "{f.name}" is not an identifier'
        if f.mode == "Missing":
            return f'field "{f.name}" has no value'
    return None


def _atoms_or_none(text: str) -> list[Atom]:
    try:
        return atoms_of(text, _skip(text, 0), "")[0]
    except Malformed:
        return []


def _plain_sum(text: str, found: re.Match) -> tuple[list[Atom], int, int, int]:
    atoms, start, end = atoms_of(text, found.end(), found[1])
    return atoms, 0, start, end


def _plain_field(text: str, name: str, value: str | list[Atom], which: int, start: int, end: int) -> Field:
    """The field of a part of a plain entry."""
    if not which:
        return Field(name, text[start:end], "Expression", value, start, end, start, end)
    if which == 4:
        return Field(name, value, "Bare", [Atom(value, "Bare", value)], start, end, start, end)
    mode = "Braced" if which == 2 else "Quoted"
    return Field(name, value.strip(SPACE), mode, [Atom(value, mode, text[start - 1 : end + 1])], start, end, start - 1, end + 1)


def _plain_block(text: str, at: int, closing: Ends) -> Block | None:
    """The entry at a place, read in one pass where it is written plainly; what it is in :func:`_block` too."""
    head = _PLAIN_HEAD.match(text, at)
    if not head:
        return None
    kind, key = head.groups()
    if kind.lower() in ("comment", "preamble", "string"):
        return None
    parts: list[tuple] = []
    here = head.end()
    while True:
        if found := _PLAIN_FIELD.match(text, here):
            which = found.lastindex
            parts.append((found[1], found[which], which, *found.span(which)))
            here = found.end()
        elif found := _PLAIN_SUM.match(text, here):
            parts.append((found[1], *_plain_sum(text, found)))
            here = found.end(2)
        else:
            break
    if text[here : here + 1] != "}" or closing.after(head.end(), "{", True, True) != here + 1:
        return None
    return Block("entry", at, here + 1, text[at : here + 1], key, None, None, Entry(kind, key, None, parts, text))


def _block(text: str, at: int, closing: Ends) -> Block:
    found = _opens(text, at)
    line_end = text.find("\n", at)
    line_end = len(text) if line_end < 0 else line_end
    if not found:
        if _COMMENT.match(text[at : at + 9]):
            return Block("comment", at, line_end, text[at:line_end], value=text[at + 8 : line_end].strip())
        found_next = _OPENS.search(text, at + 1)
        end = found_next.start() if found_next else len(text)
        return Block("other", at, end, text[at:end], value=text[at:end])
    word, inner = found[1].strip(SPACE), found.end()
    kind = word.lower()
    ends = closing.both(inner, found[2], kind in ("preamble", "comment"))
    if len(ends) == 2:  # without escapes it ends earlier: only where something can follow
        gap = _SPACES.match(text, ends[0])
        rest = text[gap.end() if gap else ends[0] :][:1]
        ends = ends if not rest or rest in "@%" else ends[1:]
    if not ends:
        again = _LINE_AT.search(text, at + 1)
        end = again.start() + 1 if again else len(text)
        return Block("failed", at, end, text[at:end], error="entry ended before closing delimiter")
    end = ends[0]
    raw, body = text[at:end], text[inner : end - 1]
    if kind == "comment":
        return Block("comment", at, end, raw, value=body)
    if kind == "preamble":
        atoms = _atoms_or_none(body)
        return Block("preamble", at, end, raw, value=atoms[0].value if len(atoms) == 1 and atoms[0].mode != "Bare" else body.strip(SPACE))
    if kind == "string":
        name, value, atoms, fault = _string_parts(body)
        return Block("string", at, end, raw, key=name.lower() if atoms else "", value=atoms[0].value if len(atoms) == 1 else value.strip(SPACE) if atoms else "", fault=fault)
    try:
        entry = _entry(word, body, inner)
    except Malformed as error:
        return Block("failed", at, end, raw, error=str(error))
    return Block("entry", at, end, raw, key=entry.key, entry=entry)


def scan(text: str) -> list[Block]:
    """All blocks of a source, in order; their raw texts join to the source."""
    blocks: list[Block] = []
    at, n, closing = 0, len(text), Ends(text)
    while at < n:
        if found := _SPACES.match(text, at):
            block = Block("whitespace", at, found.end(), found[0])
        elif text[at] == "@" and (plain := _plain_block(text, at, closing)):
            block = plain
        elif text[at] == "%":
            end = text.find("\n", at)
            end = n if end < 0 else end
            for inside in re.finditer("@", text[at:end]):  # a whole block may follow on the line
                if (candidate := _opens(text, at + inside.start())) and "\n" not in candidate[0] and closing.after(candidate.end(), candidate[2], True) > 0:
                    whole = _block(text, at + inside.start(), closing)
                    if whole.kind in ("entry", "string", "preamble"):
                        end = at + inside.start()
                        break
            block = Block("comment", at, end, text[at:end], value=text[at + 1 : end].strip())
        elif text[at] == "@":
            block = _block(text, at, closing)
        else:
            end = at
            while True:
                found = _OPENS.search(text, end)
                end = found.start() if found else n
                if not found or text[end] == "%" or _opens(text, end):
                    break
                end += 1
            block = Block("other", at, end, text[at:end], value=text[at:end])
        blocks.append(block)
        at = block.end
    return blocks


def byte_spans(text: str, positions: list[int]) -> dict[int, int]:
    """Character positions to UTF-8 byte offsets."""
    if text.isascii():
        return {p: p for p in positions}
    out, last, size = {}, 0, 0
    for p in sorted(set(positions)):
        size += len(text[last:p].encode("utf-8", "surrogatepass"))
        out[p], last = size, p
    return out


def set_field(text: str, key: str, name: str, value: str, occurrence: int = 0, blocks: list[Block] | None = None) -> str:
    """The source with one field's value replaced; everything else stays as it is.  ``blocks`` are its scan, where that is at hand."""
    low = name.lower()
    # A name that stands nowhere needs no scan (of the letters that change case, only the final sigma looks at its neighbours).
    if key not in text or low.isascii() and low not in text.lower():
        raise KeyError(f"{key}.{name}")
    found = [f for b in (scan(text) if blocks is None else blocks) if b.entry and b.entry.key == key for f in b.entry.fields if f.name.lower() == low]
    if not found:
        raise KeyError(f"{key}.{name}")
    if occurrence >= len(found):
        raise IndexError(f"{key}.{name} has {len(found)} occurrences")
    target = found[occurrence]
    if target.mode == "Missing":
        if value:
            raise ValueError("BibTeX field without an assignment cannot be edited to a value")
        return text
    if target.mode == "Bare" and _BARE.fullmatch(value):
        return text[: target.start] + value + text[target.end :]
    unsafe = "quoted" if target.mode == "Quoted" else "braced"
    quotes = _plain_places(value, '"')
    if refused(value) or target.mode == "Quoted" and any(not depth for _, depth in quotes):
        raise ValueError(f"BibTeX field value contains an unsafe {unsafe} delimiter")
    if target.mode == "Quoted" and not quotes or target.mode == "Braced":
        return text[: target.start] + value + text[target.end :]
    return text[: target.outer_start] + "{" + value + "}" + text[target.outer_end :]


def refused(value: str) -> bool:
    """Whether :func:`set_field` refuses a value whatever field it is for."""
    return not _balanced(value) or "\n" in value or bool(_plain_places(value, "%")) or _ends_escaped(value)


def _plain_places(value: str, char: str) -> list[tuple[int, int]]:
    """Places of an unescaped character and how many braces are open there."""
    out, depth = [], 0
    if char not in value:
        return out
    for found in re.finditer(r"\\.|[{}]|" + re.escape(char), value, re.S):
        if found[0] == char:
            out.append((found.start(), depth))
        depth += (found[0] == "{") - (found[0] == "}")
    return out


def _balanced(value: str) -> bool:
    if "{" not in value and "}" not in value:
        return True
    depth = 0
    for found in re.finditer(r"\\.|[{}]", value, re.S):
        depth += (found[0] == "{") - (found[0] == "}")
        if depth < 0:
            return False
    return not depth


def _ends_escaped(value: str) -> bool:
    return (len(value) - len(value.rstrip("\\"))) % 2 == 1
