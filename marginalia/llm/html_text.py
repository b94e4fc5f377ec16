"""Layout-aware text of HTML pages.

A tokeniser and a tree builder that supplies implied tags make a tree of any
markup, however broken; a renderer walks it and emits all visible text: blocks
on their own lines with blank lines around paragraphs and headings, lists with
markers and indents, tables with cells aligned in columns, preformatted text as
it stands.  Style rules whose selector is one tag, class or id hide what they
say; other selectors and conditional rules are not read.  A closed <details>
shows its summary, form controls show their text.

Both walk with stacks of their own, so depth is no limit, and take time and room
in proportion to the page, whatever is in it: every delimiter is looked for
once, open elements are found by tag, indents stop growing after ``DEEP`` levels,
tables inside as many cells are rendered as plain blocks, cells are padded to
``WIDE`` columns and span as many columns and rows at most.

Rows are independent: one map over Arrow batches, nothing shuffled.

Defined results: null html gives an empty text; text outside any element is
rendered; a tag that the page ends in is dropped; repeated rows give repeated
results, an empty table none; columns other than page_id and html are ignored.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia import runtime

_COMMENT_END = re.compile(r"--!?>")
_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_NAME = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]+")
#: Levels of indents, and of tables in cells, that are laid out; columns that a cell is padded to.
DEEP, WIDE = 16, 80
_BLANK = re.compile(r"[ \t\n\r\f]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Never rendered, whatever their style says.
UNSEEN = frozenset("head script style template title meta link base noscript noembed noframes iframe object video audio canvas datalist param source track area map rp xmp".split())
BLOCKS = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li listing main menu nav ol p plaintext pre search section summary ul table caption thead tbody tfoot tr option optgroup".split())
#: Separated from their neighbours by a blank line.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure hr".split())
_LISTS = frozenset("ul ol menu dir".split())
#: Start tags that end an open <p>.
_ENDS_P = BLOCKS - {"html", "body", "caption", "thead", "tbody", "tfoot", "tr", "option", "optgroup"}
#: Start tag -> open elements it ends, looked for up to a boundary.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
    "body": ({"head"}, {"html"}),
}
#: Inside svg and math, what is defined or noted there and not drawn.
_UNDRAWN = frozenset("annotation annotation-xml clippath defs desc marker mask metadata pattern symbol".split())
_HEAD_ONLY = frozenset("title meta link base style script noscript template".split())
_P_SCOPE = frozenset("table td th caption button object html body".split())


class Node:
    """An element: tag, attributes, and children that are nodes or texts."""

    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag = tag
        self.attributes = attributes or {}
        self.children: list[Node | str] = []


def _rest_of_tag(source: str, at: int) -> tuple[dict[str, str], bool, int] | None:
    """Attributes from ``at``, whether a slash ends the tag, and where it ends; None where the page ends first."""
    found: dict[str, str] = {}
    n = len(source)
    while True:
        gap = _GAP.match(source, at)
        at = gap.end()
        if at >= n:
            return None
        if source[at] == ">":
            return found, source[at - 1] == "/", at + 1
        name = _NAME.match(source, at)
        at = name.end()
        value = ""
        if equals := _EQUALS.match(source, at):
            at = equals.end()
            if at >= n:
                return None
            if source[at] in "\"'":
                end = source.find(source[at], at + 1)
                if end < 0:
                    return None
                value, at = source[at + 1 : end], end + 1
            elif bare := _BARE.match(source, at):
                value, at = bare[0], bare.end()
        found.setdefault(name[0].lower(), entities.unescape(value) if "&" in value else value)


def _rules(sheet: str) -> list[tuple[str, str]]:
    """(selector, declarations) of a style sheet's plain rules; blocks of at-rules are skipped."""
    out, at, inside = [], 0, 0
    sheet = "".join([part.partition("*/")[2] if k else part for k, part in enumerate(sheet.split("/*"))])
    while (opened := sheet.find("{", at)) >= 0:
        head = sheet[at:opened].rpartition("}")
        inside = max(0, inside - sheet.count("}", at, opened))
        if head[2].strip().startswith("@"):
            at, inside = opened + 1, inside + 1
            continue
        closed = sheet.find("}", opened)
        body = sheet[opened + 1 : closed if closed >= 0 else len(sheet)]
        if not inside:
            out += [(selector.strip(), body) for selector in head[2].split(",")]
        if closed < 0:
            break
        at = closed + 1
    return out


_PLAIN_SELECTOR = re.compile(r"[.#]?[A-Za-z_][\w-]*\Z")


def _declared(text: str) -> dict[str, str]:
    """Declarations that matter here; an important one is marked by a space in front."""
    out = {}
    for part in text.split(";"):
        name, _, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        if name in ("display", "visibility", "content-visibility", "white-space"):
            plain = value.removesuffix("!important").strip()
            out[name] = plain if plain == value else f" {plain}"
    return out


class Tree:
    """The tree of a page under construction."""

    def __init__(self):
        self.root = Node("#root")
        self.opened = [self.root]
        self.places: dict[str, list[int]] = {}  # where elements of each tag are open
        self.sheets: list[str] = []

    def cut(self, at: int) -> None:
        while len(self.opened) > at:
            self.places[self.opened.pop().tag].pop()

    def last(self, tags) -> int:
        """Place of the innermost open element of these tags, or -1."""
        places = self.places
        return max([held[-1] for tag in tags if (held := places.get(tag))], default=-1)

    def close_to(self, names, boundary) -> None:
        """End the innermost of ``names`` above ``boundary``, and with it all inside; repeat."""
        while (at := self.last(names)) > self.last(boundary):
            self.cut(at)

    def foreign(self) -> bool:
        return bool(self.places.get("svg") or self.places.get("math"))

    def say(self, text: str) -> None:
        """Text in place: an open head ends at it, and svg draws it in its labels only."""
        if self.opened[-1].tag == "head" and text.strip(" \t\n\r\f"):
            self.cut(len(self.opened) - 1)
        if not self.places.get("svg") or self.places.get("text") or self.places.get("foreignobject"):
            self.opened[-1].children.append(text)

    def start(self, tag: str, attributes: dict[str, str], empty: bool) -> None:
        opened = self.opened
        if opened[-1].tag == "head" and tag not in _HEAD_ONLY and tag != "head":
            self.cut(len(opened) - 1)
        if tag in _ENDS_P:
            self.close_to(("p",), _P_SCOPE)
        if tag in _IMPLIED:
            self.close_to(*_IMPLIED[tag])
        if tag in ("td", "th") and opened[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self.start("tr", {}, False)
        if tag == "a":
            self.close_to(("a",), _P_SCOPE)
        if tag in _HEADINGS and opened[-1].tag in _HEADINGS:
            self.cut(len(opened) - 1)
        if tag in _UNDRAWN and self.foreign():
            attributes = attributes | {"hidden": ""}
        if tag == "text" and self.places.get("svg"):
            opened[-1].children.append(" ")  # labels stand apart
        node = Node(tag, attributes)
        opened[-1].children.append(node)
        if tag == "optgroup" and attributes.get("label"):
            node.children.append(attributes["label"])
        if not empty and tag not in VOID:
            self.places.setdefault(tag, []).append(len(opened))
            opened.append(node)

    def end(self, tag: str) -> None:
        held = self.places.get(tag)
        if tag == "br" or tag == "p" and not held:
            self.start(tag, {}, tag == "p")
        elif held and (tag in _TABLE_PARTS or held[-1] > self.last(_CELLS)):  # else it would reach out of its cell
            self.cut(held[-1])


def parse(source: str) -> tuple[Node, list[str]]:
    """The tree of a page, with implied tags supplied, and its style sheets."""
    tree = Tree()
    at, n = 0, len(source)
    while at < n:
        mark = source.find("<", at)
        if mark < 0:
            mark = n
        elif not (source[mark + 1 : mark + 2].isalpha() or source[mark + 1 : mark + 2] in ("!", "?", "/")) or not source[mark + 1 : mark + 2].isascii():
            mark += 1  # a plain "<"
        text = source[at:mark]
        if text:
            tree.say(entities.unescape(text) if "&" in text else text)
        at = mark
        if at >= n or source[at] != "<" or text.endswith("<") and source[at] != "<":
            continue
        if source.startswith("<!--", at):
            close = _COMMENT_END.search(source, at + 2)
            at = close.end() if close else n
            continue
        if source.startswith("<![CDATA[", at):
            close = source.find("]]>", at)
            tree.say(source[at + 9 : close if close >= 0 else n])
            at = close + 3 if close >= 0 else n
            continue
        ending = source.startswith("</", at)
        name = _TAG_NAME.match(source, at + 1 + ending)
        if not name:
            if source[at + 1 : at + 2] in ("!", "?", "/"):
                close = source.find(">", at)
                at = close + 1 if close >= 0 else n
            else:
                tree.say("<")
                at += 1
            continue
        rest = _rest_of_tag(source, name.end())
        if rest is None:
            break
        tag, (attributes, slash, at) = name[0].lower(), rest
        if ending:
            tree.end(tag)
            continue
        empty = slash and (tree.foreign() or tag in ("svg", "math"))
        tree.start(tag, attributes, empty)
        if empty:
            continue
        if tag in ("pre", "listing"):
            at += source.startswith("\n", at) or 2 * source.startswith("\r\n", at)
        elif tag == "plaintext":
            tree.opened[-1].children.append(source[at:])
            break
        elif tag in RAW:
            close = _RAW_END[tag].search(source, at)
            raw = source[at : close.start()]
            if tag == "style":
                tree.sheets.append(raw)
            tree.opened[-1].children.append(entities.unescape(re.sub(r"\A\r?\n", "", raw) if tag == "textarea" else raw) if tag in ("textarea", "title") else raw)
            tree.cut(len(tree.opened) - 1)
            end = source.find(">", close.end())
            at = n if end < 0 or close.start() == n else end + 1
    return tree.root, tree.sheets


class Styles:
    """What style sheets and style attributes say of an element."""

    def __init__(self, sheets: list[str]):
        self.rules: dict[str, dict[str, str]] = {}
        for selector, body in (rule for sheet in sheets for rule in _rules(sheet)):
            if _PLAIN_SELECTOR.match(selector) and (said := _declared(body)):
                self.rules.setdefault(selector if selector[0] in ".#" else selector.lower(), {}).update(said)

    def of(self, node: Node) -> dict[str, str]:
        said: dict[str, str] = {}
        if self.rules:
            given = node.attributes
            keys = [node.tag, *[f".{c}" for c in given.get("class", "").split()], f"#{given['id']}" if "id" in given else ""]
            for key in keys:
                for name, value in self.rules.get(key, {}).items():
                    if not said.get(name, "").startswith(" ") or value.startswith(" "):
                        said[name] = value
        if style := node.attributes.get("style"):
            said |= {name: value for name, value in _declared(style).items() if not said.get(name, "").startswith(" ") or value.startswith(" ")}
        return {name: value.strip() for name, value in said.items()}


def hidden(node: Node, style: dict[str, str]) -> bool:
    """Whether an element and all in it is not displayed."""
    if node.tag in UNSEEN or node.tag == "dialog" and "open" not in node.attributes:
        return True
    if style.get("display") == "none" or style.get("content-visibility") == "hidden":
        return True
    return "hidden" in node.attributes and "display" not in style or node.attributes.get("type", "").lower() == "hidden"


def _visibility(style: dict[str, str], inherited: bool) -> bool:
    said = style.get("visibility")
    return inherited if said not in ("hidden", "collapse", "visible") else said == "visible"


def _preformatted(node: Node, style: dict[str, str], inherited: bool) -> bool:
    if node.tag in ("pre", "listing", "plaintext", "textarea"):
        return True
    said = style.get("white-space")
    return inherited if said not in ("pre", "pre-wrap", "pre-line", "normal", "nowrap") else said.startswith("pre")


def _marker(kind: str, number: int) -> str:
    """An ordered list's number in its type: 1, a, A, i or I."""
    if kind in ("a", "A") and number > 0:
        out = ""
        while number:
            number, digit = divmod(number - 1, 26)
            out = chr(97 + digit) + out
        return out.upper() if kind == "A" else out
    if kind in ("i", "I") and 0 < number < 4000:
        out = ""
        for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            out += sign * (number // value)
            number %= value
        return out.upper() if kind == "I" else out
    return str(number)


def _whole(text: str | None, other: int) -> int:
    text = (text or "").strip()
    return int(text) if text.removeprefix("-").isdigit() and text.isascii() and len(text) < 9 else other


class Flow:
    """Text under construction: collapses white space and owes breaks until text comes."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.owed = 0  # line breaks due before the next text
        self.space = False  # whether a space is due before the next text
        #: Per open level the indent up to it, and its list marker until that is written.
        self.indents: list[list[str | None]] = []
        self.written = 0  # levels below this have no marker to write

    def _open(self) -> None:
        if self.owed:
            if self.line:
                self._break()
            if self.lines:
                self.lines += [""] * (self.owed - 1)
            self.owed = 0
        if not self.line:
            levels, self.written = self.indents, min(self.written, len(self.indents))
            shown = [levels[self.written - 1][0] if self.written else ""]
            for level in levels[self.written :]:
                blank = level[0][sum(map(len, shown)) :] if level[1] is None else ""
                shown.append(level[1] or blank)
                level[1] = None
            self.written = len(levels)
            self.line.append("".join(shown))
            self.space = False

    def enter(self, width: int, mark: str | None = None) -> None:
        """A level further in; past ``DEEP`` levels the indent grows no more."""
        before = self.indents[-1][0] if self.indents else ""
        self.indents.append([before + " " * width if len(self.indents) < DEEP else before, mark])

    def leave(self) -> None:
        self.indents.pop()
        self.written = min(self.written, len(self.indents))

    def _break(self) -> None:
        self.lines.append("".join(self.line).rstrip())
        self.line = []
        self.space = False

    def words(self, text: str) -> None:
        words = [w for w in _BLANK.split(text) if w]
        if not words:
            self.space = self.space or bool(self.line and text)
            return
        begins = text[0] in " \t\n\r\f"
        due = (self.space or begins) and bool(self.line) and not self.owed
        self._open()
        if due:
            self.line.append(" ")
        self.line.append(" ".join(words))
        self.space = text[-1] in " \t\n\r\f"

    def verbatim(self, text: str) -> None:
        for k, part in enumerate(text.replace("\r\n", "\n").split("\n")):
            if k:
                self._open()
                self._break()
            if part:
                self._open()
                self.line.append(part)
        self.space = False

    def block(self, breaks: int) -> None:
        if self.line or self.lines:
            self.owed = max(self.owed, breaks)

    def newline(self) -> None:
        self._open()
        self._break()

    def insert(self, lines: list[str], breaks: int) -> None:
        if lines:
            self.block(breaks)
            for line in lines:
                self._open()
                self.line.append(line)
                self._break()
            self.block(breaks)

    def text(self) -> str:
        if self.line:
            self._break()
        return "\n".join(self.lines).strip("\n")


def _width(text: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text) if not text.isascii() else len(text)


def _span(node: Node, name: str) -> int:
    value = node.attributes.get(name, "1").strip()
    return min(max(int(value), 1), WIDE) if value.isascii() and value.isdigit() and len(value) < 6 else 1


def _aligned(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Lines of a table whose cells are (text, columns spanned, rows spanned); columns line up."""
    placed: list[list[tuple[int, str, int]]] = []
    widths: dict[int, int] = {}
    below: dict[int, tuple[int, int]] = {}  # column -> columns and rows that a cell further up still covers
    for row in rows:
        at, here, covers = 0, [], {}
        for text, across, down in row:
            while at in below:
                here.append((at, "", below[at][0]))
                at += below[at][0]
            here.append((at, text, across))
            if across == 1:
                widths[at] = max(widths.get(at, 0), max(map(_width, text.split("\n"))))
            if down > 1:
                covers[at] = (across, down - 1)
            at += across
        below = {c: (across, left - 1) for c, (across, left) in below.items() if left > 1} | covers
        placed.append(here)
    lines = []
    for here in placed:
        parts = [text.split("\n") for _, text, _ in here]
        for k in range(max(map(len, parts), default=0)):
            cells = []
            for part, (at, _, across) in zip(parts, here):
                room = widths.get(at, 0) if across == 1 else sum([widths.get(c, 0) for c in range(at, at + across)]) + 3 * (across - 1)
                shown = part[k] if k < len(part) else ""
                cells.append(shown + " " * (min(room, WIDE) - _width(shown)))
            lines.append(" | ".join(cells).rstrip())
    return lines


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TABLE_PARTS = frozenset("table tr tbody thead tfoot td th body html".split())
_CELLS = ("table", "td", "th")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])|\Z", re.I) for tag in RAW}
#: Types of <input> whose value is not shown as text.
_MUTE = frozenset("hidden checkbox radio password image file color range".split())


def render(root: Node, sheets: list[str] = ()) -> tuple[str, dict[str, int]]:
    """Visible text and how many blocks, lists and tables gave it.

    The stack holds what is still to do: a node to enter, or a function to run
    when everything inside an element is done.
    """
    counts = {"blocks": 0, "lists": 0, "tables": 0}
    flows, styles = [Flow()], Styles(sheets)
    tables: list[list[list[tuple[str, int, int]]]] = []
    lists: list[list] = []  # [type of number or empty, next number, step]
    flat = 0  # open tables that are too deep to be laid out
    todo: list = [(child, True, False) for child in reversed(root.children)]

    def leave_block(breaks: int):
        return lambda: flows[-1].block(breaks)

    def leave_list():
        lists.pop()
        flows[-1].block(1 if lists else 2)

    def leave_indent(breaks: int):
        def done():
            flows[-1].leave()
            flows[-1].block(breaks)

        return done

    def leave_cell(across: int, down: int):
        def done():
            text = flows.pop().text()
            tables[-1][-1].append((text, across, down))

        return done

    def leave_table():
        rows = [row for row in tables.pop() if any(text for text, _, _ in row)]
        flows[-1].insert(_aligned(rows), 2)

    def leave_flat():
        nonlocal flat
        flat -= 1
        flows[-1].block(2)

    while todo:
        item = todo.pop()
        if callable(item):
            item()
            continue
        node, seen, kept = item
        flow = flows[-1]
        if isinstance(node, str):
            if seen:
                flow.verbatim(node) if kept else flow.words(node)
            continue
        style = styles.of(node) if styles.rules or node.attributes else {}
        if hidden(node, style):
            continue
        tag = node.tag
        seen, kept = _visibility(style, seen), _preformatted(node, style, kept)
        if tag == "br":
            flow.newline()
            continue
        if tag == "hr":
            flow.block(2)
            continue
        if tag == "input" and seen and node.attributes.get("type", "").lower() not in _MUTE and node.attributes.get("value"):
            flow.words(f" {node.attributes['value']} ")
        if tag in VOID:
            continue
        breaks = 2 if tag in SPACED else 1 if tag in BLOCKS else 0
        counts["blocks"] += tag in BLOCKS
        children = node.children
        if tag == "table":
            counts["tables"] += 1
            flow.block(2)
            if flat or len(tables) >= DEEP:
                flat += 1
                todo.append(leave_flat)
            else:
                tables.append([])
                todo.append(leave_table)
        elif tag in ("tr", "td", "th") and flat:
            flow.block(1)
            todo.append(leave_block(1))
        elif tag == "tr" and tables:
            tables[-1].append([])
        elif tag in ("td", "th") and tables:
            if not tables[-1]:
                tables[-1].append([])
            flows.append(Flow())
            todo.append(leave_cell(_span(node, "colspan"), _span(node, "rowspan")))
        elif tag == "caption" and tables:
            flow.block(1)
            todo.append(leave_block(1))
        elif tag in _LISTS:
            counts["lists"] += 1
            flow.block(1 if lists else 2)
            down = tag == "ol" and "reversed" in node.attributes
            begin = _whole(node.attributes.get("start"), sum([not isinstance(c, str) and c.tag == "li" for c in children]) if down else 1)
            lists.append([node.attributes.get("type", "1") if tag == "ol" else "", begin, -1 if down else 1])
            todo.append(leave_list)
        elif tag == "li":
            flow.block(1)
            mark = "- "
            if lists and lists[-1][0]:
                number = _whole(node.attributes.get("value"), lists[-1][1])
                lists[-1][1] = number + lists[-1][2]
                mark = f"{_marker(lists[-1][0], number)}. "
            flow.enter(len(mark), mark)
            todo.append(leave_indent(1))
        elif tag in ("blockquote", "dd"):
            flow.block(breaks)
            flow.enter(4)
            todo.append(leave_indent(breaks))
        elif breaks:
            flow.block(breaks)
            todo.append(leave_block(breaks))
        if tag == "details" and "open" not in node.attributes:
            children = [c for c in children if not isinstance(c, str) and c.tag == "summary"][:1]
        todo += [(child, seen, kept) for child in reversed(children)]
    return flows[0].text(), counts


def page_text(source: str | None) -> tuple[str, dict[str, int]]:
    """Visible text of one page and its counts."""
    return render(*parse(source or ""))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars, n_blocks, n_lists and n_tables of every page."""
    runtime.ship(pages.sparkSession)
    schema = "page_id bigint, text string, n_chars bigint, n_blocks int, n_lists int, n_tables int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [page_text(source.as_py()) for source in batch.column(1)]
            counts = [pa.array([c[name] for _, c in got], pa.int32()) for name in ("blocks", "lists", "tables")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in got], pa.string()), pa.array([len(t) for t, _ in got], pa.int64()), *counts], names=["page_id", "text", "n_chars", "n_blocks", "n_lists", "n_tables"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "html").mapInArrow(run, schema)
