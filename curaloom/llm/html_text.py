"""Text of HTML pages, laid out as a reader sees it.

A tree builder supplies the tags that pages leave out, rules of visibility decide
what shows, and a renderer writes all visible text: blocks on lines of their own,
paragraphs apart, lists with their marks, table cells in aligned columns.

``display`` and ``visibility`` are taken from ``style`` attributes and from rules
of ``<style>`` elements, by importance, specificity and order; a child may be
visible again in a parent that is not.  Selectors may name tags, classes and ids,
and elements within others (``nav li.x``, ``div > p``).  Those with attributes or
states are passed over, and so are ``@`` blocks but ``@media`` for screens.

All steps run on explicit stacks, so elements may nest as deep as they like; an
end tag finds its element at any distance.  Work and output grow with the length
of the page alone, since layout is bounded: the indent, the nesting of aligned
tables and the width of columns, each by a constant below.
"""

from __future__ import annotations

import re
from html import unescape
from unicodedata import combining, east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

#: Fixed values of the language: elements without content, with raw text, hidden ones, and blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
UNPARSED = RAW | {"title", "textarea"}
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes object audio video canvas datalist annotation annotation-xml".split())
#: Within an ``svg``: the elements whose text shows, and those that are never drawn by themselves.
DRAWN_TEXT = frozenset("text foreignobject".split())
UNDRAWN = frozenset("defs desc metadata symbol clippath mask marker pattern lineargradient radialgradient filter".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr menu xmp".split())
BLOCKS = SPACED | frozenset("html body address article aside details dialog dd div dt fieldset figcaption footer form header hgroup legend li main nav section summary center caption tr option optgroup select textarea search".split())
CLOSES_P = SPACED | frozenset("address article aside center details dialog dir div dd dt fieldset figcaption footer form header hgroup li main nav section summary".split())
#: For an opening tag: the open elements it ends, and those at which the search for them stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select", "datalist"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "caption": ({"caption", "colgroup"}, {"table"}),
    "colgroup": ({"caption", "colgroup"}, {"table"}),
}
#: Elements that only mark text, and what an end tag of another kind doesn't reach across.
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
SPECIAL = BLOCKS | frozenset("table tbody thead tfoot td th ul ol dl pre blockquote figure hr menu xmp p button object template".split())
CELLS = frozenset("td th caption".split())
#: Values of ``display`` that put an element on lines of its own, and those that don't; elements of lists and tables keep theirs.
BLOCK_LIKE = frozenset("block flex grid flow-root list-item table -webkit-box".split())
INLINE_LIKE = frozenset("inline inline-block inline-flex inline-grid contents".split())
FIXED = frozenset("li ul ol menu dd table caption colgroup tbody thead tfoot tr td th blockquote svg text foreignobject html body".split())
TABLE_PARTS = frozenset("caption colgroup col tbody thead tfoot tr td th".split())
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
NAME = re.compile(r"[A-Za-z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=]+|=[^\s/>=]*)?(\s*=\s*)?")
UNQUOTED = re.compile(r"[^\s>]*")
SPACE = re.compile(r"[ \t\n\f\r]+")
DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
COMPOUND = re.compile(r"([A-Za-z][\w-]*|\*)?((?:[.#][\w-]+)*)")
MARK = re.compile(r"([.#])([\w-]+)")
SCREEN = re.compile(r"(?:only\s+)?(?:screen|all)", re.I)
BRACE = re.compile("[{}]")
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
#: Bounds of the layout: columns of indent, aligned tables within each other, columns of text that widen a table's column, the place up to which columns are aligned, and columns that a cell can hold for later rows.
DEEPEST, MOST_TABLES, WIDEST, FARTHEST, MOST_HELD = 60, 16, 80, 480, 1000
#: Open elements across which the end of a formatting element leaves blocks open; beyond that it ends them.
ACROSS = 64


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "depth", "met", "above")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent
        self.depth = parent.depth + 1 if parent else 0
        self.met = self.above = 0  # the beginnings of selectors that end here, and those that end in elements around


def tokens(html: str):
    """``("text", value)``, ``("open", tag, attributes)`` and ``("close", tag)`` in order."""
    at, size = 0, len(html)
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            yield "text", html[at:], None
            return
        if lt > at:
            yield "text", html[at:lt], None
        after = html[lt + 1 : lt + 2]
        if after == "!" and html.startswith("<!--", lt):
            end = html.find("-->", lt + 4) if not html.startswith(("<!-->", "<!--->"), lt) else html.find(">", lt) - 2
            at = size if end < 0 else end + 3
        elif after in ("!", "?") or (after == "/" and not html[lt + 2 : lt + 3].isalpha()):
            end = html.find(">", lt)
            at = size if end < 0 else end + 1
        elif name := NAME.match(html, lt + 1 + (after == "/")):
            tag, at, attrs = name[0].lower(), name.end(), {}
            while at < size and html[at] != ">":
                m = ATTRIBUTE.match(html, at)
                at, key, value = max(m.end(), at + (m.end() == at)), m[1], ""
                if m[2] and at < size:
                    if html[at] in "\"'":
                        end = html.find(html[at], at + 1)
                        if end < 0:
                            return  # the page ends inside a tag
                        value, at = html[at + 1 : end], end + 1
                    else:
                        m = UNQUOTED.match(html, at)
                        value, at = m[0], m.end()
                if key:
                    attrs.setdefault(key.lower(), unescape(value))
            if at >= size:
                return
            at += 1
            if after == "/":
                yield "close", tag, None
                continue
            yield "open", tag, attrs
            if tag in UNPARSED:
                end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(html, at)
                stop = end.start() if end else size
                if stop > at:
                    yield "raw" if tag in RAW else "text", html[at:stop], None
                at = stop
        else:
            yield "text", "<", None
            at = lt + 1


def build(html: str) -> tuple[Node, list[str]]:
    """The tree of a page and its style sheets; html, head, body, table sections, rows and ends of paragraphs are implied."""
    root, sheets = Node("html", {}, None), []
    head, body = Node("head", {}, root), Node("body", {}, root)
    root.children += [head, body]
    here, special = head, []
    opened: dict[str, list[Node]] = {"html": [root], "head": [head]}  # by tag, the innermost last

    def enter(tag: str, attrs: dict[str, str]) -> None:
        nonlocal here
        node = Node(tag, attrs, here)
        here.children.append(node)
        here = node
        opened.setdefault(tag, []).append(node)
        if tag in SPECIAL:
            special.append(node)

    def left() -> Node:
        """Close the innermost element."""
        nonlocal here
        node, here = here, here.parent
        opened[node.tag].pop()
        if node.tag in SPECIAL:
            special.pop()
        return node

    def leave(node: Node) -> None:
        """Close everything up to and with ``node``."""
        while left() is not node:
            pass

    def innermost(tags: set[str] | frozenset[str]) -> Node | None:
        found = None
        for tag in tags:
            own = opened.get(tag)
            if own and (found is None or own[-1].depth > found.depth):
                found = own[-1]
        return found

    def nearest(tags: set[str] | frozenset[str], stops: set[str] | frozenset[str]) -> Node | None:
        """The innermost open element of ``tags``, unless one of ``stops`` is open within it."""
        node = innermost(tags)
        if node is None:
            return None
        stop = (special[-1] if special else None) if stops is SPECIAL else innermost(stops)
        return node if stop is None or stop.depth <= node.depth else None

    def within_special(node: Node) -> bool:
        return bool(special) and special[-1].depth > node.depth

    def unwrap(outer: Node) -> None:
        """End a formatting element around open blocks: what they hold so far keeps it, and they go on without."""
        path, node = [], here
        while node is not outer:
            path.append(node)
            node = node.parent
            if len(path) > ACROSS:
                leave(outer)
                return
        opened[outer.tag].remove(outer)
        outer.children.pop()
        outer.parent.children.append(path[-1])
        path[-1].parent = outer.parent
        for nth, node in enumerate(path):
            inner = [node.children.pop()] if nth else []  # the next of the path, which is the last child
            if node.children:
                copy = Node(outer.tag, outer.attrs, node)
                copy.children = node.children
                for child in copy.children:
                    if isinstance(child, Node):
                        child.parent = copy
                inner.insert(0, copy)
            node.children = inner

    def to_body() -> None:
        nonlocal here
        if opened["head"]:
            while here.tag != "head":
                left()
            opened["head"].pop()
            opened["body"], here = [body], body

    for kind, value, attrs in tokens(html):
        if kind == "open":
            if value in ("html", "head", "body"):
                if value == "body":
                    to_body()
                (body if value == "body" else root if value == "html" else head).attrs.update({k: v for k, v in attrs.items()})
                continue
            if here.tag == "head" and value not in HEAD_ONLY:
                to_body()
            if value in TABLE_PARTS and not opened.get("table"):
                continue
            if value in CLOSES_P and (p := nearest({"p"}, {"table", "td", "th", "caption", "button", "object"})):
                leave(p)
            if value in ENDS:
                tags, stops = ENDS[value]
                while node := nearest(tags, stops):
                    leave(node)
            if value in ("td", "th") and here.tag != "tr" and nearest({"table"}, {"td", "th", "caption"}):
                if here.tag == "table":
                    enter("tbody", {})
                enter("tr", {})
            elif value == "tr" and here.tag == "table":
                enter("tbody", {})
            if value == "a" and (a := nearest({"a"}, {"table", "td", "th", "caption"})):
                leave(a)
            if value in VOID:
                here.children.append(Node(value, attrs, here))
            else:
                enter(value, attrs)
        elif kind == "close":
            if value == "br":
                to_body()
                here.children.append(Node("br", {}, here))
            elif value == "p" and not opened.get("p"):
                to_body()
                here.children.append(Node("p", {}, here))
            elif value == "head":
                to_body()
            elif value not in ("html", "body"):
                if value in ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"):
                    stops = frozenset({"table"} - {value})
                else:
                    stops = CELLS if value in SPECIAL or value in FORMATTING else SPECIAL
                if node := nearest({value}, stops):
                    (unwrap if value in FORMATTING and within_special(node) else leave)(node)
        else:
            if here.tag == "head" and kind == "text":
                if not value.strip(" \t\n\f\r"):
                    continue
                to_body()
            value = unescape(value) if kind == "text" and "&" in value else value
            if here.tag in ("pre", "textarea") and not here.children:
                value = value.removeprefix("\n")  # a line break right after the tag is not content
            if here.tag in ("table", "tbody", "thead", "tfoot", "tr") and value.strip(" \t\n\f\r"):
                table = here
                while table.tag != "table":
                    table = table.parent
                siblings = table.parent.children
                siblings.insert(len(siblings) - 1, value)  # text between cells shows before its table
            elif here.tag == "style":
                if for_screens(here.attrs.get("media", "")):
                    sheets.append(value)
            else:
                here.children.append(value)
    return root, sheets


def for_screens(media: str) -> bool:
    """Whether one of the queries of a list holds for any screen; those that ask for more are taken not to."""
    return any(not q.strip() or SCREEN.fullmatch(q.strip()) for q in media.split(","))


def declared(css: str) -> list[tuple[str, str, bool]]:
    return [(prop.lower(), value.lower(), bool(important)) for prop, value, important in DECLARED.findall(css)]


class Rules:
    """What style sheets say of ``display`` and ``visibility``.

    A selector is a row of compounds.  An element is held against the compounds that
    name its tag, a class or its id; where one fits, the selector's beginning ends
    here.  Elements carry the beginnings that end in them and around them as bits, so
    a compound asks for one bit and no ancestor is looked at twice.
    """

    def __init__(self, sheets: list[str]):
        # by what a compound is found by: tag, classes, ids, the bit before it, whether that must be the parent's, its own bit, declarations
        self.by_key: dict[tuple[str, str], list[list]] = {}
        self.known: dict[tuple, list] = {}  # the same; equal beginnings of selectors are one
        self.order = self.bits = 0
        for sheet in sheets:
            self.read(COMMENT.sub(" ", sheet))

    def read(self, css: str) -> None:
        at, blocks = 0, []  # open blocks, and whether they hold for screens
        while brace := BRACE.search(css, at):
            if brace[0] == "}":
                at = brace.end()
                if blocks:
                    blocks.pop()
                continue
            head, at = css[at : brace.start()].rpartition(";")[2].strip(), brace.end()
            if head.startswith("@"):
                name, _, media = head.partition(" ")
                blocks.append(name.lower() == "@media" and for_screens(media) and all(blocks))
                continue
            end = css.find("}", at)
            end = len(css) if end < 0 else end
            if all(blocks) and (said := declared(css[at:end])):
                said = [(prop, value, important, self.order + i) for i, (prop, value, important) in enumerate(said)]
                self.order += len(said)
                for selector in head.split(","):
                    self.add(selector.strip(), said)
            at = end + 1

    def add(self, selector: str, said: list[tuple]) -> None:
        steps, child, weight = [], False, [0, 0, 0]
        for word in selector.replace(">", " > ").split():
            if word == ">":
                child = True
                continue
            m = COMPOUND.fullmatch(word)
            if not m:
                return
            marks = MARK.findall(m[2])
            names = frozenset(n for sign, n in marks if sign == "."), frozenset(n for sign, n in marks if sign == "#")
            tag = (m[1] or "*").lower()
            for i, n in enumerate((len(names[1]), len(names[0]), tag != "*")):
                weight[i] += n
            steps.append((tag, *names, child))
            child = False
        if child or not steps or steps[0][3]:
            return
        before = None
        for step in steps:
            entry = self.known.get((before, step))
            if entry is None:
                tag, classes, ids, _ = step
                key = ("#", min(ids)) if ids else (".", min(classes)) if classes else ("", tag)
                entry = self.known[before, step] = [*step[:3], before, step[3], None, {}]
                self.by_key.setdefault(key, []).append(entry)
            if step is steps[-1]:
                for prop, value, important, order in said:
                    rank = (important, tuple(weight), order, value)
                    entry[6][prop] = max(entry[6].get(prop, rank), rank)
            elif entry[5] is None:
                entry[5] = self.bits
                self.bits += 1
            before = entry[5]

    def of(self, node: Node) -> dict[str, str]:
        """The values that hold for an element; its parent's must have been asked for before."""
        a, found, parent = node.attrs, {}, node.parent
        if parent is not None:
            node.above = parent.above | parent.met
        if self.by_key:
            classes = a.get("class", "").split()
            keys = [("", "*"), ("", node.tag), *((".", c) for c in dict.fromkeys(classes)), *([("#", a["id"])] if "id" in a else [])]
            for key in keys:
                for tag, named, ids, before, of_parent, own, said in self.by_key.get(key, ()):
                    if (tag not in ("*", node.tag)) or (len(named) > 1 and not named.issubset(classes)) or (named and key[0] == "#" and not named.issubset(classes)) or (len(ids) > 1):
                        continue
                    if before is not None and not (parent is not None and (parent.met if of_parent else node.above) >> before & 1):
                        continue
                    if own is not None:
                        node.met |= 1 << own
                    for prop, rank in said.items():
                        if prop not in found or found[prop] < rank:
                            found[prop] = rank
        if "style" in a:
            for order, (prop, value, important) in enumerate(declared(a["style"])):
                rank = (important, (1000, 0, 0), order, value)
                if prop not in found or found[prop] < rank:
                    found[prop] = rank
        return {prop: rank[3] for prop, rank in found.items()}


class Page:
    """Lines of text under way: white space collapses, blocks ask for breaks, lists and quotes indent."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False
        self.blank = False
        self.open: list[tuple[str, int]] = []  # marks of open lists and quotes, and the lines before each
        self.marks: list[str] = []  # those of them without a line so far, which are always the innermost
        self.indent = 0

    def start(self) -> None:
        """Before the first text of a line: the blank line that was asked for."""
        if self.blank and not self.parts and self.lines:
            self.lines.append("")
        self.blank = False

    def text(self, value: str) -> None:
        words = [w for w in SPACE.split(value) if w]
        if value[:1] in " \t\n\f\r":
            self.space = True
        if words:
            self.start()
            if self.parts and self.space:
                self.parts.append(" ")
            self.parts.append(" ".join(words))
            self.space = value[-1] in " \t\n\f\r"

    def verbatim(self, value: str) -> None:
        if not value:
            return
        self.start()
        first, *rest = value.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.parts.append(first)
        for line in rest:
            self.line(True)
            self.parts.append(line)

    def put(self, line: str) -> None:
        if line:
            line = " " * min(self.indent, DEEPEST) + "".join(self.marks) + line
            self.indent += sum(map(len, self.marks))
            self.marks = []
        self.lines.append(line)

    def line(self, even_empty: bool = False) -> None:
        if self.parts or even_empty:
            self.put("".join(self.parts) if even_empty else "".join(self.parts).rstrip())
            self.parts = []
        self.space = False

    def apart(self) -> None:
        self.line()
        if not self.marks:  # the first block of an item starts beside its mark
            self.blank = True

    def add(self, lines: list[str]) -> None:
        if not lines:
            return
        self.line()
        self.start()
        for x in lines:
            self.put(x)

    def enter(self, mark: str) -> None:
        self.line()
        self.open.append((mark, len(self.lines)))
        self.marks.append(mark)

    def leave(self) -> None:
        self.line()
        mark, before = self.open.pop()
        while len(self.lines) > before and not self.lines[-1].strip():
            self.lines.pop()
        if self.marks:
            self.marks.pop()
        else:
            self.indent -= len(mark)
            self.blank = False

    def done(self) -> list[str]:
        self.line()
        while self.lines and not self.lines[-1].strip():
            self.lines.pop()
        return self.lines


def number(text: str | None, least: int, most: int, default: int) -> int:
    """The whole number at the head of an attribute, within bounds."""
    m = re.match(r"\s*(-?[0-9]{1,9})", text or "")
    return min(max(int(m[1]), least), most) if m else default


def columns(line: str) -> int:
    """Columns that a line takes: wide characters two, combining ones none."""
    return len(line) if line.isascii() else sum(0 if combining(c) else 2 if east_asian_width(c) in "WF" else 1 for c in line)


def table_lines(rows: list[list[tuple[list[str], int, int]]], caption: list[str]) -> list[str]:
    """Cells in aligned columns; a cell that spans several takes their width."""
    grid: list[list[tuple[int, list[str]]]] = []
    held: dict[int, int] = {}  # the row after the last that a cell from above covers, by column
    width: dict[int, int] = {}
    for nth, row in enumerate(rows):
        at, line = 0, []
        for lines, across, down in row:
            while held.get(at, 0) > nth:
                at += 1
            line.append((at, lines))
            own = min(max(map(columns, lines), default=0), WIDEST) if across == 1 else 0
            width[at] = max(width.get(at, 0), own)
            if down > 1:
                for c in range(at, min(at + across, MOST_HELD)):
                    held[c] = max(held.get(c, 0), nth + down)
            at += across
        grid.append(line)
    starts, place = {}, 0
    for c in sorted(width):
        starts[c] = min(place, FARTHEST)
        place += width[c] + 2
    out = list(caption)
    for line in grid:
        pieces: list[list[tuple[int, str]]] = [[] for _ in range(max((len(lines) for _, lines in line), default=0))]
        for at, lines in line:
            for k, x in enumerate(lines):
                if x:
                    pieces[k].append((at, x))
        for piece in pieces:
            made, filled = [], 0
            for at, x in piece:
                gap = starts[at] - filled
                gap = gap if gap > 0 else 2 if filled else 0
                made.append(" " * gap + x)
                filled += gap + columns(x)
            out.append("".join(made).rstrip())
    while out and not out[-1]:
        out.pop()
    return out


def shown(node: Node, rules: Rules, seen: bool) -> tuple[bool, bool, str]:
    """Whether an element is there at all, whether its own text can be seen, and its ``display`` where that is said."""
    a, parent = node.attrs, node.parent
    if node.tag in HIDDEN or (node.tag == "dialog" and "open" not in a):
        return False, False, ""
    if parent is not None and parent.tag == "details" and "open" not in parent.attrs and node.tag != "summary":
        return False, False, ""
    said = rules.of(node) if rules.by_key or "style" in a else {}
    display = said.get("display", "none" if "hidden" in a else "")
    visibility = said.get("visibility", "inherit")
    return display != "none", visibility == "visible" or (seen and visibility not in ("hidden", "collapse")), display


#: How elements stand among their neighbours: apart from them, or on lines of their own; all others stand in theirs.
STANDING = {tag: "apart" if tag in SPACED else "line" for tag in BLOCKS}


def layout(tag: str, display: str) -> str:
    """The same where a style says how an element is displayed."""
    own = STANDING.get(tag, "")
    if tag in FIXED:
        return own
    return own or "line" if display in BLOCK_LIKE else "" if display in INLINE_LIKE else own


def render(root: Node, sheets: list[str]) -> str:
    """All visible text of a tree."""
    rules, page, pages, tables, lists, pre = Rules(sheets), Page(), [], [], [], 0
    standing: dict[Node, str] = {}  # of open elements, where their style says it
    drawing: list[bool] = []  # within svg: whether text shows, by open element that decides it
    stack: list[tuple[object, str, bool]] = [(root, "enter", True)]
    while stack:
        node, step, seen = stack.pop()
        if isinstance(node, str):
            if seen and (not drawing or drawing[-1]):
                (page.verbatim if pre else page.text)(node)
            continue
        tag = node.tag
        if step == "enter":
            there, seen, display = shown(node, rules, seen)
            if not there or (drawing and tag in UNDRAWN):
                continue
            step = "leave"
            closed = tag == "details" and "open" not in node.attrs
            if tag == "br":
                page.line(True)
            elif (own := layout(tag, display) if display else STANDING.get(tag, "")) == "apart":
                page.apart()
            elif own == "line":
                page.line()
            if display and tag not in FIXED:
                standing[node] = own
            if tag in ("pre", "textarea", "xmp"):
                pre += 1
            if tag in ("ul", "ol", "menu"):
                if lists and not page.marks:
                    page.blank = False
                lists.append([tag, number(node.attrs.get("start"), -10**9, 10**9, 1), False])
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1, True]
                if kind[0] == "ol":
                    kind[1] = number(node.attrs.get("value"), -10**9, 10**9, kind[1])
                page.blank, kind[2] = page.blank and not kind[2], True
                page.enter(f"{kind[1]}. " if kind[0] == "ol" else "- ")
            elif tag in ("blockquote", "dd"):
                page.enter("  ")
            elif tag in ("td", "th", "caption"):
                if tables and tables[-1] is not None and (tag == "caption" or tables[-1][0]):
                    step = "leave cell"
                    pages.append(page)
                    page = Page()
                else:
                    page.line()
            elif tag == "table":
                tables.append(([], []) if len(tables) < MOST_TABLES else None)
            elif tag == "tr" and tables and tables[-1] is not None:
                tables[-1][0].append([])
            elif tag == "svg":
                drawing.append(False)
            elif drawing and tag in DRAWN_TEXT:
                drawing.append(True)
                page.space = True
            stack.append((node, step, seen))
            stack.extend((c, "enter", seen) for c in reversed(node.children) if not (closed and isinstance(c, str)))
            continue
        if tag in ("pre", "textarea", "xmp"):
            pre -= 1
        if step == "leave cell":
            lines, page = page.done(), pages.pop()
            if tag == "caption":
                tables[-1][1].extend(lines)
            else:
                tables[-1][0][-1].append((lines, number(node.attrs.get("colspan"), 1, 1000, 1), number(node.attrs.get("rowspan"), 1, 65534, 1)))
        elif tag == "li":
            page.leave()
            if lists:
                lists[-1][1] += 1
        elif tag in ("blockquote", "dd"):
            page.leave()
            if tag == "blockquote":
                page.apart()
        elif tag in ("ul", "ol", "menu"):
            lists.pop()
            page.apart()
            if lists:
                page.blank = False
        elif tag == "table":
            if (made := tables.pop()) is not None:
                page.add(table_lines(*made))
            page.apart()
        elif tag == "svg" or (drawing and tag in DRAWN_TEXT):
            drawing.pop()
            page.space = True
        elif (own := standing.pop(node) if node in standing else STANDING.get(tag, "")) == "apart":
            page.apart()
        elif own == "line" or tag in ("td", "th", "caption"):
            page.line()
    return "\n".join(page.done())


def extract_text(html: str | None) -> str:
    return render(*build(html)) if html else ""


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id`` and ``text`` for every row.

    Defined cases: a null or empty page has the empty text; a page that ends in
    the middle of a tag keeps what came before; a null id and repeated rows keep
    their rows; an empty table gives an empty result; other columns aren't read.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("x"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([extract_text(x) for x in batch.column(1).to_pylist()], pa.string())], names=["id", "text"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string")
