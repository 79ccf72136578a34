"""Layout-aware text of HTML: a tree builder, visibility rules and a renderer.

The builder supplies the tags that HTML lets authors leave out (table sections and
rows, ends of items, cells, options and paragraphs, the body after a head), moves
what may not stand in a table in front of it, and closes what is left open. The
renderer walks the tree with a stack of its own, so depth is no limit. Blocks are
kept apart by a line end, paragraphs, headings and tables by an empty line; list
items carry bullets or numbers and are indented by level; table cells are laid
out on a grid and padded to their columns' widths. What is hidden is decided by
the cascade of the page's own sheets and style attributes (`css_rules`), the
`hidden` attribute and the elements that never show; other style is not
followed: a block is one by its tag. Linked sheets are not at hand. Scripts do not
run here, so <noscript> shows and scripts, styles, templates and embedded media do
not.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintel.llm import common
from lintel.llm.css_rules import Cascade, on_screen

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPED = frozenset("title textarea".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p plaintext pre search section summary table ul dd dt listing xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INLINE = frozenset("a b big code em font i nobr s small strike strong tt u".split())
TABLE_PARTS = frozenset("table tbody thead tfoot tr".split())
SECTIONS = frozenset("tbody thead tfoot".split())
CELLS = frozenset("td th".split())
BARRIER = frozenset("table td th caption template html marquee object applet".split())
HIDDEN = frozenset("head script style template title link meta base audio video canvas iframe object datalist area source track rp noembed noframes param".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure listing plaintext xmp dl fieldset".split())  # an empty line around them
BLOCKS = SPACED | frozenset("address article aside body center details dialog dd dir div dt figcaption footer form header hgroup hr html legend li main menu nav ol optgroup option search section summary ul caption".split())

_WS = " \t\n\f\r"
_TAG = re.compile(r"<(/?)([a-zA-Z][^ \t\n\f\r/>]*+)")
_END_OF_COMMENT = re.compile(r"--!?>")
_BETWEEN = re.compile(r"[ \t\n\f\r/]*+")
#: A name (which may begin with "=") and its value: quoted, bare, or none before the tag's end.
_ATTRIBUTE = re.compile(r"([^ \t\n\f\r/>][^ \t\n\f\r/>=]*+)(?:[ \t\n\f\r]*+(=)[ \t\n\f\r]*+(?:\"([^\"]*+)\"|'([^']*+)'|(?![\"'>])([^ \t\n\f\r>]++)|(?=>)))?")
_OPEN_VALUE = re.compile(r"[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:[\"']|\Z)")
_SPACE = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("tag", "attrs", "kids", "up")

    def __init__(self, tag: str, attrs: dict, up):
        self.tag, self.attrs, self.kids, self.up = tag, attrs, [], up


class Builder:
    """Makes the tree; `open` is the chain of open elements."""

    def __init__(self):
        self.root = Node("html", {}, None)
        self.open = [self.root]
        self.count: dict[str, int] = {}  # of open elements by tag, so that most searches end at once
        self.sheets: list[str] = []
        self.on_screen = True

    def push(self, tag: str, attrs: dict) -> Node:
        node = Node(tag, attrs, None)
        self.place(node)
        self.open.append(node)
        self.count[tag] = self.count.get(tag, 0) + 1
        return node

    def pop(self) -> None:
        self.count[self.open.pop().tag] -= 1

    def place(self, kid) -> None:
        """Into the open element, or before the table if that may not hold it."""
        top = self.open[-1]
        tag = None if isinstance(kid, str) else kid.tag
        if top.tag in TABLE_PARTS and tag not in TABLE_PARTS and tag not in CELLS and tag not in ("caption", "colgroup", "col", "script", "style", "template", "form", "input"):
            if tag is None and not kid.strip():
                return
            at = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k].tag == "table"), 0)
            if at:
                table, top = self.open[at], self.open[at - 1]
                if not isinstance(kid, str):
                    kid.up = top
                top.kids.insert(len(top.kids) - 1 if top.kids and top.kids[-1] is table else len(top.kids), kid)
                return
        if tag is not None:
            kid.up = top
        top.kids.append(kid)

    def inside(self, tags, stop=BARRIER) -> int:
        """The place of the innermost open element among `tags`, 0 if a barrier comes first."""
        if not any(self.count.get(t) for t in tags):
            return 0
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                return k
            if self.open[k].tag in stop:
                return 0
        return 0

    def cut(self, k: int) -> None:
        while k and len(self.open) > k:
            self.pop()

    def text(self, s: str) -> None:
        if self.open[-1].tag == "head" and s.strip():
            self.pop()
        self.place(unescape(s) if "&" in s else s)

    def start(self, tag: str, attrs: dict) -> None:
        if self.open[-1].tag == "head" and tag not in IN_HEAD and tag != "head":
            self.pop()
        if tag in ("html", "body"):
            held = self.root if tag == "html" else next((n for n in self.open if n.tag == "body"), None)
            if held is not None:
                for k, v in attrs.items():
                    held.attrs.setdefault(k, v)
                return
        if tag == "head" and len(self.open) > 1:
            return
        if tag in CLOSES_P:
            self.cut(self.inside(("p",), BARRIER | {"button"}))
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.pop()
        elif tag == "li":
            self.cut(self.inside(("li",), BARRIER | {"ul", "ol", "menu"}))
        elif tag in ("dd", "dt"):
            self.cut(self.inside(("dd", "dt"), BARRIER | {"dl"}))
        elif tag in ("option", "optgroup"):
            self.cut(self.inside(("option",) if tag == "option" else ("option", "optgroup"), BARRIER | {"select", "datalist"}))
        elif tag in ("button", "a", "nobr"):
            self.cut(self.inside((tag,)))
        elif tag in ("rt", "rp"):
            self.cut(self.inside(("rt", "rp"), BARRIER | {"ruby"}))
        elif tag in CELLS:
            self.leave_for(CELLS | {"caption"})
            if self.open[-1].tag == "table":
                self.push("tbody", {})
            if self.open[-1].tag in SECTIONS:
                self.push("tr", {})
        elif tag == "tr":
            self.leave_for(CELLS | {"caption", "tr"})
            if self.open[-1].tag == "table":
                self.push("tbody", {})
        elif tag in SECTIONS or tag in ("caption", "colgroup"):
            self.leave_for(CELLS | SECTIONS | {"caption", "tr", "colgroup"})
        if tag in CELLS or tag == "tr" or tag in SECTIONS or tag in ("caption", "colgroup", "col"):
            if not self.count.get("table"):
                return  # table parts mean nothing outside a table
        if tag in VOID:
            self.place(Node(tag, attrs, None))
        else:
            self.push(tag, attrs)

    def leave_for(self, tags) -> None:
        """Closes table parts inside the nearest table, the outermost of `tags` included."""
        last = 0
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == "table":
                break
            if self.open[k].tag in tags:
                last = k
        self.cut(last)

    def end(self, tag: str) -> None:
        if tag == "br":
            return self.place(Node("br", {}, None))
        if tag in ("html", "body"):
            return
        stop = BARRIER - {tag}
        if tag in TABLE_PARTS or tag in CELLS:
            stop = frozenset() if tag == "table" else frozenset({"table"})
        k = self.inside(HEADINGS if tag in HEADINGS else (tag,), stop)
        if not k:
            if tag == "p":
                self.place(Node("p", {}, None))
            return
        if tag in INLINE and any(n.tag in BLOCKS for n in self.open[k + 1 :]):
            return  # the block it was closed in stays open; formatting shows no text
        self.cut(k)


def attributes(html: str, at: int) -> tuple[dict, int]:
    """(attributes, end) of a tag from behind its name; of a repeated name the first counts.

    Names and values end as the standard's tokenizer ends them. The end is -1
    where the page ends inside the tag, which then does not count.
    """
    out: dict = {}
    n = len(html)
    while True:
        at = _BETWEEN.match(html, at).end()
        if at >= n:
            return out, -1
        if html[at] == ">":
            return out, at + 1
        m = _ATTRIBUTE.match(html, at)
        at = m.end()
        if m[2] is None and _OPEN_VALUE.match(html, at):
            return out, -1  # a quote that is never closed
        value = m[3] if m[3] is not None else m[4] if m[4] is not None else m[5] or ""
        out.setdefault(m[1].lower(), unescape(value) if "&" in value else value)


def tokens(html: str):
    """(kind, a, b) of a page: ("text", text, 0), ("start", name, attributes), ("end", name, 0).

    Comments and declarations are left out. What a script or another raw element
    holds comes as one ("raw", text, name).
    """
    at, n = 0, len(html)
    while at < n:
        less = html.find("<", at)
        if less < 0:
            less = n
        if less > at:
            yield "text", html[at:less], 0
        if less == n:
            return
        m = _TAG.match(html, less)
        if m is None:
            after = html[less + 1 : less + 2]
            if html.startswith("<!--", less):
                if html.startswith((">", "->"), less + 4):
                    at = html.index(">", less) + 1
                else:
                    end = _END_OF_COMMENT.search(html, less + 4)
                    at = end.end() if end else n
            elif after in ("!", "?") or after == "/" and less + 2 < n:
                end = html.find(">", less)
                at = end + 1 if end >= 0 else n
            else:
                yield "text", "<", 0
                at = less + 1
            continue
        at = m.end()
        if html[at : at + 1] == ">":
            attrs: dict = {}
            at += 1
        else:
            attrs, at = attributes(html, at)
            if at < 0:
                return
        tag = m[2].lower()
        if m[1]:
            yield "end", tag, 0
            continue
        yield "start", tag, attrs
        if tag in RAW or tag in ESCAPED:
            close = re.compile(f"</{re.escape(tag)}(?=[ \\t\\n\\f\\r/>])", re.I).search(html, at)
            stop = close.start() if close else n
            yield "raw", html[at:stop], tag
            if not close:
                return
            at = attributes(html, close.end())[1]
            if at < 0:
                return
        elif tag == "plaintext":
            yield "raw", html[at:], tag
            return


def parse(html: str) -> Builder:
    """The tree of a page."""
    b = Builder()
    for kind, a, extra in tokens(html):
        if kind == "text":
            b.text(a)
        elif kind == "start":
            b.start(a, extra)
            if a == "style":
                b.on_screen = on_screen(extra.get("media", ""))
        elif kind == "end":
            b.end(a)
        else:
            if extra == "style" and b.on_screen:
                b.sheets.append(a)
            if b.open[-1].tag == extra:
                b.open[-1].kids.append(unescape(a) if extra in ESCAPED else a)
                if extra != "plaintext":
                    b.pop()
    return b


class Lines:
    """Text under construction: spaces collapse, line ends between blocks do not add up."""

    def __init__(self):
        self.parts: list[str] = []
        self.ends = 0  # line ends due before the next text
        self.space = False
        self.fresh = True  # nothing on the line yet
        self.indent = ""
        self.marker = ""

    def block(self, n: int) -> None:
        if self.parts:
            self.ends = max(self.ends, n)
        self.space = False

    def open_line(self) -> None:
        if self.ends:
            self.parts.append("\n" * self.ends)
            self.ends, self.fresh = 0, True
        if self.fresh:
            lead = self.indent
            if self.marker:
                lead = lead[: len(lead) - len(self.marker)] + self.marker
                self.marker = ""
            if lead:
                self.parts.append(lead)
            self.space = False

    def text(self, s: str) -> None:
        lead = s[0] in " \t\n\f\r"
        words = _SPACE.sub(" ", s).strip(" ")
        if not words:
            self.space = self.space or lead
            return
        self.space = self.space or lead
        if self.ends or self.fresh:
            self.open_line()
        if self.space:
            self.parts.append(" ")
        self.parts.append(words)
        self.fresh, self.space = False, s[-1] in " \t\n\f\r"

    def kept(self, s: str) -> None:
        """Text whose white space counts."""
        for k, line in enumerate(s.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if k:
                self.newline()
            if line:
                self.open_line()
                self.parts.append(line)
                self.fresh = False

    def newline(self) -> None:
        if self.ends or self.marker:
            self.open_line()
        self.parts.append("\n")
        self.fresh, self.space = True, False

    def done(self) -> str:
        return "\n".join(line.rstrip(" ") for line in "".join(self.parts).strip("\n").split("\n"))


class Grid:
    """A table's cells on their rows and columns."""

    def __init__(self):
        self.sections: dict[str, list] = {"thead": [], "tbody": [], "tfoot": []}
        self.section = "tbody"
        self.cell: tuple[int, int] = (1, 1)

    def lines(self) -> list[str]:
        grid, taken = [], {}
        for rows in self.sections.values():
            taken.clear()  # a row span ends with its section
            for cells in rows:
                row, at = [], 0
                for text, across, down in cells:
                    while taken.get(at, 0):
                        at += 1
                    row.append((at, across, text.split("\n")))
                    for k in range(at, at + across):
                        if down > 1:
                            taken[k] = down
                    at += across
                grid.append(row)
                for k in [k for k in taken]:
                    taken[k] -= 1
                    if taken[k] <= 0:
                        del taken[k]
        width: dict[int, int] = {}
        for wide in (False, True):
            for row in grid:
                for at, across, text in row:
                    if (across > 1) == wide:
                        have = sum(width.get(k, 0) + 2 for k in range(at, at + across)) - 2
                        need = max(map(len, text))
                        if need > have:
                            last = at + across - 1
                            width[last] = width.get(last, 0) + need - have
        edge, x = {}, 0
        for k in range(max(width, default=-1) + 1):
            edge[k] = x
            x += width.get(k, 0) + 2
        out = []
        for row in grid:
            for k in range(max((len(t) for _, _, t in row), default=0)):
                line = ""
                for at, _, text in row:
                    if k < len(text) and text[k]:
                        line = line.ljust(edge[at]) + text[k]
                out.append(line.rstrip())
        return out


def _number(value, default: int, most: int) -> int:
    m = re.match(r"\s*(-?\d{1,9})", value or "")
    return min(int(m[1]), most) if m else default


def render(b: Builder) -> str:
    """The visible text of a tree."""
    cascade = Cascade(b.sheets)

    def gone(node: Node, said: dict) -> bool:
        tag, attrs = node.tag, node.attrs
        if tag in HIDDEN or tag == "input" and attrs.get("type", "").lower() == "hidden":
            return True
        if "display" in said and said["display"] not in ("revert", "revert-layer"):
            return said["display"] == "none"
        return "hidden" in attrs and attrs["hidden"].lower() != "until-found" or tag == "dialog" and "open" not in attrs

    lines, outer, grids = Lines(), [], []
    lists: list[list] = []  # [numbered, next number, step] of open lists
    seen, pre = True, 0
    stack: list = [(b.root, False, None)]
    while stack:
        node, leaving, saved = stack.pop()
        if isinstance(node, str):
            if seen:
                lines.kept(node) if pre else lines.text(node)
            continue
        tag = node.tag
        if leaving:
            seen, was_indent = saved[:2]
            if tag in CELLS and grids:
                cell = lines.done()
                lines = outer.pop()
                lists = saved[2]
                pre = saved[3]
                grid = grids[-1]
                rows = grid.sections[grid.section]
                if not rows:
                    rows.append([])
                across, down = grid_span(node)
                rows[-1].append((cell, across, down))
            elif tag == "table":
                laid = grids.pop().lines()
                if any(laid):
                    lines.open_line()
                    lines.parts.append(("\n" + lines.indent).join(laid))
                    lines.fresh = False
                lines.block(2)
            elif tag == "li":
                if lines.marker:
                    lines.open_line()
                    lines.fresh = False
                lines.indent = was_indent
                lines.block(1)
            elif tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
                lines.block(1 if lists else 2)
            elif tag in ("dd", "blockquote"):
                lines.indent = was_indent
                lines.block(2 if tag == "blockquote" else 1)
            elif tag in BLOCKS:
                lines.block(2 if tag in SPACED else 1)
            if tag in ("pre", "listing", "plaintext", "xmp", "textarea"):
                pre -= 1
            continue
        said = cascade.computed(node) if cascade.by_key or node.attrs else {}
        if gone(node, said):
            continue
        before = (seen, lines.indent, lists, pre)
        if "visibility" in said and said["visibility"] not in ("inherit", "unset", "revert", "revert-layer"):
            seen = said["visibility"] not in ("hidden", "collapse")
        if tag == "br":
            if seen:
                lines.newline()
            seen = before[0]
            continue
        if tag == "hr" or tag == "wbr":
            if tag == "hr":
                lines.block(1)
            seen = before[0]
            continue
        if tag == "input":
            if seen and node.attrs.get("type", "").lower() in ("submit", "reset", "button") and node.attrs.get("value"):
                lines.text(node.attrs["value"])
            seen = before[0]
            continue
        if tag in VOID:
            seen = before[0]
            continue
        kids = node.kids
        if tag == "table":
            lines.block(2)
            grids.append(Grid())
        elif tag in SECTIONS and grids:
            grids[-1].section = tag
        elif tag == "tr" and grids:
            grid = grids[-1]
            if node.up is not None and node.up.tag in SECTIONS:
                grid.section = node.up.tag
            grid.sections[grid.section].append([])
        elif tag in CELLS and grids:
            outer.append(lines)
            lines, lists, pre = Lines(), [], 0
        elif tag in ("ul", "ol", "menu", "dir"):
            lines.block(1 if lists else 2)
            step = -1 if "reversed" in node.attrs else 1
            first = _number(node.attrs.get("start"), 1 if step > 0 else sum(getattr(k, "tag", "") == "li" for k in kids), 10**9)
            lists.append([tag == "ol", first, step])
        elif tag == "li":
            lines.block(1)
            if lines.marker:  # an item right inside an item
                lines.open_line()
                lines.fresh = False
                lines.block(1)
            own = lists[-1] if lists else [False, 1, 1]
            if "value" in node.attrs:
                own[1] = _number(node.attrs["value"], own[1], 10**9)
            if seen:
                lines.marker = f"{own[1]}. " if own[0] else "- "
                lines.indent += " " * len(lines.marker)
            own[1] += own[2]
        elif tag in ("dd", "blockquote"):
            lines.block(2 if tag == "blockquote" else 1)
            lines.indent += "  "
        elif tag in BLOCKS:
            lines.block(2 if tag in SPACED else 1)
        if tag in ("pre", "listing", "plaintext", "xmp", "textarea"):
            pre += 1
            if kids and isinstance(kids[0], str) and kids[0].startswith("\n"):
                kids = [kids[0][1:], *kids[1:]]
        if tag == "details" and "open" not in node.attrs:
            kids = [k for k in kids if getattr(k, "tag", "") == "summary"][:1]
        if tag == "q":
            kids = ["“", *kids, "”"]
        stack.append((node, True, before))
        for kid in reversed(kids):
            if kid != "":
                stack.append((kid, False, None))
    return lines.done()


def grid_span(node: Node) -> tuple[int, int]:
    """(columns, rows) of a cell."""
    down = _number(node.attrs.get("rowspan"), 1, 65534)
    return max(1, _number(node.attrs.get("colspan"), 1, 1000)), max(1, down) if down else 65534


def text_of(html: str) -> str:
    """The visible text of a page."""
    return render(parse(html))


def rendered(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """`pages` with a column `out`: the visible text of `html`.

    A null page gives null, an empty one the empty string. Rows are independent.
    A column already named `out` is replaced; an empty table gives an empty one.
    No shuffle.
    """
    common.ship(pages.sparkSession)
    src = pages.select(F.struct(*[pages[f"`{c}`"] for c in pages.columns if c != out]).alias("r"), pages[f"`{html}`"].cast("string").alias("t"))

    def run(batches):
        for batch in batches:
            for part in common.pieces(batch, "t"):
                got = [None if h is None else text_of(h) for h in part.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("r"), pa.array(got, pa.string())], ["r", "s"])

    schema = T.StructType([src.schema["r"], T.StructField("s", T.StringType())])
    return src.mapInArrow(run, schema).select("r.*", F.col("s").alias(out))
