"""Visible text of HTML pages, laid out: block spacing, lists, aligned table cells.

A tree builder (open elements, implied end tags, void and raw-text elements) drives a renderer of blocks. Both work without
recursion, so depth of nesting does no harm.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from html import unescape
from unicodedata import combining, east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantalog.llm.shared import slices

MARK = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
EDGE = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"[ \t\n\r\f]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
UNSEEN = frozenset("head title script style template noscript noembed noframes datalist iframe audio video canvas object rp".split())
#: Blank line around (1) or just a line of its own (0).
BLOCKS = {
    **dict.fromkeys("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir table blockquote pre figure hr fieldset xmp listing".split(), 1),
    **dict.fromkeys("address article aside body center details dialog div dd dt figcaption footer form header hgroup html legend li main nav optgroup option search section summary caption".split(), 0),
}
CLOSES_P = frozenset(BLOCKS) - frozenset("html body option optgroup legend caption".split())
#: Which open elements a start tag ends, and the elements that it looks no further than.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    **dict.fromkeys(("dt", "dd"), ({"dt", "dd"}, {"dl"})),
    **dict.fromkeys(("option", "optgroup"), ({"option"}, {"select", "datalist"})),
    **dict.fromkeys(("td", "th"), ({"td", "th"}, {"table", "tr"})),
    "tr": ({"tr", "td", "th"}, {"table"}),
    **dict.fromkeys(("thead", "tbody", "tfoot"), ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"})),
    **dict.fromkeys(("rt", "rp"), ({"rt", "rp"}, {"ruby"})),
    "body": ({"head"}, {"html"}),
}
BARRIER = frozenset("table td th caption button object html".split())
HIDING = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(\w+)", re.I)


#: Levels of nesting that indent a line; deeper ones stand as far to the right as this.
DEEPEST = 40


class Tags:
    """Where tags end. What was looked for in vain isn't looked for again, so malformed pages take linear time."""

    def __init__(self, html: str):
        self.html, self.gone = html, set()

    def find(self, what: str, at: int) -> int:
        found = -1 if what in self.gone else self.html.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def end(self, at: int) -> int:
        """The '>' of the tag that `at` is in, outside quoted values (a quote that nothing closes is no quote); -1: there is none."""
        while ">" not in self.gone:
            edge = EDGE.search(self.html, at)
            if edge is None:
                self.gone.add(">")
            elif edge[0] == ">":
                return edge.start()
            else:
                closed = self.find(edge[0], edge.end())
                at = closed + 1 if closed >= 0 else edge.end()
        return -1


def columns_of(text: str) -> int:
    """Columns that a text takes: East Asian wide characters take two, combining ones none."""
    return len(text) if text.isascii() else sum(0 if combining(c) else 2 if east_asian_width(c) in "WF" else 1 for c in text)


class Flow:
    """Lines of one block container, with pending inline text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.blank = False  # a blank line is due before the next line
        self.prefixes: list[str] = []
        self.mark = ""  # of a list item that has no line yet

    def end_line(self, force: bool = False) -> None:
        text = "".join(self.inline).strip(" ") if self.inline else ""
        self.inline.clear()
        if text or force:
            self.put(text)

    def put(self, text: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        indent = "".join(self.prefixes[:DEEPEST])
        if self.mark:
            indent = indent[: max(0, len(indent) - len(self.mark))] + self.mark
            self.mark = ""
        self.lines.append((indent + text).rstrip(" ") if text else "")

    def gap(self) -> None:
        self.blank = True

    def text(self, data: str) -> None:
        data = SPACE.sub(" ", data)
        if data[:1] == " " and (not self.inline or self.inline[-1][-1:] == " "):
            data = data[1:]
        if data:
            self.inline.append(data)


class Grid:
    """Rows of cells of one table."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, int, list[str]]]] = []  # column, columns spanned, lines
        self.held: dict[int, tuple[int, int]] = {}  # first column of a cell above -> column after it, last row that it takes
        self.row: list[tuple[int, int, list[str]]] | None = None
        self.column = 0  # the first that may be free in this row

    def open_row(self) -> None:
        self.close_row()
        self.row, self.column = [], 0

    def close_row(self) -> None:
        if self.row is not None:
            self.rows.append(self.row)
            self.row = None

    def cell(self, lines: list[str], across: int, down: int) -> None:
        if self.row is None:
            self.row, self.column = [], 0
        while (over := self.held.get(self.column)) and over[1] >= len(self.rows):
            self.column = over[0]
        self.row.append((self.column, across, lines))
        if down > 1:
            self.held[self.column] = (self.column + across, len(self.rows) + down - 1)
        self.column += across

    def laid_out(self) -> list[str]:
        self.close_row()
        width: dict[int, int] = {}
        for row in self.rows:
            for column, across, lines in row:
                if across == 1:
                    width[column] = max(width.get(column, 0), max(map(columns_of, lines), default=0))
        for row in self.rows:
            for column, across, lines in row:
                if across > 1:
                    have = sum(width.get(column + i, 0) for i in range(across)) + 2 * (across - 1)
                    last = column + across - 1
                    width[last] = width.get(last, 0) + max(0, max(map(columns_of, lines), default=0) - have)
        left, at = {}, 0
        for column in range(max(width, default=-1) + 1):
            left[column] = at
            at += width[column] + 2 if width.get(column) else 0  # a column without text of its own takes no room
        out = []
        for row in self.rows:
            for i in range(max((len(lines) for _, _, lines in row), default=0)):
                line = ""
                for column, _, lines in row:
                    if i < len(lines):
                        line += " " * (left.get(column, at) - columns_of(line)) + lines[i]
                out.append(line.rstrip())
        return out


def _span(value: str | None, most: int) -> int:
    return min(most, max(1, int(value))) if value and value.strip().isdigit() and len(value) < 9 else 1


class Renderer:
    """Open and close events of elements in, text out."""

    def __init__(self) -> None:
        self.flow = Flow()
        self.outer: list[tuple[Flow, Grid | None]] = []
        self.grid: Grid | None = None
        self.lists: list[list] = []  # number of the next item (None: bullets), step
        self.pre = 0
        self.flat = 0  # tables open below DEEPEST levels of tables; their rows and cells are lines

    def text(self, data: str) -> None:
        if self.pre:
            first, *rest = data.replace("\r\n", "\n").split("\n")
            self.flow.inline.append(first)
            for line in rest:
                self._pre_line()
                self.flow.inline.append(line)
        elif self.grid is not None and self.flow is self.grid_flow and not data.strip():
            return
        else:
            self.flow.text(data)

    grid_flow: Flow | None = None

    def _pre_line(self) -> None:
        self.flow.put("".join(self.flow.inline).rstrip())
        self.flow.inline.clear()

    def open(self, tag: str, attributes: dict[str, str]) -> None:
        flow = self.flow
        if tag in ("table", "tr", "td", "th") and (self.flat or tag == "table" and len(self.outer) >= 2 * DEEPEST):
            self.flat += tag == "table"
            flow.end_line()
        elif tag == "br":
            flow.end_line(force=True)
        elif tag == "hr":
            flow.end_line()
            flow.gap()
        elif tag == "wbr":
            pass
        elif tag == "q":
            flow.text("“")
        elif tag == "input":
            if attributes.get("type", "text").lower() not in ("checkbox", "radio", "image", "file", "color", "range", "password") and attributes.get("value"):
                flow.text(attributes["value"])
        elif tag == "table":
            flow.end_line()
            flow.gap()
            self.outer.append((flow, self.grid))
            self.grid, self.flow = Grid(), Flow()
            self.grid_flow = self.flow
        elif tag == "tr" and self.grid:
            self.grid.open_row()
        elif tag in ("td", "th") and self.grid:
            self.outer.append((self.flow, self.grid))
            self.grid, self.flow = None, Flow()
        elif tag in BLOCKS:
            flow.end_line()
            if BLOCKS[tag] and not (tag in ("ul", "ol", "menu", "dir") and self.lists):
                flow.gap()
            if tag in ("ul", "ol", "menu", "dir"):
                start = attributes.get("start", "1").strip()
                number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
                self.lists.append([number if tag == "ol" else None, -1 if "reversed" in attributes else 1])
            elif tag == "li":
                mark = "- "
                if self.lists and self.lists[-1][0] is not None:
                    own = attributes.get("value", "").strip()
                    if re.fullmatch(r"-?\d{1,9}", own):
                        self.lists[-1][0] = int(own)
                    mark = f"{self.lists[-1][0]}. "
                    self.lists[-1][0] += self.lists[-1][1]
                flow.mark = mark
                flow.prefixes.append(" " * len(mark))
            elif tag == "blockquote":
                flow.prefixes.append("> ")
            elif tag == "dd":
                flow.prefixes.append("  ")
            elif tag in ("pre", "xmp", "listing"):
                self.pre += 1

    def close(self, tag: str, attributes: dict[str, str]) -> None:
        if tag == "q":
            self.flow.text("”")
        elif self.flat and tag in ("table", "tr", "td", "th"):
            self.flat -= tag == "table"
            self.flow.end_line()
        elif tag == "table" and self.grid:
            self.flow.end_line()
            lines, loose = self.grid.laid_out(), self.flow.lines
            self.flow, self.grid = self.outer.pop()
            self.grid_flow = self.flow if self.grid else None
            for line in [*loose, *lines]:  # what stands in a table outside its cells comes before it
                self.flow.put(line)
            self.flow.gap()
        elif tag in ("td", "th") and self.grid is None and self.outer and self.outer[-1][1] is not None:
            self.flow.end_line()
            lines = self.flow.lines
            self.flow, self.grid = self.outer.pop()
            self.grid_flow = self.flow
            self.grid.cell(lines, _span(attributes.get("colspan"), 1000), _span(attributes.get("rowspan"), 65534))
        elif tag == "tr" and self.grid:
            self.grid.close_row()
        elif tag in BLOCKS:
            flow = self.flow
            if tag in ("pre", "xmp", "listing"):
                if flow.inline:
                    self._pre_line()
                self.pre = max(0, self.pre - 1)
            flow.end_line()
            if tag == "li":
                flow.mark = ""
            if tag in ("li", "blockquote", "dd") and flow.prefixes:
                flow.prefixes.pop()
            if tag in ("ul", "ol", "menu", "dir") and self.lists:
                self.lists.pop()
            if BLOCKS[tag] and not (tag in ("ul", "ol", "menu", "dir") and self.lists):
                flow.gap()
        elif tag == "summary":
            self.flow.end_line()


def render(html: str | None) -> str:
    """The text that a reader of the page sees."""
    out, stack = Renderer(), []  # stack: tag, attributes, state before it
    opened: defaultdict[str, list[int]] = defaultdict(list)  # where in the stack each tag is open
    state = [True, True]  # whether text here is displayed, and visible

    def push(tag: str, attributes: dict[str, str]) -> None:
        opened[tag].append(len(stack))
        stack.append((tag, attributes, tuple(state)))
        style = attributes.get("style", "")
        parent = stack[-2][0] if len(stack) > 1 else ""
        if (
            tag in UNSEEN
            or "hidden" in attributes
            or style and HIDING.search(style)
            or tag == "dialog" and "open" not in attributes
            or parent == "details" and tag != "summary" and "open" not in stack[-2][1]
        ):
            state[0] = False
        if style and (found := VISIBILITY.search(style)):
            state[1] = found[1].lower() not in ("hidden", "collapse")
        if state[0]:
            out.open(tag, attributes)

    def pop() -> None:
        tag, attributes, before = stack.pop()
        opened[tag].pop()
        if state[0]:
            out.close(tag, attributes)
        state[:] = before

    def end(names: set[str], stop: frozenset | set) -> None:
        """Closes everything from the innermost open one of `names` on, unless `stop` comes first."""
        last = lambda tags: max((opened[t][-1] for t in tags if opened[t]), default=-1)
        found = last(names)
        if found >= 0 and found > last(t for t in stop if t not in names):
            while len(stack) > found:
                pop()

    def text(data: str) -> None:
        if data and state[0] and state[1] and not (stack and stack[-1][0] == "details" and "open" not in stack[-1][1]):
            out.text(unescape(data) if "&" in data else data)

    html, at = (html or "").replace("\0", ""), 0
    size, tags = len(html), Tags(html)
    while at < size:
        match = MARK.search(html, at)
        text(html[at : match.start()] if match else html[at:])
        if match is None:
            break
        comment, slash, name = match.groups()
        if comment:
            stop = tags.find("-->", match.start() + 4)
            at = size if stop < 0 else stop + 3
            continue
        stop = tags.end(match.end()) if name else tags.find(">", match.end())
        if stop < 0:  # a tag that never ends is none, and neither is what follows it
            break
        rest, at = html[match.end() : stop], stop + 1
        if not name:
            continue
        if slash:
            tag = name.lower()
            if tag == "br":
                if state[0] and state[1]:
                    out.open(tag, {})
            elif tag in BLOCKS or tag in BARRIER:
                if tag == "p" and not opened["p"]:
                    push("p", {})
                    pop()
                elif tag not in ("html", "body"):
                    end({tag}, BARRIER - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot") else frozenset())
            elif tag in ("tr", "tbody", "thead", "tfoot"):
                end({tag}, {"table"})
            else:
                end({tag}, BARRIER)
        else:
            tag = name.lower()
            attributes = {}
            if rest and rest != "/":
                for key, a, b, c in ATTRIBUTE.findall(rest):
                    value = a or b or c
                    attributes.setdefault(key.lower(), unescape(value) if "&" in value else value)
            if tag in ("html", "body") and opened[tag]:
                continue
            if tag in CLOSES_P:
                end({"p"}, BARRIER)
            if tag in IMPLIED:
                end(*IMPLIED[tag])
            elif stack and stack[-1][0] == "head" and tag not in ("title", "meta", "link", "base", "script", "style", "template", "noscript"):
                pop()
            if tag in ("td", "th") and stack and stack[-1][0] in ("table", "tbody", "thead", "tfoot"):
                push("tr", {})
            if tag in VOID:
                if state[0] and state[1] and not (tag == "input" and attributes.get("type", "").lower() == "hidden") and "hidden" not in attributes:
                    out.open(tag, attributes)
                continue
            push(tag, attributes)
            if tag in RAW:
                found = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                stop = found.start() if found else size
                text(html[at:stop])
                at = stop
            elif tag in ("pre", "listing") and html[at : at + 1] == "\n":
                at += 1
    while stack:
        pop()
    out.flow.end_line()
    lines = out.flow.lines
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines).strip("\n")


def extract_text(df: DataFrame, id_col: str = "page_id", html_col: str = "html", carry: Sequence[str] = ()) -> DataFrame:
    """(id, text string, the carried columns) for each row.

    A null or empty page gives ''; null and repeated ids pass through; columns not carried are ignored; an empty table gives an
    empty result. Pages of any length and malformed ones take time in proportion to their length: a tag that is never closed by
    '>' ends the page's text, a quote in a tag that nothing closes is an ordinary character, and lines are indented by the
    first DEEPEST levels of nesting only, and so many levels of tables are laid out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                texts = [render(h) for h in part.column(1).to_pylist()]
                more = [part.column(k) for k in range(2, part.num_columns)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), *more], ["id", "text", *(f"c{i}" for i in range(len(more)))])

    rows = df.select(F.col(id_col).alias("id"), F.col(html_col).alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)])
    out = rows.mapInArrow(run, rows.schema)
    return out.select(F.col("id").alias(id_col), "text", *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])
