"""HTML to text the way a layout shows it.

A tree builder takes tags, text and comments from a scanner and builds elements with implied end tags (a
new list item ends the open one, a block ends an open paragraph, a cell ends a cell, a row a row, and so on);
end tags close up to their element and are dropped if none is open. What is open is known by name and by border,
so each tag costs a fixed number of steps. A renderer walks the tree. Not shown are: head, script, style, template and
the like; `hidden`, `aria-hidden`; what a style attribute or a rule of a style sheet in the page gives
`display: none`. `visibility` is inherited and may come back inside. Of style sheets, rules count whose selectors are
an element's name, class or id, or these together; rules under conditions (`@media`) and with other selectors don't.
White space collapses outside `pre`; blocks begin lines, paragraphs and headings have an empty line
around them; list items have a bullet or number and their depth's indent (up to `MOST_INDENT` characters); `br` and `hr` break lines.

Tables are rendered with a row a line, on a grid with row and column spans; a cell's text stands in its first row and
column. Columns are as wide as their widest cell of at most `WIDEST` characters; longer cells push the rest of their row on, and nothing
is cut. A table whose padding would be far more than its text has its cells apart, not aligned. Cells
without a row get one, and what stands in a table outside its cells comes before it.

The tree and its walk use lists as stacks, so depth of nesting is not bounded by recursion; time and output are linear in the page.

Defined results: null html gives null text, empty html an empty text; broken markup is text or dropped, never an error;
repeated rows have equal results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from piispan.llm.common import narrow, sliced

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_SHOWN = frozenset("head script style template noscript title meta link iframe object svg math canvas audio video select datalist".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure hr".split())
#: Widest cell that a column is aligned to, most characters of indent, and how many times its text a table's padding may be.
WIDEST, MOST_INDENT, MOST_PADDING = 60, 80, 8
_SCOPE = frozenset({"table", "td", "th", "caption", "html", "button", "object"})
_ENDS_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
_SECTIONS = frozenset({"thead", "tbody", "tfoot"})
_CELLS = frozenset({"td", "th"})
#: What start tags end: elements of the first kind that are open since one of the second; the nearest, or all of them.
_ENDED = {
    "p": (frozenset({"p"}), _SCOPE | BLOCKS - {"p"}, False),
    "item": (frozenset({"li"}), frozenset({"ul", "ol", "menu"}), False),
    "term": (frozenset({"dt", "dd"}), frozenset({"dl"}), False),
    "option": (frozenset({"option"}), frozenset({"select"}), False),
    "cell": (_CELLS, frozenset({"tr", "table"}), True),
    "row": (_CELLS | {"tr", "caption"}, frozenset({"table"}), True),
    "section": (_CELLS | _SECTIONS | {"tr", "caption"}, frozenset({"table"}), True),
    "reach": (_CELLS | {"table"}, frozenset(), False),
}
_KINDS = tuple(_ENDED)
_STARTS = {"li": "item", "dt": "term", "dd": "term", "option": "option", "td": "cell", "th": "cell", "tr": "row"} | dict.fromkeys(_SECTIONS, "section")
#: By name: of each kind, whether an element is ended (1), hides what is open (2), or neither.
_ROLE = {t: tuple(1 if t in ended else 2 if t in hides else 0 for ended, hides, _ in _ENDED.values()) for ended, hides, _ in _ENDED.values() for t in (*ended, *hides)}
_ALL = tuple(x[2] for x in _ENDED.values())
# quotes open at the start of an attribute's value only
_TAG = re.compile(r"<(?:!--(?:.*?)(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?|[\"'])*+)(?:>|\Z))", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_DECLARED = re.compile(r"(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.IGNORECASE)
_SELECTOR = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)")
_CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.DOTALL)


class Node:
    __slots__ = ("attributes", "children", "nested", "style", "tag")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []
        self.nested = False  # of a table: whether it holds another
        self.style: dict[str, str] = {}


class _Open:
    """The open elements."""

    def __init__(self, root: Node):
        self.nodes, self.at = [root], {}
        self.marks = [(-1,) * len(_KINDS)]

    def push(self, node: Node) -> None:
        i, role = len(self.nodes), _ROLE.get(node.tag)
        self.nodes.append(node)
        self.at.setdefault(node.tag, []).append(i)
        last = self.marks[-1]
        self.marks.append(last if role is None else tuple(-1 if r == 2 else m if r == 0 or (every and m >= 0) else i for r, m, every in zip(role, last, _ALL, strict=True)))

    def cut(self, i: int) -> None:
        for node in self.nodes[i:]:
            self.at[node.tag].pop()
        del self.nodes[i:], self.marks[i:]

    def end(self, kind: str) -> None:
        """Ends the elements of a kind, as far as they are open since a border."""
        i = self.marks[-1][_KINDS.index(kind)]
        if i > 0:
            self.cut(i)

    def end_tag(self, tag: str) -> None:
        found = self.at.get(tag)
        # an inline end tag does not reach out of a cell
        if found and (tag in BLOCKS or found[-1] > self.marks[-1][-1]):
            self.cut(found[-1])


def parse(source: str) -> Node:
    root = Node("html")
    stack, at, sheets = _Open(root), 0, []
    while at < len(source):
        m = _TAG.search(source, at)
        if m is None:
            stack.nodes[-1].children.append(html.unescape(source[at:]))
            break
        if m.start() > at:
            stack.nodes[-1].children.append(html.unescape(source[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            stack.end_tag(tag)
            continue
        if tag in ("html", "body"):
            stack.end_tag("head")
            root.attributes.update(_attributes(m[3]))
            continue
        if tag in BLOCKS and stack.nodes[-1].tag == "head":
            stack.cut(len(stack.nodes) - 1)
        if tag in _ENDS_P:
            stack.end("p")
        if tag in _STARTS:
            stack.end(_STARTS[tag])
        node = Node(tag, _attributes(m[3]))
        stack.nodes[-1].children.append(node)
        if tag == "table" and stack.at.get("table"):
            stack.nodes[stack.at["table"][-1]].nested = True
        if tag in RAW:
            end = _raw_end(tag).search(source, at)
            body = source[at : end.start() if end else len(source)]
            node.children.append(html.unescape(body) if tag in ("textarea", "title") else body)
            if tag == "style":
                sheets.append(body)
            at = end.end() if end else len(source)
        elif tag not in VOID and not m[3].endswith("/"):
            stack.push(node)
    if "display" in source or "visibility" in source:
        _styled(root, _style_rules("\n".join(sheets)))
    return root


@lru_cache(maxsize=16)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.IGNORECASE)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(_ATTRIBUTE.finditer(raw)))} if raw.strip() else {}


def _style_rules(css: str) -> dict[str, list[tuple]]:
    """Rules of a style sheet that show or hide, by the class, id or name that they ask for first."""
    out: dict[str, list[tuple]] = {}
    css, at, nth = _CSS_COMMENT.sub(" ", css), 0, 0
    while (brace := css.find("{", at)) >= 0:
        head = css[at:brace].rsplit(";", 1)[-1].strip()
        end = css.find("}", brace)
        end = len(css) if end < 0 else end
        if head.startswith("@") and 0 <= (inner := css.find("{", brace + 1)) < end:  # rules under a condition: to its own brace
            depth, end = 1, inner
            for m in re.finditer(r"[{}]", css[brace + 1 :]):
                depth += 1 if m[0] == "{" else -1
                end = brace + 1 + m.start()
                if not depth:
                    break
        elif not head.startswith("@"):
            says = _DECLARED.findall(css[brace + 1 : end])
            for selector in head.split(",") if says else ():
                m = _SELECTOR.fullmatch(selector.strip())
                if not m or not m[0]:
                    continue
                tag, parts = (m[1] or "*").lower(), re.findall(r"[.#][\w-]+", m[2])
                weight = (sum(x[0] == "#" for x in parts), sum(x[0] == "." for x in parts), tag != "*")
                nth += 1
                out.setdefault(parts[0] if parts else tag, []).append((weight, nth, tag, frozenset(parts), says))
        at = end + 1
    return out


def _styled(root: Node, rules: dict[str, list[tuple]]) -> None:
    """Gives each element what its style attribute and the rules say, the strongest last."""
    work = [root]
    while work:
        node = work.pop()
        work += [c for c in node.children if isinstance(c, Node)]
        a = node.attributes
        names = {"." + c for c in a.get("class", "").split()} | ({"#" + a["id"]} if "id" in a else set()) if rules else set()
        said = [(bool(important), 0, weight, nth, prop, value) for key in (names | {node.tag, "*"} if rules else ()) for weight, nth, tag, parts, says in rules.get(key, ()) if tag in ("*", node.tag) and parts <= names for prop, value, important in says]
        said += [(bool(important), 1, (0, 0, 0), nth, prop, value) for nth, (prop, value, important) in enumerate(_DECLARED.findall(a["style"]) if "style" in a else ())]
        for *_, prop, value in sorted(said):
            node.style[prop.lower()] = value.lower()


def visible(node: Node) -> bool:
    """Whether an element is laid out at all."""
    a = node.attributes
    if node.tag in NOT_SHOWN or node.tag == "input" or a.get("aria-hidden", "").lower() == "true":
        return False
    return node.style.get("display", "none" if "hidden" in a else "") != "none"


class _Lines:
    """Text lines with collapsing white space and margins."""

    def __init__(self):
        self.lines, self.now, self.space, self.gap, self.indent, self.marker = [], [], True, 0, [], ""

    def text(self, s: str, keep: bool) -> None:
        if keep:
            first, *rest = s.split("\n")
            self.now.append(first)
            for line in rest:
                self.end_line(force=True)
                self.now.append(line)
            self.space = not self.now[-1] or self.now[-1].endswith(" ")
            return
        s = _SPACE.sub(" ", s)
        if self.space:
            s = s.lstrip(" ")
        if s:
            self.now.append(s)
            self.space = s.endswith(" ")

    def end_line(self, force: bool = False) -> None:
        line = "".join(self.now).rstrip()
        self.now, self.space = [], True
        if not line and not force and not self.marker:
            return
        if line or self.marker:
            if self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            pad = "".join(self.indent[:MOST_INDENT])[:MOST_INDENT]
            if self.marker:
                pad, self.marker = pad[: max(0, len(pad) - len(self.marker))] + self.marker, ""
            self.lines.append((pad + line).rstrip())
        elif self.lines:
            self.lines.append("")

    def margin(self) -> None:
        self.end_line()
        self.gap = 1


def _table_parts(table: Node) -> tuple[list[list[Node]], list[Node], Node]:
    """Cells by row, captions, and what stands outside both; cells without a row get one, elements around rows are looked through."""
    rows: list[list[Node]] = []
    captions: list[Node] = []
    stray, implied = Node("div"), None
    work: list[tuple] = [(c, None, stray) for c in reversed(table.children)]
    while work:
        node, row, into = work.pop()
        if isinstance(node, str):
            into.children.append(node)
        elif not visible(node):
            continue
        elif node.tag in ("td", "th"):
            if row is None:
                if implied is None:
                    rows.append(implied := [])
                row = implied
            row.append(node)
        elif node.tag == "caption":
            captions.append(node)
        else:
            if node.tag == "tr":
                rows.append(row := [])
            if node.tag in ("tr", "thead", "tbody", "tfoot"):
                implied = None
            else:
                shell = Node(node.tag, node.attributes)
                shell.style = node.style
                into.children.append(shell)
                into = shell
            if "visibility" in node.style:  # inherited by what is taken out of the element
                for c in node.children:
                    if isinstance(c, Node):
                        c.style.setdefault("visibility", node.style["visibility"])
            work += [(c, row, into) for c in reversed(node.children)]
    return rows, captions, stray


def _span(cell: Node, name: str, most: int) -> int:
    n = cell.attributes.get(name, "").strip()
    return max(1, min(int(n), most)) if n.isascii() and n.isdigit() and len(n) < 10 else 1


def _grid(rows: list[list[Node]]) -> list[list[tuple[int, Node]]]:
    """Cells with their first columns; a cell goes to the first column that no cell of a row above still takes."""
    out, taken = [], []  # taken: (first column, end, row that it ends at), by column
    for r, cells in enumerate(rows):
        taken = [t for t in taken if t[2] > r]
        column, i, row, more = 0, 0, [], []
        for c in cells:
            while i < len(taken) and taken[i][0] <= column:
                column = max(column, taken[i][1])
                i += 1
            width, height = _span(c, "colspan", 1000), _span(c, "rowspan", 65534)
            row.append((column, c))
            if height > 1:
                if more and more[-1][1:] == (column, r + height):
                    more[-1] = (more[-1][0], column + width, r + height)
                else:
                    more.append((column, column + width, r + height))
            column += width
        if more:
            taken = sorted([*taken, *more])
        out.append(row)
    return out


def _aligned(table: Node, shown: bool) -> list[str] | None:
    """Lines of a table of simple cells, after those of what it holds outside its cells; None for one that holds tables (layout), which is shown as blocks."""
    if table.nested:
        return None
    table_rows, captions, stray = _table_parts(table)
    rows, width = [], {}
    for cells in _grid(table_rows):
        row = [(column, x) for column, c in cells if (x := " ".join(y.strip() for y in render(c, shown).split("\n") if y.strip()))]
        for column, x in row:
            width[column] = max(width.get(column, 0), len(x) if len(x) <= WIDEST else 0)
        if row:
            rows.append(row)
    lines = [x for x in render(stray, shown).split("\n") if x] + [x for c in captions if (x := render(c, shown))]
    at, total = {}, 0
    for column in sorted(width):
        at[column] = total
        total += width[column] + 2
    if sum(at[row[-1][0]] for row in rows) > MOST_PADDING * (sum(len(x) for row in rows for _, x in row) + 1000):
        return lines + ["  ".join(x for _, x in row) for row in rows]
    for row in rows:
        parts, upto = [], 0
        for column, x in row:
            gap = max(at[column] - upto, 2 if parts else 0)
            parts += [" " * gap, x]
            upto += gap + len(x)
        lines.append("".join(parts))
    return lines


def render(root: Node, shown: bool = True) -> str:
    """Text of an element; `shown` is the visibility that it inherits."""
    out = _Lines()
    work: list[tuple] = [("in", root, False, shown)]
    counters: list[int | None] = []
    while work:
        step, node, pre, shown = work.pop()
        if isinstance(node, str):
            if shown:
                out.text(node, pre)
            continue
        tag = node.tag
        if step == "out":
            if tag in SPACED:
                out.margin()
            elif tag in BLOCKS:
                out.end_line()
            if tag in ("ul", "ol", "menu"):
                counters.pop()
            if tag in ("li", "blockquote", "dd") and out.indent:
                out.end_line()
                out.marker = ""
                out.indent.pop()
            continue
        if node is not root and not visible(node):
            continue
        if "visibility" in node.style:
            shown = node.style["visibility"] == "visible"
        if tag == "br":
            out.end_line(force=True)
            continue
        if tag == "hr":
            out.margin()
            continue
        if tag == "img":
            if shown and node.attributes.get("alt"):
                out.text(node.attributes["alt"], False)
            continue
        if tag == "table" and node is not root and (lines := _aligned(node, shown)) is not None:
            out.margin()
            for line in lines:
                out.now = [line]
                out.end_line()
            out.margin()
            continue
        if node is not root or tag not in ("td", "th", "caption"):
            if tag in SPACED and not (tag in ("ul", "ol") and counters):
                out.margin()
            elif tag in BLOCKS:
                out.end_line()
        if tag in ("ul", "menu"):
            counters.append(None)
        elif tag == "ol":
            start = node.attributes.get("start", "")
            counters.append(int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1)
        elif tag == "li":
            mark = "- "
            if counters and counters[-1] is not None:
                mark = f"{counters[-1]}. "
                counters[-1] += 1
            out.indent.append(" " * len(mark))
            out.marker = mark if shown else ""
        elif tag in ("blockquote", "dd"):
            out.indent.append("  ")
        work.append(("out", node, pre, shown))
        inside = pre or tag in ("pre", "textarea", "xmp")
        work += [("in", c, inside, shown) for c in reversed(node.children)]
    out.end_line()
    return "\n".join(out.lines).strip("\n")


def extract_text(source: str | None) -> str | None:
    return None if source is None else render(parse(source))


def render_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text for each row of `pages`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array([extract_text(x) for x in batch["html"].to_pylist()], pa.string())], names=["page_id", "url", "text"])

    return narrow(pages, "page_id", "url", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string")
