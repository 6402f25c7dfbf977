"""HTML bodies to text: a small tree builder over the standard tokenizer, then pruning, table folding and output.

Implied end tags are handled for paragraphs, list items, table parts and the head, and what stands in a table outside of its
cells goes before the table (foster parenting); the standard's adoption rules are not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from quillspark.functions.text import WHITE, clean_body

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that end in a line break (fixed values).
BLOCKS = frozenset("p div tr td th li h1 h2 h3 h4 h5 h6 section article pre".split())
PRUNED = frozenset("script style head blockquote".split())
#: Marks of hidden or footer wrappers (fixed values).
MARKS = ("mobile-hide", "hidemobile", "hide-mobile", "footer-copyright", "moe-hide")
HEAD_PARTS = frozenset("base link meta noscript script style template title".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table ul".split())
#: A start tag ends these open elements, looked for up to the nearest element of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Where a table holds nothing but its parts, what those are, and what holds anything.
ROWS = frozenset("table tbody thead tfoot tr".split())
PARTS = frozenset("caption col colgroup tbody tfoot thead tr td th".split())
IN_PLACE = PARTS | frozenset("form script style template".split())
CELLS = frozenset("caption td th".split())
HOLDERS = ROWS | CELLS
_WHITE = re.compile(f"[{WHITE}]+")


class Node:
    """An element: its children are elements and strings."""

    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None) -> None:
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], None

    def elements(self) -> Iterator[Node]:
        """Elements below, in document order."""
        stack = [iter(self.children)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
            elif isinstance(child, Node):
                yield child
                stack.append(iter(child.children))

    def texts(self) -> Iterator[str]:
        stack = [iter(self.children)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
            elif isinstance(child, Node):
                stack.append(iter(child.children))
            else:
                yield child


class _Builder(HTMLParser):
    """``open`` are the elements not yet ended, ``at`` where those of each name stand in it: no step looks through all of them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]
        self.at: dict[str, list[int]] = {}

    def _last(self, names: set[str] | frozenset[str]) -> int:
        """Where the innermost open element of these names stands; 0 without one."""
        return max((self.at[x][-1] for x in names if self.at.get(x)), default=0)

    def _cut(self, size: int) -> None:
        while len(self.open) > size:
            self.at[self.open.pop().tag].pop()

    def _end(self, names: set[str] | frozenset[str], stop: set[str]) -> None:
        last = self._last(names)
        if last and last >= self._last(stop):
            self._cut(last)

    def _add(self, child: Node | str, in_place: bool) -> None:
        """Appends to the open element, or before its table where that holds only parts of a table."""
        here = self.open[-1]
        if not in_place and here.tag in ROWS:
            table = self.open[self._last({"table"})]
            if table.parent is not None:
                here, around = table.parent, table.parent.children
                at = next(i for i in range(len(around) - 1, -1, -1) if around[i] is table)
                around.insert(at, child)
        if here is self.open[-1]:
            here.children.append(child)
        if isinstance(child, Node):
            child.parent = here

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.open[-1].tag == "head" and tag not in HEAD_PARTS:
            self._cut(len(self.open) - 1)
        if tag in ENDS:
            self._end(*ENDS[tag])
        elif tag in ENDS_P:
            self._end({"p"}, {"table", "td", "th", "button"})
        if tag in PARTS:  # ends what was put before the table
            last = self._last(HOLDERS)
            if last and self.open[last].tag in ROWS:
                self._cut(last + 1)
        node = Node(tag, {k: v or "" for k, v in attrs})
        self._add(node, tag in IN_PLACE)
        if tag not in VOID:
            self.at.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self._add(Node("br"), False)
        elif tag not in VOID:
            self._end({tag}, {"table"} if tag not in {"table", "html", "body"} else set())

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "head" and data.strip():
            self._cut(len(self.open) - 1)
        self._add(data, not data.strip())


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _hidden(node: Node) -> bool:
    if node.tag not in ("table", "div", "td"):
        return False
    names = (node.attrs.get("class", "") + "\n" + node.attrs.get("id", "")).lower()
    return node.attrs.get("data-sonar-role", "").lower() == "footer" or any(m in names for m in MARKS)


def _cell(node: Node) -> str:
    return " ".join(x for x in _WHITE.split("".join(node.texts())) if x)


def _plain_rows(rows: list[list[str]]) -> list[str]:
    """Rows without headers: ``key: value`` where no row has more than two filled cells, else commas."""
    filled = [[c for c in row if c] for row in rows]
    pairs = all(len(r) <= 2 for r in filled)
    out = []
    for row in filled:
        if pairs and len(row) == 2:
            out.append(f"{row[0]} {row[1]}" if row[0].endswith(":") else f"{row[0]}: {row[1]}")
        elif row:
            out.append(", ".join(row))
    return out


def table_text(table: Node) -> str:
    """A table's rows as lines; nested tables must have been folded before."""
    feet = {id(tr) for foot in table.elements() if foot.tag == "tfoot" for tr in foot.elements() if tr.tag == "tr"}
    headers, body, foot = [], [], []
    for tr in (x for x in table.elements() if x.tag == "tr"):
        cells = {tag: [_cell(x) for x in tr.elements() if x.tag == tag] for tag in ("th", "td")}
        if id(tr) in feet:
            foot.append(cells["th"] + cells["td"])
        elif cells["td"]:
            body.append(cells["td"])
        else:
            headers += [h for h in cells["th"] if h]
    if headers:
        paired = [", ".join(f"{h}: {v}" for h, v in zip(headers, row, strict=False) if v) for row in body]
        lines = [x for x in paired if x] or headers
    else:
        lines = _plain_rows(body)
    lines = lines + _plain_rows([r for r in foot if r])
    return "\n".join(lines) if lines else " ".join(table.texts())


def _simplify(node: Node) -> None:
    """Drops pruned and hidden elements, then replaces tables by their text, innermost first."""
    todo, order = [node], []
    while todo:
        now = todo.pop()
        now.children = [c for c in now.children if isinstance(c, str) or not (c.tag in PRUNED or _hidden(c))]
        order.append(now)
        todo += [c for c in now.children if isinstance(c, Node)]
    for now in reversed(order):
        now.children = [f"\n{table_text(c)}\n" if isinstance(c, Node) and c.tag == "table" else c for c in now.children]


def _text(node: Node) -> str:
    parts: list[str] = []

    def newline() -> None:
        if not parts or not parts[-1].endswith("\n"):
            parts.append("\n")

    stack = [(node, iter(node.children))]
    while stack:
        now, rest = stack[-1]
        child = next(rest, None)
        if child is None:
            stack.pop()
            if now.tag in BLOCKS:
                newline()
        elif isinstance(child, str):
            if child:
                parts.append(child)
        else:
            if child.tag == "br":
                newline()
            stack.append((child, iter(child.children)))
    return "".join(parts)


def body_text(html: str) -> str:
    root = parse(html)
    for node in root.elements():
        node.parent = None  # no cycles: a page's tree goes when it is done with, not at some later collection
    _simplify(root)
    return clean_body(_text(root))
