"""HTML to rows: grids of table cells, and sections of prose. Parsing is tolerant and runs once per document in Arrow
batches.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.spread import spread

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CONTENT = frozenset(("p", "li", "td", "th"))
HIDDEN = frozenset(("script", "style"))
PARSED = 1 << 20  # characters of pages whose rows are held at once
# An opening tag ends open elements of these kinds, up to the nearest of the bounds.
IMPLIED = {
    "p": (
        ("p",), ("td", "th", "li", "table", "body", "div")
    ), "li": (("li", "p"), ("ul", "ol", "body")), "tr": (("td", "th", "tr", "p"), ("table",)),
    "td": (("td", "th", "p"), ("tr", "table")), "th": (("td", "th", "p"), ("tr", "table")), "table": (("p",), ("td", "th", "body", "div")), "div": (
        ("p",), ("td", "th", "li", "body", "div")
    ),
    **{
        h: (("p",), ("td", "th", "li", "body", "div")) for h in HEADINGS
    }, "ul": (("p",), ("td", "th", "li", "body", "div")), "ol": (("p",), ("td", "th", "li", "body", "div")),
}


class Node:
    __slots__ = ("tag", "parts")

    def __init__(self, tag: str):
        self.tag, self.parts = tag, []  # parts: Node or str

    def walk(self):
        """This node and all below, in document order, without recursion."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(p for p in reversed(n.parts) if isinstance(p, Node))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack.extend(reversed(n.parts))
        return "".join(out)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        ends, bounds = IMPLIED.get(tag, ((), ()))
        i = len(self.open) - 1
        cut = None
        while i > 0 and self.open[i].tag not in bounds:
            if self.open[i].tag in ends:
                cut = i
            i -= 1
        if cut is not None:
            del self.open[cut:]
        node = Node(tag)
        self.open[-1].parts.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].parts.append(Node(tag))

    def handle_endtag(self, tag):
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag == "table" and tag != "table":
                return

    def handle_data(self, data):
        if not self.hidden:
            self.open[-1].parts.append(data)


def tree(html: str) -> Node:
    t = _Tree()
    t.feed(html)
    t.close()
    return t.root


def squeeze(text: str) -> str:
    return " ".join(text.split())


def tables(html: str):
    """Of every table, outer ones first: its text, and the cells of all rows inside it."""
    for i, t in enumerate(n for n in tree(html).walk() if n.tag == "table"):
        rows = [
            [
                squeeze(c.text()) for c in r.parts if isinstance(c, Node) and c.tag in ("td", "th")
            ] for r in t.walk() if r.tag == "tr"
        ]
        yield i, squeeze(t.text()), rows


def sections(html: str):
    """(heading or None, text) of each stretch between headings that has text. Text of a content element counts once,
    whatever is nested in it.
    """
    root = tree(html)
    body = next((n for n in root.walk() if n.tag == "body"), root)
    heading, parts = None, []

    def flush():
        text = squeeze(" ".join(p.strip() for p in parts if p.strip()))
        parts.clear()
        return [(heading, text)] if text else []

    stack = [body]
    while stack:
        n = stack.pop()
        if n.tag in HEADINGS:
            yield from flush()
            heading = n.text().strip() or None
        elif n.tag in CONTENT:
            parts.append(n.text())
        else:
            stack.extend(p for p in reversed(n.parts) if isinstance(p, Node))
    yield from flush()


def _mapped(df: DataFrame, key: str, html: str, rows, fields: list[tuple[str, pa.DataType]], ddl: str) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        def batch_of(keys, at, out):
            columns = [pa.array([r[j] for r in out], t) for j, (_, t) in enumerate(fields)]
            return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *columns], [key, *(n for n, _ in fields)])

        for batch in batches:
            keys, at, out, size = batch.column(0), [], [], 0
            for i, page in enumerate(batch.column(1)):  # one page at a time is a Python string
                text = page.as_py() or ""
                size += len(text)
                for r in rows(text):
                    at.append(i)
                    out.append(r)
                if size >= PARSED:
                    yield batch_of(keys, at, out)
                    at, out, size = [], [], 0
            yield batch_of(keys, at, out)

    return spread(df.select(key, html)).mapInArrow(run, f"{key} {kind}, {ddl}")


def html_sections(df: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, pos, heading, text"""
    return _mapped(
        df, key, html, lambda t: ((i, h, x) for i, (h, x) in enumerate(sections(t))),
        [("pos", pa.int32()), ("heading", pa.string()), ("text", pa.string())], "pos int, heading string, text string"
    )


def html_rows(df: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, table_idx, table_text, row_idx, cells: a row for each table row; a table without rows gives one with null
    cells.
    """
    def rows(t):
        for i, text, grid in tables(t):
            for j, cells in enumerate(grid) if grid else [(0, None)]:
                yield i, text, j, cells

    return _mapped(
        df, key, html, rows,
        [
            ("table_idx", pa.int32()), ("table_text", pa.string()), ("row_idx", pa.int32()),
            ("cells", pa.list_(pa.string()))
        ],
        "table_idx int, table_text string, row_idx int, cells array<string>"
    )
