"""Text of page fragments that need the tree: nested blocks, quotes, preformatted text. One value at a time, Arrow-batched."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from itertools import groupby

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements that hold blocks of their own, and those that never have an end tag.
BLOCKS = {"div", "table", "tbody", "thead", "tfoot", "tr", "td", "p", "ul", "ol", "li"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"br", "tt"}


class Node:
    def __init__(self, tag: str, attributes: dict[str, str | None]) -> None:
        self.tag, self.attributes, self.children = tag, attributes, []

    def walk(self) -> Iterator[Node | str]:
        """Everything below, in order."""
        todo = [iter(self.children)]
        while todo:
            for child in todo[-1]:
                yield child
                if isinstance(child, Node):
                    todo.append(iter(child.children))
                    break
            else:
                todo.pop()

    def text(self, between: str = "") -> str:
        return between.join(x for x in self.walk() if isinstance(x, str))

    def first(self, wanted: Callable[[Node], bool]) -> Node | None:
        return next((x for x in self.walk() if isinstance(x, Node) and wanted(x)), None)

    def classes(self) -> list[str]:
        return (self.attributes.get("class") or "").split()


class _Builder(HTMLParser):
    """A tree of elements and text; an end tag closes the nearest element of its name, comments go."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1].children.append(Node(tag, dict(attrs)))

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _lines(text: str) -> str:
    """One kind of line end, nothing before it, at most one blank line."""
    text = re.sub(r"\r\n?", "\n", text).replace("\xa0", " ")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", text)).strip()


def _block(node: Node, inner: str) -> str:
    """The text of one element between others; `inner` is that of its own blocks."""
    if node.tag == "blockquote":
        return "\n".join(f"> {line}" if line else ">" for line in inner.split("\n")).strip() if inner else ""
    if node.tag in BLOCKS:
        return inner
    return _lines(node.text("" if node.tag == "pre" else " "))


def paragraphs(node: Node) -> str:
    """Flowing text and <tt> in a row is one paragraph; <pre> keeps its lines; quotes are marked; blocks and other
    elements stand alone. Paragraphs are parted by blank lines. Deep nesting needs no deep stack."""
    done: dict[int, str] = {}
    nested = [node, *(x for x in node.walk() if isinstance(x, Node) and (x.tag in BLOCKS or x.tag == "blockquote"))]
    for outer in reversed(nested):  # inner blocks come first
        parts = []
        for flowing, group in groupby(outer.children, key=lambda c: isinstance(c, str) or c.tag in INLINE):
            if flowing:
                words = (" ".join((c if isinstance(c, str) else c.text(" ")).split()) for c in group)
                parts.append(" ".join(filter(None, words)))
            else:
                parts += [_block(c, done.get(id(c), "")) for c in group]
        done[id(outer)] = "\n\n".join(filter(None, parts))
    return done[id(node)]


def broken_lines(node: Node) -> str:
    """Text in which <br> ends a line (white space around it goes) and a paragraph right after another begins after a blank
    line."""
    marks = {"br": ("\x01", ""), "p": ("\x02", "\x03")}
    out, todo = [], [iter(node.children)]
    ends = [""]
    while todo:
        for child in todo[-1]:
            if isinstance(child, str):
                out.append(re.sub("[\x01-\x03]", "", child))
                continue
            begin, end = marks.get(child.tag, ("", ""))
            out.append(begin)
            todo.append(iter(child.children))
            ends.append(end)
            break
        else:
            todo.pop()
            out.append(ends.pop())
    text = re.sub("[ \t\r\n]*\x01[ \t\r\n]*", "\n", "".join(out))
    return re.sub("[\x02\x03]", "", re.sub(r"\x03\s*\x02", "\n\n", text))


@F.pandas_udf(T.StringType())
def live_body(pages: pd.Series) -> pd.Series:
    """The message on a live page: the paragraphs of its body element; empty for none."""

    def one(page: str | None) -> str:
        body = tree(page or "").first(lambda x: x.tag == "div" and "msgBody" in x.classes())
        return paragraphs(body) if body else ""

    return pages.map(one)


@F.pandas_udf(T.StringType())
def mail_text(pages: pd.Series) -> pd.Series:
    """The message on a monthly page: its mail element without address, map, dfn and the note of receipt; else all <pre>;
    else the whole page."""

    def one(page: str | None) -> str:
        root = tree(page or "")
        mail = root.first(lambda x: x.tag == "div" and "mail" in x.classes())
        if mail is not None:
            received = mail.first(lambda x: x.tag == "span" and x.attributes.get("id") == "received")
            for node in [mail, *(x for x in mail.walk() if isinstance(x, Node))]:
                node.children = [c for c in node.children if isinstance(c, str) or (c.tag not in ("address", "map", "dfn") and c is not received)]
            return broken_lines(mail).strip()
        parts = [broken_lines(x) for x in root.walk() if isinstance(x, Node) and x.tag == "pre"]
        return ("\n".join(parts) if parts else broken_lines(root)).strip()

    return pages.map(one)
