"""Lenient HTML: leaf blocks as marked text, and marked text back to markup."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from ..functions import lexicons as L
from ..runtime import arrow_rows

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def texts(self) -> Iterator[str]:
        for c in self.children:
            if isinstance(c, str):
                yield c
            elif c.tag not in L.SKIP_INSIDE:
                yield from c.texts()

    def text(self) -> str:
        return " ".join(t.strip() for t in self.texts() if t.strip())


class _Tree(HTMLParser):
    """Builds nodes; unclosed paragraphs and list items end where HTML says, other open elements at their parent's end."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        tag = tag.rsplit(":", 1)[-1]
        if tag in _CLOSES_P and any(n.tag == "p" for n in self.open):
            self._close("p")
        if tag in _SIBLINGS and len(self.open) > 1 and self.open[-1].tag in _SIBLINGS[tag]:
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.open[-1].children.append(Node(tag.rsplit(":", 1)[-1], {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        self._close(tag.rsplit(":", 1)[-1])

    def _close(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(markup: str) -> Node:
    tree = _Tree()
    tree.feed(markup)
    tree.close()
    return tree.root


def heading(root: Node) -> str:
    """The first h1, else h2, h3 or title, that has text."""
    for tag in ("h1", "h2", "h3", "title"):
        found = next((n for n in root.walk() if n.tag == tag), None)
        if found and found.text():
            return found.text()
    return ""


def _tidy(text: str) -> str:
    text = re.sub(r"[ \t\n\r]+", " ", text)
    return re.sub(r"(\]\])\s+", r"\1 ", re.sub(r"\s+(\[\[/?)", r" \1", text)).strip()


def marked_text(node: Node) -> tuple[str, list[tuple[str, str, dict[str, str]]]]:
    """Text with inline elements as markers, numbered in the order in which they close; and (id, tag, attributes)."""
    markers: list[tuple[str, str, dict[str, str]]] = []

    def inner(n: Node) -> str:
        out = "".join(c if isinstance(c, str) else inner(c) for c in n.children)
        if n.tag in L.INLINE_TAGS and out.strip():
            name = f"ZX{n.tag.upper()}{len(markers) + 1}X"
            markers.append((name, n.tag, n.attrs))
            return f"[[{name}]]{out}[[/{name}]]"
        return out

    return _tidy("".join(c if isinstance(c, str) else inner(c) for c in node.children)), markers


def leaf_blocks(root: Node) -> Iterator[Node]:
    """Block elements that hold neither another block nor scripts, styles or drawings."""
    for n in root.walk():
        if n.tag in L.BLOCK_TAGS and not any(d.tag in L.BLOCK_TAGS or d.tag in L.SKIP_INSIDE for d in n.walk()):
            yield n


def units(markup: str) -> Iterator[tuple[int, str, str, str, list]]:
    """(block_pos, tag, text, marked_text, markers) of every block worth translating; positions count from 1."""
    k = 0
    for n in leaf_blocks(parse(markup)):
        text = n.text()
        if len(text) >= 2 and re.search("[A-Za-z]", text):
            k += 1
            marked, markers = marked_text(n)
            yield k, n.tag, text, marked or text, markers


def analysis_blocks(markup: str) -> Iterator[str]:
    """Text of every p and div of more than 25 characters; nested ones count twice."""
    for n in parse(markup).walk():
        if n.tag in ("p", "div") and len(t := n.text()) > 25:
            yield t


_MARK = re.compile(r"\[\[(/?)(ZX[A-Z]+[0-9]+X)\]\]")


def markup_of(text: str, markers: list[tuple[str, str, dict[str, str]]]) -> str:
    """The inverse of marked_text: unknown markers are dropped, unmatched closings ignored, open ones closed at the end."""
    known = {m[0]: m for m in markers}
    out, stack, at = [], [], 0
    for m in _MARK.finditer(text):
        out.append(html.escape(text[at : m.start()], quote=False))
        at = m.end()
        if m.group(2) not in known:
            continue
        _, tag, attrs = known[m.group(2)]
        if m.group(1):
            if stack and stack[-1][0] == m.group(2):
                out.append(f"</{stack.pop()[1]}>")
        else:
            stack.append((m.group(2), tag))
            out.append(f"<{tag}{''.join(f' {k}="{html.escape(str(v))}"' for k, v in (attrs or {}).items())}>")
    out.append(html.escape(text[at:], quote=False))
    out += [f"</{tag}>" for _, tag in reversed(stack)]
    return "".join(out)


def block_markup(text: str, markers: list[tuple[str, str, dict[str, str]]]) -> str:
    """What goes into a block: markup if no marker is missing, else the text without markers."""
    if markers and all(f"[[{m[0]}]]" in text and f"[[/{m[0]}]]" in text for m in markers):
        return markup_of(text.strip(), markers)
    return html.escape(_MARK.sub("", text.strip()), quote=False)


UNITS = "id bigint, block_pos int, tag string, text string, marked_text string, markers array<struct<marker_id:string,tag_name:string,attrs:map<string,string>>>"


def units_of(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """The translation units of HTML pages. Null pages have none."""

    def run(ids: list, pages: list) -> Iterator[tuple]:
        for i, p in zip(ids, pages):
            for pos, tag, text, marked, markers in units(p or ""):
                yield i, pos, tag, text, marked, [{"marker_id": a, "tag_name": b, "attrs": list(c.items())} for a, b, c in markers]

    return arrow_rows(pages, run, [id_col, html_col], UNITS)
