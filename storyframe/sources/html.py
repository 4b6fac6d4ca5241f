"""HTML in two forms: expressions for flat pages, and a parser for books."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyframe.functions.text import ETX, STX, clean_text

# Elements and class names that carry no prose.
DROPPED = ("sup", "script", "style", "nav", "footer")
DROPPED_CLASSES = ("page-number", "pagenum", "hidden", "metadata", "footnote")
_BLOCKS = ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "section", "article", "td", "br")
_VOID = ("br", "img", "hr", "meta", "link", "input", "area", "base", "col", "wbr")


def mark_italics(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<(em|i)\b[^>]*>(.*?)</\1>", f"{STX}$2{ETX}")


def html_text(html: Column, dropped: tuple[str, ...] = DROPPED) -> Column:
    """The text of a flat page: dropped elements go, italics are marked, tags become blanks, white space is collapsed."""
    out = html
    for tag in (*dropped, "head"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    out = F.regexp_replace(mark_italics(out), r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return clean_text(out)


def paragraphs(html: Column) -> Column:
    """Texts of p elements of two characters or more."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))
    return F.filter(F.transform(found, lambda p: clean_text(F.regexp_replace(mark_italics(p), r"(?s)<[^>]*>", " "))), lambda p: F.length(p) >= 2)


def links(html: Column) -> Column:
    """array<struct<href,title>> of anchors; titles without tags and leading digits."""
    hrefs = F.regexp_extract_all(html, F.lit(r"""(?is)<a\b[^>]*href=["']([^"']*)["'][^>]*>(.*?)</a>"""), F.lit(1))
    texts = F.regexp_extract_all(html, F.lit(r"""(?is)<a\b[^>]*href=["']([^"']*)["'][^>]*>(.*?)</a>"""), F.lit(2))
    tidy = F.transform(texts, lambda t: F.regexp_replace(clean_text(F.regexp_replace(t, r"(?s)<[^>]*>", " ")), r"^\d+[\s._-]*", ""))
    return F.arrays_zip(hrefs.alias("href"), tidy.alias("title"))


def meta(html: Column, name: str) -> Column:
    pattern = rf"""(?is)<meta\b[^>]*name=["']{re.escape(name)}["'][^>]*content=["']([^"']*)["']"""
    return F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))


def page_title(html: Column) -> Column:
    return F.nullif(clean_text(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1)), F.lit(""))


class _Prose(HTMLParser):
    """Blocks of text between block elements, with places of anchors."""

    def __init__(self, dropped: tuple[str, ...]) -> None:
        super().__init__(convert_charrefs=True)
        self.dropped, self.skip, self.open = dropped, 0, []
        self.blocks: list[str] = [""]
        self.tags: list[str] = [""]
        self.anchors: dict[str, int] = {}
        self.title, self.meta, self.in_title = "", {}, False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        at = dict(attrs)
        if tag == "meta" and at.get("name"):
            self.meta[at["name"].lower()] = at.get("content") or ""
        out = tag in self.dropped or tag == "head" or any(c in DROPPED_CLASSES for c in (at.get("class") or "").split())
        if tag not in _VOID:
            self.open.append((tag, out))
            self.skip += out
        self.in_title = tag == "title" or self.in_title
        if tag in _BLOCKS:
            self.blocks.append("")
            self.tags.append(tag)
        if at.get("id"):
            self.anchors[at["id"]] = len(self.blocks) - 1
        if tag in ("em", "i") and not self.skip:
            self.blocks[-1] += STX

    def handle_endtag(self, tag: str) -> None:
        self.in_title = self.in_title and tag != "title"
        if not any(t == tag for t, _ in self.open):
            return
        if tag in ("em", "i") and not self.skip:
            self.blocks[-1] += ETX
        while self.open:
            t, out = self.open.pop()
            self.skip -= out
            if t == tag:
                break
        if tag in _BLOCKS:
            self.blocks.append("")
            self.tags.append("")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.skip:
            self.blocks[-1] += data


def parse(html: str, dropped: tuple[str, ...] = DROPPED) -> dict:
    """paragraphs [(tag, text)], anchors {id: paragraph}, title and meta of a document."""
    p = _Prose(dropped)
    p.feed(html)
    p.close()
    kept, place = [], {}
    for i, (tag, text) in enumerate(zip(p.tags, p.blocks)):
        place[i] = len(kept)
        text = " ".join(text.split(" ")) if STX in text else text
        text = re.sub(r"[ \t\r\n\f\v]+", " ", text).strip()
        if len(text) >= 2:
            kept.append((tag, text))
    return {"paragraphs": kept, "anchors": {k: place[v] for k, v in p.anchors.items()}, "title": " ".join(p.title.split()), "meta": p.meta}


class Node:
    """An element of a document; `order` is its place among all elements and texts."""

    __slots__ = ("tag", "id", "order", "children", "parent")

    def __init__(self, tag: str, id_: str | None, order: int, parent: Node | None) -> None:
        self.tag, self.id, self.order, self.parent = tag, id_, order, parent
        self.children: list[Node | tuple[int, str]] = []

    def walk(self) -> Iterator[Node]:
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def texts(self, low: float, high: float, marked: bool) -> Iterator[str]:
        """Texts whose order lies in [low, high), italics marked if asked for."""
        italic = marked and self.tag in ("em", "i")
        if italic:
            yield STX
        for c in self.children:
            if isinstance(c, Node):
                yield from c.texts(low, high, marked)
            elif low <= c[0] < high:
                yield c[1]
        if italic:
            yield ETX


class _Tree(HTMLParser):
    def __init__(self, dropped: tuple[str, ...]) -> None:
        super().__init__(convert_charrefs=True)
        self.dropped, self.n = dropped, 0
        self.root = self.at = Node("", None, 0, None)
        self.skipped: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.n += 1
        if self.skipped:
            if tag not in _VOID:
                self.skipped.append(tag)
            return
        at = dict(attrs)
        if tag in self.dropped or tag == "head" or any(c in DROPPED_CLASSES for c in (at.get("class") or "").split()):
            if tag not in _VOID:
                self.skipped.append(tag)
            return
        if tag == "p":  # a paragraph ends where the next begins
            self._close("p", ("div", "section", "body", "td", "li", "blockquote"))
        node = Node(tag, at.get("id") or (at.get("name") if tag == "a" else None), self.n, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def _close(self, tag: str, stop: tuple[str, ...] = ()) -> None:
        node = self.at
        while node is not None and node.tag != tag and node.tag not in stop:
            node = node.parent
        if node is not None and node.tag == tag and node.parent is not None:
            self.at = node.parent

    def handle_endtag(self, tag: str) -> None:
        if self.skipped:
            if tag in self.skipped:
                while self.skipped.pop() != tag:
                    pass
            return
        self._close(tag)

    def handle_data(self, data: str) -> None:
        self.n += 1
        if not self.skipped:
            self.at.children.append((self.n, data))


def tree(html: str, dropped: tuple[str, ...] = DROPPED) -> Node:
    p = _Tree(dropped)
    p.feed(html)
    p.close()
    return p.root


_SPEAKER = re.compile(r"\|\s*([A-Z][A-Z\s]+):\s*")  # Fixed value: a name in capitals and a colon begin what someone says
SHORT_CHARS = 100


def _tidy(texts: Iterator[str]) -> str:
    return " ".join("".join(texts).split())


def prose(root: Node, low: float = 0, high: float = float("inf")) -> list[str]:
    """Paragraphs of two characters or more of a document, or of what lies between two places in it.

    The children of its first section; else its outermost p and div; if these have under 100 characters, what speakers in capitals say;
    else its lines.
    """
    inside = lambda n: low <= n.order < high
    long_enough = lambda texts: [t for t in texts if len(t) >= 2]
    found: list[str] = []
    if (section := next((n for n in root.walk() if n.tag == "section" and inside(n)), None)) is not None:
        found = long_enough(_tidy(c.texts(low, high, True)) for c in section.children if isinstance(c, Node))
        found = found or [t for t in [_tidy(section.texts(low, high, False))] if t]
    if not found:
        blocks = [n for n in root.walk() if n.tag in ("p", "div") and inside(n)]
        among = {id(n) for n in blocks}

        def nested(n: Node | None) -> bool:
            while (n := n.parent) is not None:
                if id(n) in among:
                    return True
            return False

        found = long_enough(_tidy(n.texts(low, high, True)) for n in blocks if not nested(n))
    if len(" ".join(found)) < SHORT_CHARS:
        intro, *said = _SPEAKER.split("|".join(root.texts(low, high, False)))
        if said:
            found = [t for t in [intro.strip()] if t] + [f"{who.strip()}: {words.strip()}" for who, words in zip(said[::2], said[1::2])]
    return found or long_enough(x.strip() for x in "\n".join(root.texts(low, high, False)).split("\n"))
