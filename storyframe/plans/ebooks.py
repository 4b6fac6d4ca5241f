"""Ebook files made from pages, for queries on the readers: EPUB, FB2 and MOBI."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path string, mtime string, length long, content binary"
COVER = b"\x89PNG\r\n\x1a\n" + bytes(6000)


def first_text(url: str) -> str:
    return f"The first chapter tells at some length of {url} and of nothing else."


def second_text(url: str) -> str:
    return f"The second chapter goes on about {url}, as it was found."


def epub(page_id: int, url: str) -> bytes:
    """Two chapters in one file, cut at an anchor; a part without text; script talk; and a short chapter that is left out."""
    u = escape(url)
    xhtml = lambda body: f'<html xmlns="http://www.w3.org/1999/xhtml"><body>{body}</body></html>'
    points = [("Chapter 1", "a.xhtml#one"), ("Chapter 2", "a.xhtml#two"), ("Talk", "talk.xhtml"), ("Part I", "none.xhtml"), ("Stub", "stub.xhtml")]
    ncx = "".join(f"<navPoint><navLabel><text>{t}</text></navLabel><content src='{h}'/></navPoint>" for t, h in points)
    files = {
        "META-INF/container.xml": '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>',
        "OEBPS/book.opf": f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Page: {page_id}</dc:title><dc:creator>Ann {page_id}</dc:creator><dc:language>en</dc:language>'
        '<meta name="cover" content="img"/></metadata><manifest><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="img" href="front.png" media-type="image/png"/>'
        '<item id="a" href="a.xhtml"/></manifest><spine toc="ncx"><itemref idref="a"/></spine></package>',
        "OEBPS/toc.ncx": f'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap>{ncx}</navMap></ncx>',
        "OEBPS/a.xhtml": xhtml(f'<h1 id="one">Chapter 1</h1><p>{escape(first_text(url))}</p><p>An <em>italic</em> word.<sup>1</sup></p><h1 id="two">Chapter 2</h1><div><p>{escape(second_text(url))}</p></div><p>x</p>'),
        "OEBPS/talk.xhtml": xhtml(f"<b>ANN LEE: </b>I have read all of it, {u}<b>BOB: </b>and so have I, more than once"),
        "OEBPS/stub.xhtml": xhtml("<p>Too short.</p>"),
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
        z.writestr("OEBPS/front.png", COVER)
    return out.getvalue()


def epub_plain(page_id: int, url: str) -> bytes:
    """No contents: a part and two chapters by headings, in two files of the spine, and a line that reads like one."""
    a = f"<html><body><h1>Part One</h1><h2>Arrival</h2><p>{escape(first_text(url))}</p></body></html>"
    b = f"<html><body><p>Chapter 2</p><p>{escape(second_text(url))}</p><p>{escape(first_text(url))}</p></body></html>"
    opf = '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="a.html"/><item id="b" href="b.html"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in (("book.opf", opf), ("a.html", a), ("b.html", b)):
            z.writestr(name, text)
    return out.getvalue()


def fb2(page_id: int, url: str) -> bytes:
    return (
        f'<FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0"><description><title-info><author><first-name>Bo</first-name><last-name>Ek{page_id}</last-name></author>'
        f"<book-title>Page {page_id}</book-title><lang>sv</lang></title-info></description><body><section><title><p>Book One</p></title><section><title><p>Start</p></title><p>{escape(first_text(url))}</p></section>"
        f"<section><p>{escape(second_text(url))}</p></section></section></body></FictionBook>"
    ).encode()


def packed(text: bytes) -> bytes:
    """A PalmDOC record of literals, and of a copy where the last eight bytes come again."""
    out, i = bytearray(), 0
    while i < len(text):
        if i >= 8 and text[i : i + 8] == text[i - 8 : i] and len(text) - i >= 8:
            out += (0x8000 | 8 << 3 | 5).to_bytes(2)
            i += 8
        elif 9 <= text[i] < 0x80 or text[i] == 0:
            out.append(text[i])
            i += 1
        else:
            run = text[i : i + 8]
            out += bytes([len(run)]) + run
            i += len(run)
    return bytes(out)


def mobi(page_id: int, url: str, compressed: bool, linked: bool = True) -> bytes:
    """A table of contents with places (if linked), two parts and a cover."""
    bodies = [f"<h2>One</h2><p>{escape(first_text(url))}</p>", f"<p>{escape(second_text(url))}</p><p>abcdefghabcdefgh</p>"]
    cut = "<mbp:pagebreak/>"
    head = f'<html><head><title>Mobi {page_id}</title><meta name="author" content="Cy {page_id}"/></head><body>'
    links = "<a filepos=%010d>The One</a> <a filepos=%010d>The Two</a>"
    begin = len((head + links % (0, 0) + cut).encode())
    text = (head + links % (begin, begin + len((bodies[0] + cut).encode())) + cut + cut.join(bodies)).encode()
    if not linked:
        text = (head + "<h1>Volume I</h1><h2>Chapter 1. Start</h2>" + bodies[0] + cut + "<h2>Book Two</h2><h2>II. Next</h2>" + bodies[1]).encode()
    pages = [text[i : i + 4096] for i in range(0, len(text), 4096)]
    exth = struct.pack(">III", 100, 8 + 3, 0)[:8] + b"Exa" + struct.pack(">III", 201, 12, 0)
    exth = b"EXTH" + struct.pack(">II", 12 + len(exth), 2) + exth
    exth += bytes(-len(exth) % 4)
    header = bytearray(232 + 16)
    struct.pack_into(">HHIHHHH", header, 0, 2 if compressed else 1, 0, len(text), len(pages), 4096, 0, 0)
    header[16:20] = b"MOBI"
    struct.pack_into(">III", header, 20, 232, 2, 65001)
    struct.pack_into(">II", header, 84, len(header) + len(exth), 4)
    struct.pack_into(">I", header, 108, len(pages) + 1)
    struct.pack_into(">I", header, 128, 0x40)
    records = [bytes(header) + exth + b"Name", *((packed(p) if compressed else p) for p in pages), COVER]
    at, index = 78 + 8 * len(records) + 2, b""
    for i, r in enumerate(records):
        index += struct.pack(">II", at, 2 * i)
        at += len(r)
    return b"name".ljust(32, b"\0") + bytes(28) + b"BOOKMOBI" + bytes(8) + struct.pack(">H", len(records)) + index + bytes(2) + b"".join(records)


def files(spark: SparkSession, sf: str, suffix: str, make: Callable[[int, str], bytes]) -> DataFrame:
    """A file for each page: (path, mtime, length, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = [make(i, u) for i, u in zip(rows["page_id"], rows["url"])]
            yield pd.DataFrame({"path": [f"/books/{i}{suffix}" for i in rows["page_id"]], "mtime": "1.5", "length": [len(b) for b in made], "content": made})

    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.coalesce("url", F.lit("")).alias("url")).mapInPandas(run, FILES)
