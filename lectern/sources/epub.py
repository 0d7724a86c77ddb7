"""EPUB books: a partitioned reader over binary files, chapter selection, and a writer.

A book is a zip of at most a few MB; books are read in parallel, one a row, and exploded to items and blocks.
"""

from __future__ import annotations

import html
import io
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..runtime import arrow_rows
from . import html as H

ITEMS = "book_id string, title string, author string, language string, spine_pos int, name string, item_id string, content string"


def _local(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def read_items(data: bytes) -> Iterator[tuple[str, str, str, int, str, str, str]]:
    """(title, author, language, position, name, id, markup) of the documents of a book: those of the spine in its
    order, then the others; each name once, positions from 1."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        path = next(e.get("full-path", "") for e in container.iter() if _local(e) == "rootfile")
        package = ElementTree.fromstring(z.read(path))
        folder = posixpath.dirname(path)
        meta = {k: "; ".join(e.text.strip() for e in package.iter() if _local(e) == k and e.text) for k in ("title", "creator", "language")}
        manifest = {e.get("id"): e for e in package.iter() if _local(e) == "item"}
        documents = [i for i, e in manifest.items() if "html" in (e.get("media-type") or "")]
        spine = [e.get("idref") for e in package.iter() if _local(e) == "itemref"]
        there, seen, pos = set(z.namelist()), set(), 0
        for i in [*(s for s in spine if s in documents), *documents]:
            name = posixpath.normpath(posixpath.join(folder, unquote(manifest[i].get("href", ""))))
            if name in seen or name not in there:
                continue
            seen.add(name)
            pos += 1
            yield meta["title"], meta["creator"], meta["language"] or "en", pos, name, i, z.read(name).decode("utf-8", "replace")


def items(spark: SparkSession, path: str) -> DataFrame:
    """The documents of all books under path, in spine order. Broken files have no row; their book_id is the file's stem."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path)

    def run(paths: list, contents: list) -> Iterator[tuple]:
        for p, c in zip(paths, contents):
            book = unquote(p.rsplit("/", 1)[-1]).removesuffix(".epub")
            try:
                rows = list(read_items(c))
            except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError):
                continue
            for r in rows:
                yield book, *r

    return arrow_rows(files, run, ["path", "content"], ITEMS)


def units(books: DataFrame) -> DataFrame:
    """(book_id, name, spine_pos, block_pos, tag, text, marked_text, markers) of every item."""

    def run(book: list, name: list, pos: list, content: list) -> Iterator[tuple]:
        for b, n, p, c in zip(book, name, pos, content):
            for k, tag, text, marked, markers in H.units(c or ""):
                yield b, n, p, k, tag, text, marked, [{"marker_id": x, "tag_name": y, "attrs": list(z.items())} for x, y, z in markers]

    schema = "book_id string, name string, spine_pos int, " + H.UNITS.removeprefix("id bigint, ")
    return arrow_rows(books, run, ["book_id", "name", "spine_pos", "content"], schema)


def analysis_blocks(books: DataFrame) -> DataFrame:
    """(book, spine_pos, k, text) of every p and div of more than 25 characters."""

    def run(book: list, pos: list, content: list) -> Iterator[tuple]:
        for b, p, c in zip(book, pos, content):
            for k, t in enumerate(H.analysis_blocks(c or "")):
                yield b, p, k, t

    return arrow_rows(books, run, ["book_id", "spine_pos", "content"], "book string, spine_pos int, k int, text string")


def stem(name: Column) -> Column:
    return F.regexp_replace(F.substring_index(name, "/", -1), r"\.[^.]*$", "")


def non_story(name: Column) -> Column:
    """Front or back matter by its file name."""
    s = T.normalize_text(stem(name))
    return s.rlike("|".join(L.NON_STORY)) & ~F.contains(s, F.lit("chapter"))


def numbered_chapter(name: Column, content: Column) -> Column:
    return ~non_story(name) & (T.chapter_number(stem(name)).isNotNull() | T.chapter_number(T.first_heading(content)).isNotNull())


def chapter_score(name: Column, item_id: Column, content: Column, number: int) -> Column:
    """How well an item answers to a chapter number: by file name 100, id 95, heading 90, title 70; -1000 if it is no story."""
    title = T.squeeze(F.regexp_replace(F.regexp_extract(content, r"(?is)<title[^>]*>(.*?)</title>", 1), "<[^>]+>", " "))
    is_it = lambda c, n: F.when(T.chapter_number(c) == number, n).otherwise(0)
    s = is_it(stem(name), 100) + is_it(item_id, 95) + is_it(T.first_heading(content), 90) + is_it(title, 70)
    return F.when(non_story(name), -1000).otherwise(s)


def pick_chapter(books: DataFrame, number: int) -> DataFrame:
    """The item of every book that answers best to the number; the first of equals; none if none does."""
    s = books.withColumn("score", chapter_score(F.col("name"), F.col("item_id"), F.col("content"), number)).where("score > 0")
    rest = [c for c in s.columns if c != "book_id"]
    return s.groupBy("book_id").agg(F.min_by(F.struct(*rest), F.struct(-F.col("score"), F.col("spine_pos"))).alias("_r")).select("book_id", "_r.*")


def reference_chapter(books: DataFrame, number: int) -> DataFrame:
    """(book_id, text): the item whose name ends in chNNN.xhtml, else the first that names the chapter."""
    named = F.endswith(F.lower("name"), F.lit(f"ch{number:03d}.xhtml"))
    t = T.html_text(F.col("content"))
    says = F.lower(t).rlike(rf"chapitre\s+{number}(?:[^0-9]|$)")
    c = books.select("book_id", "spine_pos", t.alias("text"), named.alias("named"), says.alias("says")).where("named or says")
    return c.groupBy("book_id").agg(F.min_by("text", F.struct((~F.col("named")).cast("int"), F.col("spine_pos"))).alias("text"))


_PAGE = '<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{title}</title></head><body>\n{body}\n</body></html>'


def build(title: str, author: str, language: str, chapters: list[tuple[str, str]]) -> bytes:
    """A minimal book of (heading, body markup) chapters."""
    out = io.BytesIO()
    names = [f"ch{k:03d}.xhtml" for k in range(1, len(chapters) + 1)]
    esc = html.escape
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip")
        z.writestr("META-INF/container.xml", '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        manifest = "".join(f'<item id="c{k}" href="{n}" media-type="application/xhtml+xml"/>' for k, n in enumerate(names))
        spine = "".join(f'<itemref idref="c{k}"/>' for k in range(len(names)))
        z.writestr("OEBPS/content.opf", f'<?xml version="1.0" encoding="utf-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, title)}</dc:identifier><dc:title>{esc(title)}</dc:title><dc:creator>{esc(author)}</dc:creator><dc:language>{esc(language)}</dc:language></metadata><manifest>{manifest}</manifest><spine>{spine}</spine></package>')
        for n, (heading, body) in zip(names, chapters):
            z.writestr(f"OEBPS/{n}", _PAGE.format(title=esc(heading), body=f"<h1>{esc(heading)}</h1>\n{body}"))
    return out.getvalue()


def write(blocks: DataFrame, path: str) -> DataFrame:
    """One book a book_id under path, which all executors share. blocks: (book_id, title, author, language,
    chapter, pos, tag, text, markers). Files are written under another name and then renamed, so a repeated
    task leaves whole files. Returns (book_id, file, n_bytes)."""
    import os

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["chapter", "pos"], kind="stable")
        first = pdf.iloc[0]
        chapters = []
        for name, part in pdf.groupby("chapter", sort=True):
            body = "\n".join(f"<{t}>{H.block_markup(x or '', [(m['marker_id'], m['tag_name'], dict(m['attrs'] or {})) for m in (ms if ms is not None else [])])}</{t}>" for t, x, ms in zip(part["tag"], part["text"], part["markers"]))
            chapters.append((str(name), body))
        data = build(first["title"] or "", first["author"] or "", first["language"] or "fr", chapters)
        os.makedirs(path, exist_ok=True)
        stem_ = re.sub(r"[^A-Za-z0-9._-]+", "_", str(first["book_id"])) or "book"
        target = f"{path}/{stem_}.epub"
        temporary = f"{target}.{uuid.uuid4().hex}"
        with open(temporary, "wb") as f:
            f.write(data)
        os.replace(temporary, target)
        return pd.DataFrame({"book_id": [first["book_id"]], "file": [target], "n_bytes": [len(data)]})

    return blocks.groupBy("book_id").applyInPandas(one, "book_id string, file string, n_bytes bigint")


def side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """Items of two books paired by the stem of their file names: (stem, content_a, content_b)."""
    x = a.select(stem(F.col("name")).alias("stem"), F.col("content").alias("content_a"))
    return x.join(b.select(stem(F.col("name")).alias("stem"), F.col("content").alias("content_b")), "stem")
