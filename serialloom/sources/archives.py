"""Book archives: one job opens each archive once, the rest is column work."""

import posixpath
import zipfile
from collections.abc import Iterator
from datetime import datetime
from io import BytesIO
from typing import NamedTuple
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.dates import rfc3339, time_literal
from ..functions.html import first_text, meta_content
from ..functions.labels import stable_id, strip_ext
from ..functions.urls import url_segment
from ..plans.pin import pin
from .compat import COMPAT_RULES, compat_columns
from .elements import Rule, extract_elements

# Where the parts of a chapter file written by this system are.
STORED_RULES = (
    Rule("stored_content", classes=("chapter-content",)),
    Rule("stored_start", classes=("authors-note-start",)),
    Rule("stored_end", classes=("authors-note-end",)),
)
# Name under which chapter files say that they follow STORED_RULES.  Pass the
# names that your archives carry if they were written by another program.
GENERATOR = "serialloom"

_HEADER = ("identifier", "source", "title", "creator", "description", "date")
ENTRIES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("kind", T.StringType()),  # book, page, image or error
        T.StructField("seq", T.LongType()),  # place of a page in the reading order
        T.StructField("name", T.StringType()),
        T.StructField("mime", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("bytes", T.BinaryType()),
        *[T.StructField(f, T.StringType()) for f in _HEADER],
    ]
)
_ARROW_ENTRIES = pa.schema(
    [
        (f.name, {"bytes": pa.binary(), "seq": pa.int64()}.get(f.name, pa.string()))
        for f in ENTRIES.fields
    ]
)
_BATCH_ROWS, _BATCH_BYTES = 2_000, 4_000_000


def _local(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _directory(archive: zipfile.ZipFile) -> tuple[dict, dict, list[str]]:
    """Header, items (href and type by id) and reading order, as the archive lists them."""
    container = ElementTree.fromstring(archive.read("META-INF/container.xml"))
    package = next(e.get("full-path") for e in container.iter() if _local(e) == "rootfile")
    root = ElementTree.fromstring(archive.read(package))
    base = posixpath.dirname(package)
    header, items, sequence = {}, {}, []
    for e in root.iter():
        kind = _local(e)
        if kind in _HEADER:
            header.setdefault(kind, e.text)
        elif kind == "item":
            href = posixpath.normpath(posixpath.join(base, unquote(e.get("href", ""))))
            items[e.get("id")] = (href, e.get("media-type") or "")
        elif kind == "itemref":
            sequence.append(e.get("idref"))
    return header, items, sequence


def _entries(archive: zipfile.ZipFile) -> Iterator[dict]:
    """What one archive holds: its header, its pages in reading order, its images.

    All or nothing: the whole archive is tried, piece by piece, before the first entry is
    given; entries are unpacked one at a time.
    """
    header, items, sequence = _directory(archive)
    broken = archive.testzip()
    if broken is not None:
        raise zipfile.BadZipFile(f"bad entry {broken}")
    yield {"kind": "book", **header}
    book = {"identifier": header.get("identifier")}
    for seq, item in enumerate(sequence):
        try:
            text = archive.read(items[item][0]).decode("utf-8", "replace")
        except KeyError:
            text = ""
        yield {**book, "kind": "page", "seq": seq, "name": item, "text": text}
    for href, mime in items.values():
        name = posixpath.basename(href)
        if mime.startswith("image") and name and href in archive.NameToInfo:
            yield {**book, "kind": "image", "name": name, "mime": mime, "bytes": archive.read(href)}


def _open_archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for batch in batches:
        for path, data in zip(batch.column("path"), batch.column("content")):
            for entry in _opened(data.as_py()):
                rows.append({"path": path.as_py(), **entry})
                size += len(entry.get("bytes") or b"") + len(entry.get("text") or "")
                if size > _BATCH_BYTES or len(rows) >= _BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW_ENTRIES)
                    rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _ARROW_ENTRIES)


def _opened(data: bytes) -> Iterator[dict]:
    begun = False
    try:
        with zipfile.ZipFile(BytesIO(data)) as archive:
            for entry in _entries(archive):
                begun = True
                yield entry
    except Exception as problem:  # unreadable is a row, not a failed job
        if begun:  # it has been tried as a whole: this is no fault of the archive
            raise
        yield {"kind": "error", "text": f"{type(problem).__name__}: {problem}"}


class Library(NamedTuple):
    books: DataFrame
    chapters: DataFrame
    content: DataFrame
    assets: DataFrame
    rejects: DataFrame


def read_archives(spark: SparkSession, files: list[str]) -> DataFrame:
    """(path, content) of archives, given as paths or globs."""
    return spark.read.format("binaryFile").load(files).select("path", "content")


def open_archives(archives: DataFrame) -> DataFrame:
    """Entries of archives (path, content).  Write this once, then ingest from it:
    every table of :func:`ingest_archives` would otherwise open the archives anew."""
    return archives.select("path", "content").mapInArrow(_open_archives, ENTRIES)


def ingest_archives(
    entries: DataFrame, run_ts: datetime, generators: tuple[str, ...] = (GENERATOR,)
) -> Library:
    """Split archive entries into books, chapters, chapter texts, assets, rejects.

    All five tables have the ``path`` of the archive.  Missing header fields are '' (the
    date: the time of the run).  The first page and the navigation page are no chapters.

    The book's id is the archive's identifier.  Of several archives with one identifier the
    first, by path, has it; the others, as those without any, have an id made of their path,
    so that two archives are never one book.
    """
    run = time_literal(run_ts, T.TimestampType())
    empty = F.lit("")
    firsts = (
        entries.where((F.col("kind") == "book") & F.col("identifier").isNotNull())
        .groupBy("identifier")
        .agg(F.min("path").alias("_first"), F.count("*").alias("_k"))
        .where("_k > 1")
    )
    # only identifiers that several archives have; mostly none
    shared = pin(firsts.select("identifier", "_first"))
    entries = entries.join(shared, "identifier", "left")
    own = F.coalesce(F.col("path") == F.col("_first"), F.lit(True))
    book_id = F.coalesce(F.when(own, F.col("identifier")), stable_id(F.col("path"))).alias("book_id")
    headers = entries.where(F.col("kind") == "book")
    books = headers.select(
        "path",
        book_id,
        F.coalesce("source", empty).alias("url"),
        F.coalesce("title", empty).alias("title"),
        F.coalesce("creator", empty).alias("author"),
        F.coalesce("description", empty).alias("description"),
        F.coalesce(rfc3339(F.col("date")), run).alias("date_published"),
        empty.alias("cover_url"),
    )
    pages = (
        entries.where((F.col("kind") == "page") & (F.col("seq") > 0))
        .withColumn("_item", strip_ext(F.col("name")))
        .where(F.col("_item") != "nav")
        .select("path", book_id, "seq", "_item", F.col("text").alias("html"))
    )
    html = F.col("html")
    read = pages.select(
        "path",
        "book_id",
        F.col("seq").alias("pos"),
        "_item",
        F.coalesce(first_text(html, "title"), empty).alias("title"),
        F.coalesce(meta_content(html, "chapterurl"), empty).alias("url"),
        F.coalesce(rfc3339(meta_content(html, "published")), run).alias("date_published"),
        F.coalesce(meta_content(html, "generator").isin(*generators), F.lit(False)).alias("_own"),
        "html",
    ).withColumn("identifier", url_segment(F.col("url"), 4, F.col("_item")))
    chapters = read.select("path", "book_id", "identifier", "pos", "date_published", "title", "url")
    picked = extract_elements(
        read, STORED_RULES + COMPAT_RULES, ["path", "book_id", "identifier", "title", "_own"]
    )
    compat = compat_columns(F.col("body"), F.col("notes"), F.col("title"))
    stored = {"content": "stored_content", "note_start": "stored_start", "note_end": "stored_end"}
    content = picked.select(
        "path",
        "book_id",
        "identifier",
        *[
            F.when(F.col("_own"), F.col(stored[field])).otherwise(compat[field]).alias(field)
            for field in stored
        ],
    )
    assets = entries.where(F.col("kind") == "image").select(
        "path", book_id, F.col("name").alias("filename"), "mime", "bytes"
    )
    rejects = entries.where(F.col("kind") == "error").select("path", F.col("text").alias("error"))
    return Library(books, chapters, content, assets, rejects)
