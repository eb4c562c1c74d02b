"""Inputs of the registered queries, derived by Spark from the given tables.

The tables hold no books, so their rows stand in: an order is a book and its
line items are chapters, page urls are asset urls, events are requests, and
documents, orders and pages are wrapped into feed documents, web pages and
archives for the ingest jobs to take apart again.
"""

import zipfile
from collections.abc import Iterator
from datetime import datetime
from io import BytesIO
from uuid import uuid4
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..fixed_values import NATIVE_BOOK_PREFIX
from ..plans.pin import shared_folder
from ..sources.elements import slices

RUN_TS = datetime(2024, 6, 1, 12, 30)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    return f"{shared_folder(spark)}/work-{uuid4().hex}"


# --- an order is a book, its line items are chapters ------------------------

CHAPTERS_SQL = """
published AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS book_id, CAST(l_linenumber AS VARCHAR) AS identifier,
         CAST(l_linenumber AS BIGINT) AS arr_pos, max(l_shipdate) AS date_published,
         'Chapter ' || CAST(l_linenumber AS VARCHAR) AS title,
         '/c/' || CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) AS url
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
stored AS (
  SELECT book_id, identifier, arr_pos AS pos,
         CASE WHEN arr_pos % 3 = 0 THEN date_published - INTERVAL 1 DAY
              ELSE date_published END AS date_published,
         'Stored ' || identifier AS title, url
  FROM published WHERE (CAST(book_id AS BIGINT) * 7 + arr_pos) % 5 <> 0)
"""


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.max("l_shipdate").alias("date_published"))
        .selectExpr(
            "CAST(l_orderkey AS STRING) AS book_id",
            "CAST(l_linenumber AS STRING) AS identifier",
            "CAST(l_linenumber AS BIGINT) AS arr_pos",
            "date_published",
            "'Chapter ' || l_linenumber AS title",
            "'/c/' || l_orderkey || '/' || l_linenumber AS url",
        )
    )


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        published(spark, sf_dir)
        .where("(CAST(book_id AS BIGINT) * 7 + arr_pos) % 5 <> 0")
        .selectExpr(
            "book_id",
            "identifier",
            "arr_pos AS pos",
            "CASE WHEN arr_pos % 3 = 0 THEN date_published - INTERVAL 1 DAY "
            "ELSE date_published END AS date_published",
            "'Stored ' || identifier AS title",
            "url",
        )
    )


TEXTS_SQL = """
stored_texts AS (
  SELECT *, CASE WHEN pos % 4 = 0 THEN NULL ELSE 'stored ' || url END AS content,
         CAST(NULL AS VARCHAR) AS note_start,
         CASE WHEN pos % 2 = 0 THEN NULL ELSE 'note' END AS note_end
  FROM stored),
fetched_texts AS (
  SELECT book_id, identifier,
         CASE WHEN arr_pos % 5 = 0 THEN NULL ELSE 'fetched ' || url END AS content,
         'start' AS note_start, CAST(NULL AS VARCHAR) AS note_end
  FROM published)
"""


def stored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).selectExpr(
        "*",
        "CASE WHEN pos % 4 = 0 THEN NULL ELSE 'stored ' || url END AS content",
        "CAST(NULL AS STRING) AS note_start",
        "CASE WHEN pos % 2 = 0 THEN NULL ELSE 'note' END AS note_end",
    )


def fetched_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(spark, sf_dir).selectExpr(
        "book_id",
        "identifier",
        "CASE WHEN arr_pos % 5 = 0 THEN NULL ELSE 'fetched ' || url END AS content",
        "'start' AS note_start",
        "CAST(NULL AS STRING) AS note_end",
    )


BOOKS_SQL = f"""
books AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS book_id,
         CASE WHEN o_orderkey % 11 = 0
              THEN 'https://example.org/b/' || CAST(o_orderkey AS VARCHAR)
              ELSE '{NATIVE_BOOK_PREFIX}' || CAST(o_orderkey AS VARCHAR) END AS url,
         'Book ' || CAST(o_orderkey AS VARCHAR) AS title,
         'https://cdn.example.org/' || CAST(o_orderkey AS VARCHAR) || '/cover.v' ||
           CAST(o_orderkey % 3 AS VARCHAR) || '.jpg?s=1' AS cover_url
  FROM orders)
"""


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS book_id",
        "CASE WHEN o_orderkey % 11 = 0 THEN 'https://example.org/b/' || o_orderkey "
        f"ELSE '{NATIVE_BOOK_PREFIX}' || o_orderkey END AS url",
        "'Book ' || o_orderkey AS title",
        "'https://cdn.example.org/' || o_orderkey || '/cover.v' || (o_orderkey % 3) "
        "|| '.jpg?s=1' AS cover_url",
    )


def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    titles = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return items.join(titles, items.l_orderkey == titles.o_orderkey).selectExpr(
        "CAST(l_orderkey AS STRING) AS book_id",
        "o_orderpriority AS feed_title",
        "l_shipdate AS published",
    )


# --- documents that the ingest jobs take apart ------------------------------


def feed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed document per order: two good dates and a bad one; some are cut off."""
    return table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS book_id",
        "'<?xml version=\"1.0\"?><rss><channel><title>' || o_orderpriority || '</title>'"
        " || '<item><title>new</title><pubDate>' "
        " || date_format(o_orderdate, 'EEE, dd MMM yyyy HH:mm:ss') || ' GMT</pubDate></item>'"
        " || '<item><pubDate>' || date_format(o_orderdate + INTERVAL 1 DAY, 'd MMM yyyy HH:mm:ss')"
        " || ' +0200</pubDate></item><item><pubDate>soon</pubDate></item>'"
        " || CASE WHEN o_orderkey % 17 = 0 THEN '<broken' ELSE '</channel></rss>' END AS html",
    )


FICTION_ERROR = """
CASE WHEN o_orderkey % 19 = 0 THEN 'No title found'
     WHEN o_orderkey % 23 = 0 THEN 'No cover found'
     WHEN o_orderkey % 29 = 0 THEN 'No chapters found'
     WHEN o_orderkey % 31 = 0 THEN 'chapter list is not valid JSON'
     WHEN o_orderkey % 37 = 0 THEN 'chapter list has an unusable entry' END
"""


def fiction_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index page per order, with three chapters; some lack a part."""

    def entry(n):
        return (
            f"'{{\"id\":' || (o_orderkey * 10 + {n}) || ',\"order\":{n - 1},\"date\":\"' || "
            f"date_format(o_orderdate + INTERVAL {n} DAY, \"yyyy-MM-dd'T'HH:mm:ss\") || 'Z\"'"
            f" || ',\"title\":\"Part {n}\",\"slug\":null,\"url\":\"/fiction/' || o_orderkey || "
            f"'/b/chapter/' || (o_orderkey * 10 + {n}) || '/part-{n}\"}}'"
        )

    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        f"'{NATIVE_BOOK_PREFIX}' || o_orderkey || '/book' AS url",
        "'<html><body>' || CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE '<h1 class=\"t\">Book <i>'"
        " || o_orderkey || '</i></h1>' END"
        " || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '<h4><span>by</span> <a href=\"/p\">' "
        " || o_orderpriority || '</a></h4>' END"
        " || '<div class=\"description\"><div class=\"hidden-content more\"><p>About <b>' "
        " || o_orderkey || '</b></p><div>end</div></div></div><script>'"
        " || CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE 'window.fictionCover = \"https://cdn/' "
        " || o_orderkey || '.jpg\";\\n' END"
        " || CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE 'window.chapters = [' || "
        " CASE WHEN o_orderkey % 31 = 0 THEN '{oops' "
        "      WHEN o_orderkey % 37 = 0 THEN '{\"id\":-1}' ELSE "
        f"{entry(1)} || ',' || {entry(2)} || ',' || {entry(3)} END || '];\\n' END"
        " || '</script></body></html>' AS html",
    )


ESCAPED_TEXT = "replace(replace(text, '&', '&amp;'), '<', '&lt;')"


def chapter_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chapter page per document, with a hidden notice; notes on some."""
    return table(spark, sf_dir, "documents").selectExpr(
        "source AS book_id",
        "CAST(doc_id AS STRING) AS identifier",
        "'<html><body><p>menu<div class=\"page\">'"
        " || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '<hr><div class=\"portlet x\"><h5>n</h5>"
        "<div class=\"author-note\"><p>before ' || doc_id || '</p></div></div>' END"
        " || '<div class=\"chapter-inner chapter-content\"><p>' || " + ESCAPED_TEXT + " || '</p>'"
        " || '<span class=\"cjM' || doc_id || '\"><br>Taken from ' || source || '.</span>'"
        " || '<p>fin</p></div>'"
        " || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '<div class=\"portlet\">"
        "<div class=\"author-note\">after ' || doc_id || '</div></div>' END"
        " || '</div></body></html>' AS html",
    )


def compat_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chapter file of the external updater per document, with 0 to 3 notes."""
    note = "'<div class=\"author-note-portlet\"><b>note {n} of ' || doc_id || '</b></div>'"
    notes = " || ".join(
        f"CASE WHEN doc_id % 4 >= {n} THEN {note.format(n=n)} ELSE '' END" for n in (1, 2, 3)
    )
    return table(spark, sf_dir, "documents").selectExpr(
        "source AS book_id",
        "CAST(doc_id AS STRING) AS identifier",
        "'T' || doc_id AS title",
        "'<html><head><title>T' || doc_id || '</title></head><body>'"
        " || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '<h3 class=\"fff_chapter_title\">T' "
        " || doc_id || '</h3>' END || " + notes + " || '<p>' || " + ESCAPED_TEXT
        + " || '</p></body></html>' AS html",
    )


def _zip_books(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, "text")):
        paths, contents = [], []
        for doc, text, source in zip(*batch.to_pydict().values()):
            body = escape(text)
            buffer = BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr(
                    "META-INF/container.xml",
                    '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container">'
                    '<rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>',
                )
                author = "" if doc % 3 == 0 else f"<dc:creator>{escape(source)}</dc:creator>"
                z.writestr(
                    "OEBPS/content.opf",
                    '<package xmlns="http://www.idpf.org/2007/opf">'
                    '<metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
                    f"<dc:title>Doc {doc}</dc:title>{author}"
                    f"<dc:identifier>doc-{doc}</dc:identifier>"
                    f"<dc:source>https://site.example/fiction/{doc}</dc:source>"
                    "<dc:date>2024-01-02T03:04:05+01:00</dc:date></metadata><manifest>"
                    '<item id="title" href="text/title.xhtml" media-type="application/xhtml+xml"/>'
                    '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml"/>'
                    '<item id="one.xhtml" href="text/one.xhtml" media-type="application/xhtml+xml"/>'
                    '<item id="two" href="text/two.xhtml" media-type="application/xhtml+xml"/>'
                    '<item id="pic" href="images/pic.png" media-type="image/png"/>'
                    '</manifest><spine><itemref idref="title"/><itemref idref="nav"/>'
                    '<itemref idref="one.xhtml"/><itemref idref="two"/></spine></package>',
                )
                z.writestr("OEBPS/text/title.xhtml", "<html><body>title</body></html>")
                z.writestr("OEBPS/nav.xhtml", "<html><body>nav</body></html>")
                z.writestr(
                    "OEBPS/text/one.xhtml",
                    f"<html><head><title>One {doc}</title>"
                    '<meta name="generator" content="serialloom"/>'
                    f'<meta name="chapterurl" content="https://s.example/fiction/{doc}/b/chapter/{doc}01/x"/>'
                    '<meta name="published" content="2024-01-01T00:00:00Z"/></head><body>'
                    f'<h1>One</h1><div class="chapter-content"><p>{body}</p></div>'
                    '<div class="authors-note-end">bye</div></body></html>',
                )
                z.writestr(
                    "OEBPS/text/two.xhtml",
                    f"<html><head><title>Two</title></head><body><p>second {doc}</p></body></html>",
                )
                z.writestr("OEBPS/images/pic.png", b"\x89PNG\r\n\x1a\n" + str(doc).encode())
            data = buffer.getvalue()
            paths.append(f"/lib/{source}/{doc}.epub")
            contents.append(data[: len(data) // 2] if doc % 10 == 9 else data)
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"]
        )


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive per document; every tenth is cut off."""
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", "text", "source")
        .mapInArrow(_zip_books, "path string, content binary")
    )


def tool_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five log lines per order, as an external updater would leave them."""
    return table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS run_id",
        "inline(array("
        " named_struct('stream', 'stdout', 'line_no', 1L, 'line',"
        "  'Updating a.epub, URL: https://x already contains 3 chapters.'),"
        " named_struct('stream', 'stdout', 'line_no', 2L, 'line', CASE o_orderkey % 6"
        "  WHEN 0 THEN 'a.epub already contains 12 chapters.'"
        "  WHEN 1 THEN 'Do update - epub(' || (o_orderkey % 100) || ') vs url(' || (o_orderkey % 100 + 7) || ')'"
        "  WHEN 2 THEN 'a.epub contains ' || (o_orderkey % 50 + 4) || ' chapters, more than source: ' || (o_orderkey % 50) || '.'"
        "  WHEN 3 THEN 'a.epub - Skipping'"
        "  WHEN 4 THEN 'Do update - epub(1) vs url(70000)' ELSE 'nothing known' END),"
        " named_struct('stream', 'stdout', 'line_no', 3L, 'line',"
        "  CASE WHEN o_orderkey % 6 = 4 THEN 'b - Skipping' ELSE 'done' END),"
        " named_struct('stream', 'stderr', 'line_no', 9L, 'line',"
        "  CASE WHEN o_orderkey % 12 = 1 THEN 'late - Skipping' ELSE 'warning' END)))",
    )


def image_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their links turned into images; a book is a host."""
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id", "url", "replace(html, '<a href=', '<img src=') AS html"
    )
