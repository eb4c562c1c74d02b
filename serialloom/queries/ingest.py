"""Queries that take feed documents, web pages and archives apart."""

import os
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from ..fixed_values import NATIVE_BOOK_PREFIX
from ..sources import archives as archive_source, listing
from ..sources.chapter_pages import ingest_chapter_pages
from ..sources.compat import ingest_compat_chapters
from ..sources.feeds import ingest_feeds
from ..sources.fiction import ingest_fiction_pages
from . import inputs
from .inputs import FICTION_ERROR, RUN_TS


def _micros(df, name):
    return df.withColumn(name, F.unix_micros(name))


def feeds(spark, sf_dir):
    return _micros(ingest_feeds(inputs.feed_pages(spark, sf_dir)), "published")


def _fiction(spark, sf_dir):
    return ingest_fiction_pages(inputs.fiction_pages(spark, sf_dir), RUN_TS)


def fiction_books(spark, sf_dir):
    return _micros(_fiction(spark, sf_dir).books, "date_published")


def fiction_chapters(spark, sf_dir):
    return _micros(_fiction(spark, sf_dir).chapters, "date_published")


def fiction_rejects(spark, sf_dir):
    return _fiction(spark, sf_dir).rejects


FICTION_SQL = f"f AS (SELECT *, {FICTION_ERROR} AS error FROM orders)"


def chapter_texts(spark, sf_dir):
    return ingest_chapter_pages(inputs.chapter_pages(spark, sf_dir))[0]


def chapter_notices(spark, sf_dir):
    return ingest_chapter_pages(inputs.chapter_pages(spark, sf_dir))[1]


def compat_chapters(spark, sf_dir):
    return ingest_compat_chapters(inputs.compat_pages(spark, sf_dir))


ESCAPED = "replace(replace(text, '&', '&amp;'), '<', '&lt;')"
XML_ESCAPED = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _library(spark, sf_dir):
    entries = archive_source.open_archives(inputs.archives(spark, sf_dir))
    return archive_source.ingest_archives(entries, RUN_TS)


def archive_books(spark, sf_dir):
    return _micros(_library(spark, sf_dir).books, "date_published")


def archive_chapters(spark, sf_dir):
    return _micros(_library(spark, sf_dir).chapters, "date_published")


def archive_content(spark, sf_dir):
    return _library(spark, sf_dir).content


def archive_assets(spark, sf_dir):
    return _library(spark, sf_dir).assets.withColumn("bytes", F.hex("bytes"))


def archive_rejects(spark, sf_dir):
    return _library(spark, sf_dir).rejects.select("path")


#: Tasks that write the files of a library.
TREE_TASKS = 48


def _write_tree(folder):
    """Files of a library, one per order, and an ignore list in each folder that holds some.

    A file of some bytes takes a whole block of a disk, so a task links files of one content to
    the first of them; where that can't be done, a file has its own block again.
    """

    def fill(path, size, first):
        try:
            os.link(first[size], path)
        except (KeyError, OSError):  # none yet, no more links, or the path is there
            path.write_bytes(b"x" * size)
            first[size] = path

    def written(batches):
        made, first = set(), {}
        for batch in batches:
            for order, status in zip(batch.column("o_orderkey").to_pylist(), batch.column("o_orderstatus").to_pylist()):
                at = Path(folder, status, f"shelf{order % 4}")
                if at not in made:
                    at.mkdir(parents=True, exist_ok=True)
                    (at.parent / ".autignore").write_text("*3.epub\n!_*\n")
                    (at / ".autignore").write_text("_*9.epub\n")
                    made.add(at)
                mark = "." if order % 7 == 0 else "_" if order % 3 == 0 else ""
                fill(at / f"{mark}{order}.{'txt' if order % 5 == 0 else 'epub'}", order % 10, first)
            yield pa.RecordBatch.from_arrays([batch.column("o_orderkey")], ["o_orderkey"])

    return written


def scanned_tree(spark, sf_dir):
    """What is visible of a tree of files: hidden ones and those that ignore lists name are not."""
    folder = f"{inputs.work_folder(spark)}/lib"
    plain = folder.removeprefix("file:").replace("///", "/")
    orders = inputs.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    # rows are small and files slow: every task writes some, whatever the splits of the table
    dealt = orders.repartition(TREE_TASKS, "o_orderkey")
    dealt.mapInArrow(_write_tree(plain), "o_orderkey bigint").write.format("noop").mode("overwrite").save()
    found = listing.scan_library(spark, [folder])
    return found.select(F.substring("path", len(plain) + 2, 2**31 - 1).alias("path"), "length")


QUERIES = {
    "scan_library": (
        scanned_tree,
        """WITH f AS (
             SELECT o_orderstatus || '/shelf' || CAST(o_orderkey % 4 AS VARCHAR) || '/' AS dir, o_orderkey AS k,
               CASE WHEN o_orderkey % 7 = 0 THEN '.' WHEN o_orderkey % 3 = 0 THEN '_' ELSE '' END AS mark FROM orders)
           SELECT dir || mark || CAST(k AS VARCHAR) || '.epub' AS path, CAST(k % 10 AS BIGINT) AS length
           FROM f WHERE k % 5 <> 0 AND mark <> '.'
             AND CASE WHEN mark = '_' THEN k % 10 <> 9 ELSE k % 10 <> 3 END""",
    ),
    "ingest_feeds": (
        feeds,
        """SELECT CAST(o_orderkey AS VARCHAR) AS book_id, o_orderpriority AS feed_title,
           epoch_us(o_orderdate) AS published FROM orders
           UNION ALL
           SELECT CAST(o_orderkey AS VARCHAR), o_orderpriority,
           epoch_us(o_orderdate) + 86400000000 - 7200000000 FROM orders""",
    ),
    "ingest_fiction_books": (
        fiction_books,
        f"""WITH {FICTION_SQL} SELECT CAST(o_orderkey AS VARCHAR) AS book_id,
            '{NATIVE_BOOK_PREFIX}' || CAST(o_orderkey AS VARCHAR) || '/book' AS url,
            'Book <i>' || CAST(o_orderkey AS VARCHAR) || '</i>' AS title,
            CASE WHEN o_orderkey % 3 = 0 THEN '<unknown>' ELSE o_orderpriority END AS author,
            '<p>About <b>' || CAST(o_orderkey AS VARCHAR) || '</b></p><div>end</div>' AS description,
            epoch_us(o_orderdate) + 86400000000 AS date_published,
            'https://cdn/' || CAST(o_orderkey AS VARCHAR) || '.jpg' AS cover_url
            FROM f WHERE error IS NULL""",
    ),
    "ingest_fiction_chapters": (
        fiction_chapters,
        f"""WITH {FICTION_SQL} SELECT CAST(o_orderkey AS VARCHAR) AS book_id,
            CAST(o_orderkey * 10 + n AS VARCHAR) AS identifier, CAST(n - 1 AS BIGINT) AS ord,
            CAST(n - 1 AS BIGINT) AS arr_pos,
            epoch_us(o_orderdate) + n * 86400000000 AS date_published,
            'Part ' || CAST(n AS VARCHAR) AS title,
            'https://www.royalroad.com/fiction/' || CAST(o_orderkey AS VARCHAR) || '/b/chapter/' ||
              CAST(o_orderkey * 10 + n AS VARCHAR) || '/part-' || CAST(n AS VARCHAR) AS url
            FROM f CROSS JOIN (VALUES (1), (2), (3)) v(n) WHERE error IS NULL""",
    ),
    "ingest_fiction_rejects": (
        fiction_rejects,
        f"""WITH {FICTION_SQL} SELECT CAST(o_orderkey AS VARCHAR) AS book_id,
            '{NATIVE_BOOK_PREFIX}' || CAST(o_orderkey AS VARCHAR) || '/book' AS url, error
            FROM f WHERE error IS NOT NULL""",
    ),
    "ingest_chapter_pages": (
        chapter_texts,
        f"""SELECT source AS book_id, CAST(doc_id AS VARCHAR) AS identifier,
            '<p>' || {ESCAPED} || '</p><p>fin</p>' AS content,
            CASE WHEN doc_id % 3 <> 0 THEN '<p>before ' || CAST(doc_id AS VARCHAR) || '</p>' END AS note_start,
            CASE WHEN doc_id % 2 <> 0 THEN 'after ' || CAST(doc_id AS VARCHAR) END AS note_end
            FROM documents""",
    ),
    "chapter_notices": (
        chapter_notices,
        """SELECT source AS book_id, CAST(doc_id AS VARCHAR) AS identifier,
           'cjM' || CAST(doc_id AS VARCHAR) AS class, '<br>Taken from ' || source || '.' AS html
           FROM documents""",
    ),
    "ingest_compat_chapters": (
        compat_chapters,
        f"""WITH d AS (SELECT *, CAST(doc_id AS VARCHAR) AS id FROM documents)
            SELECT source AS book_id, id AS identifier,
            CASE WHEN doc_id % 4 = 3 THEN '<div class="author-note-portlet"><b>note 1 of ' || id || '</b></div>' ELSE '' END
            || repeat('<div class="author-note-portlet"></div>', CAST(least(doc_id % 4, 2) AS INTEGER))
            || '<p>' || {ESCAPED} || '</p>' AS content,
            CASE WHEN doc_id % 4 >= 2 THEN '<b>note ' || CAST(doc_id % 4 - 1 AS VARCHAR) || ' of ' || id || '</b>' END AS note_start,
            CASE WHEN doc_id % 4 >= 1 THEN '<b>note ' || CAST(doc_id % 4 AS VARCHAR) || ' of ' || id || '</b>' END AS note_end
            FROM d""",
    ),
    "archive_books": (
        archive_books,
        """SELECT '/lib/' || source || '/' || CAST(doc_id AS VARCHAR) || '.epub' AS path,
           'doc-' || CAST(doc_id AS VARCHAR) AS book_id,
           'https://site.example/fiction/' || CAST(doc_id AS VARCHAR) AS url,
           'Doc ' || CAST(doc_id AS VARCHAR) AS title,
           CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS author, '' AS description,
           epoch_us(TIMESTAMP '2024-01-02 02:04:05') AS date_published, '' AS cover_url
           FROM documents WHERE doc_id % 10 <> 9""",
    ),
    "archive_chapters": (
        archive_chapters,
        """SELECT '/lib/' || source || '/' || CAST(doc_id AS VARCHAR) || '.epub' AS path, 'doc-' || CAST(doc_id AS VARCHAR) AS book_id, CAST(doc_id AS VARCHAR) || '01' AS identifier,
           CAST(2 AS BIGINT) AS pos, epoch_us(TIMESTAMP '2024-01-01') AS date_published,
           'One ' || CAST(doc_id AS VARCHAR) AS title,
           'https://s.example/fiction/' || CAST(doc_id AS VARCHAR) || '/b/chapter/' || CAST(doc_id AS VARCHAR) || '01/x' AS url
           FROM documents WHERE doc_id % 10 <> 9
           UNION ALL
           SELECT '/lib/' || source || '/' || CAST(doc_id AS VARCHAR) || '.epub', 'doc-' || CAST(doc_id AS VARCHAR), 'two', 3, epoch_us(TIMESTAMP '2024-06-01 12:30:00'),
           'Two', '' FROM documents WHERE doc_id % 10 <> 9""",
    ),
    "archive_content": (
        archive_content,
        f"""SELECT '/lib/' || source || '/' || CAST(doc_id AS VARCHAR) || '.epub' AS path, 'doc-' || CAST(doc_id AS VARCHAR) AS book_id, CAST(doc_id AS VARCHAR) || '01' AS identifier,
            '<p>' || {XML_ESCAPED} || '</p>' AS content, CAST(NULL AS VARCHAR) AS note_start, 'bye' AS note_end
            FROM documents WHERE doc_id % 10 <> 9
            UNION ALL
            SELECT '/lib/' || source || '/' || CAST(doc_id AS VARCHAR) || '.epub', 'doc-' || CAST(doc_id AS VARCHAR), 'two', '<p>second ' || CAST(doc_id AS VARCHAR) || '</p>', NULL, NULL
            FROM documents WHERE doc_id % 10 <> 9""",
    ),
    "archive_assets": (
        archive_assets,
        """SELECT '/lib/' || source || '/' || CAST(doc_id AS VARCHAR) || '.epub' AS path, 'doc-' || CAST(doc_id AS VARCHAR) AS book_id, 'pic.png' AS filename,
           'image/png' AS mime, '89504E470D0A1A0A' || hex(CAST(doc_id AS VARCHAR)) AS bytes
           FROM documents WHERE doc_id % 10 <> 9""",
    ),
    "archive_rejects": (
        archive_rejects,
        """SELECT '/lib/' || source || '/' || CAST(doc_id AS VARCHAR) || '.epub' AS path
           FROM documents WHERE doc_id % 10 = 9""",
    ),
}
