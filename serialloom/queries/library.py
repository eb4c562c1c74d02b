"""Queries on headers, progress, reports, stash, cache, sink, stream and whole jobs."""

from pyspark.sql import functions as F

from ..fixed_values import NATIVE_BOOK_PREFIX
from ..functions.labels import strip_ext
from ..operators import assets, diff, library
from ..plans.maintain import Crawled, Stored, create_books, stash_and_recreate, update_books
from ..sinks.blobs import Blobs
from ..sinks.tables import publish_library, read_table
from ..streaming.feeds import FeedWatch, watch_feeds
from . import chapters, inputs
from .inputs import BOOKS_SQL, CHAPTERS_SQL, RUN_TS, table

# --- headers, progress, report, stash ---------------------------------------


def defaults(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").selectExpr(
        "'/lib/' || o_orderkey || '.epub' AS path",
        "CASE WHEN o_orderkey % 2 = 0 THEN 'id-' || o_orderkey END AS book_id",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'https://x/' || o_orderkey END AS url",
        "CASE WHEN o_orderkey % 5 <> 0 THEN 'Book ' || o_orderkey END AS title",
        "CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS author",
        "CAST(NULL AS STRING) AS description",
        "CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END AS date_published",
    )
    return library.fill_defaults(raw, RUN_TS)


DEFAULTS_SQL = """
WITH p AS (SELECT *, '/lib/' || CAST(o_orderkey AS VARCHAR) || '.epub' AS path,
                  CAST(o_orderkey AS VARCHAR) AS k FROM orders),
m AS (SELECT *, md5(path) AS h FROM p)
SELECT path,
  CASE WHEN o_orderkey % 2 = 0 THEN 'id-' || k ELSE h[1:8] || '-' || h[9:12] || '-' || h[13:16]
       || '-' || h[17:20] || '-' || h[21:32] END AS book_id,
  CASE WHEN o_orderkey % 3 = 0 THEN 'https://x/' || k ELSE '' END AS url,
  CASE WHEN o_orderkey % 5 <> 0 THEN 'Book ' || k ELSE '' END AS title,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority ELSE '' END AS author,
  '' AS description,
  CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate ELSE TIMESTAMP '2024-06-01 12:30:00' END AS date_published,
  CASE WHEN o_orderkey % 5 <> 0 THEN 'Book ' || k ELSE path || ' (No Title)' END AS display_title
FROM m
"""


def progress(spark, sf_dir):
    read = table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS book_id",
        "CASE WHEN o_orderkey % 4 = 0 THEN 1.0D ELSE 0.5D END AS percent_finished",
    )
    return library.rewind_progress(read, chapters.outcomes(spark, sf_dir))


def report(spark, sf_dir):
    titles = inputs.books(spark, sf_dir).selectExpr("book_id", "repeat(title || ' ', 8) AS title")
    return library.report_lines(chapters.outcomes(spark, sf_dir), titles)


def stash(spark, sf_dir):
    files = table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS book_id",
        "'/lib/b.' || o_orderkey || '.epub' AS path",
        "CASE WHEN o_orderkey % 10 <> 0 THEN 'https://x/' || o_orderkey END AS url",
    )
    return library.stash_books(files, RUN_TS)


def stripped(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "CASE WHEN doc_id % 2 = 0 THEN 'c' || doc_id || '.xhtml' ELSE 'c' || doc_id END AS item"
    )
    return rows.select("doc_id", strip_ext(F.col("item")).alias("identifier"))


# --- asset cache ------------------------------------------------------------


def _assets(spark, sf_dir, keep):
    return (
        table(spark, sf_dir, "documents")
        .where(keep)
        .selectExpr("source AS book_id", "doc_id || '.png' AS filename", "text")
    )


def _with_bytes(df, mark):
    return df.selectExpr("book_id", "filename", f"CAST('{mark}' || text AS BINARY) AS bytes")


def _cache_parts(spark, sf_dir):
    folder = inputs.work_folder(spark)
    wanted = _assets(spark, sf_dir, "doc_id % 5 <> 0").select("book_id", "filename")
    cache, fetched = (Blobs(spark, f"{folder}/{name}", buckets=16) for name in ("cache", "fetched"))
    cache.add(_with_bytes(_assets(spark, sf_dir, "doc_id % 3 = 0"), "cached "), "load")
    fetched.add(_with_bytes(_assets(spark, sf_dir, "doc_id % 2 = 0"), "fetched "), "load")
    return wanted, cache, fetched


def _as_text(df):
    return df.withColumn("bytes", F.md5("bytes"))


def cache_lookup(spark, sf_dir):
    return _as_text(assets.cache_aside(*_cache_parts(spark, sf_dir)))


def cache_additions(spark, sf_dir):
    return _as_text(assets.cache_delta(*_cache_parts(spark, sf_dir)))


def cache_after_runs(spark, sf_dir):
    """The cache after a run added what it had fetched, twice, as a repeated run would."""
    wanted, cache, fetched = _cache_parts(spark, sf_dir)
    for _ in range(2):
        cache.add(assets.cache_delta(wanted, cache, fetched), "run-1")
    return _as_text(cache.table())


CACHE_SQL = """SELECT source AS book_id, CAST(doc_id AS VARCHAR) || '.png' AS filename, {} AS bytes
FROM documents WHERE {}"""

# --- sink and stream --------------------------------------------------------


def publish(spark, sf_dir):
    """The stored chapters of all books, after the changed books were replaced."""
    columns = ["book_id", "identifier", "pos", "date_published", "title", "url"]
    folder = inputs.work_folder(spark)
    base = inputs.stored(spark, sf_dir).select(*columns)
    publish_library(base, f"{folder}/chapters", f"{folder}/staging-1", buckets=16)
    updated = chapters.outcomes(spark, sf_dir).where("outcome = 'Updated'").select("book_id")
    merged = chapters.merged(spark, sf_dir).join(updated, "book_id", "left_semi").select(*columns)
    publish_library(merged, f"{folder}/chapters", f"{folder}/staging-2", buckets=16)
    return read_table(spark, f"{folder}/chapters", base.schema)


PUBLISH_SQL = f"""
WITH {CHAPTERS_SQL}, {chapters.MERGED_COUNT_ONLY},
updated AS (SELECT book_id FROM ({chapters.OUTCOMES_SQL}) WHERE outcome = 'Updated')
SELECT book_id, identifier, pos, date_published, title, url FROM merged
WHERE book_id IN (SELECT book_id FROM updated)
UNION ALL
SELECT book_id, identifier, pos, date_published, title, url FROM stored
WHERE book_id NOT IN (SELECT book_id FROM updated)
"""


def watch(spark, sf_dir):
    """The last thing a watcher of the line items says about each book."""
    folder = inputs.work_folder(spark)
    schema = table(spark, sf_dir, "lineitem").schema
    items = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "lineitem*.parquet")
        .parquet(sf_dir)
        .selectExpr("CAST(l_orderkey AS STRING) AS book_id", "l_shipdate AS published")
    )
    watch = FeedWatch(spark, f"{folder}/newest", 16)

    def say(news, batch):
        # as if the first attempt had failed after the batch was known
        again = watch.news(items_of_batch(spark, sf_dir), batch)
        news.unionByName(again).distinct().write.mode("overwrite").parquet(f"{folder}/said/batch={batch}")

    query = (
        watch_feeds(items, watch, say)
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema("book_id string, newest_us bigint").parquet(f"{folder}/said/*")


def items_of_batch(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr("CAST(l_orderkey AS STRING) AS book_id", "l_shipdate AS published")


# --- whole jobs -------------------------------------------------------------

CHAPTER_URL = "'https://www.royalroad.com/fiction/' || o_orderkey || '/b/chapter/' || (o_orderkey * 10 + {n}) || '/part-{n}'"


def shelf(spark, sf_dir, more_images="''"):
    """Orders as books of three published chapters, two of them stored.

    A quarter of the second chapters is stored with an older date; a fifth of the
    feeds has nothing newer; every seventh third chapter was not crawled.
    """
    orders = table(spark, sf_dir, "orders")
    shelf = orders.selectExpr(
        "CAST(o_orderkey AS STRING) AS book_id",
        f"'{NATIVE_BOOK_PREFIX}' || o_orderkey || '/book' AS url",
        "'Stored ' || o_orderkey AS title",
        "'old' AS author",
        "'' AS description",
        "CAST(o_orderdate AS TIMESTAMP) AS date_published",
        "'https://cdn/old.jpg' AS cover_url",
    )

    def chapter(n, date):
        return (
            f"named_struct('identifier', CAST(o_orderkey * 10 + {n} AS STRING), 'pos', {n}L, "
            f"'date_published', CAST({date} AS TIMESTAMP), 'title', 'Stored {n}', 'url', "
            + CHAPTER_URL.format(n=n) + ")"
        )

    second = "CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate ELSE o_orderdate + INTERVAL 2 DAY END"
    listed = orders.selectExpr(
        "CAST(o_orderkey AS STRING) AS book_id",
        f"inline(array({chapter(1, 'o_orderdate + INTERVAL 1 DAY')}, {chapter(2, second)}))",
    )
    texts = listed.selectExpr(
        "book_id", "identifier", "'<p>old</p>' AS content",
        "CAST(NULL AS STRING) AS note_start", "CAST(NULL AS STRING) AS note_end",
    )
    feed = orders.selectExpr(
        "CAST(o_orderkey AS STRING) AS book_id",
        "o_orderpriority AS feed_title",
        "CAST(CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 4 <> 0 THEN o_orderdate + INTERVAL 2 DAY"
        " ELSE o_orderdate + INTERVAL 3 DAY END AS TIMESTAMP) AS published",
    )
    page = "'<div class=\"chapter-inner chapter-content\"><p class=\"x\">Text {n} of ' || o_orderkey || '</p><img src=\"https://cdn/' || o_orderkey || '/{n}.png\">' || {more} || '</div>'"
    crawled = orders.selectExpr(
        "o_orderkey",
        "inline(array("
        + ", ".join(
            f"named_struct('n', {n}, 'url', {CHAPTER_URL.format(n=n)}, 'html', {page.format(n=n, more=more_images)})"
            for n in (1, 2, 3)
        )
        + "))",
    ).where("NOT (n = 3 AND o_orderkey % 7 = 0)")
    index = inputs.fiction_pages(spark, sf_dir).select("url", "html")
    return Stored(shelf, listed, texts), feed, Crawled(index, crawled.select("url", "html"))


def _update(spark, sf_dir, refresh=diff.COUNT_ONLY):
    stored, feed, crawled = shelf(spark, sf_dir)
    return update_books(stored, feed, crawled, RUN_TS, refresh)


def job_outcomes(spark, sf_dir):
    return _update(spark, sf_dir).outcomes


def job_toc(spark, sf_dir):
    return _update(spark, sf_dir).toc


def job_manifest(spark, sf_dir):
    return _update(spark, sf_dir).manifest


def job_new_content(spark, sf_dir):
    return _update(spark, sf_dir).new_content


def job_replace_chapters(spark, sf_dir):
    run = _update(spark, sf_dir, diff.REPLACE)
    return run.chapters.withColumn("date_published", F.unix_micros("date_published"))


JOB = f"""
j AS (SELECT *, CAST(o_orderkey AS VARCHAR) AS book_id, CAST(o_orderkey * 10 + 3 AS VARCHAR) AS third,
        o_orderkey % 5 = 0 AND o_orderkey % 4 <> 0 AS current,
        {inputs.FICTION_ERROR} AS error FROM orders),
u AS (SELECT * FROM j WHERE NOT current AND error IS NULL)
"""


def created(spark, sf_dir):
    _, _, crawled = shelf(spark, sf_dir)
    urls = table(spark, sf_dir, "orders").selectExpr(f"'{NATIVE_BOOK_PREFIX}' || o_orderkey || '/book' AS url")
    return create_books(urls, crawled, RUN_TS)


def created_outcomes(spark, sf_dir):
    return created(spark, sf_dir).outcomes


def created_spine(spark, sf_dir):
    return created(spark, sf_dir).spine


def recreated_outcomes(spark, sf_dir):
    _, _, crawled = shelf(spark, sf_dir)
    files = table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS book_id",
        "'/lib/' || o_orderkey || '.epub' AS path",
        f"CASE WHEN o_orderkey % 2 = 0 THEN '{NATIVE_BOOK_PREFIX}' || o_orderkey || '/book' END AS url",
    )
    return stash_and_recreate(files, crawled, RUN_TS)[1].outcomes


CREATED_SQL = f"""
WITH {JOB} SELECT book_id, CASE WHEN error IS NULL THEN 'Updated' ELSE 'Error' END AS outcome,
CAST(CASE WHEN error IS NULL THEN 3 END AS INTEGER) AS n, error FROM j
"""


QUERIES = {
    "fill_defaults": (defaults, DEFAULTS_SQL),
    "rewind_progress": (
        progress,
        f"""SELECT CAST(o_orderkey AS VARCHAR) AS book_id,
            CASE WHEN o_orderkey % 4 = 0 AND r.outcome = 'Updated' THEN 0.99::DOUBLE
                 WHEN o_orderkey % 4 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS percent_finished
            FROM orders LEFT JOIN ({chapters.OUTCOMES_SQL}) r
            ON r.book_id = CAST(o_orderkey AS VARCHAR)""",
    ),
    "report_lines": (
        report,
        f"""WITH r AS ({chapters.OUTCOMES_SQL}), {BOOKS_SQL}
            SELECT r.book_id, '[' || lpad('+' || CAST(n AS VARCHAR), 4, ' ') || '] ' ||
                   substring(repeat(title || ' ', 8), 1, 50) AS line
            FROM r JOIN books b ON r.book_id = b.book_id WHERE outcome = 'Updated'""",
    ),
    "stash_books": (
        stash,
        """SELECT k AS book_id, '/lib/b.' || k || '.epub' AS path,
           CASE WHEN o_orderkey % 10 <> 0 THEN 'https://x/' || k END AS url,
           CASE WHEN o_orderkey % 10 <> 0 THEN 'b.' || k || '_2024-06-01_12h30.epub' END AS stash_name,
           o_orderkey % 10 <> 0 AS recreate,
           CASE WHEN o_orderkey % 10 = 0 THEN 'No url could be found for /lib/b.' || k || '.epub' END AS error
           FROM (SELECT *, CAST(o_orderkey AS VARCHAR) AS k FROM orders)""",
    ),
    "strip_ext": (
        stripped,
        "SELECT doc_id, 'c' || CAST(doc_id AS VARCHAR) AS identifier FROM documents",
    ),
    "cache_aside": (
        cache_lookup,
        CACHE_SQL.format(
            "CASE WHEN doc_id % 3 = 0 THEN md5('cached ' || text) WHEN doc_id % 2 = 0 THEN md5('fetched ' || text) END",
            "doc_id % 5 <> 0",
        ),
    ),
    "cache_delta": (
        cache_additions,
        CACHE_SQL.format("md5('fetched ' || text)", "doc_id % 5 <> 0 AND doc_id % 3 <> 0 AND doc_id % 2 = 0"),
    ),
    "cache_after_runs": (
        cache_after_runs,
        CACHE_SQL.format(
            "CASE WHEN doc_id % 3 = 0 THEN md5('cached ' || text) ELSE md5('fetched ' || text) END",
            "doc_id % 3 = 0 OR doc_id % 5 <> 0 AND doc_id % 2 = 0",
        ),
    ),
    "publish_library": (publish, PUBLISH_SQL),
    "watch_feeds": (
        watch,
        "SELECT CAST(l_orderkey AS VARCHAR) AS book_id, max(epoch_us(l_shipdate)) AS newest_us FROM lineitem GROUP BY l_orderkey",
    ),
    "update_job_outcomes": (
        job_outcomes,
        f"""WITH {JOB} SELECT book_id, CASE WHEN current THEN 'UpToDate' WHEN error IS NOT NULL THEN 'Error'
              ELSE 'Updated' END AS outcome,
            CAST(CASE WHEN current OR error IS NOT NULL THEN NULL WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END AS INTEGER) AS n,
            CASE WHEN NOT current THEN error END AS error FROM j""",
    ),
    "update_job_toc": (
        job_toc,
        f"""WITH {JOB} SELECT book_id, CAST(0 AS BIGINT) AS play_order, 'cover' AS nav_id, 'Cover' AS label,
              'text/title.xhtml' AS target, false AS in_nav FROM u
            UNION ALL
            SELECT book_id, n, CAST(o_orderkey * 10 + n AS VARCHAR),
              CASE WHEN n < 3 THEN 'Stored ' ELSE 'Part ' END || CAST(n AS VARCHAR),
              'text/' || CAST(o_orderkey * 10 + n AS VARCHAR) || '.xhtml', true
            FROM u CROSS JOIN (VALUES (1), (2), (3)) v(n) WHERE NOT (n = 3 AND o_orderkey % 7 = 0)""",
    ),
    "update_job_manifest": (
        job_manifest,
        f"""WITH {JOB}
            SELECT book_id, '1_fixed' AS section, f.seq, f.item_id, f.href, f.media_type, f.properties
            FROM u CROSS JOIN (VALUES
              (CAST(0 AS BIGINT), 'title', 'text/title.xhtml', 'application/xhtml+xml', CAST(NULL AS VARCHAR)),
              (1, 'stylesheet', 'styles/stylesheet.css', 'text/css', NULL),
              (2, 'toc', 'toc.ncx', 'application/xhtml+xml', NULL),
              (3, 'nav', 'nav.xhtml', 'application/xhtml+xml', 'nav')) f(seq, item_id, href, media_type, properties)
            UNION ALL SELECT book_id, '2_image', 0, book_id || '.jpg', 'images/' || book_id || '.jpg', 'image/jpg', NULL FROM u
            UNION ALL SELECT book_id, '2_image', 0, '3.png', 'images/3.png', 'image/png', NULL FROM u WHERE o_orderkey % 7 <> 0
            UNION ALL SELECT book_id, '3_chapter', n, CAST(o_orderkey * 10 + n AS VARCHAR),
              'text/' || CAST(o_orderkey * 10 + n AS VARCHAR) || '.xhtml', 'application/xhtml+xml', NULL
            FROM u CROSS JOIN (VALUES (1), (2), (3)) v(n) WHERE NOT (n = 3 AND o_orderkey % 7 = 0)""",
    ),
    "update_job_new_content": (
        job_new_content,
        f"""WITH {JOB} SELECT book_id, third AS identifier,
            '<p class="x">Text 3 of ' || book_id || '</p><img src="https://cdn/' || book_id || '/3.png">' AS content,
            CAST(NULL AS VARCHAR) AS note_start, CAST(NULL AS VARCHAR) AS note_end
            FROM u WHERE o_orderkey % 7 <> 0""",
    ),
    "update_job_replace": (
        job_replace_chapters,
        f"""WITH {JOB} SELECT book_id, CAST(o_orderkey * 10 + n AS VARCHAR) AS identifier,
            epoch_us(o_orderdate) + n * 86400000000 AS date_published,
            CASE WHEN n = 3 OR (n = 2 AND o_orderkey % 4 = 0) THEN 'Part ' ELSE 'Stored ' END || CAST(n AS VARCHAR) AS title,
            'https://www.royalroad.com/fiction/' || book_id || '/b/chapter/' || CAST(o_orderkey * 10 + n AS VARCHAR)
              || '/part-' || CAST(n AS VARCHAR) AS url, CAST(n AS BIGINT) AS pos
            FROM u CROSS JOIN (VALUES (1), (2), (3)) v(n) WHERE NOT (n = 3 AND o_orderkey % 7 = 0)""",
    ),
    "create_job_outcomes": (created_outcomes, CREATED_SQL),
    "create_job_spine": (
        created_spine,
        f"""WITH {JOB} SELECT book_id, CAST(0 AS BIGINT) AS seq, 'title' AS idref FROM j WHERE error IS NULL
            UNION ALL SELECT book_id, n, CAST(o_orderkey * 10 + n AS VARCHAR) FROM j
            CROSS JOIN (VALUES (1), (2), (3)) v(n)
            WHERE error IS NULL AND NOT (n = 3 AND o_orderkey % 7 = 0)""",
    ),
    "recreate_job_outcomes": (recreated_outcomes, CREATED_SQL + " WHERE o_orderkey % 2 = 0"),
}
