"""Queries on stored and published chapters: diff, merge, gate, outcome, products."""

from functools import partial

from pyspark.sql import DataFrame

from ..operators import assets, diff, products
from ..operators.routing import NATIVE_RULES, route_sources
from ..fixed_values import NATIVE_BOOK_PREFIX
from .inputs import (
    BOOKS_SQL,
    CHAPTERS_SQL,
    RUN_TS,
    TEXTS_SQL,
    books,
    feed_items,
    fetched_texts,
    published,
    stored,
    stored_texts,
    table,
)

WITH = f"WITH {CHAPTERS_SQL}"
WITH_TEXTS = f"WITH {CHAPTERS_SQL}, {TEXTS_SQL}"
WITH_BOOKS = f"WITH {CHAPTERS_SQL}, {BOOKS_SQL}"

CLASSIFIED_SQL = """
classified AS (
  SELECT p.*, CASE WHEN s.book_id IS NULL THEN 'new'
                   WHEN p.date_published > s.date_published THEN 'changed'
                   ELSE 'kept' END AS change
  FROM published p LEFT JOIN stored s USING (book_id, identifier))
"""

FEED_SQL = """
feed AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS book_id, max(l_shipdate) AS feed_max,
         min(o_orderpriority) AS feed_title
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey)
"""

GATE_SQL = """
gates AS (
  SELECT f.book_id, c.current_max, f.feed_max,
         coalesce(c.current_max >= f.feed_max, false) AS up_to_date
  FROM feed f LEFT JOIN
    (SELECT book_id, max(date_published) AS current_max FROM stored GROUP BY book_id) c
    ON f.book_id = c.book_id)
"""


def outcomes(spark, sf_dir) -> DataFrame:
    """One outcome per book of the library: the whole comparison end to end."""
    current = stored(spark, sf_dir)
    shelf = route_sources(books(spark, sf_dir), NATIVE_RULES)
    gates = diff.gate_up_to_date(
        diff.library_high_water(current), diff.feed_high_water(feed_items(spark, sf_dir))
    )
    counts = diff.change_count(diff.classify_chapters(published(spark, sf_dir), current))
    rejects = shelf.where("CAST(book_id AS BIGINT) % 13 = 0").selectExpr(
        "book_id", "'No title found' AS error"
    )
    return diff.update_outcome(shelf, gates, counts, rejects)


OUTCOMES_SQL = f"""
WITH {CHAPTERS_SQL}, {BOOKS_SQL}, {CLASSIFIED_SQL}, {FEED_SQL}, {GATE_SQL},
counts AS (SELECT book_id, count(DISTINCT identifier) AS n FROM classified
           WHERE change <> 'kept' GROUP BY book_id),
joined AS (
  SELECT b.book_id, starts_with(b.url, '{NATIVE_BOOK_PREFIX}') AS supported, g.up_to_date,
         CAST(b.book_id AS BIGINT) % 13 = 0 AS rejected, c.n
  FROM books b LEFT JOIN gates g ON b.book_id = g.book_id
  LEFT JOIN counts c ON b.book_id = c.book_id),
named AS (
  SELECT *, CASE WHEN NOT supported OR up_to_date IS NULL THEN 'Unsupported'
                 WHEN up_to_date THEN 'UpToDate'
                 WHEN rejected OR n > 65535 THEN 'Error'
                 WHEN n > 0 THEN 'Updated' ELSE 'UpToDate' END AS outcome
  FROM joined)
SELECT book_id, outcome,
       CAST(CASE WHEN outcome = 'Updated' THEN n END AS INTEGER) AS n,
       CASE WHEN supported AND up_to_date IS NULL THEN 'feed has no valid date'
            WHEN outcome = 'Error' AND rejected THEN 'No title found'
            WHEN outcome = 'Error' THEN 'more than 65535 new chapters' END AS error
FROM named
"""


def new(spark, sf_dir):
    return diff.new_chapters(published(spark, sf_dir), stored(spark, sf_dir))


def new_with_repeats(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "CAST(l_orderkey AS STRING) AS book_id",
        "CAST(l_linenumber AS STRING) AS identifier",
        "l_shipdate AS date_published",
    )
    return diff.new_chapters(rows, stored(spark, sf_dir))


def changed(spark, sf_dir):
    return diff.changed_chapters(published(spark, sf_dir), stored(spark, sf_dir))


def classified(spark, sf_dir):
    return diff.classify_chapters(published(spark, sf_dir), stored(spark, sf_dir))


def counts(spark, sf_dir):
    return diff.change_count(classified(spark, sf_dir))


def library_newest(spark, sf_dir):
    return diff.library_high_water(stored(spark, sf_dir))


def feed_newest(spark, sf_dir):
    return diff.feed_high_water(feed_items(spark, sf_dir))


def oldest(spark, sf_dir):
    return diff.first_published(books(spark, sf_dir), published(spark, sf_dir), RUN_TS)


def gate(spark, sf_dir):
    return diff.gate_up_to_date(library_newest(spark, sf_dir), feed_newest(spark, sf_dir))


def merged(spark, sf_dir, refresh=diff.COUNT_ONLY):
    return diff.merge_chapters(stored(spark, sf_dir), published(spark, sf_dir), refresh)


MERGED_SQL = """
kept AS (SELECT s.book_id, s.identifier, {date} AS date_published, {title} AS title, s.url,
                0 AS side, s.pos AS pos_at
         FROM stored s JOIN published p USING (book_id, identifier)),
fresh AS (SELECT p.book_id, p.identifier, p.date_published, p.title, p.url, 1 AS side,
                 p.arr_pos AS pos_at
          FROM published p ANTI JOIN stored s USING (book_id, identifier)),
merged AS (
  SELECT book_id, identifier, date_published, title, url,
         row_number() OVER (PARTITION BY book_id ORDER BY side, pos_at) AS pos
  FROM (SELECT * FROM kept UNION ALL SELECT * FROM fresh))
"""
MERGED_COUNT_ONLY = MERGED_SQL.format(date="s.date_published", title="s.title")
MERGED_REPLACE = MERGED_SQL.format(
    date="greatest(s.date_published, p.date_published)",
    title="CASE WHEN p.date_published > s.date_published THEN p.title ELSE s.title END",
)


def order(spark, sf_dir):
    current = stored(spark, sf_dir).where("identifier <> '4'")
    return diff.reading_order(current, new(spark, sf_dir)).select("book_id", "identifier", "pos")


def attached(spark, sf_dir, refresh=diff.COUNT_ONLY):
    moved = classified(spark, sf_dir).where("change <> 'kept'")
    merged_texts = diff.merge_chapters(
        stored_texts(spark, sf_dir), published(spark, sf_dir), refresh
    )
    filled = diff.attach_content(merged_texts, moved, fetched_texts(spark, sf_dir), refresh)
    return filled.select("book_id", "identifier", "content", "note_start", "note_end")


ATTACHED_SQL = """
joined AS (
  SELECT p.book_id, p.identifier, s.content AS c, s.note_start AS ns, s.note_end AS ne,
         f.content AS fc, f.note_start AS fns, f.note_end AS fne, p.change
  FROM classified p LEFT JOIN stored_texts s USING (book_id, identifier)
  LEFT JOIN fetched_texts f USING (book_id, identifier)),
pick AS (SELECT *, change <> 'kept' AND {use_new} AS use_new FROM joined)
SELECT book_id, identifier,
       CASE WHEN use_new THEN fc ELSE c END AS content,
       CASE WHEN use_new THEN fns ELSE ns END AS note_start,
       CASE WHEN use_new THEN fne ELSE ne END AS note_end
FROM pick
"""


def with_content(spark, sf_dir):
    return diff.drop_contentless(stored_texts(spark, sf_dir)).select("book_id", "identifier", "content")


def pruned(spark, sf_dir):
    return diff.prune_for_diff(stored_texts(spark, sf_dir))


def covers(spark, sf_dir):
    shelf = books(spark, sf_dir)
    fetched = shelf.where("CAST(book_id AS BIGINT) % 3 = 0").selectExpr(
        "book_id", "cover_url || '&new' AS cover_url"
    )
    return diff.refresh_cover(shelf, fetched)


def toc(spark, sf_dir):
    return products.table_of_contents(books(spark, sf_dir), merged(spark, sf_dir))


def manifest(spark, sf_dir):
    shelf = books(spark, sf_dir)
    names = assets.asset_names(shelf.selectExpr("book_id", "cover_url AS url"))
    return products.manifest(shelf, merged(spark, sf_dir), names)


MANIFEST_SQL = f"""
WITH {CHAPTERS_SQL}, {BOOKS_SQL}, {MERGED_COUNT_ONLY}
SELECT book_id, '1_fixed' AS section, f.seq, f.item_id, f.href, f.media_type, f.properties
FROM books CROSS JOIN (VALUES
  (CAST(0 AS BIGINT), 'title', 'text/title.xhtml', 'application/xhtml+xml', CAST(NULL AS VARCHAR)),
  (1, 'stylesheet', 'styles/stylesheet.css', 'text/css', NULL),
  (2, 'toc', 'toc.ncx', 'application/xhtml+xml', NULL),
  (3, 'nav', 'nav.xhtml', 'application/xhtml+xml', 'nav')) f(seq, item_id, href, media_type, properties)
UNION ALL
SELECT book_id, '2_image', 0, 'cover.v' || CAST(CAST(book_id AS BIGINT) % 3 AS VARCHAR) || '.jpg',
       'images/cover.v' || CAST(CAST(book_id AS BIGINT) % 3 AS VARCHAR) || '.jpg', 'image/jpg', NULL
FROM books
UNION ALL
SELECT book_id, '3_chapter', pos, identifier, 'text/' || identifier || '.xhtml',
       'application/xhtml+xml', NULL
FROM merged
"""


def spine(spark, sf_dir):
    return products.spine(books(spark, sf_dir), merged(spark, sf_dir))


QUERIES = {
    "update_outcomes": (outcomes, OUTCOMES_SQL),
    "new_chapters": (new, f"{WITH} SELECT p.* FROM published p ANTI JOIN stored USING (book_id, identifier)"),
    "new_chapters_with_repeats": (
        new_with_repeats,
        f"""{WITH} SELECT CAST(l_orderkey AS VARCHAR) AS book_id,
            CAST(l_linenumber AS VARCHAR) AS identifier, l_shipdate AS date_published
            FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM stored s
              WHERE s.book_id = CAST(l_orderkey AS VARCHAR)
                AND s.identifier = CAST(l_linenumber AS VARCHAR))""",
    ),
    "changed_chapters": (
        changed,
        f"""{WITH} SELECT p.* FROM published p JOIN stored s USING (book_id, identifier)
            WHERE p.date_published > s.date_published""",
    ),
    "classify_chapters": (classified, f"{WITH}, {CLASSIFIED_SQL} SELECT * FROM classified"),
    "change_count": (
        counts,
        f"""{WITH}, {CLASSIFIED_SQL}
            SELECT book_id, count(DISTINCT identifier) AS n,
                   CASE WHEN count(DISTINCT identifier) > 65535
                        THEN 'more than 65535 new chapters' END AS error
            FROM classified WHERE change <> 'kept' GROUP BY book_id""",
    ),
    "library_high_water": (
        library_newest,
        f"{WITH} SELECT book_id, max(date_published) AS current_max FROM stored GROUP BY book_id",
    ),
    "feed_high_water": (feed_newest, f"WITH {FEED_SQL} SELECT * FROM feed"),
    "first_published": (
        oldest,
        f"""{WITH_BOOKS} SELECT b.book_id,
            coalesce(min(p.date_published), TIMESTAMP '2024-06-01 12:30:00') AS date_published
            FROM books b LEFT JOIN published p ON b.book_id = p.book_id GROUP BY b.book_id""",
    ),
    "gate_up_to_date": (gate, f"{WITH}, {FEED_SQL}, {GATE_SQL} SELECT * FROM gates"),
    "merge_chapters_count_only": (
        merged,
        f"{WITH}, {MERGED_COUNT_ONLY} SELECT * FROM merged",
    ),
    "merge_chapters_replace": (
        partial(merged, refresh=diff.REPLACE),
        f"{WITH}, {MERGED_REPLACE} SELECT * FROM merged",
    ),
    "reading_order": (
        order,
        f"""{WITH} SELECT book_id, identifier,
            row_number() OVER (PARTITION BY book_id ORDER BY side, pos_at) AS pos
            FROM (SELECT book_id, identifier, 0 AS side, pos AS pos_at FROM stored
                  WHERE identifier <> '4'
                  UNION ALL
                  SELECT book_id, identifier, 1, arr_pos FROM published p
                  ANTI JOIN stored USING (book_id, identifier))""",
    ),
    "attach_content_count_only": (
        attached,
        f"{WITH_TEXTS}, {CLASSIFIED_SQL}, " + ATTACHED_SQL.format(use_new="c IS NULL"),
    ),
    "attach_content_replace": (
        partial(attached, refresh=diff.REPLACE),
        f"{WITH_TEXTS}, {CLASSIFIED_SQL}, " + ATTACHED_SQL.format(use_new="fc IS NOT NULL"),
    ),
    "drop_contentless": (
        with_content,
        f"{WITH_TEXTS} SELECT book_id, identifier, content FROM stored_texts WHERE content IS NOT NULL",
    ),
    "prune_for_diff": (pruned, f"{WITH} SELECT * FROM stored"),
    "refresh_cover": (
        covers,
        f"""WITH {BOOKS_SQL} SELECT book_id, url, title,
            cover_url || CASE WHEN CAST(book_id AS BIGINT) % 3 = 0 THEN '&new' ELSE '' END AS cover_url
            FROM books""",
    ),
    "table_of_contents": (
        toc,
        f"""{WITH_BOOKS}, {MERGED_COUNT_ONLY}
            SELECT book_id, CAST(0 AS BIGINT) AS play_order, 'cover' AS nav_id, 'Cover' AS label,
                   'text/title.xhtml' AS target, false AS in_nav FROM books
            UNION ALL
            SELECT book_id, pos, identifier, title, 'text/' || identifier || '.xhtml', true
            FROM merged""",
    ),
    "manifest": (manifest, MANIFEST_SQL),
    "spine": (
        spine,
        f"""{WITH_BOOKS}, {MERGED_COUNT_ONLY}
            SELECT book_id, CAST(0 AS BIGINT) AS seq, 'title' AS idref FROM books
            UNION ALL SELECT book_id, pos, identifier FROM merged""",
    ),
}
