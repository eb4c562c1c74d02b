"""Index pages of books: the header and the list of published chapters."""

from collections.abc import Sequence
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F, types as T

from ..fixed_values import NATIVE_SITE
from ..functions.binding import bound
from ..functions.dates import rfc3339, time_literal
from ..functions.html import chapters_from_script, cover_from_script, script_value
from ..functions.labels import stable_id
from ..functions.urls import absolute_url, url_segment
from .elements import Rule, extract_by_source, extract_elements

# Where the parts of a book's index page are.
FICTION_RULES = (
    Rule("title", tag="h1"),
    Rule("author", tag="a", inside_tag="h4"),
    Rule("description", classes=("hidden-content",), parent_class="description"),
)
# Fixed value: author shown when the page names none.
UNKNOWN_AUTHOR = "<unknown>"

LISTED = "array<struct<id:bigint,order:bigint,date:string,title:string,url:string>>"
_LARGEST_ID = 4_294_967_295


class FictionPages(NamedTuple):
    books: DataFrame
    chapters: DataFrame
    rejects: DataFrame


def parse_fiction_pages(pages: DataFrame, rules: Sequence[Rule] = FICTION_RULES) -> DataFrame:
    """One row per page: header fields, the chapter list, and what is wrong.

    ``pages`` has url and html, and book_id where the book is known; else the id
    is the second part of the url path.
    """
    if "book_id" not in pages.columns:
        url = F.col("url")
        pages = pages.withColumn("book_id", url_segment(url, 1, stable_id(url)))
    scripts = pages.withColumns(
        {
            "cover_url": cover_from_script(F.col("html")),
            "_json": chapters_from_script(F.col("html")),
        }
    )
    return _judged(extract_elements(scripts, rules, ["book_id", "url", "cover_url", "_json"]))


def parse_index_pages(pages: DataFrame, profiles: DataFrame) -> DataFrame:
    """As :func:`parse_fiction_pages`, with ``site``, for pages of several sources.

    ``pages`` has book_id, url, html and source; ``profiles`` comes from ``Profiles.of_pages``.
    Pages of a source without a profile give no row.
    """
    scripts = pages.join(profiles, "source").withColumns(
        {
            "cover_url": script_value(F.col("html"), F.col("cover_script")),
            "_json": script_value(F.col("html"), F.col("chapters_script")),
        }
    )
    keep = ["book_id", "url", "site", "cover_url", "_json"]
    return _judged(extract_by_source(scripts, [r.field for r in FICTION_RULES], keep))


def _judged(parsed: DataFrame) -> DataFrame:
    """What parsing made of each page: header fields, the chapter list, and what is wrong."""
    listed = F.from_json("_json", LISTED)

    def unusable(c):
        whole = F.lit(0), F.lit(_LARGEST_ID)
        return ~F.coalesce(
            c["id"].between(*whole)
            & c["order"].between(*whole)
            & rfc3339(c["date"]).isNotNull()
            & c["title"].isNotNull()
            & c["url"].isNotNull(),
            F.lit(False),
        )

    def judged(chapters):
        error = (
            F.when(F.col("title").isNull(), "No title found")
            .when(F.col("cover_url").isNull(), "No cover found")
            .when(F.col("_json").isNull(), "No chapters found")
            .when(chapters.isNull(), "chapter list is not valid JSON")
            .when(F.exists(chapters, unusable), "chapter list has an unusable entry")
        )
        return F.struct(chapters.alias("listed"), error.alias("error"))

    # The list is read once: a filter on a plain column made from it would be pushed
    # down and read it again.
    return parsed.select(
        *[c for c in ("book_id", "url", "site", "title") if c in parsed.columns],
        F.coalesce("author", F.lit(UNKNOWN_AUTHOR)).alias("author"),
        F.coalesce("description", F.lit("")).alias("description"),
        "cover_url",
        F.inline(F.array(bound(listed, judged))),
    )


def ingest_fiction_pages(
    pages: DataFrame,
    run_ts: datetime,
    site: str = NATIVE_SITE,
    rules: Sequence[Rule] = FICTION_RULES,
) -> FictionPages:
    """Split index pages (url, html) into books, published chapters and rejects."""
    return split_parsed(parse_fiction_pages(pages, rules), run_ts, site)


def split_parsed(parsed: DataFrame, run_ts: datetime, site: str = NATIVE_SITE) -> FictionPages:
    """Books, published chapters and rejects from parsed index pages.

    Links lead to the page's own ``site``, where it has that column.
    """
    own_site = F.col("site") if "site" in parsed.columns else F.lit(site)
    good = parsed.where(F.col("error").isNull())
    dates = F.transform("listed", lambda c: rfc3339(c["date"]))
    books = good.select(
        "book_id",
        "url",
        "title",
        "author",
        "description",
        F.coalesce(F.array_min(dates), time_literal(run_ts, T.TimestampType())).alias("date_published"),
        "cover_url",
    )
    chapters = good.select("book_id", own_site.alias("_site"), F.posexplode("listed").alias("_at", "_c")).select(
        "book_id",
        F.col("_c.id").cast("string").alias("identifier"),
        F.col("_c.order").alias("ord"),
        F.col("_at").cast("long").alias("arr_pos"),
        rfc3339(F.col("_c.date")).alias("date_published"),
        F.col("_c.title").alias("title"),
        absolute_url(F.col("_c.url"), F.col("_site")).alias("url"),
    )
    rejects = parsed.where(F.col("error").isNotNull()).select("book_id", "url", "error")
    return FictionPages(books, chapters, rejects)
