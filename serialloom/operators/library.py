"""Book headers, reading progress and stash names."""

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.dates import time_literal
from ..functions.labels import stable_id, summary_line, untitled


def fill_defaults(books: DataFrame, run_ts: datetime) -> DataFrame:
    """Header fallbacks: empty text, an id made from the path, the time of the run.

    ``books`` has path and the header columns.  ``display_title`` is what a
    report shows for a book without a title.
    """
    empty = F.lit("")
    date = F.col("date_published")
    run = time_literal(run_ts, books.schema["date_published"].dataType)
    return books.select(
        "path",
        F.coalesce("book_id", stable_id(F.col("path"))).alias("book_id"),
        *[F.coalesce(c, empty).alias(c) for c in ("url", "title", "author", "description")],
        F.coalesce(date, run).alias("date_published"),
        F.coalesce("title", untitled(F.col("path"))).alias("display_title"),
    )


def rewind_progress(progress: DataFrame, outcomes: DataFrame) -> DataFrame:
    """A book read to the end that got new chapters goes back to 99 percent."""
    grown = (
        outcomes.where(F.col("outcome") == "Updated")
        .select("book_id")
        .distinct()
        .withColumn("_grown", F.lit(True))
    )
    share = F.col("percent_finished")
    rewound = F.when(F.col("_grown") & (share == 1), F.lit(0.99)).otherwise(share)
    return progress.join(grown, "book_id", "left").select(
        *[rewound.alias(c) if c == "percent_finished" else F.col(c) for c in progress.columns]
    )


def report_lines(outcomes: DataFrame, titles: DataFrame) -> DataFrame:
    """The line to show for each book that has something to say."""
    named = outcomes.join(titles.select("book_id", "title"), "book_id", "left")
    line = summary_line(F.col("outcome"), F.col("n"), F.coalesce("title", F.lit("")))
    return named.select("book_id", line.alias("line")).where(F.col("line").isNotNull())


def stash_name(path: Column, stash_ts: Column) -> Column:
    """'{stem}_{date}_{time}.epub' for a book file."""
    stem = F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)
    return F.concat(
        stem, F.lit("_"), F.date_format(stash_ts, "yyyy-MM-dd_HH'h'mm"), F.lit(".epub")
    )


def stash_books(books: DataFrame, stash_ts: datetime) -> DataFrame:
    """What to do with each book when the library is stashed.

    ``books`` has book_id, path, url.  A book with a url is kept under
    ``stash_name`` and created again at its own path; one without is an error.
    """
    has_url = F.col("url").isNotNull()
    return books.select(
        "book_id",
        "path",
        "url",
        F.when(has_url, stash_name(F.col("path"), time_literal(stash_ts, T.TimestampNTZType()))).alias("stash_name"),
        has_url.alias("recreate"),
        F.when(~has_url, F.concat(F.lit("No url could be found for "), "path")).alias("error"),
    )
