"""Compare what is stored with what is published, and merge the two.

Chapters are keyed by (book_id, identifier).  Joins run on that pair, so a book
of any size is spread over all tasks; per-book facts are aggregates that combine
before the shuffle.
"""

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import MAX_CHANGES
from ..functions.dates import time_literal
from ..plans.pin import pin
from .running import numbered

KEY = ["book_id", "identifier"]
TEXTS = ["content", "note_start", "note_end"]
COUNT_ONLY, REPLACE = "count_only", "replace"
_POS_BLOCK = 100_000


def _check_refresh(refresh: str) -> None:
    if refresh not in (COUNT_ONLY, REPLACE):
        raise ValueError(f"refresh must be {COUNT_ONLY!r} or {REPLACE!r}, not {refresh!r}")


def prune_for_diff(chapters: DataFrame) -> DataFrame:
    """Chapter list without its texts."""
    return chapters.select(*[c for c in chapters.columns if c not in TEXTS])


def drop_contentless(chapters: DataFrame) -> DataFrame:
    return chapters.where(F.col("content").isNotNull())


def _oldest_stored(current: DataFrame) -> DataFrame:
    # One row per key, so that a repeated stored key cannot pile up in a join.
    return current.groupBy(*KEY).agg(F.min("date_published").alias("_stored_date"))


def new_chapters(fetched: DataFrame, current: DataFrame) -> DataFrame:
    """Published chapters whose id is not stored; repeated ids are all kept."""
    return fetched.join(current.select(*KEY).distinct(), KEY, "left_anti")


def changed_chapters(fetched: DataFrame, current: DataFrame) -> DataFrame:
    """Published chapters that are newer than a stored one with the same id."""
    stored = _oldest_stored(current)
    match = (
        (fetched.book_id == stored.book_id)
        & (fetched.identifier == stored.identifier)
        & (fetched.date_published > stored["_stored_date"])
    )
    return fetched.join(stored, match, "left_semi")


def classify_chapters(fetched: DataFrame, current: DataFrame) -> DataFrame:
    """Published chapters with ``change``: new, changed or kept, in one join."""
    stored = _oldest_stored(current).withColumn("_stored", F.lit(True))
    change = (
        F.when(F.col("_stored").isNull(), "new")
        .when(F.col("date_published") > F.col("_stored_date"), "changed")
        .otherwise("kept")
    )
    return fetched.join(stored, KEY, "left").select(*fetched.columns, change.alias("change"))


def change_count(classified: DataFrame) -> DataFrame:
    """Distinct new or changed ids per book; ``error`` when there are too many."""
    return (
        classified.where(F.col("change") != "kept")
        .groupBy("book_id")
        .agg(F.count_distinct("identifier").alias("n"))
        .withColumn("error", too_many_changes(F.col("n")))
    )


def too_many_changes(n: Column) -> Column:
    return F.when(n > MAX_CHANGES, F.lit(f"more than {MAX_CHANGES} new chapters"))


def reading_order(
    stored: DataFrame, new: DataFrame, pos_block: int = _POS_BLOCK
) -> DataFrame:
    """Stored chapters by ``pos``, then new ones by ``arr_pos``, as ``pos`` 1..n."""
    shared = [c for c in stored.columns if c != "pos" and c in new.columns]
    both = stored.select(*shared, F.lit(0).alias("_side"), F.col("pos").alias("_at")).unionByName(
        new.select(*shared, F.lit(1).alias("_side"), F.col("arr_pos").alias("_at"))
    )
    # numbering reads its input twice, and what is new comes out of a join
    blocked = pin(both.withColumn("_block", F.floor(F.col("_at") / F.lit(pos_block))))
    return numbered(
        blocked, ["book_id"], [["_side", "_block"]], ["_at", "identifier"], "pos"
    ).drop("_side", "_block", "_at")


def take_newer_headers(current: DataFrame, fetched: DataFrame) -> DataFrame:
    """Stored chapters with date, title and url of their newest published twin."""
    header = ["date_published", "title", "url"]
    latest = fetched.groupBy(*KEY).agg(F.max(F.struct(*header)).alias("_twin"))
    newer = F.col("_twin.date_published") > F.col("date_published")
    return current.join(latest, KEY, "left").select(
        *[
            F.when(newer, F.col(f"_twin.{c}")).otherwise(F.col(c)).alias(c)
            if c in header
            else F.col(c)
            for c in current.columns
        ]
    )


def merge_chapters(
    current: DataFrame,
    fetched: DataFrame,
    refresh: str = COUNT_ONLY,
    pos_block: int = _POS_BLOCK,
) -> DataFrame:
    """Stored chapters followed by the new ones.

    Chapters that are gone from the published list stay.  With ``count_only`` a
    stored chapter keeps its date, title and url for good; with ``replace`` it
    takes those of a newer published twin.
    """
    _check_refresh(refresh)
    stored = take_newer_headers(current, fetched) if refresh == REPLACE else current
    fresh = new_chapters(fetched, current)
    for text in TEXTS:
        if text in current.columns and text not in fresh.columns:
            fresh = fresh.withColumn(text, F.lit(None).cast("string"))
    return reading_order(stored, fresh, pos_block)


def attach_content(
    chapters: DataFrame,
    changed_ids: DataFrame,
    content: DataFrame,
    refresh: str = COUNT_ONLY,
) -> DataFrame:
    """Give the chapters in ``changed_ids`` their fetched texts.

    Stored text wins with ``count_only``, fetched text with ``replace``; the text
    and its two notes move together.  A chapter whose fetch failed stays as it
    was.  ``content`` has one row per key.
    """
    _check_refresh(refresh)
    wanted = content.join(changed_ids.select(*KEY).distinct(), KEY, "left_semi").select(
        *KEY, *[F.col(t).alias(f"_new_{t}") for t in TEXTS]
    )
    use_new = (
        F.col("content").isNull() if refresh == COUNT_ONLY else F.col("_new_content").isNotNull()
    )
    others = [c for c in chapters.columns if c not in TEXTS]
    return chapters.join(wanted, KEY, "left").select(
        *others, *[F.when(use_new, F.col(f"_new_{t}")).otherwise(F.col(t)).alias(t) for t in TEXTS]
    )


def refresh_cover(current: DataFrame, fetched: DataFrame) -> DataFrame:
    """Stored headers, with the cover url of the published side where there is one."""
    covers = fetched.select("book_id", F.col("cover_url").alias("_cover"))
    return current.join(covers, "book_id", "left").select(
        *[
            F.coalesce("_cover", "cover_url").alias(c) if c == "cover_url" else F.col(c)
            for c in current.columns
        ]
    )


def library_high_water(chapters: DataFrame) -> DataFrame:
    return chapters.groupBy("book_id").agg(F.max("date_published").alias("current_max"))


def feed_high_water(feed_items: DataFrame) -> DataFrame:
    """Newest feed date and feed title per book; no row without a valid date."""
    # Titles are grouped first: a minimum of strings would sort every item, while
    # what is left here is one row per book and title.
    return (
        feed_items.where(F.col("published").isNotNull())
        .groupBy("book_id", "feed_title")
        .agg(F.max("published").alias("_newest"))
        .groupBy("book_id")
        .agg(F.max("_newest").alias("feed_max"), F.min("feed_title").alias("feed_title"))
    )


def first_published(books: DataFrame, chapters: DataFrame, run_ts: datetime) -> DataFrame:
    """Oldest chapter date per book, the time of the run for a book without any."""
    oldest = chapters.groupBy("book_id").agg(F.min("date_published").alias("_oldest"))
    fallback = time_literal(run_ts, chapters.schema["date_published"].dataType)
    return (
        books.select("book_id")
        .join(oldest, "book_id", "left")
        .select("book_id", F.coalesce("_oldest", fallback).alias("date_published"))
    )


def gate_up_to_date(library_max: DataFrame, feed_max: DataFrame) -> DataFrame:
    """Books of the feed with ``up_to_date``: stored newest >= feed newest."""
    current = library_max.select("book_id", "current_max")
    return feed_max.join(current, "book_id", "left").select(
        "book_id",
        "current_max",
        "feed_max",
        F.coalesce(F.col("current_max") >= F.col("feed_max"), F.lit(False)).alias("up_to_date"),
    )


def update_outcome(
    books: DataFrame, gates: DataFrame, counts: DataFrame, rejects: DataFrame
) -> DataFrame:
    """One outcome row per book.

    ``books`` has book_id and source, ``gates`` one row per book whose feed could
    be read, ``counts`` comes from :func:`change_count`, ``rejects`` has book_id
    and error.  A book without a readable feed is unsupported too, but carries an
    error, so that only truly unsupported books reach the ignore list.
    """
    joined = (
        books.select("book_id", "source")
        .join(gates.select("book_id", "up_to_date"), "book_id", "left")
        .join(
            counts.select("book_id", "n", F.col("error").alias("_count_error")),
            "book_id",
            "left",
        )
        .join(
            rejects.groupBy("book_id").agg(F.min("error").alias("_reject")),
            "book_id",
            "left",
        )
    )
    unsupported = F.col("source") == "unsupported"
    no_feed = F.col("up_to_date").isNull()
    fault = F.coalesce("_reject", "_count_error")
    outcome = (
        F.when(unsupported | no_feed, "Unsupported")
        .when(F.col("up_to_date"), "UpToDate")
        .when(fault.isNotNull(), "Error")
        .when(F.col("n") > 0, "Updated")
        .otherwise("UpToDate")
    )
    error = F.when(~unsupported & no_feed, "feed has no valid date").when(
        F.col("outcome") == "Error", fault
    )
    return (
        joined.withColumn("outcome", outcome)
        .withColumn("error", error)
        .select(
            "book_id",
            "outcome",
            F.when(F.col("outcome") == "Updated", F.col("n").cast("int")).alias("n"),
            "error",
        )
    )
