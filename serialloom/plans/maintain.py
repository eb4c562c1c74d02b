"""The three jobs over a whole library: update, create, stash.

Each takes tables and gives tables; :mod:`serialloom.sinks` writes them.
"""

from collections.abc import Sequence
from datetime import datetime
from functools import cached_property
from typing import NamedTuple

from pyspark.sql import DataFrame, Window, functions as F

from .. import schemas
from ..functions.html import clean_html
from ..functions.labels import stable_id
from ..functions.urls import url_segment
from ..operators import assets, diff, products
from ..operators.library import stash_books
from ..operators.routing import ALL_RULES, COMPAT, UNSUPPORTED, SourceRule, route_sources
from ..operators.toollog import classify_tool_log
from ..sinks.blobs import Blobs
from ..sources.elements import extract_by_source
from ..sources.fiction import parse_index_pages, split_parsed
from ..sources.profiles import CHAPTER, INDEX, NATIVE, Profiles, SourceProfile, profile_tables
from .pin import pin


class Stored(NamedTuple):
    """What the library holds."""

    books: DataFrame  # schemas.BOOKS
    chapters: DataFrame  # schemas.CHAPTERS
    content: DataFrame  # schemas.CHAPTER_CONTENT
    high_water: DataFrame | None = None  # schemas.HIGH_WATER; without it, all chapters are read


class Images(NamedTuple):
    """Where the images of a run come from."""

    cache: Blobs  # by book_id, filename
    fetched: Blobs  # by url


class Crawled(NamedTuple):
    """What was crawled: pages by url, with fetched_at where a url may repeat."""

    index_pages: DataFrame  # url, html[, fetched_at]
    chapter_pages: DataFrame  # url, html[, fetched_at]


class Run:
    """What one job has to report and to write.

    Tables that several outputs share are worked out once, when first asked for.
    """

    def __init__(
        self,
        outcomes: DataFrame,
        books: DataFrame,
        stored_chapters: DataFrame,
        new_chapters: DataFrame,
        to_fetch: DataFrame,
        chapter_pages: DataFrame,
        stored_content: DataFrame,
        sources: DataFrame,
        profiles: Profiles,
        refresh: str = diff.COUNT_ONLY,
        images: Images | None = None,
    ):
        self.outcomes = outcomes  # schemas.OUTCOMES
        self.books = books
        self._stored_chapters = stored_chapters
        self._new_chapters = new_chapters
        self._to_fetch = to_fetch
        self._chapter_pages = chapter_pages
        self._stored_content = stored_content
        self._sources = sources  # book_id, source
        self._profiles = profiles
        self._refresh = refresh
        self.images = images

    @cached_property
    def _parsed(self) -> DataFrame:
        """The crawled pages of the wanted chapters; others are never parsed."""
        keys = self._to_fetch.select(*diff.KEY, "url").distinct().join(self._sources, "book_id")
        keys = pin(keys.join(self._profiles.of_pages(CHAPTER).select("source", "rules"), "source"))
        wanted = _latest(self._chapter_pages, keys).select(*diff.KEY, "html", "rules")
        return pin(extract_by_source(wanted, diff.TEXTS, diff.KEY, notices=True))

    @property
    def new_content(self) -> DataFrame:
        return diff.drop_contentless(self._parsed.select(*diff.KEY, *diff.TEXTS))

    @property
    def notices(self) -> DataFrame:
        """What was taken out of the fetched texts (sources with a notice rule)."""
        return self._parsed.select(*diff.KEY, F.inline("notices"))

    @property
    def _kept_content(self) -> DataFrame:
        if self._refresh == diff.COUNT_ONLY:
            return self._stored_content
        return self._stored_content.join(
            self.new_content.select(*diff.KEY), diff.KEY, "left_anti"
        )

    @cached_property
    def chapters(self) -> DataFrame:
        """Chapters with a text, in reading order."""
        if "content" in self.__dict__:  # worked out before, and the same chapters
            has_text = self.content.select(*diff.KEY)
        else:
            stored = diff.drop_contentless(self._stored_content).select(*diff.KEY)
            has_text = stored.unionByName(self.new_content.select(*diff.KEY))
        return pin(
            diff.reading_order(
                self._stored_chapters.join(has_text, diff.KEY, "left_semi"),
                self._new_chapters.join(has_text, diff.KEY, "left_semi"),
            )
        )

    @cached_property
    def content(self) -> DataFrame:
        """The texts of the run's books, as they are stored."""
        return pin(diff.drop_contentless(self._kept_content).unionByName(self.new_content))

    @property
    def high_water(self) -> DataFrame:
        return diff.library_high_water(self.chapters)

    @cached_property
    def _wanted_images(self) -> DataFrame:
        texts = self._kept_content.unionByName(self.new_content)
        return pin(assets.drop_failed_assets(assets.book_assets(self.books, texts)))

    @cached_property
    def resolved_assets(self) -> DataFrame:
        """What became of each image: cached, fetched or failed (runs with images)."""
        return pin(assets.resolve_assets(self._wanted_images, *self.images))

    @cached_property
    def asset_names(self) -> DataFrame:
        """The names of the books' images: those that were obtained, or without images in the
        run those of all urls."""
        if self.images is None:
            return pin(assets.asset_names(self._wanted_images))
        return assets.obtained(self.resolved_assets).select("book_id", "url", "filename")

    @property
    def asset_bytes(self) -> DataFrame:
        return assets.asset_bytes(self.resolved_assets, *self.images)

    def cache_images(self, run_id: str) -> int:
        """Add the images that this run has fetched to the cache."""
        return assets.cache_resolved(self.resolved_assets, *self.images, run_id)

    @property
    def rendered(self) -> DataFrame:
        """Texts as they go into the books; images that were not obtained keep their url."""
        return render_texts(self.content, self.asset_names if self.images else None)

    @property
    def toc(self) -> DataFrame:
        return products.table_of_contents(self.books, self.chapters)

    @property
    def manifest(self) -> DataFrame:
        return products.manifest(self.books, self.chapters, self.asset_names)

    @property
    def spine(self) -> DataFrame:
        return products.spine(self.books, self.chapters)


def render_texts(content: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Texts as they go into a book: cleaned, images pointing into the book.

    ``names`` (book_id, url, filename) says which images the book has, and under what name.
    Without it every image has the name that its url gives it.
    """
    cleaned = content.select(
        "book_id", "identifier", *[clean_html(F.col(t)).alias(t) for t in diff.TEXTS]
    )
    if names is None:
        return assets.rewrite_with_base_names(cleaned)
    return assets.rewrite_with_names(cleaned, names)


def _latest(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (with url) joined with the last page fetched of each url.

    Which fetch that is, is decided on urls and times alone; only those pages are read and
    moved. Of several at one moment, or without ``fetched_at``, the one with the greatest
    hash is taken. Pages are never broadcast, however small a guess at their size may be: they
    are the left side of joins with narrow tables, and only a right side is; the last join, which
    may become an inner one, is told so.
    """
    found = pages.join(wanted.select("url").distinct(), "url", "left_semi")
    if "fetched_at" in pages.columns:
        last = pin(found.groupBy("url").agg(F.max("fetched_at").alias("_last"))).withColumnRenamed("url", "_url")
        same = (F.col("url") == F.col("_url")) & F.col("fetched_at").eqNullSafe(F.col("_last"))
        found = pages.join(last, same, "left_semi")
    one = found.groupBy("url").agg(F.max_by("html", F.xxhash64("html")).alias("html"))
    # as good as an inner join, since every page left is wanted
    return one.hint("merge").join(wanted, "url", "left").select(*wanted.columns, "html")


def _parse_index_pages(
    crawled: DataFrame, books: DataFrame, profiles: Profiles
) -> tuple[DataFrame, DataFrame]:
    """(parsed index pages of the given books, the books whose page is missing).

    Only the pages of those books are parsed, and each only once.
    """
    wanted = pin(books.select("url", "book_id", "source").distinct())
    parsed = pin(parse_index_pages(_latest(crawled, wanted), profiles.of_pages(INDEX)))
    missing = books.join(parsed.select("book_id").distinct(), "book_id", "left_anti")
    return parsed, missing.select("book_id", F.lit("index page was not fetched").alias("error"))


def _without_profile(books: DataFrame, known: Sequence[str]) -> DataFrame:
    """Errors of books whose source has rules but no profile here."""
    mine = F.col("source").isin(*known, UNSUPPORTED, COMPAT)
    error = F.concat(F.lit("no profile for the source "), F.col("source"))
    return books.where(~mine).select("book_id", error.alias("error"))


def _unreadable(rejects: DataFrame | None, spark) -> DataFrame:
    """Outcomes of files that are no books: unsupported, as those without a url are."""
    none = spark.createDataFrame([], schemas.OUTCOMES)
    if rejects is None:
        return none
    said = rejects.select(stable_id(F.col("path")).alias("book_id"), F.lit("Unsupported").alias("outcome")).distinct()
    return none.unionByName(said, allowMissingColumns=True)


def _tool_outcomes(books: DataFrame, tool_log: DataFrame | None) -> DataFrame:
    """One outcome for each book of the external updater; other runs in its log count for nothing."""
    silent = F.lit("no run of the external updater")
    if tool_log is None:
        return books.select("book_id", F.lit("Error").alias("outcome"), F.lit(None).cast("int").alias("n"), silent.alias("error"))
    said = classify_tool_log(tool_log)
    return books.join(said, "book_id", "left").select(
        "book_id",
        F.coalesce("outcome", F.lit("Error")).alias("outcome"),
        "n",
        F.when(F.col("outcome").isNull(), silent).otherwise(F.col("error")).alias("error"),
    )


def update_books(
    stored: Stored,
    feed_items: DataFrame,
    crawled: Crawled,
    run_ts: datetime,
    refresh: str = diff.COUNT_ONLY,
    rules: Sequence[SourceRule] = ALL_RULES,
    profiles: Sequence[SourceProfile] = (NATIVE,),
    tool_log: DataFrame | None = None,
    images: Images | None = None,
    unreadable: DataFrame | None = None,
) -> Run:
    """Bring every stored book up to date with what is published.

    Books of all sources go through one job, each by the profile of its source.  Pages are
    parsed only for books that the feed says have moved on, and chapter pages only for
    chapters whose text is wanted.  ``crawled`` may have several pages of a url, with the
    time of each fetch.

    Every stored book gets one outcome.  Those of the external updater come from its log,
    where each run_id is a book_id; without a run in the log such a book is an error, and so
    is one of a source that neither a profile nor the updater takes care of, unless its feed
    says it is up to date.  A book without a url is unsupported, and so is each file of
    ``unreadable`` (path, ...: the rejects of reading archives), under an id made of its path.
    """
    spark = stored.books.sparkSession
    tables, names = profile_tables(spark, profiles), [p.name for p in profiles]
    every = route_sources(stored.books, rules)
    routed = every.where(F.col("source") != COMPAT)
    gates = pin(
        diff.gate_up_to_date(
            diff.library_high_water(stored.chapters) if stored.high_water is None else stored.high_water,
            diff.feed_high_water(feed_items),
        )
    )
    behind = routed.where(F.col("source").isin(names)).join(
        gates.where(~F.col("up_to_date")).select("book_id"), "book_id", "left_semi"
    )
    parsed, missing = _parse_index_pages(crawled.index_pages, behind, tables)
    fiction = split_parsed(parsed, run_ts)
    classified = pin(diff.classify_chapters(fiction.chapters, stored.chapters))
    outcomes = diff.update_outcome(
        routed,
        gates,
        diff.change_count(classified),
        fiction.rejects.select("book_id", "error")
        .unionByName(missing)
        .unionByName(_without_profile(routed, names)),
    )
    native = pin(outcomes)
    outcomes = native.unionByName(
        _tool_outcomes(every.where(F.col("source") == COMPAT).select("book_id"), tool_log)
    ).unionByName(_unreadable(unreadable, spark))
    # the external updater writes its books itself
    updated = native.where(F.col("outcome") == "Updated").select("book_id")

    def of_updated(df):
        return df.join(updated, "book_id", "left_semi")

    moved = of_updated(classified.where(F.col("change") != "kept"))
    to_fetch, stored_chapters = moved, of_updated(stored.chapters)
    if refresh == diff.COUNT_ONLY:
        to_fetch = moved.join(
            diff.drop_contentless(stored.content).select(*diff.KEY), diff.KEY, "left_anti"
        )
    else:
        stored_chapters = diff.take_newer_headers(stored_chapters, moved)
    return Run(
        outcomes,
        diff.refresh_cover(
            of_updated(routed.select(*stored.books.columns)), fiction.books
        ),
        stored_chapters,
        moved.where(F.col("change") == "new"),
        to_fetch,
        crawled.chapter_pages,
        of_updated(stored.content),
        routed.select("book_id", "source"),
        tables,
        refresh,
        images,
    )


def create_books(
    urls: DataFrame,
    crawled: Crawled,
    run_ts: datetime,
    rules: Sequence[SourceRule] = ALL_RULES,
    profiles: Sequence[SourceProfile] = (NATIVE,),
    images: Images | None = None,
) -> Run:
    """Make books for urls that are not stored: every published chapter is new.

    Each distinct url gets one outcome, and those that fail do not stop the others; urls that
    only the external updater can read are errors.  The id of a book of the native site is in
    its url; other books have one made of theirs.  A second url of one book is skipped, under
    an id of its own.  ``urls`` may bring the book_id to keep.
    """
    spark = urls.sparkSession
    tables, names = profile_tables(spark, profiles), [p.name for p in profiles]
    url = F.col("url")
    of_url = F.when(F.col("source") == NATIVE.name, url_segment(url, 1, stable_id(url))).otherwise(stable_id(url))
    if "book_id" in urls.columns:
        every = route_sources(urls.select("url", "book_id").distinct(), rules)
    else:
        every = route_sources(urls.select("url").distinct(), rules).withColumn("book_id", of_url)
    every = pin(every)
    # urls of one book are few, and number themselves apart from others
    place = F.row_number().over(Window.partitionBy("book_id").orderBy("source", "url"))
    placed = pin(every.withColumn("_place", place))
    asked = placed.where("_place = 1").drop("_place")
    twice = placed.where("_place > 1").select(
        stable_id(F.concat_ws(" ", "book_id", "url")).alias("book_id"),
        F.lit("Skipped").alias("outcome"),
        F.lit(None).cast("int").alias("n"),
        F.concat(F.lit("another url of the book "), "book_id", F.lit(": "), "url").alias("error"),
    )
    left_out = asked.where(F.col("source") == COMPAT).select("book_id")
    asked = asked.where(F.col("source") != COMPAT)
    behind = asked.where(F.col("source").isin(names))
    parsed, missing = _parse_index_pages(crawled.index_pages, behind, tables)
    fiction = split_parsed(parsed, run_ts)
    everything_new = fiction.chapters.withColumn("change", F.lit("new"))
    outcomes = pin(
        diff.update_outcome(
            asked,
            asked.select("book_id", F.lit(False).alias("up_to_date")),
            diff.change_count(everything_new),
            fiction.rejects.select("book_id", "error")
            .unionByName(missing)
            .unionByName(_without_profile(asked, names)),
        )
        .unionByName(_tool_outcomes(left_out, None))
        .unionByName(twice)
    )
    good = outcomes.where(F.col("outcome").isin("Updated", "UpToDate")).select("book_id")
    new = fiction.chapters.join(good, "book_id", "left_semi")
    return Run(
        outcomes,
        fiction.books.join(good, "book_id", "left_semi"),
        spark.createDataFrame([], schemas.CHAPTERS),
        new,
        new,
        crawled.chapter_pages,
        spark.createDataFrame([], schemas.CHAPTER_CONTENT),
        asked.select("book_id", "source"),
        tables,
        images=images,
    )


def stash_and_recreate(
    files: DataFrame, crawled: Crawled, stash_ts: datetime
) -> tuple[DataFrame, Run]:
    """(what is stashed under which name, the run that makes those books anew).

    ``files`` has book_id, path and url.  A book made anew keeps its book_id, by
    which the stash names its path, so two files with one url stay two books.
    """
    stashed = stash_books(files, stash_ts)
    again = stashed.where("recreate").select("book_id", "url")
    return stashed, create_books(again, crawled, stash_ts)
