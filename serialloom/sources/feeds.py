"""Feed documents of books."""

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import rfc2822
from ..functions.html import first_text


def ingest_feeds(pages: DataFrame) -> DataFrame:
    """(book_id, feed_title, published): a row per date, none for an unreadable date.

    ``pages`` has book_id and html, the feed document.  The title is the first
    one in the document; dates are taken wherever they stand, so a document that
    is not well-formed still counts.
    """
    dates = F.regexp_extract_all(
        "html", F.lit(r"(?is)<pubDate(?:\s[^>]*)?>(.*?)</pubDate\s*>"), F.lit(1)
    )
    # Dates are read inside the list: a filter on a column made here would be pushed
    # down and make every date be read twice.
    read = F.filter(F.transform(dates, rfc2822), lambda d: d.isNotNull())
    return pages.select(
        "book_id",
        first_text(F.col("html"), "title").alias("feed_title"),
        F.explode(read).alias("published"),
    ).where(F.col("feed_title").isNotNull())
