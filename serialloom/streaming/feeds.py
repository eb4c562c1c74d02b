"""Watch feeds: say which books have something new, as items arrive."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..sinks.versions import BUCKETS, Versions

NEWS = StructType([StructField("book_id", StringType()), StructField("newest_us", LongType())])
#: What is known is written together anew after so many batches with news.
TIDY_BATCHES = 50


class FeedWatch:
    """The newest date that was said of each book, kept as a table.

    Every batch of items is reduced to one row per book, compared with the table, and what is
    newer becomes its next version, under the batch's number. A batch that is run again after
    a failure says what it said the first time, and changes nothing.
    """

    def __init__(self, spark: SparkSession, base: str, buckets: int = BUCKETS, name: str = "watch"):
        self.kept, self.name = Versions(spark, base, {"newest": NEWS}, buckets=buckets), name

    def newest(self) -> DataFrame:
        return self.kept.read("newest")

    def news(self, items: DataFrame, batch_id: int) -> DataFrame:
        """(book_id, newest_us) of the books that a batch of (book_id, published) has news of.

        Dates may come in any order; only the newest counts, so nothing is ever too late.
        """
        run = f"{self.name}-{batch_id}"
        version = self.kept.version_of(run)
        if version is None:
            said = items.where(F.col("published").isNotNull()).groupBy("book_id")
            latest = said.agg(F.max(F.unix_micros(F.col("published").cast("timestamp"))).alias("newest_us"))
            before = self.newest().select("book_id", F.col("newest_us").alias("_before"))
            newer = F.coalesce(F.col("newest_us") > F.col("_before"), F.lit(True))
            found = latest.join(before, "book_id", "left").where(newer).select("book_id", "newest_us")
            version = self.kept.publish_replacing("newest", found, run)
            if version % TIDY_BATCHES == 0:
                self.kept.compact(f"{run}-tidy")
        return self.kept.brought("newest", version)


def watch_feeds(items: DataFrame, watch: FeedWatch, say: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A stream of (book_id, published) that calls ``say(news, batch_id)`` for each batch.

    ``say`` may be called again with a batch that it has seen, with the same rows: write them
    under the batch's number.
    """
    return items.writeStream.foreachBatch(lambda rows, batch: say(watch.news(rows, batch), batch))
