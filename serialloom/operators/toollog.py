"""Outcome of an external updater's runs, read from its log lines."""

from pyspark.sql import DataFrame, functions as F

# The lines of the external updater that mean something.
PROGRESS_LINE = r"^Updating .*, URL: .*$"
UP_TO_DATE_LINE = r"^.* already contains \d+ chapters\.$"
UPDATE_LINE = r"^Do update - epub\((\d+)\) vs url\((\d+)\)$"
AHEAD_LINE = r"^.* contains (\d+) chapters, more than source: (\d+)\.$"
SKIP_ENDING = " - Skipping"

_LARGEST = 65_535


def classify_tool_log(lines: DataFrame) -> DataFrame:
    """(book_id, outcome, n, error) per run_id.

    Error lines come before output lines.  The first line that matches decides;
    a line whose numbers are out of range is passed over.  A run without any
    matching line is an error.
    """
    line = F.col("line")

    def number(pattern, i):
        value = F.regexp_extract(line, pattern, i).try_cast("long")
        return F.when(value.between(0, _LARGEST), value)

    stored, published = number(UPDATE_LINE, 1), number(UPDATE_LINE, 2)
    here, source = number(AHEAD_LINE, 1), number(AHEAD_LINE, 2)

    def verdict(outcome, n):
        return F.struct(F.lit(outcome).alias("outcome"), n.cast("int").alias("n"))

    silent = F.lit(None)
    found = F.when(
        ~line.rlike(PROGRESS_LINE),
        F.when(line.rlike(UP_TO_DATE_LINE), verdict("UpToDate", silent))
        .when(
            line.rlike(UPDATE_LINE),
            F.when(stored.isNotNull() & published.isNotNull(), verdict("Updated", published - stored)),
        )
        .when(
            line.rlike(AHEAD_LINE),
            F.when(
                here.isNotNull() & source.isNotNull(),
                verdict("MoreChapterThanSource", here - source),
            ),
        )
        .when(F.endswith(line, F.lit(SKIP_ENDING)), verdict("Skipped", silent)),
    )
    rank = F.struct(F.when(F.col("stream") == "stderr", 0).otherwise(1), F.col("line_no"))
    first = (
        lines.select("run_id", found.alias("_found"), rank.alias("_rank"))
        .groupBy("run_id")
        .agg(
            F.min_by("_found", F.when(F.col("_found").isNotNull(), F.col("_rank"))).alias("_first")
        )
    )
    return first.select(
        F.col("run_id").alias("book_id"),
        F.coalesce("_first.outcome", F.lit("Error")).alias("outcome"),
        F.col("_first.n").alias("n"),
        F.when(F.col("_first").isNull(), F.lit("no known line in the tool's output")).alias("error"),
    )
