"""Book files of a library."""

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ignore import apply_ignore_rules

BOOK_EXTENSION = "epub"


def list_files(
    spark: SparkSession, roots: Sequence[str], extension: str = BOOK_EXTENSION
) -> DataFrame:
    """(path, modified, length) of every file below the roots with that extension.

    Only the listing is read: ``path`` is without the scheme, and no file is
    opened.  Hidden files are left out.
    """
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*.{extension}")
        .option("recursiveFileLookup", "true")
        .load(list(roots))
    )
    return listed.select(
        F.regexp_replace("path", r"^[a-z][a-z0-9]*:(?://[^/]*)?", "").alias("path"),
        F.col("modificationTime").alias("modified"),
        "length",
    )


def book_files(
    paths: DataFrame, extension: str = BOOK_EXTENSION, roots: Sequence[str] = ()
) -> DataFrame:
    """Paths of visible book files in a listing made elsewhere.

    Only what lies below the listed root can hide a file; a root may be hidden itself.
    """
    path = F.col("path")
    below = path
    # longer roots first: one may lie below another
    for root in sorted({_plain(r) for r in roots}, key=len):
        below = F.when(F.startswith(path, F.lit(root)), F.substring(path, len(root), 2**31 - 1)).otherwise(below)
    hidden = below.rlike(r"(^|/)\.[^/.]")
    return paths.where(F.endswith(path, F.lit(f".{extension}")) & ~hidden)


def _plain(root: str) -> str:
    """A root as listed paths start: without the scheme, with a slash at its end."""
    return re.sub(r"^[a-z][a-z0-9]*:(?://[^/]*)?", "", root).rstrip("/") + "/"


def scan_library(
    spark: SparkSession,
    roots: Sequence[str],
    ignore_rules: DataFrame,
    extension: str = BOOK_EXTENSION,
) -> DataFrame:
    """Book files below the roots that no ignore rule hides."""
    listed = book_files(list_files(spark, roots, extension), extension, roots)
    return apply_ignore_rules(listed, ignore_rules)


def read_ignore_files(spark: SparkSession, roots: Sequence[str], name: str) -> DataFrame:
    """Ignore lists kept as files beside the books, as (dir, line_no, pattern).

    Spark lists no file whose name starts with '.' or '_'; lists under such names
    have to be loaded into the ignore_rules table another way.
    """
    lists = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", name)
        .option("recursiveFileLookup", "true")
        .load(list(roots))
    )
    path = F.regexp_replace("path", r"^[a-z][a-z0-9]*:(?://[^/]*)?", "")
    lines = F.split(F.col("content").cast("string"), r"\r?\n")
    return lists.select(
        F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("dir"),
        F.posexplode(lines).alias("_at", "pattern"),
    ).select("dir", F.col("_at").cast("long").alias("line_no"), "pattern")
