"""Writing the library's tables as Parquet, bucketed by book."""

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

BUCKETS = 256


def with_bucket(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("book_id"), F.lit(buckets)).cast("int"))


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table of the library; empty when it has not been written yet."""
    try:
        return spark.read.schema(schema).parquet(path).select(*schema.names)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _write(df: DataFrame, path: str, mode: str, partition: str) -> None:
    # REBALANCE puts each partition's rows together for few files, and lets
    # adaptive execution split a partition that is too large for one task.
    (
        df.hint("rebalance", partition)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )


def publish_library(
    updated: DataFrame, base: str, staging: str, buckets: int = BUCKETS
) -> None:
    """Replace all rows of the books in ``updated``; other books stay.

    The affected buckets are written in full to ``staging`` (a new path on the
    same file system), then put in place by a dynamic partition overwrite, which
    itself moves finished files only when the whole job is done.  Untouched
    buckets are neither read nor written.
    """
    spark = updated.sparkSession
    rows = with_bucket(updated, buckets)
    now = read_table(spark, base, rows.schema)
    # At most ``buckets`` rows, so the broadcast is bounded; it prunes partitions.
    affected = F.broadcast(rows.select("bucket").distinct())
    others = now.join(affected, "bucket", "left_semi").join(
        rows.select("book_id").distinct(), "book_id", "left_anti"
    )
    _write(others.unionByName(rows), staging, "overwrite", "bucket")
    _write(spark.read.schema(rows.schema).parquet(staging), base, "overwrite", "bucket")


def append_ignore_rules(additions: DataFrame, path: str, line_no: int) -> None:
    """Add plain file names to the ignore lists of their directories.

    All lines of one run share a line number: the order of plain names does not
    matter.
    """
    additions.select("dir", F.lit(line_no).cast("long").alias("line_no"), "pattern").write.mode(
        "append"
    ).parquet(path)


def write_stash(
    stashed: DataFrame, tables: Sequence[DataFrame], path: str, names: Sequence[str], stamp: str
) -> None:
    """Keep the rows of stashed books under ``path/{table}/stash={stamp}``."""
    kept = stashed.where("recreate").select("book_id", "stash_name")
    for name, table in zip(names, tables):
        (
            table.join(kept, "book_id")
            .write.mode("overwrite")
            .parquet(f"{path}/{name}/stash={stamp}")
        )
