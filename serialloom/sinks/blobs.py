"""Bytes by key, of which a job reads only those that it asks for.

Keys are decided on alone: looking one up reads no bytes. Bytes are then read by a scan of
the buckets that have wanted keys, against which the wanted keys are broadcast in parts of a
bounded size; so bytes stay where they are read, and those nobody asked for go nowhere. All
parts are in the driver's memory at once, so there is a bound on their number too: more keys
than that are sorted and merged with the rows of their buckets.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..plans.pin import pin
from .versions import BUCKETS, Versions

#: Wanted keys are broadcast in parts of about so many bytes.
PART_BYTES = 32 << 20
#: At most so many parts are broadcast; for more, both sides are shuffled.
MOST_PARTS = 8
#: What a key's row takes in a broadcast beside its text.
_ROW_BYTES = 64
_TABLE = "blobs"


class Blobs:
    """A table of ``key`` columns (strings) and ``bytes``, one row per key."""

    def __init__(
        self, spark: SparkSession, base: str, key: Sequence[str] = ("book_id", "filename"), buckets: int = BUCKETS
    ):
        self.key = list(key)
        fields = [T.StructField(c, T.StringType()) for c in self.key]
        schema = T.StructType([*fields, T.StructField("bytes", T.BinaryType())])
        self.versions = Versions(spark, base, {_TABLE: schema}, self.key, buckets)

    def table(self) -> DataFrame:
        return self.versions.read(_TABLE)

    def keys(self) -> DataFrame:
        """Every key that is held; no bytes are read."""
        return self.table().select(*self.key)

    def add(self, rows: DataFrame, run_id: str) -> int:
        """Add rows whose keys are not held yet; a run that is repeated adds nothing."""
        return self.versions.publish({_TABLE: rows}, run_id)

    def missing(self, wanted: DataFrame) -> DataFrame:
        """Rows of ``wanted`` whose key is not held; no bytes move."""
        return wanted.join(self.keys(), self.key, "left_anti")

    def with_bytes(
        self,
        wanted: DataFrame,
        part_bytes: int = PART_BYTES,
        most_parts: int = MOST_PARTS,
        value: Column | None = None,
    ) -> DataFrame:
        """Rows of ``wanted`` (a key may repeat) whose key is held, with ``bytes``.

        Each broadcast holds a part of the keys, by their hash, and each part reads its own
        buckets. A part is a whole number of buckets, or a bucket is read by several parts.
        Of more than ``most_parts`` parts none is broadcast. Neither bound changes the result.
        ``value``, a column made of ``bytes``, takes their place; it is all that moves then.
        """
        value = F.col("bytes") if value is None else value
        buckets = self.versions.buckets
        wanted = pin(wanted.withColumn("_hash", F.xxhash64(*self.key)))
        columns = [c for c in wanted.columns if c != "_hash"]
        texts = [F.octet_length(c) for c in columns if dict(wanted.dtypes)[c] == "string"]
        size = sum([F.coalesce(t, F.lit(0)) for t in texts], F.lit(_ROW_BYTES + 8 * len(wanted.columns)))
        spread = wanted.groupBy(F.pmod("_hash", F.lit(buckets)).cast("int").alias("bucket")).agg(
            F.sum(size.cast("long")).alias("bytes")
        )
        by_bucket = {r.bucket: r.bytes for r in spread.collect()}  # a row per bucket
        parts, held, total = [], [], 0
        for bucket in sorted(by_bucket):
            here = by_bucket[bucket]
            if held and total + here > part_bytes:
                parts.append((held, 0, 1))
                held, total = [], 0
            slices = -(-here // part_bytes)
            if slices > 1:
                parts += [([bucket], i, slices) for i in range(slices)]
            else:
                held, total = [*held, bucket], total + here
        if held or not parts:
            parts.append((held, 0, 1))

        pieces = self.versions.pieces()

        def rows(mine):
            found = self.versions.rows_of(_TABLE, [p for p in pieces if p.bucket in mine])
            return found.select(*self.key, value.alias("bytes"))

        if len(parts) > most_parts:
            met = rows(set(by_bucket)).hint("merge").join(wanted.drop("_hash"), self.key)
            return met.select(*columns, "bytes")
        found = None
        for mine, i, slices in parts:
            keys = wanted.where(F.pmod("_hash", F.lit(buckets)).isin(mine))
            if slices > 1:
                keys = keys.where(F.pmod(F.shiftright("_hash", 32), F.lit(slices)) == i)
            met = rows(set(mine)).join(F.broadcast(keys.drop("_hash")), self.key).select(*columns, "bytes")
            found = met if found is None else found.unionByName(met)
        return found
