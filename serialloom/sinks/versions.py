"""Tables that change together, kept as versions.

A run writes the rows of the keys it replaces, each once, beside what is there; nothing that
a reader may be using is touched. One small file, the commit, then names the new version and
the pieces (bucket of a version) that make it up. Readers resolve the newest commit, so they
see all tables of a run or none, and older versions stay readable. Compaction writes the
buckets that runs have added to anew, as one piece each, and is itself a version.

::

    base/commits/version=3/part-….parquet        the pieces of version 3
    base/{table}/version=3/bucket=17/….parquet   the rows that version 3 brought
    base/replaced/version=3/bucket=17/….parquet  the keys whose earlier rows they replace

One writer at a time; a writer that fails leaves files that no commit names, and its
successor overwrites them.
"""

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BUCKETS = 256
REPLACED = "replaced"
_COMMIT = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("bucket", T.IntegerType()),  # NULL: the commit itself
        T.StructField("piece", T.LongType()),  # the version that wrote it
        T.StructField("replaces", T.BooleanType()),  # hides earlier rows of its keys
    ]
)


class Piece(NamedTuple):
    bucket: int
    version: int
    replaces: bool


def _missing(problem: AnalysisException) -> bool:
    return problem.getCondition() == "PATH_NOT_FOUND"


class Versions:
    """Tables under ``base``, each with the ``key`` columns that decide the bucket."""

    def __init__(
        self,
        spark: SparkSession,
        base: str,
        tables: Mapping[str, T.StructType],
        key: Sequence[str] = ("book_id",),
        buckets: int = BUCKETS,
    ):
        self.spark, self.base, self.buckets = spark, base.rstrip("/"), buckets
        self.tables, self.key = dict(tables), list(key)

    # --- commits -------------------------------------------------------------

    def _commits(self) -> DataFrame | None:
        # versions are the folders' names; nothing else is known of a commit without a file
        schema = T.StructType([*_COMMIT.fields, T.StructField("version", T.LongType())])
        try:
            return self.spark.read.schema(schema).parquet(f"{self.base}/commits")
        except AnalysisException as problem:
            if not _missing(problem):
                raise
            return None

    def newest(self) -> int:
        """The newest committed version; 0 before the first."""
        commits = self._commits()
        found = None if commits is None else commits.agg(F.max("version")).first()[0]
        return found or 0

    def version_of(self, run_id: str) -> int | None:
        """The version that this run has committed."""
        commits = self._commits()
        if commits is None:
            return None
        return commits.where(F.col("run_id") == run_id).agg(F.min("version")).first()[0]

    def pieces(self, version: int | None = None) -> list[Piece]:
        """What a version is made of: at most ``buckets`` pieces, and one more per bucket for
        each run since the last compaction."""
        version = self.newest() if version is None else version
        if version == 0:
            return []
        commits = self._commits()
        rows = [] if commits is None else (
            commits.where(F.col("version") == version).select("bucket", "piece", "replaces").collect()
        )
        if not rows:
            raise ValueError(f"{self.base} has no version {version}")
        return sorted(Piece(*r) for r in rows if r.bucket is not None)

    def _commit(self, version: int, run_id: str, pieces: Sequence[Piece]) -> int:
        rows = [(run_id, None, None, None), *((run_id, *p) for p in pieces)]
        # one task, one file: the commit is there whole or not at all
        self.spark.createDataFrame(rows, _COMMIT).coalesce(1).write.mode("overwrite").parquet(
            f"{self.base}/commits/version={version}"
        )
        return version

    # --- writing -------------------------------------------------------------

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _write(self, name: str, rows: DataFrame, version: int) -> None:
        # REBALANCE gathers a bucket's rows in few files and splits a large one
        rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy(
            "bucket"
        ).parquet(f"{self.base}/{name}/version={version}")

    def _written(self, name: str, version: int, columns: Sequence[str]) -> DataFrame:
        fields = [*self._schema(name).fields, T.StructField("bucket", T.IntegerType())]
        return (
            self.spark.read.schema(T.StructType(fields))
            .parquet(f"{self.base}/{name}/version={version}")
            .select(*columns)
        )

    def _schema(self, name: str) -> T.StructType:
        if name == REPLACED:
            some = next(iter(self.tables.values()))
            return T.StructType([some[c] for c in self.key])
        return self.tables[name]

    def publish(self, rows: Mapping[str, DataFrame], run_id: str, replaced: DataFrame | None = None) -> int:
        """Commit ``rows`` (by table) as the next version, and return its number.

        ``replaced`` has the keys whose earlier rows go, in every table; rows of other keys
        are refused. Without it, rows are added to what is there. A run that has been
        committed is not written again.
        """
        done = self.version_of(run_id)
        if done is not None:
            return done
        if unknown := set(rows) - set(self.tables):
            raise ValueError(f"no such table: {', '.join(sorted(unknown))}")
        version = self.newest() + 1
        for name, given in rows.items():
            self._write(name, given.select(*self._schema(name).names), version)
        return self._committed(version, run_id, set(rows), replaced)

    def _committed(self, version: int, run_id: str, written: set[str], replaced: DataFrame | None) -> int:
        before = self.pieces(version - 1)
        for name in set(self.tables) - written:
            self._write(name, self.spark.createDataFrame([], self.tables[name]), version)
        if replaced is None:
            touched = [self._written(name, version, ["bucket"]) for name in written]
        else:
            self._write(REPLACED, replaced.select(*self.key).distinct(), version)
            if strange := self._strange(version, sorted(written)):
                raise ValueError(f"rows of {strange[0]} whose key is not replaced")
            touched = [self._written(REPLACED, version, ["bucket"])]
        buckets = sorted({r.bucket for t in touched for r in t.distinct().collect()})
        new = [Piece(b, version, replaced is not None) for b in buckets]
        return self._commit(version, run_id, [*before, *new])

    def _strange(self, version: int, names: Sequence[str]) -> list[str]:
        """Those of the tables that have rows in this version whose key it does not replace.

        The keys of all tables are gathered at once, added up before they move.
        """
        every = self._written(REPLACED, version, self.key).withColumn("_tables", F.lit(0))
        for i, name in enumerate(names):
            every = every.unionByName(self._written(name, version, self.key).withColumn("_tables", F.lit(1 << i)))
        met = every.groupBy(*self.key).agg(F.bit_or("_tables").alias("_tables"), F.min("_tables").alias("_least"))
        # a null key replaces nothing
        alone = (F.col("_least") > 0) | ((F.col("_tables") > 0) & F.greatest(*[F.col(c).isNull() for c in self.key], F.lit(False)))
        found = met.where(alone).agg(F.bit_or("_tables")).first()[0] or 0
        return [name for i, name in enumerate(names) if found >> i & 1]

    def publish_replacing(self, name: str, rows: DataFrame, run_id: str) -> int:
        """Commit ``rows`` of one table, replacing whatever their own keys had."""
        done = self.version_of(run_id)
        if done is not None:
            return done
        # written first: the keys that are replaced are read from what was written
        version = self.newest() + 1
        self._write(name, rows.select(*self._schema(name).names), version)
        keys = self._written(name, version, self.key).distinct()
        return self._committed(version, run_id, {name}, keys)

    def compact(self, run_id: str, least: int = 2) -> int:
        """Write each bucket of at least ``least`` pieces as one; other buckets stay as they are."""
        done = self.version_of(run_id)
        if done is not None:
            return done
        version = self.newest() + 1
        pieces = self.pieces(version - 1)
        held = [p.bucket for p in pieces]
        many = sorted({b for b in held if held.count(b) >= least})
        if not many:
            return version - 1
        for name in self.tables:
            mine = self.rows_of(name, [p for p in pieces if p.bucket in set(many)])
            self._write(name, mine, version)
        kept = [p for p in pieces if p.bucket not in set(many)]
        return self._commit(version, run_id, [*kept, *(Piece(b, version, False) for b in many)])

    # --- reading -------------------------------------------------------------

    def _scan(self, name: str, pieces: Sequence[Piece]) -> DataFrame:
        """All rows of these pieces, with their version and bucket."""
        schema = self._schema(name)
        fields = [*schema.fields, T.StructField("version", T.LongType()), T.StructField("bucket", T.IntegerType())]
        by_version: dict[int, list[int]] = {}
        for p in pieces:
            by_version.setdefault(p.version, []).append(p.bucket)
        if not by_version:
            return self.spark.createDataFrame([], T.StructType(fields))
        read = (
            self.spark.read.schema(T.StructType(fields))
            .option("basePath", f"{self.base}/{name}")
            .parquet(*[f"{self.base}/{name}/version={v}" for v in sorted(by_version)])
        )
        live = F.lit(False)
        for v, buckets in sorted(by_version.items()):
            live |= (F.col("version") == v) & F.col("bucket").isin(buckets)
        return read.where(live)

    def rows_of(self, name: str, pieces: Sequence[Piece]) -> DataFrame:
        """The rows of a table in these pieces that no later one of them replaces."""
        columns = self.tables[name].names
        newest: dict[int, int] = {}  # of each bucket, the last piece that replaces
        for p in pieces:
            if p.replaces:
                newest[p.bucket] = max(p.version, newest.get(p.bucket, 0))
        older = [p for p in pieces if p.version < newest.get(p.bucket, 0)]
        mixed = {p.bucket for p in older}
        plain = self._scan(name, [p for p in pieces if p not in set(older)]).select(*columns)
        if not mixed:
            return plain
        rows = self._scan(name, older)
        last = (
            self._scan(REPLACED, [p for p in pieces if p.replaces and p.bucket in mixed])
            .groupBy(*self.key)
            .agg(F.max("version").alias("_last"))
        )
        # a key's rows are those of its last replacement, and what was added after it
        seen = rows.join(last, self.key, "left").where(F.coalesce(F.col("version") >= F.col("_last"), F.lit(True)))
        return plain.unionByName(seen.select(*columns))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version, the newest unless given.

        Pieces that no later one of their bucket replaces rows of are read as they are; the rows
        of older pieces meet the replaced keys, which are narrow.
        """
        return self.rows_of(name, self.pieces(version))

    def brought(self, name: str, version: int) -> DataFrame:
        """The rows that one version wrote, whatever came after it."""
        return self._written(name, version, self.tables[name].names)

    def unused(self, keep: int = 1) -> DataFrame:
        """(path) of the pieces that the newest ``keep`` versions don't need.

        Removing them, and the commits of the versions before, is up to the caller.
        """
        commits = self._commits()
        if commits is None:
            return self.spark.createDataFrame([], "path string")
        pieces = commits.where(F.col("bucket").isNotNull()).select("version", "piece", "bucket")
        needed = pieces.where(F.col("version") > self.newest() - keep).select("piece", "bucket").distinct()
        gone = pieces.select("piece", "bucket").distinct().join(needed, ["piece", "bucket"], "left_anti")
        name = F.explode(F.array(*[F.lit(n) for n in (*self.tables, REPLACED)]))
        where = F.format_string(f"{self.base}/%s/version=%d/bucket=%d", F.col("name"), F.col("piece"), F.col("bucket"))
        return gone.withColumn("name", name).select(where.alias("path"))
