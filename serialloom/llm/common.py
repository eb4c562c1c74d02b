"""What several of the operators share: reading tables, row ids, Arrow helpers, words."""

import ctypes
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.pin import pin

#: Bytes of ASCII white space, as the contracts write it: ``[\x20\x09-\x0D]``.
SPACES = r"[\x20\x09-\x0D]+"

#: Up to so many row ids (8 bytes each) are broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 2_000_000

#: A worker keeps at most so many words with what it knows of them, then starts anew.
CACHED_WORDS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Number the rows, written once: a later scan with other splits would number them anew."""
    return pin(df.withColumn(name, F.monotonically_increasing_id()))


def numbered_rows(docs: DataFrame, text: str, row_id: str | None) -> DataFrame:
    """row_id, doc_id and text: numbered here, and written, unless ``row_id`` names a column
    of ``docs`` that numbers its rows. A column that merely has that name is like any other."""
    body = F.col(text).cast("string").alias("text")
    if row_id is None:
        return with_row_id(docs.select("doc_id", body))
    return docs.select(F.col(row_id).alias("row_id"), "doc_id", body)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with more underscores if the table has such a column."""
    while name in df.columns:
        name += "_"
    return name


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Tasks get Arrow batches of at most so many rows in what runs inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def trimmed(run):
    """A function over batches that, when it is done, gives back what it has freed.

    A worker outlives its tasks and takes those of later stages; what it keeps of a task's
    memory is added to what these need.
    """

    def runs(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return runs


def pick_rows(docs: DataFrame, ids: DataFrame, how: str, key: str = "row_id") -> DataFrame:
    """``docs`` with (left_semi) or without (left_anti) these rows; ``ids`` is a written table."""
    small = ids.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if small else ids, key, how)


def remainder(doc_id, modulus: int):
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


#: Slices for work that gives back as much as it gets, and is done text by text.
SMALL = 1 << 20


def by_size(batches, column: str = "text", most: int = 8 << 20):
    """The batches in slices of at most so many bytes of text, or of one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, end - start)
            start = end


def words(text: bytes) -> list[bytes]:
    """``[^\x20\x09-\x0D]+`` of the text with A-Z lower-cased; both are what bytes do."""
    return text.lower().split()


class Known(dict):
    """Words with what ``make`` says of them, forgotten all at once when too many."""

    def __init__(self, make, most: int = CACHED_WORDS):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        made = self[word] = self.make(word)
        return made


def sorted_groups(batches, keys: list[str]):
    """Tables of the rows that agree in ``keys``, from batches sorted by them.

    Only one group and one batch are held at a time.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows])
        starts = np.zeros(rows.num_rows, bool)
        starts[0] = True
        for key in keys:
            values = rows.column(key).to_numpy()
            starts[1:] |= values[1:] != values[:-1]
        at = np.flatnonzero(starts)
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield rows.slice(a, b - a)
        held = rows.slice(at[-1])
    if held is not None:
        yield held
