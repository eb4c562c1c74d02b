"""Best-two-fit packing of token pieces into sequences of a fixed capacity.

A sequence is filled greedily, the largest piece that fits first. While a gap stays, its
smallest piece is taken out again if two unpacked pieces fill the widened gap more
tightly. All that matters to this is how many pieces there are of each length, so the
packing runs on those counts, one number per length up to the capacity: as long as the
counts allow, the next sequence has the pattern of the last one, and all these are made at
once. The pieces then look up their places: a piece is the k-th of its length, and the
plan says where the k-th of that length goes.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.pin import pin
from .common import SMALL, by_size, trimmed
from .tokens import default_path, encoder

CAPACITY, END_ID = 1024, 2


def _cut(path: str, end_id: int, capacity: int):
    def run(batches):
        enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in by_size(batches, most=SMALL):
            row, piece, start, length, local, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                whole = enc.encode(text or "") + end
                n = len(whole) // 4
                at, size = 0, (n - 1) % capacity + 1
                for k in range((n - 1) // capacity + 1):
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    local.append(seen[size])
                    seen[size] += 1
                    ids.append(whole[4 * at : 4 * (at + size)])
                    at, size = at + size, capacity
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array([task] * len(row), pa.int32()),
                    pa.array(local, pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                ["doc_id", "piece", "start", "length", "task", "local", "ids"],
            )

    return run


def token_pieces(
    docs: DataFrame, text: str = "text", tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY
) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids, and task and local for ``pack``.

    A document is its ids and ``end_id``; null and empty texts are the end alone. Longer
    ones than ``capacity`` are cut into pieces of that size, the first one may be shorter.
    ids are little-endian unsigned 32-bit integers. Repeated rows give pieces of their own.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).cast("string").alias("text")).mapInArrow(
        trimmed(_cut(tokenizer or default_path(), end_id, capacity)),
        f"doc_id {kind}, piece int, start long, length long, task int, local long, ids binary",
    )


def plan(counts: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """Where pieces go, from their number by length (counts[0] is not used).

    Rows (length, first, last, sequence, each, offset): of that length, the pieces first to
    last - 1 go to the sequences from ``sequence`` on, ``each`` to a sequence, side by side
    from ``offset``.
    """
    capacity = len(counts) - 1
    left, taken = counts.astype(np.int64), np.zeros(capacity + 1, np.int64)
    lengths = np.arange(capacity + 1)
    rows, sequence = [], 0
    while left[1:].any():
        free, used = left.copy(), {}
        peak: dict[int, int] = {}

        def take(size: int, times: int):
            free[size] -= times
            used[size] = used.get(size, 0) + times
            peak[size] = max(peak.get(size, 0), used[size])

        gap = capacity
        while gap and (fits := np.flatnonzero(free[1 : gap + 1])).size:
            size = int(fits[-1]) + 1
            times = int(min(free[size], gap // size))
            take(size, times)
            gap -= times * size
        while gap:
            small = min(used)
            pair = _tightest(free, lengths, gap + small)
            if pair is None or sum(pair) <= small:
                break
            take(small, -1)
            if not used[small]:
                del used[small]
            for size in pair:
                take(size, 1)
            gap += small - sum(pair)
        times = min((int(left[s]) - peak[s]) // n + 1 for s, n in used.items())
        offset = 0
        for size, n in sorted(used.items(), reverse=True):
            rows.append((size, int(taken[size]), int(taken[size]) + n * times, sequence, n, offset))
            taken[size] += n * times
            left[size] -= n * times
            offset += n * size
        sequence += times
    return rows


def _tightest(free: np.ndarray, lengths: np.ndarray, room: int) -> tuple[int, int] | None:
    """Two unpacked lengths with the largest sum up to ``room``."""
    top = min(room, len(free) - 1)
    below = np.maximum.accumulate(np.where(free[: top + 1] > 0, lengths[: top + 1], 0))
    a = np.flatnonzero(free[: top + 1])
    a = a[(a > 0) & (a < room)]
    if not len(a):
        return None
    b = below[np.minimum(a, room - a)]
    # the only piece of its length can't be taken twice
    twice = (b == a) & (free[a] < 2)
    b = np.where(twice, below[np.maximum(np.minimum(a, room - a) - 1, 0)], b)
    sums = np.where(b > 0, a + b, 0)
    best = int(np.argmax(sums))
    return (int(a[best]), int(b[best])) if sums[best] else None


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset; sequences are gapless from offset 0.

    ``pieces`` has length (1 to capacity), task and local: the number of the task that made
    the piece and how many of its length that task made before. They are written first, so
    these numbers stay as they are. No pieces give no rows.
    """
    spark = pieces.sparkSession
    pieces = pin(pieces)
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = by_task.select(
        "task",
        "length",
        (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"),
    )
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row per length
        counts[row.length] = row.n
    names = ["length", "first", "last", "sequence", "each", "at"]
    made = np.array(plan(counts), np.int64).reshape(-1, len(names))
    # from Arrow, since a list of rows would start Python workers of its own on the executors
    places = spark.createDataFrame(pa.table({name: pa.array(made[:, i]) for i, name in enumerate(names)}))
    ranked = pieces.join(before, ["task", "length"]).withColumn("rank", F.col("before") + F.col("local"))
    ranked = ranked.drop("task", "local", "before")
    step = F.col("rank") - F.col("first")
    # the plan's size follows the capacity, not the documents
    return (
        ranked.join(F.broadcast(places), "length")
        .filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
        .withColumn("sequence_id", F.col("sequence") + F.floor(step / F.col("each")))
        .withColumn("offset", F.col("at") + (step % F.col("each")) * F.col("length"))
        .drop("rank", "first", "last", "sequence", "each", "at")
    )


def digested(pieces: DataFrame) -> DataFrame:
    """The pieces with ids_crc32 in place of their ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def packed_digest(docs: DataFrame) -> DataFrame:
    return pack(digested(token_pieces(docs))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packed_digest(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op5_best_fit_packing": (op5_best_fit_packing, None)}
