"""Benchmark decontamination: which words of a document repeat a benchmark passage.

The distinct word windows of all benchmark items go to the executors as a hash set; one
pass over the documents looks every window of theirs up by a rolling hash, and verifies a
hit word by word. At most about ``MOST_WINDOWS`` windows are broadcast at once: a
larger benchmark is cut into slices, each of which scans the documents, and the hits are
merged. What goes out is a window and its number; which items have it, however many, is
joined to the numbers that were hit.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.pin import pin
from .common import as_bytes, numbered_rows

WIDTH = 13
#: Windows in one broadcast, about 300 bytes each in a worker.
MOST_WINDOWS = 200_000

#: A-Z lower-cased; every other ASCII character but digits and letters is a separator.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else 32 if b < 48 or 58 <= b <= 96 or 123 <= b <= 127 else b for b in range(256)
)
_BASE = np.uint64(0x9E3779B97F4A7C15)

HITS = "row_id long, doc_id {id}, n_words long, spans array<struct<start:long,end:long>>, numbers array<long>"


def item_words(text: bytes) -> list[bytes]:
    r"""``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z lower-cased."""
    return text.translate(_WORD_BYTES).split()


class _Zero(dict):
    def __missing__(self, word):
        return 0


class Windows:
    """The windows of one slice: per length their hashes, and the number of each."""

    def __init__(self, rows: list[tuple[bytes, int]]):
        self.ids = _Zero()
        self.numbers: dict[tuple[int, ...], int] = {}
        for window, number in rows:
            key = tuple(self.ids.setdefault(w, len(self.ids) + 1) for w in window.split(b" "))
            self.numbers[key] = number
        by_length: dict[int, list[tuple[int, ...]]] = {}
        for key in self.numbers:
            by_length.setdefault(len(key), []).append(key)
        self.hashes = {
            n: np.unique(self._rolled(np.array(keys, np.uint64).T)) for n, keys in sorted(by_length.items())
        }

    @staticmethod
    def _rolled(columns) -> np.ndarray:
        total = None
        for column in columns:
            total = column.copy() if total is None else total * _BASE + column
        return total

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[int]]:
        """Merged spans [start, end) of hit words, and the numbers of the windows, sorted."""
        n = len(words)
        ids = np.fromiter(map(self.ids.__getitem__, words), np.uint64, n)
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        marks = np.zeros(n + 1, np.int64)
        numbers: set[int] = set()
        for width, hashes in self.hashes.items():
            if n < width:
                break
            at = np.flatnonzero(unknown[width:] == unknown[:-width])
            if not len(at):
                continue
            rolled = self._rolled(ids[at + i] for i in range(width))
            near = np.searchsorted(hashes, rolled)
            near[near == len(hashes)] = 0
            for start in at[hashes[near] == rolled].tolist():
                found = self.numbers.get(tuple(ids[start : start + width].tolist()))
                if found is not None:
                    numbers.add(found)
                    marks[start] += 1
                    marks[start + width] -= 1
        if not numbers:
            return [], []
        hit = np.concatenate([[False], np.cumsum(marks)[:n] > 0, [False]])
        edges = np.flatnonzero(hit[1:] != hit[:-1]).reshape(-1, 2)
        return [(int(a), int(b)) for a, b in edges], sorted(numbers)


#: The last slice that this worker has prepared, and what it was made of.
_prepared: list = [None, None]


def _known(rows) -> Windows:
    if _prepared[0] is not rows:
        _prepared[:] = rows, Windows(rows)
    return _prepared[1]


def _windows_of(width: int):
    def run(batches):
        for batch in batches:
            ids, windows = [], []
            for item, text in zip(batch.column("item").to_pylist(), as_bytes(batch.column("text")), strict=True):
                got = item_words(text)
                if got:
                    n = min(width, len(got))
                    each = {b" ".join(got[i : i + n]) for i in range(len(got) - n + 1)}
                    windows += each
                    ids += [item] * len(each)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(windows, pa.binary())], ["item", "window"]
            )

    return run


def _scan(windows, id_type):
    def run(batches):
        known = _known(windows.value)
        for batch in batches:
            counts, spans, numbers = [], [], []
            for text in as_bytes(batch.column("text")):
                got = item_words(text)
                s, i = known.hits(got)
                counts.append(len(got))
                spans.append([{"start": a, "end": b} for a, b in s])
                numbers.append(i)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row_id"),
                    batch.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(numbers, pa.list_(pa.int64())),
                ],
                ["row_id", "doc_id", "n_words", "spans", "numbers"],
            )

    return run


def _merge(batches):
    """Spans of several slices into disjoint ones."""
    for batch in batches:
        rows = batch.to_pylist()
        for row in rows:
            merged: list[dict] = []
            for span in sorted(row["spans"], key=lambda s: (s["start"], s["end"])):
                if merged and span["start"] <= merged[-1]["end"]:
                    merged[-1]["end"] = max(merged[-1]["end"], span["end"])
                else:
                    merged.append(dict(span))
            row["spans"] = merged
        yield pa.RecordBatch.from_pylist(rows, batch.schema)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    most_windows: int = MOST_WINDOWS,
    row_id: str | None = None,
) -> DataFrame:
    """One row per document: row_id, doc_id, n_words, spans, items.

    spans are the word ranges [start, end) covered by occurring windows, in order and
    disjoint; items the ids, as sorted strings, of the benchmark items with such windows.
    A window is ``width`` consecutive words of an item; an item of fewer words, but not
    none, is one window. ``row_id`` may name a column of ``docs`` that numbers the rows (see
    ``with_row_id``). Null and empty texts have no words and no hits, on either side; a null item id counts as the empty
    string, items with one id as one item. Repeated rows each get their row; further
    columns are ignored; with an empty benchmark nothing is hit.
    """
    spark = docs.sparkSession
    texts = numbered_rows(docs, text, row_id)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    windows = pin(
        benchmark.select(
            F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(item_text).cast("string").alias("text")
        )
        .mapInArrow(_windows_of(width), "item string, window binary")
        .distinct()
    )
    numbered = pin(windows.select("window").distinct().withColumn("number", F.monotonically_increasing_id()))
    slices = max(1, -(-numbered.count() // most_windows))
    parts = []
    for k in range(slices):
        mine = numbered.filter(F.pmod(F.xxhash64("window"), F.lit(slices)) == k)
        held = [(bytes(row.window), row.number) for row in mine.toLocalIterator()]
        sent = spark.sparkContext.broadcast(held)
        parts.append(pin(texts.mapInArrow(_scan(sent, id_type), HITS.format(id=id_type))))
        sent.destroy()
    found = parts[0].select("row_id", "doc_id", "n_words")
    hits = reduce(DataFrame.unionByName, (p.filter(F.size("numbers") > 0) for p in parts))
    spans = hits.select("row_id", "spans")
    if slices > 1:
        together = spans.groupBy("row_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        spans = together.mapInArrow(_merge, "row_id long, spans array<struct<start:long,end:long>>")
    said = hits.select("row_id", F.explode("numbers").alias("number")).join(numbered, "number").join(windows, "window")
    items = said.groupBy("row_id").agg(F.array_sort(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<struct<start:long,end:long>>")
    return found.join(spans.join(items, "row_id"), "row_id", "left").select(
        "row_id",
        "doc_id",
        "n_words",
        F.coalesce("spans", none).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def _without(batches):
    for batch in batches:
        out = []
        for text, spans in zip(as_bytes(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
            if spans:
                plain = np.frombuffer(text.translate(_WORD_BYTES), np.uint8) != 32
                edges = np.flatnonzero(np.diff(np.concatenate([[0], plain.view(np.int8), [0]]))).reshape(-1, 2)
                kept, last = [], 0
                for span in spans:
                    kept.append(text[last : edges[span["start"], 0]])
                    last = edges[span["end"] - 1, 1]
                text = b"".join([*kept, text[last:]])
            out.append(text)
        yield pa.RecordBatch.from_arrays(
            [batch.column("row_id"), pa.array(out, pa.binary()).cast(pa.string())], ["row_id", "text"]
        )


def remove_spans(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """(row_id, text): the texts without the hit words and what stands between those of a span.

    ``docs`` brings the row_id that ``found`` has. Null becomes empty.
    """
    rows = docs.select("row_id", F.col(text).cast("string").alias("text")).join(
        found.select("row_id", "spans"), "row_id"
    )
    return rows.mapInArrow(_without, "row_id long, text string")


def judged(found: DataFrame) -> DataFrame:
    """Counts and the verdict: contaminated if a twentieth of the words or more is hit."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s.end - s.start)
    return found.withColumn("n_hit", hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return judged(contamination(docs, bench)).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


#: Words of a text, as the contract has them.
_SQL_WORDS = r"""regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

HIT_SQL = rf"""
d AS (SELECT row_number() OVER () AS rid, doc_id, {_SQL_WORDS.format("coalesce(text, '')")} AS w FROM source),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_SQL_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(13, len(w)) AS n,
         array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS r(i) WHERE len(w) > 0),
dw AS (
  SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM d, (SELECT DISTINCT n FROM bw), unnest(range(1, len(w) - n + 2)) AS r(i) WHERE len(w) >= n),
hit AS (SELECT rid, i, n, item FROM dw JOIN bw USING (n, win)),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS r(p) GROUP BY rid),
named AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items
          FROM hit GROUP BY rid),
judged AS (
  SELECT d.rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
         coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
         coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
  FROM d LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid))
"""
SQL = f"""WITH source AS (SELECT doc_id, text FROM documents), {HIT_SQL}
SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM judged"""

QUERIES = {"op7_decontamination": (op7_decontamination, SQL)}
