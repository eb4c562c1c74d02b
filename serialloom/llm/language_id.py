"""Language identification by nearest centroid.

A text is the vector of the byte 1-, 2- and 3-grams of its words (lower-cased UTF-8, every
run of ASCII characters that are no letters as one space, hashed into ``BUCKETS``),
weighted by TF-IDF and normalised. Spherical k-means gives several centroids
per language, fitted on a bounded sample of labelled rows; the language is that of the
centroid with the largest cosine. A text is rejected if it has no letter, or if it is far
from all centroids. A few words have few n-grams and so a small cosine with any centroid;
the cosine is measured against the root of their number up to ``SATURATED`` for that.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.pin import pin
from .common import SMALL, by_size, remainder, sorted_groups, trimmed

BUCKETS, CENTROIDS = 1 << 13, 4
#: About so many rows of each language are what the model is fitted on.
SAMPLE = 500
#: Rejected below this share of the sample's first percentile.
REJECT_SHARE = 0.3
SATURATED = 400
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_SPAN = 1 << 20
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_HELD = re.compile(rb" {2,}")


def counts_of(text: str) -> np.ndarray:
    """How often each bucket's n-grams occur in the whole text."""
    total = np.zeros(BUCKETS, np.float32)
    folded = _HELD.sub(b" ", b" " + text.lower().encode("utf-8", "replace").translate(_FOLD) + b" ")
    raw = np.frombuffer(folded, np.uint8)
    for at in range(0, max(1, len(raw) - 2), _SPAN):  # long texts in spans, which overlap by two
        b = raw[at : at + _SPAN + 2].astype(np.uint32)
        two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA6B)
        three = two[:-1] * np.uint32(0xC2B2AE35) + b[2:] * np.uint32(0x27D4EB2F)
        last = at + _SPAN + 2 >= len(raw)
        # the overlap belongs to the next span
        total += np.bincount(b if last else b[:-2], minlength=BUCKETS)
        total += np.bincount((two if last else two[:-1]) >> np.uint32(19), minlength=BUCKETS)
        total += np.bincount(three >> np.uint32(19), minlength=BUCKETS)
    return total


def _reach(ngrams: int) -> float:
    return max(1.0, min(float(ngrams), SATURATED)) ** 0.5 / SATURATED**0.5


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, centroids: np.ndarray, owner: np.ndarray, least: float):
        self.languages, self.idf, self.centroids, self.owner, self.least = languages, idf, centroids, owner, least

    def vector(self, text: str) -> np.ndarray:
        v = np.log1p(counts_of(text)) * self.idf
        return v / max(float(np.sqrt(v @ v)), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(nearest, score, rejected)"""
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        vector = self.vector(text)
        cosines = self.centroids @ vector
        best = int(np.argmax(cosines))
        score = min(1.0, max(0.0, float(cosines[best])))
        return self.languages[self.owner[best]], score, score < self.least * _reach(np.count_nonzero(vector))


def fit_language(vectors: np.ndarray) -> np.ndarray:
    """Spherical k-means of one language's vectors: its centroids."""
    at = [int(np.argmax(vectors @ vectors.mean(axis=0)))]
    while len(at) < min(CENTROIDS, len(vectors)):  # the farthest from those there are
        at.append(int(np.argmin((vectors @ vectors[at].T).max(axis=1))))
    centers = vectors[at]
    for _ in range(10):
        nearest = np.argmax(vectors @ centers.T, axis=1)
        sums = np.array([vectors[nearest == c].sum(axis=0) for c in range(len(centers))])
        norms = np.sqrt((sums**2).sum(axis=1, keepdims=True))
        centers = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centers)
    return centers.astype(np.float32)


def _document_counts(batches):
    """(bucket, docs): in how many texts of the task each bucket occurs; bucket -1 counts the texts."""
    seen, n = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            seen += counts_of(text) > 0
            n += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(at, -1)), pa.array(np.append(seen[at], n))], ["bucket", "docs"]
    )


def _fit_languages(idf: np.ndarray):
    def run(batches):
        for rows in sorted_groups(batches, ["lang"]):
            counts = np.array([counts_of(t) for t in rows.column("text").to_pylist()], np.float32)
            vectors = np.log1p(counts) * idf
            vectors /= np.maximum(np.sqrt((vectors**2).sum(axis=1, keepdims=True)), 1e-12)
            centers = fit_language(vectors)
            reach = np.array([_reach(m) for m in (vectors > 0).sum(axis=1)])
            nearness = (vectors @ centers.T).max(axis=1) / reach
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows.column("lang")[0].as_py()], pa.string()),
                    pa.array([centers.tobytes()], pa.binary()),
                    pa.array([nearness.astype(float).tolist()], pa.list_(pa.float64())),
                ],
                ["lang", "centroids", "nearness"],
            )

    return run


def train(docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on about ``sample`` rows of each language, those with the least hash, at most twice as many.

    Every language with a text that has a letter is learned, in a group of its own. The
    model takes 128 KB a language.
    """
    labelled = docs.select(
        F.col(lang).alias("lang"), F.col(text).cast("string").alias("text"), F.xxhash64("doc_id", text).alias("hash")
    ).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"[\p{L}]"))
    sizes = pin(labelled.groupBy("lang").agg(F.count("*").alias("rows")))
    share = F.least(F.lit(1.0), sample / F.col("rows")) * 2**32
    picked = labelled.join(sizes.select("lang", share.alias("share")), "lang").filter(
        F.pmod(F.xxhash64("hash"), F.lit(2**32)) < F.col("share")
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("hash"), "text"))
    picked = pin(picked.withColumn("place", place).filter(F.col("place") <= 2 * sample).select("lang", "text", "place"))
    seen = picked.mapInArrow(_document_counts, "bucket long, docs long").groupBy("bucket").agg(F.sum("docs").alias("docs"))
    in_docs, n = np.zeros(BUCKETS), 0
    for row in seen.collect():  # a row per bucket
        if row.bucket < 0:
            n = row.docs
        else:
            in_docs[row.bucket] = row.docs
    idf = (np.log((1 + n) / (1 + in_docs)) + 1).astype(np.float32)
    dealt = picked.repartition("lang").sortWithinPartitions("lang", "place").select("lang", "text")
    made = dealt.mapInArrow(_fit_languages(idf), "lang string, centroids binary, nearness array<double>")
    found = sorted(made.collect(), key=lambda r: r.lang)  # a row per language
    if not found:
        return Model([], idf, np.zeros((0, BUCKETS), np.float32), np.zeros(0, int), 0.0)
    centroids = [np.frombuffer(r.centroids, np.float32).reshape(-1, BUCKETS) for r in found]
    owner = np.repeat(np.arange(len(found)), [len(c) for c in centroids])
    least = REJECT_SHARE * float(np.percentile([x for r in found for x in r.nearness], 1))
    return Model([r.lang for r in found], idf, np.concatenate(centroids), owner, least)


def _predict(model):
    def run(batches):
        m = model.value
        for batch in batches:
            got = [m.predict(t) for t in batch.column("text").to_pylist()]
            names = [f for f in batch.schema.names if f != "text"]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(n) for n in names),
                    pa.array([g[0] for g in got], pa.string()),
                    pa.array([g[1] for g in got], pa.float64()),
                    pa.array([g[2] for g in got], pa.bool_()),
                ],
                [*names, "lang_pred", "score", "rejected"],
            )

    return run


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: ``key``, lang_pred, score, rejected.

    lang_pred is the nearest learned language, ``und`` for texts that are null or have no
    letter, and for all if nothing was learned; these have score 0 and are rejected. Others
    are rejected if their cosine is too far below the sample's. Rows repeat as they do in
    ``docs``; further columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # CENTROIDS x BUCKETS numbers a language
    return docs.select(key, F.col(text).cast("string").alias("text")).mapInArrow(
        trimmed(_predict(sent)), f"{key} {kind}, lang_pred string, score double, rejected boolean"
    )


def _accepted(model, text: str):
    def run(batches):
        m = model.value
        for batch in by_size(batches, text, SMALL):
            kept = [not m.predict(t)[2] for t in batch.column(text).to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return run


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents that ``identify`` does not reject, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(trimmed(_accepted(sent, text)), docs.schema)


def learning_rows(docs: DataFrame) -> DataFrame:
    """Rows whose id's crc32 modulo 5 is not 0."""
    return docs.filter(remainder(F.col("doc_id"), 5) != 0)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs, train(learning_rows(docs)))
    return found.select(
        "doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "rejected"
    )


QUERIES = {"op10_language_id": (op10_language_id, None)}
