"""Toxicity by subword-bag embeddings.

A word is the bag of itself and its character n-grams, each with an embedding; a window of
a few words is the average of its words, and a linear softmax says whether it is toxic.
Embeddings and softmax are trained jointly in numpy on a bounded sample of labelled rows.
Misspelt words never seen before share n-grams with those seen.

Labels are of documents, so at first each window has its document's label; then, for half
of the training, only the windows of toxic documents that score highest stay toxic, as most
of their windows are harmless. A document's score is a logistic function, fitted on sample
rows kept out of that training, of its highest window, its mean and its length.
"""

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHED_WORDS, remainder

BUCKETS, DIM, WINDOW = 1 << 17, 8, 6
NGRAMS = (3, 4, 5)
#: Rows of each label in the sample, and their words, at most.
SAMPLE, SAMPLE_WORDS = 1200, 1_000_000
EPOCHS, RATE = 20, 0.05
#: Words whose features are worked out at once.
CHUNK = 100_000
_PUNCTUATION = b".,;:!?\"'()[]{}|*#%$&-_~"
#: Share of the windows of toxic documents that stay toxic in the second half.
TOP_SHARE = 0.1


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return (text or "").lower().encode("utf-8", "replace").translate(None, _PUNCTUATION).split()


def bags(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of every feature: each word itself, and its byte n-grams with marked ends."""
    joined = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), sizes)
    end = np.cumsum(sizes)[word]
    buckets = [np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % np.uint32(BUCKETS)]
    owners = [np.arange(len(words))]
    rolled = joined.copy()
    for n in range(2, NGRAMS[-1] + 1):
        rolled = rolled[:-1] * np.uint32(0x01000193) + joined[n - 1 :]
        if n in NGRAMS:
            at = np.flatnonzero(np.arange(len(rolled)) + n <= end[: len(rolled)])
            h = rolled[at] * np.uint32(0x9E3779B1)
            buckets.append((h ^ (h >> np.uint32(15))) % np.uint32(BUCKETS))
            owners.append(word[at])
    return np.concatenate(buckets), np.concatenate(owners)


class Model:
    """After training, a word's part in a window's logit is one number per feature."""

    def __init__(self, logit: np.ndarray, bias: float, scale: np.ndarray):
        self.logit, self.bias, self.scale = logit, bias, scale

    def learn(self, known: dict[bytes, float], words: set[bytes]):
        """Add what the model says of these words."""
        new = [w for w in words if w not in known]
        for k in range(0, len(new), CHUNK):
            part = new[k : k + CHUNK]
            bucket, owner = bags(part)
            said = np.bincount(owner, self.logit[bucket], len(part)) / np.bincount(owner, minlength=len(part))
            known.update(zip(part, said.tolist(), strict=True))

    def summary(self, got: list[bytes], known: dict[bytes, float]) -> np.ndarray | None:
        if not got:
            return None
        s = np.fromiter(map(known.__getitem__, got), np.float64, len(got))
        width = min(WINDOW, len(s))
        total = np.concatenate([[0.0], np.cumsum(s)])
        windows = (total[width:] - total[:-width]) / width + self.bias
        top = np.sort(np.unique(s))[-3:]
        return np.array([1.0, windows.max(), top[0], top.mean(), windows.mean(), np.log(len(s))])

    def scores(self, texts: list[str | None], known: dict[bytes, float]) -> list[float]:
        docs = [words_of(t) for t in texts]
        if len(known) > CACHED_WORDS:
            known.clear()
        self.learn(known, {w for d in docs for w in d})
        return [self.score(d, known) for d in docs]

    def score(self, words: list[bytes], known: dict[bytes, float]) -> float:
        x = self.summary(words, known)
        if x is None:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.scale @ x, -30, 30))))


def _scatter(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, weights=values[:, d], minlength=n) for d in range(values.shape[1])], axis=1)


def _embed(texts: list[str], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Train on windows; returns each feature's part in the logit, and the bias."""
    number: dict[bytes, int] = {}
    docs = [[number.setdefault(w, len(number)) for w in words_of(t)] for t in texts]
    bucket, owner = bags(list(number))
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    used, flat = np.unique(bucket[order], return_inverse=True)
    sizes = np.bincount(owner)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    words = np.concatenate([np.array(d, np.int64) for d in docs if d])
    cuts = [np.arange(0, len(d), WINDOW) for d in docs]
    base = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    at = np.concatenate([c + b for c, b in zip(cuts, base)]).astype(np.int64)
    widths = np.diff(np.concatenate([at, [len(words)]]))
    doc_of = np.repeat(np.arange(len(docs)), [len(c) for c in cuts])
    window_of = np.repeat(np.arange(len(at)), widths)
    target = labels[doc_of].astype(np.float64)

    rng = np.random.default_rng(7)
    params = [rng.normal(0, 0.1, (len(used), DIM)), rng.normal(0, 0.1, (DIM, 2)), np.zeros(2)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = np.ones(len(at))
    for epoch in range(EPOCHS):
        if epoch % 5 == 0:  # both classes weigh the same
            share = np.clip((weight * target).sum() / weight.sum(), 0.01, 0.99)
            balance = weight * np.where(target > 0, 0.5 / share, 0.5 / (1 - share))
            balance /= balance.sum()
        table, soft, bias = params
        word = np.add.reduceat(table[flat], starts, axis=0) / sizes[:, None]
        window = np.add.reduceat(word[words], at, axis=0) / widths[:, None]
        logits = window @ soft + bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        error = p.copy()
        error[:, 1] -= target
        error[:, 0] -= 1 - target
        error *= balance[:, None]
        to_window = (error @ soft.T) / widths[:, None]
        to_word = _scatter(words, to_window[window_of], len(sizes)) / sizes[:, None]
        grads = [_scatter(flat, to_word[owner], len(used)), window.T @ error, error.sum(axis=0)]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            step = first[k] / (1 - 0.9 ** (epoch + 1)) / (np.sqrt(second[k] / (1 - 0.999 ** (epoch + 1))) + 1e-9)
            params[k] = params[k] - RATE * step
        if epoch == EPOCHS // 2:
            # of a toxic document's windows, those in its top share and the first stay
            order = np.lexsort((-p[:, 1], doc_of))
            place = np.empty(len(at), np.int64)
            place[order] = np.arange(len(at)) - np.repeat(
                np.searchsorted(doc_of, np.arange(len(docs))), [len(c) for c in cuts]
            )
            count = np.array([len(c) for c in cuts])[doc_of]
            weight = np.where((target == 0) | (place < np.maximum(1, TOP_SHARE * count)), 1.0, 0.0)
    table, soft, bias = params
    difference = soft[:, 1] - soft[:, 0]
    said = table @ difference
    # n-grams never seen are as the average of those seen
    logit = np.full(BUCKETS, np.average(said, weights=np.bincount(flat)))
    logit[used] = said
    return logit, float(bias[1] - bias[0])


def _calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    mean, spread = x[:, 1:].mean(axis=0), x[:, 1:].std(axis=0) + 1e-9
    z = np.concatenate([x[:, :1], (x[:, 1:] - mean) / spread], axis=1)
    w = np.zeros(z.shape[1])
    ridge = np.diag([1e-6] + [0.05] * (z.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = z.T @ (z * (p * (1 - p))[:, None]) + ridge
        w = w - np.linalg.solve(h, z.T @ (p - y) + ridge @ w)
    scale = np.concatenate([w[:1], w[1:] / spread])
    scale[0] -= (w[1:] * mean / spread).sum()
    return scale


def fit(texts: list[str], labels: list[int], odds: float = 1.0) -> Model:
    """Deterministic: rows are put in order first. With one label only, all score as it.

    ``odds`` is how often label 1 is met for one label 0 outside the sample.
    """
    rows = sorted(zip(labels, texts, strict=True))
    y = np.array([r[0] for r in rows])
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS), 0.0, np.array([30.0 if len(y) and y[0] else -30.0] + [0.0] * 5))
    held = np.array([zlib.crc32(t.encode("utf-8", "replace")) % 4 == 0 for _, t in rows])
    if not (0 < y[held].sum() < held.sum()) or not (0 < y[~held].sum() < (~held).sum()):
        learn = check = np.ones(len(y), bool)
    else:
        learn, check = ~held, held
    logit, bias = _embed([rows[i][1] for i in np.flatnonzero(learn)], y[learn])
    model, known = Model(logit, bias, np.zeros(6)), {}
    docs = [words_of(rows[i][1]) for i in np.flatnonzero(check)]
    model.learn(known, {w for d in docs for w in d})
    model.scale = _calibrate(np.array([model.summary(d, known) for d in docs]), y[check].astype(float))
    model.scale[0] += np.log(odds * (y == 0).sum() / (y == 1).sum())
    return model


def _fit_all(sample: int, most_words: int, odds: float):
    def run(batches):
        texts, labels, seen, words = [], [], {0: 0, 1: 0}, {0: 0, 1: 0}
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                n = len(words_of(text))
                if n and seen[label] < 2 * sample and words[label] + n <= most_words // 2:
                    seen[label] += 1
                    words[label] += n
                    texts.append(text)
                    labels.append(label)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, labels, odds))], pa.binary())], ["model"])

    return run


def train(
    docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", sample: int = SAMPLE,
    most_words: int = SAMPLE_WORDS,
) -> Model:
    """Fit on about ``sample`` rows per label, those with the least hash; one task reads them.

    ``docs`` and ``labels`` have doc_id; rows with a null label or text are left out, and of a
    doc_id labelled twice the larger label holds. Without any label all texts score 0.
    """
    spark = docs.sparkSession
    marks = labels.filter(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    share = F.create_map(*[F.lit(v) for k in (0, 1) for v in (k, int(min(1.0, sample / sizes.get(k, 1)) * 2**32))])
    odds = max(1, sizes.get(1, 0)) / max(1, sizes.get(0, 0))
    # the labels are thinned out by hash before they meet the texts, and stay few
    picked = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2**32)) < share[F.col("label")]).limit(4 * sample)
    texts = docs.select("doc_id", F.col(text).cast("string").alias("text")).filter("text IS NOT NULL")
    rows = texts.join(F.broadcast(picked), "doc_id").select("label", "text")
    model = rows.repartition(1).mapInArrow(_fit_all(sample, most_words, odds), "model binary").collect()
    return pickle.loads(model[0].model) if model else fit([], [])


def _score(model):
    def run(batches):
        m = model.value
        known: dict[bytes, float] = {}
        for batch in batches:
            out = m.scores(batch.column("text").to_pylist(), known)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """A row per document: doc_id, score from 0 to 1.

    Null and empty texts, and texts of white space only, score 0. Rows repeat as they do in
    ``docs``; further columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by BUCKETS
    return docs.select("doc_id", F.col(text).cast("string").alias("text")).mapInArrow(
        _score(sent), f"doc_id {kind}, score double"
    )


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = train(docs, labels.filter(remainder(F.col("doc_id"), 5) != 0))
    return score(docs, model).select(
        "doc_id",
        (remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


QUERIES = {"op3_toxicity": (op3_toxicity, None)}
