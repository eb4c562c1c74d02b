"""Language-model scores from a hidden Markov model.

Every word of the learning texts is counted first. The most frequent words are symbols of
their own; the others fall into classes by their last bytes, and within its class a word
has the probability (c + 1) / (sum of c + 1 over the class, plus 1 for words not met), for
c its count in all learning texts. Baum-Welch trains the latent states: each pass over all
learning texts sums expected counts per partition, then over partitions. The first pass starts from
a chain that the counts and a fixed seed give. A text's score is the exact forward
likelihood of its symbols times its words' shares of their classes.
"""

import zlib
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.pin import pin
from .common import as_bytes, by_size, remainder
from .hidden_markov import Chain, Counts, log_likelihoods

STATES, CLASSES = 6, 256
#: Words with a symbol of their own, and words whose counts every worker holds.
SYMBOLS, HELD = 20_000, 150_000
#: Passes over all learning texts.
PASSES = 14
#: The end of a text as a token; no word is empty.
END = b""
#: Distinct words a task counts before it hands them on.
COUNTED = 400_000

_LN10 = float(np.log(10))


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, A-Z lower-cased, and how many there are up to each text's end."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    parts = found.flatten()
    # white space at either end of a text leaves an empty part there
    real = pc.binary_length(parts).to_numpy() > 0
    ends = np.concatenate([[0], np.cumsum(real)])[found.offsets.to_numpy()[1:]]
    return parts.filter(pa.array(real)).cast(pa.binary()), ends


def _count(batches):
    held, n = [], 0

    def summed():
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"])

    for part in by_size(batches):
        found, ends = _split(part.column("text"))
        counts = found.value_counts()
        held.append(pa.table({"word": counts.field("values"), "c": counts.field("counts")}))
        held.append(pa.table({"word": pa.array([END], pa.binary()), "c": pa.array([len(ends)], pa.int64())}))
        n += len(counts)
        if n > COUNTED:
            held = [summed()]
            n = held[0].num_rows
            if n > COUNTED:
                yield from held.pop().to_batches()
                n = 0
    if held:
        yield from summed().to_batches()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) of all tokens of ``text``; the end of a text is the empty word."""
    return texts.mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Frequent words with their place, symbol and count, and what the others share."""

    def __init__(self, held: list[tuple[bytes, int]], shares: dict[int, int], total: int, distinct: int):
        self.total, self.distinct = total, distinct
        self.n_own = min(SYMBOLS, len(held))
        self.words = pa.array([word for word, _ in held], pa.binary())
        #: by place, log10 of a word's count and 1
        self.logs = np.log10(np.array([c for _, c in held], np.int64) + 1.0)
        classes = [self.n_own + class_of(word) for word, _ in held[self.n_own :]]
        # behind the held words, the classes of the others, last first, as -1 stands for class 0
        behind = self.n_own + np.arange(CLASSES)[::-1]
        self.symbols = np.concatenate([np.arange(self.n_own), classes, behind]).astype(np.int32)
        mass = np.ones(CLASSES)
        for k, v in shares.items():
            mass[k] += v
        #: log10 of what a class's words are shares of
        self.log_mass = np.log10(mass)
        own = np.concatenate([np.array([c for _, c in held[: self.n_own]], np.int64), mass])
        self.frequency = own / own.sum()
        #: the smallest kind of numbers that holds every symbol
        self.packed = np.min_scalar_type(len(own))

    def _places(self, tokens: pa.Array) -> np.ndarray:
        """Of held words their place, of others -1 less their class."""
        places = pc.fill_null(pc.index_in(tokens, value_set=self.words), -1).to_numpy().astype(np.int64)
        others = np.flatnonzero(places < 0)
        if len(others):
            endings = pc.binary_slice(tokens.take(pa.array(others)), -2).dictionary_encode()
            classes = np.array([class_of(x) for x in endings.dictionary.to_pylist()], np.int64)
            places[others] = -1 - classes[endings.indices.to_numpy()]
        return places

    def encode(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, places); a place below 0 is a word whose count is not held."""
        places = self._places(pa.array(tokens, pa.binary()))
        return self.symbols[places], places

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """(symbols, places, bounds, rare) of all texts one after the other, each with its end.

        Text i is from bounds[i] to bounds[i + 1]; rare are the words that are not held, by text.
        """
        found, ends = _split(texts)
        tokens = pa.concat_arrays([found, pa.array([END], pa.binary())])
        each = self._places(tokens)
        last = ends + np.arange(len(ends))
        source = np.full(len(found) + len(ends), len(found))  # the end, unless a word is there
        inside = np.ones(len(source), bool)
        inside[last] = False
        source[inside] = np.arange(len(found))
        places, bounds = each[source], np.concatenate([[0], last + 1])
        unknown = np.flatnonzero(places < 0)
        rare = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(unknown, bounds), pa.int32()), tokens.take(pa.array(source[unknown]))
        )
        return self.symbols[places], places, bounds, rare


def _encode(vocabulary):
    """The symbols of each text, as ``Vocabulary.packed`` numbers."""

    def run(batches):
        v = vocabulary.value
        for part in by_size(batches):
            symbols, _, bounds, _ = v.encode_texts(part.column("text"))
            packed = symbols.astype(v.packed)
            at = (bounds * packed.itemsize).astype(np.int32)
            sequences = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(at), pa.py_buffer(packed)])
            yield pa.RecordBatch.from_arrays([sequences], ["symbols"])

    return run


def _expect(packed: np.dtype, chain, states: int):
    """Expected counts of a partition: rows of (symbol, s0..); -1 is the start, -2 - i the moves from i."""

    def run(batches):
        c = chain.value
        counts = Counts(states, len(c.emit))
        for batch in batches:
            counts.add(c, [np.frombuffer(s, packed) for s in as_bytes(batch.column("symbols"))])
        met = np.flatnonzero(counts.emit.any(axis=1))
        keys = np.concatenate([met, [-1], -2 - np.arange(states)])
        values = np.concatenate([counts.emit[met], counts.start[None], counts.move])
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), *(pa.array(values[:, k], pa.float64()) for k in range(states))],
            ["symbol", *(f"s{k}" for k in range(states))],
        )

    return run


def _baum_welch(encoded: DataFrame, packed: np.dtype, chain: Chain, states: int, frequency: np.ndarray) -> Chain:
    names = [f"s{k}" for k in range(states)]
    sent = encoded.sparkSession.sparkContext.broadcast(chain)
    rows = encoded.mapInArrow(_expect(packed, sent, states), "symbol long, " + ", ".join(f"{n} double" for n in names))
    sums = rows.groupBy("symbol").agg(*(F.sum(n).alias(n) for n in names)).toPandas()  # a row per symbol
    keys, values = sums["symbol"].to_numpy(), sums[names].to_numpy()
    counts = Counts(states, len(frequency))
    counts.emit[keys[keys >= 0]] = values[keys >= 0]
    for key, value in zip(keys, values, strict=True):
        if key == -1:
            counts.start = value
        elif key < -1:
            counts.move[-2 - key] = value
    return counts.chain(frequency)


class Model:
    """What scoring needs: counts (a written table), the held vocabulary and the chain."""

    def __init__(self, counts: DataFrame, vocabulary: Vocabulary, sent, chain: Chain):
        self.counts, self.vocabulary, self.sent, self.chain = counts, vocabulary, sent, chain


def train(docs: DataFrame, text: str = "text", states: int = STATES, passes: int = PASSES) -> Model:
    """Learn from all texts of ``docs``; null is empty. Without rows, all words are unknown."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text).cast("string").alias("text"))
    counts = pin(word_counts(texts))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("c"), "word").limit(HELD)
    held = [(bytes(r.word), r.c) for r in top.collect()]  # bounded by HELD
    shares: dict[int, int] = {}
    if len(held) > SYMBOLS:
        # all words but the first SYMBOLS, by class; ties at the border go by word, as above
        word, c = held[SYMBOLS - 1]
        rest = counts.filter((F.col("c") < c) | ((F.col("c") == c) & (F.col("word") > F.lit(bytearray(word)))))
        last_bytes = F.expr("substring(word, greatest(length(word) - 1, 1), 2)")
        by_class = rest.groupBy((F.crc32(last_bytes) % CLASSES).alias("k"))
        shares = {r.k: r.m for r in by_class.agg(F.sum(F.col("c") + 1).alias("m")).collect()}
    vocabulary = Vocabulary(held, shares, total, distinct)
    sent = spark.sparkContext.broadcast(vocabulary)
    encoded = pin(texts.mapInArrow(_encode(sent), "symbols binary"))
    chain = Chain.random(states, vocabulary.frequency)
    for _ in range(passes):
        chain = _baum_welch(encoded, vocabulary.packed, chain, states, vocabulary.frequency)
    return Model(counts, vocabulary, sent, chain)


def _score(vocabulary, chain):
    def run(batches):
        v, c = vocabulary.value, chain.value
        for part in by_size(batches):
            symbols, places, bounds, rare = v.encode_texts(part.column("text"))
            held, shared = places >= 0, symbols >= v.n_own
            logs = np.zeros(len(places))
            logs[held] = v.logs[places[held]]
            # the rare words' own counts are added later
            inside = np.where(shared, logs, 0.0)
            inside[shared] -= v.log_mass[symbols[shared] - v.n_own]
            # every text has its end, so none is empty
            logs, known, inside = (np.add.reduceat(x, bounds[:-1]) for x in (logs, held.astype(np.int64), inside))
            sequences = [symbols[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("row_id"),
                    part.column("doc_id"),
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.array(known, pa.int64()),
                    pa.array(logs, pa.float64()),
                    pa.array(inside + log_likelihoods(c, sequences) / _LN10, pa.float64()),
                    rare,
                ],
                ["row_id", "doc_id", "n_tokens", "known_here", "logs_here", "score_here", "rare"],
            )

    return run


def score(docs: DataFrame, model: Model, text: str = "text", row_id: str | None = None) -> DataFrame:
    """A row per document: row_id, doc_id, n_tokens, n_known, base_score, score (log10).

    Tokens are the words, A-Z lower-cased, and one end; n_known of them were met in
    learning. base_score adds log10((c + 1) / (N + V + 1)); score is the model's. A null or
    empty text is its end alone. Repeated rows get a row each; further columns are ignored,
    but ``row_id`` may name one that numbers the rows.
    """
    # read once, and written with the scores
    number = F.monotonically_increasing_id() if row_id is None else F.col(row_id)
    docs = docs.select(number.alias("row_id"), "doc_id", F.col(text).cast("string").alias("text"))
    v, spark = model.vocabulary, docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = spark.sparkContext.broadcast(model.chain)
    here = pin(
        docs.mapInArrow(
            _score(model.sent, sent),
            f"row_id long, doc_id {kind}, n_tokens long, known_here long, logs_here double, score_here double, "
            "rare array<binary>",
        )
    )
    # words that no worker holds look their counts up; what isn't met has none
    rare = here.select("row_id", F.explode("rare").alias("word")).join(model.counts, "word")
    added = rare.groupBy("row_id").agg(F.count("*").alias("k"), F.sum(F.log10(F.col("c") + 1.0)).alias("logs"))
    logs, k = F.coalesce("logs", F.lit(0.0)), F.coalesce("k", F.lit(0))
    base = log10(v.total + v.distinct + 1)
    return here.drop("rare").join(added, "row_id", "left").select(
        "row_id",
        "doc_id",
        "n_tokens",
        (F.col("known_here") + k).alias("n_known"),
        (F.col("logs_here") + logs - F.col("n_tokens") * base).alias("base_score"),
        (F.col("score_here") + logs).alias("score"),
    )


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 7) == 2
    model = train(docs.filter(~held_out))
    return score(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.vocabulary.total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


QUERIES = {"op2_lm_scoring": (op2_lm_scoring, None)}
