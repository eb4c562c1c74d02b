r"""Spelling variant grouping: a word belongs to a far more frequent word one edit away.

Near words are found by asymmetric q-chunks. The shorter word of a pair (the smaller one of
two of one length) gives two disjoint chunks, its first and its last half; the longer one
gives its positional grams of the same length. One edit touches at most one of two disjoint
chunks, so the other one is a gram of the longer word, moved by at most one place. Grams
further than one place from a chunk can't join, and aren't made. Each pair that meets is
verified by its edit distance.

A chunk that very many words share (a common beginning) would let all of them meet. There
the method is used once more on what is left of the words without the chunk: the one gives
two chunks of that, the other its grams, and both parts must agree.
"""

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.pin import pin
from .common import by_size

#: Words have at least so many code points and occurrences.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form is so many times as frequent as the word.
TIMES = 10
#: In one of so many runs of a document a code point is deleted.
TYPO = 31
#: Chunks that more words than this share are joined by a second chunk too.
CROWD = 256
#: A task passes its counts on when it holds so many words.
HELD_WORDS = 200_000

_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def _counted(least_length: int):
    run_of = re.compile(f"[A-Za-zÀ-ÿ]{{{least_length},}}")

    def counted(batches):
        held = Counter()

        def passed_on():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema=_COUNTS
            )

        for batch in by_size(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                of_doc = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                runs = Counter()
                for run, n in Counter(run_of.findall(text or "")).items():
                    runs[run.encode().lower()] += n
                for run, n in runs.items():
                    word, h = run.decode(), zlib.crc32(run, of_doc)
                    if h % TYPO == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield passed_on()
                    held.clear()
        yield passed_on()

    return counted


def count_words(docs: DataFrame, text: str = "text", least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n): the words of at least ``least_length`` code points in all whole texts.

    Runs of letters with A-Z lower-cased; where crc32 of ``<doc_id>:<run>`` is divisible by
    31, its code point at that number modulo the length is left out. Null text has none, a
    null doc_id reads as ''.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_counted(least_length), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _without(word: Column, at: Column, length: Column) -> Column:
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + length + 1, F.char_length(word)))


def _chunks(word: Column) -> Column:
    """Its two disjoint chunks: array of (gram, at, rest)."""
    size = F.char_length(word)
    half = F.floor(size / 2).cast("int")
    return F.transform(
        F.array(F.lit(0), size - half),
        lambda at: F.struct(
            F.substring(word, at + 1, half).alias("gram"), at.alias("at"), _without(word, at, half).alias("rest")
        ),
    )


def _grams(word: Column, size: Column) -> Column:
    """The positional grams that a chunk of a word of ``size`` code points can meet: array of (gram, at, rest)."""
    half = F.floor(size / 2).cast("int")
    last = F.char_length(word) - half
    near = F.array_distinct(F.flatten(F.array(*[F.array(at - 1, at, at + 1) for at in (F.lit(0), size - half)])))
    return F.transform(
        F.filter(near, lambda at: (at >= 0) & (at <= last)),
        lambda at: F.struct(
            F.substring(word, at + 1, half).alias("gram"), at.alias("at"), _without(word, at, half).alias("rest")
        ),
    )


def _verified(chunks: DataFrame, grams: DataFrame, key: list[str], shifts: list[str]) -> DataFrame:
    """(one, other): pairs that agree in ``key``, within one place, and are one edit apart.

    Neither side is broadcast: both are many rows of each word, which Spark's guess at their
    size, made from the table of words, leaves out.
    """
    one, other = chunks.alias("one").hint("merge"), grams.alias("other").hint("merge")
    met = [F.col(f"one.{c}") == F.col(f"other.{c}") for c in key]
    met += [F.abs(F.col(f"one.{c}") - F.col(f"other.{c}")) <= 1 for c in shifts]
    # of two words of one length, the smaller gives the chunks
    met.append((F.char_length("other.word") > F.col("one.size")) | (F.col("one.word") < F.col("other.word")))
    met.append(F.levenshtein(F.col("one.word"), F.col("other.word"), 1) == 1)
    return one.join(other, met).select(F.col("one.word").alias("one"), F.col("other.word").alias("other"))


def near_words(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(one, other): every two different words of the column ``word`` that are one edit apart, once.

    Words have two code points or more. ``crowd`` changes the work, never the result.
    """
    size = F.char_length("word")
    chunks = words.select("word", size.alias("size"), F.inline(_chunks(F.col("word"))))
    # the longer word meets chunks of words of its own length and of one less
    grams = words.select("word", F.explode(F.array(size, size - 1)).alias("size"))
    grams = grams.select("word", "size", F.inline(_grams(F.col("word"), F.col("size"))))
    key = ["size", "gram"]
    crowded = pin(chunks.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select(*key))
    plain = _verified(chunks.join(crowded, key, "left_anti"), grams, key, ["at"])

    def again(rows, parts):
        rows = rows.join(crowded, key, "left_semi")
        return rows.select("word", "size", "gram", "at", F.inline(parts).alias("gram2", "at2", "rest2"))

    half = F.floor(F.col("size") / 2).cast("int")
    dense = _verified(
        again(chunks, _chunks(F.col("rest"))),
        again(grams, _grams(F.col("rest"), F.col("size") - half)),
        [*key, "gram2"],
        ["at", "at2"],
    )
    return plain.unionByName(dense).distinct()


def _last_forms(forms: DataFrame) -> DataFrame:
    """(word, form) with each form replaced by the last one that forms lead to.

    Forms are ever more frequent, so there are no circles, and each round doubles the steps
    that are taken at once.
    """
    while True:
        then = forms.select(F.col("word").alias("form"), F.col("form").alias("then"))
        moved = forms.join(then, "form", "left")
        forms = pin(moved.select("word", F.coalesce("then", "form").alias("form"), F.col("then").isNotNull().alias("on")))
        if forms.filter("on").isEmpty():
            return forms.select("word", "form")
        forms = forms.select("word", "form")


def spelling_variants(counts: DataFrame, times: int = TIMES, crowd: int = CROWD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of ``counts`` (word, n), words distinct.

    Words are near if they differ by exactly one inserted, deleted or replaced code point. A
    word's form is its most frequent near word (ties: the first in code-point order) if that
    is at least ``times`` as frequent, else null; its root is the last word that forms lead
    to, itself without a form. ``n_near`` counts its near words. No word has more of them
    than its length and the alphabet allow, so no group is unbounded. An empty table gives
    no rows; other columns of ``counts`` are not looked at.
    """
    counts = pin(counts.select("word", "n"))
    pairs = pin(near_words(counts, crowd))
    both = pairs.unionByName(pairs.select(F.col("other").alias("one"), F.col("one").alias("other")))
    known = both.join(counts.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = known.groupBy(F.col("one").alias("word")).agg(
        F.count("*").alias("n_near"),
        F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("best"),
    )
    best = best.select("word", "n_near", F.col("best.word").alias("form"), (-F.col("best.n")).alias("form_n"))
    is_form = F.col("form_n") >= times * F.col("n")
    rows = counts.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"),
    )
    rows = pin(rows)
    roots = _last_forms(rows.filter("form IS NOT NULL").select("word", "form"))
    return rows.join(roots.withColumnRenamed("form", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spelling_variants(count_words(docs).filter(F.col("n") >= LEAST_COUNT))


SQL = rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k:
    CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS steps),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
bytes AS (
  SELECT run, doc_id, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM runs),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2),
      lambda i: CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT))),
    lambda c, b: xor(c // 256, steps[xor(c % 256, b) + 1])), 4294967295) AS crc
  FROM bytes, crc),
said AS (
  SELECT n, CASE WHEN crc % {TYPO} = 0
    THEN left(run, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word
  FROM hashed),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM said WHERE length(word) >= {LEAST_LENGTH}
  GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
cut AS (
  SELECT word, i, left(word, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word FROM cut c JOIN words w ON c.rest = w.word),
best AS (
  SELECT a.word, w.word AS form, w.n AS form_n, count(*) OVER (PARTITION BY a.word) AS n_near
  FROM near a JOIN words w ON a.other = w.word
  QUALIFY row_number() OVER (PARTITION BY a.word ORDER BY w.n DESC, w.word) = 1),
rows AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
    CASE WHEN b.form_n >= {TIMES} * w.n THEN b.form END AS form,
    CASE WHEN b.form_n >= {TIMES} * w.n THEN b.form_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
walk AS (
  SELECT word, word AS root FROM rows
  UNION ALL SELECT k.word, r.form FROM walk k JOIN rows r ON k.root = r.word WHERE r.form IS NOT NULL)
SELECT r.word, r.form, k.root, r.n, r.n_near, r.form_n
FROM rows r JOIN walk k ON r.word = k.word JOIN rows e ON e.word = k.root WHERE e.form IS NULL
"""

QUERIES = {"op11_spelling_variants": (op11_spelling_variants, SQL)}
