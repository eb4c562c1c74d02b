"""Quality rules: counts of each text, and its distance from its language, in DataFrame functions only.

A language's reference is two histograms over all its documents: characters by class, and
its most frequent words against all others. A document's histograms are compared with them
by Jensen-Shannon distance (square root of the divergence in bits, so from 0 to 1). Short
texts have rough histograms, so each comparison asks for a least length; a language with few
words gives no reference, and its documents are judged by the counts alone.

The references come from the counts of each language's words, one pass over the texts (a
window per language keeps its most frequent words in each partition first); documents are
judged in another, row by row, so no text is ever shuffled unless the references outgrow a
broadcast.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.binding import bound
from ..plans.pin import pin
from .common import SPACES

#: Words that repeat are found in windows of so many.
WIDTH = 8
#: Words of a language that have a bin of their own.
COMMON_WORDS = 32
#: A language needs so many words to be a reference.
REFERENCE_WORDS = 2_000
#: Least code points in words, and the largest distance of the classes, of a kept document.
CLASS_CHARS, CLASS_DISTANCE = 200, 0.3
#: Least words, and the largest distance of the common words, of a kept document.
COMMON_LENGTH, COMMON_DISTANCE = 100, 0.5

#: Classes of characters, taken out of the text in turn; what is left is another one. White
#: space is taken out too, but is no class: both histograms are of words.
CLASSES = ("[a-z]+", "[A-Z]+", SPACES, "[0-9]+", "[.,;:!?'\"()-]+", r"[\x00-\x7F]+")
_SPACE_CHARS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def word_list(text: Column) -> Column:
    """``[^\\x20\\x09-\\x0D]+`` of a text that is not null."""
    trimmed = F.btrim(text, F.lit(_SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def word_hashes(words: Column) -> Column:
    """A 64-bit hash for each word; lists of numbers are compared many times faster than texts."""
    return F.transform(words, lambda w: F.xxhash64(w))


def repeat_words(hashes: Column, width: int = WIDTH) -> Column:
    """How many words (given as hashes) lie in windows that the list has twice or more.

    Windows are told apart by a 64-bit hash, made of those of their halves; so ``width`` is
    a power of two.
    """

    def doubled(step: int):
        def joined(parts: Column) -> Column:
            n = F.size(parts) - step
            return F.zip_with(F.slice(parts, 1, n), F.slice(parts, step + 1, n), lambda a, b: F.xxhash64(a, b))

        return joined

    windows, step = hashes, 1
    while step < width:
        windows, step = bound(windows, doubled(step)), 2 * step
    windows = F.when(F.size(hashes) >= width, windows)

    def places(sorted_windows: Column) -> Column:
        def same(window, k):
            return F.coalesce(F.get(sorted_windows, k)["hash"] == window["hash"], F.lit(False))

        found = F.filter(sorted_windows, lambda w, k: same(w, k - 1) | same(w, k + 1))
        return F.sort_array(F.transform(found, lambda w: w["at"]))

    def covered(hashes: Column) -> Column:
        marked = F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), i.alias("at")))
        return F.aggregate(
            bound(F.sort_array(marked), places),
            F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n")),
            lambda got, at: F.struct(
                at.alias("last"), (got["n"] + F.least(F.lit(width), at - got["last"])).alias("n")
            ),
            lambda got: got["n"],
        )

    count = bound(
        windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0))
    )
    return F.coalesce(count, F.lit(0)).cast("long")


def with_classes(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with _classes, how many code points of the text each class has, and _spaces."""
    rest, counts = F.col(text), []
    for k, pattern in enumerate(CLASSES):
        docs = docs.withColumn(f"_rest{k}", F.regexp_replace(rest, pattern, ""))
        counts.append(F.char_length(rest) - F.char_length(f"_rest{k}"))
        rest = F.col(f"_rest{k}")
    counts.append(F.char_length(rest))
    spaces = counts.pop(CLASSES.index(SPACES)).cast("long")
    classes = F.array(*[c.cast("long") for c in counts])
    docs = docs.withColumn("_classes", classes).withColumn("_spaces", spaces)
    return docs.drop(*[f"_rest{k}" for k in range(len(CLASSES))])


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.col(lang).alias("_lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))


def references(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    common: int = COMMON_WORDS,
    least: int = REFERENCE_WORDS,
) -> DataFrame:
    """(lang, classes, words, counts, n_words): the histograms of each language of ``docs``.

    ``words`` are its most frequent ones (ties: the smaller word), ``counts`` theirs and
    last that of all other words. A null language is none.
    """
    texts = _texts(docs, text, lang).filter("_lang IS NOT NULL")
    said = texts.select("_lang", F.explode(word_list(F.col("_text"))).alias("word"))
    counts = pin(said.groupBy("_lang", "word").agg(F.count("*").alias("n")))
    totals = counts.groupBy("_lang").agg(F.sum("n").alias("n_words")).filter(F.col("n_words") >= least)
    order = Window.partitionBy("_lang").orderBy(F.col("n").desc(), "word")
    best = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= common)
    best = best.groupBy("_lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("best"))
    # each different word is taken apart once, however often it is said
    sums = F.array(*[F.sum(F.get("_classes", F.lit(k)) * F.col("n")) for k in range(len(CLASSES))])
    classes = with_classes(counts, "word").groupBy("_lang").agg(sums.alias("classes"))
    others = F.col("n_words") - F.aggregate("best.n", F.lit(0).cast("long"), lambda a, n: a + n)
    return pin(
        totals.join(best, "_lang")
        .join(classes, "_lang")
        .select(
            F.col("_lang").alias("lang"), "classes", F.col("best.word").alias("words"),
            F.concat("best.n", F.array(others)).alias("counts"), "n_words",
        )
    )


def _share(histogram: Column) -> Column:
    def shared(counts):
        total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, n: a + n)
        return bound(F.greatest(total, F.lit(1)), lambda t: F.transform(counts, lambda n: n / t))

    return bound(histogram, shared)


def distance(one: Column, other: Column) -> Column:
    """Jensen-Shannon distance of two histograms (arrays of counts) of the same bins; null without one."""

    def part(p, mean):
        return F.when(p > 0, p * F.log2(p / mean)).otherwise(F.lit(0.0))

    each = F.zip_with(
        _share(one), _share(other), lambda p, q: (part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2
    )
    total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.when(total < 0, F.lit(0.0)).otherwise(total))


def common_counts(hashes: Column, common: Column) -> Column:
    """How often each word of ``common`` is in the list, and last how many words are none of them.

    Both are given as hashes.
    """

    def counted(found: Column) -> Column:
        each = F.transform(
            F.sequence(F.lit(1).cast("long"), F.size(common).cast("long")),
            lambda k: (F.size(found) - F.size(F.array_remove(found, k))).cast("long"),
        )
        return F.concat(each, F.array((F.size(hashes) - F.size(found)).cast("long")))

    places = F.transform(hashes, lambda w: F.array_position(common, w))
    return bound(F.filter(places, lambda at: at > 0), counted)


def quality(
    docs: DataFrame,
    known: DataFrame,
    text: str = "text",
    lang: str = "lang",
    class_chars: int = CLASS_CHARS,
    class_distance: float = CLASS_DISTANCE,
    common_length: int = COMMON_LENGTH,
    common_distance: float = COMMON_DISTANCE,
) -> DataFrame:
    """``docs`` with a struct ``quality`` of what the rules say of each row.

    Its fields: n_words, word_chars (code points in words), n_symbols (of ``#*$%&|<>``),
    n_dup_lines (lines with a word that equal an earlier line), n_repeat_words (words in
    8-word windows that the text has twice or more), base_failed (fewer than 20 words, or
    over 30 % repeated), class_distance and common_distance (null where the text is
    too short or its language is no reference), kept.

    ``known`` comes from :func:`references`. Null text is empty: no words, so it fails. A
    null or unknown language leaves the counts alone to judge. Rows are judged one by one,
    so ids may repeat or be null; other columns stay as they are. An empty table gives none.
    """
    rules = known.select(
        F.col("lang").alias("_lang"), F.col("classes").alias("_reference"),
        word_hashes(F.col("words")).alias("_common"), F.col("counts").alias("_counts"),
    )
    mine = docs.select(
        F.struct(*docs.columns).alias("_row"),
        F.col(lang).alias("_lang"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"),
    )
    rows = with_classes(mine.join(rules, "_lang", "left"), "_text")
    rows = rows.withColumn("_hashes", word_hashes(word_list(F.col("_text"))))
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    n_words = F.size("_hashes").cast("long")
    facts = rows.select(
        "_row",
        n_words.alias("n_words"),
        (F.char_length("_text") - F.col("_spaces")).alias("word_chars"),
        F.regexp_count("_text", F.lit(f"[{_SYMBOLS}]")).cast("long").alias("n_symbols"),
        bound(lines, lambda found: F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_hashes")).alias("n_repeat_words"),
        distance(F.col("_classes"), F.col("_reference")).alias("class_distance"),
        F.when(n_words >= common_length, distance(common_counts(F.col("_hashes"), F.col("_common")), F.col("_counts")))
        .alias("common_distance"),
    )
    facts = facts.withColumn(
        "class_distance", F.when(F.col("word_chars") >= class_chars, F.col("class_distance"))
    ).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    far = F.coalesce(F.col("class_distance") > class_distance, F.lit(False)) | F.coalesce(
        F.col("common_distance") > common_distance, F.lit(False)
    )
    facts = facts.withColumn("kept", ~F.col("base_failed") & ~far)
    return facts.select("_row.*", F.struct(*[c for c in facts.columns if c != "_row"]).alias("quality"))


def op13_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    judged = quality(docs, references(docs))
    return judged.select(
        "doc_id",
        *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "quality.base_failed",
        "quality.kept",
    )


SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS id, doc_id, lang, coalesce(text, '') AS text FROM documents),
cut AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    regexp_replace(text, '[a-z]', '', 'g') AS r0, regexp_replace(r0, '[A-Z]', '', 'g') AS r1,
    regexp_replace(r1, '[\x20\x09-\x0D]', '', 'g') AS r2, regexp_replace(r2, '[0-9]', '', 'g') AS r3,
    regexp_replace(r3, '[.,;:!?''"()-]', '', 'g') AS r4, regexp_replace(r4, '[\x00-\x7F]', '', 'g') AS r5
  FROM t),
facts AS (
  SELECT id, doc_id, lang, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    [length(text) - length(r0), length(r0) - length(r1), length(r2) - length(r3),
     length(r3) - length(r4), length(r4) - length(r5), length(r5)] AS classes
  FROM cut),
said AS (
  SELECT id, lang, unnest(words) AS word, unnest(range(len(words))) AS pos FROM cut),
windows AS (
  SELECT id, pos, word || chr(10) || string_agg(word, chr(10)) OVER (
      PARTITION BY id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND {WIDTH - 1} FOLLOWING) AS w,
    count(*) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WIDTH - 1} FOLLOWING) AS k
  FROM said),
twice AS (
  SELECT id, pos FROM (SELECT id, pos, count(*) OVER (PARTITION BY id, w) AS k FROM windows WHERE k = {WIDTH})
  WHERE k > 1),
repeats AS (
  SELECT id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT id, pos + unnest(range({WIDTH})) AS p FROM twice) GROUP BY id),
counted AS (SELECT lang, word, count(*) AS n FROM said WHERE lang IS NOT NULL GROUP BY lang, word),
best AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank,
    sum(n) OVER (PARTITION BY lang) AS total FROM counted
  QUALIFY rank <= {COMMON_WORDS} AND total >= {REFERENCE_WORDS}),
bins AS (
  SELECT lang, rank, n / total AS q FROM best
  UNION ALL SELECT lang, 0, (any_value(total) - sum(n)) / any_value(total) FROM best GROUP BY lang),
own AS (
  SELECT id, coalesce(b.rank, 0) AS rank, count(*) AS n
  FROM said s LEFT JOIN best b ON s.lang = b.lang AND s.word = b.word GROUP BY 1, 2),
common AS (
  SELECT f.id, b.q AS q, coalesce(o.n, 0) / f.n_words AS p
  FROM facts f JOIN bins b ON f.lang = b.lang LEFT JOIN own o ON o.id = f.id AND o.rank = b.rank
  WHERE f.n_words >= {COMMON_LENGTH}),
class_sums AS (
  SELECT f.lang, u.k AS k, sum(f.classes[u.k]) AS n
  FROM facts f, (SELECT unnest(range(1, 7)) AS k) u
  WHERE f.lang IN (SELECT lang FROM best) GROUP BY 1, 2),
class AS (
  SELECT f.id, s.n / sum(s.n) OVER (PARTITION BY f.id) AS q,
    f.classes[s.k] / greatest(list_sum(f.classes), 1) AS p
  FROM facts f JOIN class_sums s ON f.lang = s.lang WHERE f.word_chars >= {CLASS_CHARS}),
far AS (
  SELECT id, 'class' AS what, sqrt(greatest(0, sum(
    CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
    + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS d FROM class GROUP BY id
  UNION ALL
  SELECT id, 'common', sqrt(greatest(0, sum(
    CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
    + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) FROM common GROUP BY id),
judged AS (
  SELECT id, bool_or(d > CASE what WHEN 'class' THEN {CLASS_DISTANCE} ELSE {COMMON_DISTANCE} END) AS far
  FROM far GROUP BY id),
base AS (
  SELECT f.*, coalesce(r.n_repeat_words, 0) AS n_repeat_words, coalesce(j.far, false) AS far,
    f.n_words < 20 OR 100 * coalesce(r.n_repeat_words, 0) > 30 * f.n_words AS base_failed
  FROM facts f LEFT JOIN repeats r USING (id) LEFT JOIN judged j USING (id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT far AS kept
FROM base
"""

QUERIES = {"op13_quality_rules": (op13_quality_rules, SQL)}
