"""Source divergence audit: how far the sources of a language differ in the terms they use.

Terms are counted per (lang, source) inside tasks and then summed by Spark. What a term adds
to a group's report depends only on its two counts, in the group and in the language, so the
terms of a group are gathered into cells (group count, language count): the score is worked
out per cell, equal scores are merged, the cumulative number of terms of the larger scores
says which cells can reach the report, and only their terms are expanded and ordered.

Pairs of sources compare whole vectors. A language's sources are cut into blocks and its terms
into slices; a task holds one slice of two blocks at a time, and the slices' sums are added.
All numbers are integers, so nothing depends on the order of the additions.
"""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.pin import pin
from .common import as_bytes, by_size, sorted_groups

#: A term is kept in a language if it is in so many of its documents.
LEAST_DOCS = 30
#: Added to every count before shares are taken; shares are counted in units of 1 / SCALE.
PSEUDO, SCALE = 5, 1_000_000_000
#: Ranks of the terms that are reported for each group.
TOP = 50
#: Sources in a block, and terms in a slice (on average), of the pairs.
BLOCK, SLICE = 128, 1024
#: A task passes its counts on when it holds so many of them.
HELD_TERMS = 200_000

_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_COUNTED = pa.schema(
    [("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())]
)
_SUMS = pa.schema(
    [("lang", pa.string()), *((c, pa.int64()) for c in ("one", "other", "total", "terms", "apart", "n_terms"))]
)


def _counted(batches):
    """Per (lang, source): the terms with their occurrences and documents, and a row without a term."""
    held, size = {}, 0

    def passed_on():
        for (lang, source), terms in held.items():
            said = [None, *(t.decode() for t in terms)]
            rows = len(said)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang.decode()] * rows, pa.string()),
                    pa.array([source.decode()] * rows, pa.string()),
                    pa.array(said, pa.string()),
                    pa.array([0, *(n for n, _ in terms.values())], pa.int64()),
                    pa.array([0, *(d for _, d in terms.values())], pa.int64()),
                ],
                schema=_COUNTED,
            )

    for batch in by_size(batches):
        texts, langs, sources = (as_bytes(batch.column(c)) for c in ("text", "lang", "source"))
        for lang, source, text in zip(langs, sources, texts, strict=True):
            if (lang, source) not in held:
                held[lang, source] = {}
                size += 1
            terms = held[lang, source]
            before = len(terms)
            for term, n in Counter(_TERM.findall(text.lower())).items():
                got = terms.get(term)
                if got is None:
                    terms[term] = [n, 1]
                else:
                    got[0] += n
                    got[1] += 1
            size += len(terms) - before
            if size > HELD_TERMS:
                yield from passed_on()
                held, size = {}, 0
    yield from passed_on()


def count_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs), and for each group one row with a null term; null reads as ''."""
    rows = docs.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))]
    )
    found = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PSEUDO) / (total + PSEUDO * terms)), exact for all longs."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + PSEUDO).cast("decimal(20,0)")
    return 1 + F.call_function("div", above, (total + PSEUDO * terms).cast("decimal(20,0)"))


class Kept:
    """The kept terms of a table of counts, written once.

    ``cells``: lang, source, term, number (of the term), n, n_lang of the terms that each
    group has. ``groups``: lang, source, place (from 0 in its language, in order), n_sources,
    total (the sum of n), n_terms and lang_total of the language.
    """

    def __init__(self, counts: DataFrame, least_docs: int = LEAST_DOCS):
        said = counts.filter("term IS NOT NULL")
        terms = said.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs"))
        terms = terms.filter(F.col("docs") >= least_docs).drop("docs")
        terms = pin(terms.withColumn("number", F.monotonically_increasing_id()))
        self.cells = pin(said.drop("docs").join(terms, ["lang", "term"]))
        langs = terms.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("n_lang").alias("lang_total"))
        totals = self.cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        of_lang = Window.partitionBy("lang")
        self.groups = pin(
            counts.select("lang", "source")
            .distinct()
            .withColumn("place", F.row_number().over(of_lang.orderBy("source")).cast("long") - 1)
            .join(totals, ["lang", "source"], "left")
            .join(langs, "lang", "left")
            .na.fill(0, ["total", "n_terms", "lang_total"])
            .withColumn("n_sources", F.max(F.col("place") + 1).over(of_lang))
        )


def top_terms(kept: Kept, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the terms whose share of a group most exceeds the language's."""
    of_group = share(F.col("n"), F.col("total"), F.col("n_terms"))
    of_lang = share(F.col("n_lang"), F.col("lang_total"), F.col("n_terms"))
    cells = (
        kept.cells.groupBy("lang", "source", "n", "n_lang")
        .agg(F.count("*").alias("terms"))
        .join(kept.groups, ["lang", "source"])
        .withColumn("value", of_group - of_lang)
        .filter("value > 0")
    )
    cells = pin(cells.select("lang", "source", "n", "n_lang", "value", "terms"))
    larger = Window.partitionBy("lang", "source").orderBy(F.col("value").desc())
    values = cells.groupBy("lang", "source", "value").agg(F.sum("terms").alias("terms"))
    # each value has a term, so those past the top-th can't be in; this is cut before the shuffle
    values = values.withColumn("place", F.row_number().over(larger)).filter(F.col("place") <= top)
    before = F.sum("terms").over(larger.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("terms")
    reach = values.withColumn("before", before).filter(F.col("before") < top)
    reach = cells.join(reach.select("lang", "source", "value"), ["lang", "source", "value"], "left_semi")
    expanded = kept.cells.join(reach.drop("terms"), ["lang", "source", "n", "n_lang"])
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "term"))
    return (
        expanded.select("lang", "source", F.col("term").alias("item"), "value", "term")
        .withColumn("rank", rank)
        .filter(F.col("rank") <= top)
        .drop("term")
    )


def _pair_sums(batches):
    """For each slice of the terms of two blocks: how far each two of their sources are apart in it."""
    for rows in sorted_groups(batches, ["lang", "slice", "low", "high"]):
        lang, low, high, n_terms = (rows.column(c)[0].as_py() for c in ("lang", "low", "high", "n_terms"))
        block, place, p, p_none = (rows.column(c).to_numpy() for c in ("block", "place", "p", "p_none"))
        number = rows.column("number").to_numpy()
        said = p > 0
        terms = np.unique(number[said])
        held = []
        for which in (low, high):
            here = block == which
            places, first = np.unique(place[here], return_index=True)
            none = p_none[here][first]
            shares = np.repeat(none[:, None], len(terms), axis=1)
            real = here & said
            shares[np.searchsorted(places, place[real]), np.searchsorted(terms, number[real])] = p[real]
            held.append((places, none, shares))
        (ones, none_of_one, left), (others, none_of_other, right) = held
        for one, none, shares in zip(ones, none_of_one, left, strict=True):
            after = others > one
            if after.any():
                k = int(after.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * k, pa.string()),
                        pa.array(np.full(k, one)),
                        pa.array(others[after]),
                        pa.array(np.abs(right[after] - shares).sum(axis=1)),
                        pa.array(np.full(k, len(terms))),
                        pa.array(np.abs(none_of_other[after] - none)),
                        pa.array(np.full(k, n_terms)),
                    ],
                    schema=_SUMS,
                )


def source_pairs(kept: Kept, block: int = BLOCK, per_slice: int = SLICE) -> DataFrame:
    """(lang, source, item, value, rank): how far each other source of the language is, farthest first.

    Every two sources of a language are a row of the result, in both directions. Each slice
    of a language's terms meets every source once, by its terms there or by a row without
    any; terms that neither block has are counted at the end.
    """
    none = F.when(F.col("n_terms") > 0, share(F.lit(0), F.col("total"), F.col("n_terms"))).otherwise(F.lit(0))
    slices = F.greatest(F.lit(1), F.ceil(F.col("n_terms") / per_slice)).cast("long")
    groups = kept.groups.select(
        "lang", "source", "place", "total", "n_terms", none.alias("p_none"), slices.alias("slices"),
        F.floor(F.col("place") / block).alias("block"),
        F.ceil(F.col("n_sources") / block).cast("long").alias("blocks"),
    )
    rows = kept.cells.join(groups, ["lang", "source"]).withColumn(
        "p", share(F.col("n"), F.col("total"), F.col("n_terms"))
    )
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("number"), "slices"))
    # p = 0: no term, the source takes part in the slice
    every = groups.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    every = every.withColumn("number", F.lit(0).cast("long")).withColumn("p", F.lit(0).cast("long"))
    columns = ["lang", "slice", "block", "blocks", "place", "number", "p", "p_none", "n_terms"]
    rows = rows.select(*columns).unionByName(every.select(*columns))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    key = ["lang", "slice", "low", "high"]
    rows = rows.select(
        "lang", "slice", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"),
        "block", "place", "number", "p", "p_none", "n_terms",
    )
    rows = rows.repartition(*key).sortWithinPartitions(*key)
    sums = rows.mapInArrow(
        _pair_sums, "lang string, one long, other long, total long, terms long, apart long, n_terms long"
    )
    value = F.sum("total") + (F.max("n_terms") - F.sum("terms")) * F.max("apart")
    sums = pin(sums.groupBy("lang", "one", "other").agg(value.alias("value")))
    both = sums.unionByName(sums.select("lang", F.col("one").alias("other"), F.col("other").alias("one"), "value"))
    names = kept.groups.select("lang", "source", "place")
    both = both.join(names.select("lang", "source", F.col("place").alias("one")), ["lang", "one"]).join(
        names.select("lang", F.col("source").alias("item"), F.col("place").alias("other")), ["lang", "other"]
    )
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return both.select("lang", "source", "item", "value").withColumn("rank", rank)


def divergence(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    least_docs: int = LEAST_DOCS,
    top: int = TOP,
) -> DataFrame:
    """(lang, source, part, item, value, rank): the report of every (lang, source) of ``docs``.

    Part ``pair`` ranks the other sources of the language by the sum of the differences of
    all kept terms' shares; part ``term`` the ``top`` kept terms that the group has and that
    have a larger share in it than in the language. Ranks go by value, largest first, then
    by the item's UTF-8 bytes.

    Null text, lang and source read as ''. A group without any term is one like others: all
    its counts are 0. A language without kept terms has pairs of value 0 and no terms. A
    row counts as often as it is repeated, ids are not looked at, other columns neither. An
    empty table gives no rows.
    """
    kept = Kept(pin(count_terms(docs, text, lang, source)), least_docs)
    parts = (("pair", source_pairs(kept)), ("term", top_terms(kept, top)))
    pairs, terms = (
        part.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
        for name, part in parts
    )
    return pairs.unionByName(terms)


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
groups AS (SELECT DISTINCT lang, source FROM d),
said AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
kept AS (
  SELECT lang, term, count(*) AS n_lang FROM said GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(n_lang) AS total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM said JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + {PSEUDO})) // (coalesce(t.total, 0) + {PSEUDO} * l.v) AS p,
    1 + ({SCALE}::HUGEINT * (k.n_lang + {PSEUDO})) // (l.total + {PSEUDO} * l.v) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM shares WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= {TOP}
"""

QUERIES = {"op12_source_divergence": (op12_source_divergence, SQL)}
