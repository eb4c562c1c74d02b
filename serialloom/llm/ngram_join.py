"""Near duplicates: documents whose 5-word shingle sets have a Jaccard of 0.75 or more.

1. Each text becomes a set of 64-bit shingles; texts with one set are one class.
2. Two linked sets share at least l tokens among the first ``n - ceil(t n) + l`` of each,
   in any order of all tokens that is the same for both (prefix filter). The order here
   puts tokens found frequent last, then goes by hash; l grows with n. So classes are
   grouped by the tokens of their prefixes; a token that only one class has there is left,
   and so is a class with fewer shared tokens than l for its smallest possible partner.
3. Groups are searched with signature trees (``signature_tree``), in two rounds. The first
   puts each class into one group only, which finds most links. The second takes all groups
   in which more than one component is left, so no link is lost. Groups are cut into zones
   of sizes that can link; groups of one zone that share classes are one bundle, and a
   bundle is searched at once, or by its groups where that is less work. Large ones are cut
   into chunks, and every chunk meets every other one.
4. The links' components give each document its class id.

Nothing here holds an unbounded group: a task holds one chunk or a pair of them.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.pin import pin, scratch
from .common import Known, as_bytes, by_size, numbered_rows, pick_rows, sorted_groups, trimmed, words
from .components import components
from .signature_tree import links

WORDS, PERCENT = 5, 75
#: Classes that one chunk of a group holds on average.
CHUNK = 4096
#: Frequent tokens are an order, not a filter: more or fewer change no result.
FREQUENT_SHARE, FREQUENT_MOST = 0.001, 200_000

#: Tasks that the rows of one frequent token go to.
SPREAD = 64
#: The l of the prefix filter: one, and so many hundredths of a set.
EXTRA = 10

_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes, known: Known, width: int = WORDS) -> np.ndarray:
    """The sorted set of a text's shingles as 64-bit hashes (int64)."""
    got = words(text)
    if not got:
        return np.empty(0, np.int64)
    h = np.fromiter(map(known.__getitem__, got), np.uint64, len(got))
    n = max(1, len(h) - width + 1)
    total = np.full(n, min(len(h), width), np.uint64)
    for i in range(min(width, len(h))):
        total = total * _MIX[0] + h[i : i + n]
        total ^= total >> np.uint64(29)
    return np.unique(_mixed(total).view(np.int64))


def _known() -> Known:
    return Known(xxhash.xxh3_64_intdigest)


def _facts(percent: int, width: int):
    """Rows of documents (row_id, n, digest), and rows of tokens frequent in a batch (token, times)."""

    def run(batches):
        known = _known()
        for batch in batches:
            sets = [shingles(t, known, width) for t in as_bytes(batch.column("text"))]
            if not sets:
                continue
            tokens, times = np.unique(np.concatenate(sets), return_counts=True)
            often = times >= max(8, len(sets) * FREQUENT_SHARE * 2)
            tokens, times = tokens[often], times[often]
            digests = [xxhash.xxh3_128_digest(s) for s in sets]
            gap, m = len(tokens), len(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([batch.column("row_id"), pa.nulls(gap, pa.int64())]),
                    pa.array([len(s) for s in sets] + [None] * gap, pa.int64()),
                    pa.array([int.from_bytes(d[:8], "little", signed=True) for d in digests] + [None] * gap, pa.int64()),
                    pa.array([int.from_bytes(d[8:], "little", signed=True) for d in digests] + [None] * gap, pa.int64()),
                    pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(tokens, pa.int64())]),
                    pa.array([None] * m + times.tolist(), pa.int64()),
                ],
                ["row_id", "n", "d1", "d2", "token", "times"],
            )

    return run


def _prefixes(percent: int, width: int, frequent):
    """(token, spread, row_id) of the tokens by which a set is grouped.

    spread deals the rows of a frequent token out to several tasks; else it is -1.
    """

    def run(batches):
        known, often = _known(), frequent.value
        for batch in by_size(batches):
            tokens, spread, rows = [], [], []
            for row, text in zip(batch.column("row_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                s = shingles(text, known, width)
                n = len(s)
                if not n:
                    continue
                late = np.zeros(n, bool)
                if len(often):
                    at = np.searchsorted(often, s)
                    at[at == len(often)] = 0
                    late = often[at] == s
                order = np.argsort(late, kind="stable")[: n + (-percent * n) // 100 + 1 + EXTRA * n // 100]
                tokens.append(s[order])
                spread.append(np.where(late[order], row % SPREAD, -1))
                rows.append(np.full(len(order), row))
            empty = [np.empty(0, np.int64)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x + empty), pa.int64()) for x in (tokens, spread, rows)],
                ["token", "spread", "row_id"],
            )

    return run


def _neighbours(batches):
    """Rows, sorted by token, whose token another row has, and all of frequent tokens."""
    held = None  # the last row, and whether one before has its token
    for batch in batches:
        if not batch.num_rows:
            continue
        token, spread, row = (batch.column(c).to_numpy() for c in ("token", "spread", "row_id"))
        if held is not None:
            token, spread, row = (np.concatenate([[h], x]) for h, x in zip(held[:3], (token, spread, row), strict=True))
        same = token[1:] == token[:-1]
        met = (spread >= 0) | np.concatenate([[held is not None and held[3]], same]) | np.concatenate([same, [False]])
        last = len(token) - 1
        held = (token[last], spread[last], row[last], met[last])
        yield _hits(token[:last][met[:last]], row[:last][met[:last]])
    if held is not None and held[3]:
        yield _hits(np.array([held[0]]), np.array([held[2]]))


def _hits(token: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(token, pa.int64()), pa.array(row, pa.int64())], ["token", "row_id"])


def _met(rows: DataFrame) -> DataFrame:
    """Tokens of more than one row."""
    return rows.groupBy("token").agg(F.count("*").alias("k")).filter("k > 1").select("token")


def _open(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Groups in which more than one component is left."""
    ends = rows.groupBy(F.struct(*keys).alias("g")).agg(F.min("component").alias("a"), F.max("component").alias("b"))
    return ends.filter("a <> b").select("g.*")


def _sets(width: int):
    def run(batches):
        known = _known()
        for batch in by_size(batches):
            sets = [shingles(t, known, width).tobytes() for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(sets, pa.binary())], ["row_id", "tokens"])

    return run


def _tree_links(percent: int):
    """Links inside each group of rows with one (token, one, two); two is -1 where a chunk meets itself."""

    def run(batches):
        out: list[tuple[int, int]] = []
        for rows in sorted_groups(batches, ["token", "one", "two"]):
            if rows.num_rows < 2:
                continue
            ids = rows.column("row_id").to_pylist()
            sets = [np.frombuffer(x, np.int64) for x in rows.column("tokens").to_pylist()]
            groups = rows.column("component").to_numpy()
            cross = rows.column("other").to_numpy(zero_copy_only=False) if rows.column("two")[0].as_py() >= 0 else None
            out += _stars(ids, links(sets, groups, percent, cross))
            if len(out) > 10_000:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    return run


def _stars(ids: list[int], found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Each linked row with the first row that its links reach; short paths join quickly."""
    head = list(range(len(ids)))

    def first(i: int) -> int:
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    for i, j in found:
        a, b = sorted((first(i), first(j)))
        head[b] = a
    return [(ids[i], ids[first(i)]) for i in {i for pair in found for i in pair} if first(i) != i]


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"]
    )


def _search(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) found in the groups of rows (token, one, two, other, row_id, component)."""
    full = rows.join(sets, "row_id")
    dealt = full.repartition("token", "one", "two").sortWithinPartitions("token", "one", "two", "row_id")
    wanted = dealt.select("token", "one", "two", "other", "row_id", "component", "tokens")
    return wanted.mapInArrow(trimmed(_tree_links(percent)), "a long, b long")


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    percent: int = PERCENT,
    width: int = WORDS,
    chunk: int = CHUNK,
    row_id: str | None = None,
) -> DataFrame:
    """One row per document: row_id, doc_id, n_shingles, component_id, kept.

    ``docs`` needs doc_id and ``text``; ``row_id`` may name a column of its own that numbers
    the rows (see ``with_row_id``). Words are what ASCII white space separates, A-Z lower-cased; a text of fewer words than ``width``
    is one shingle. Two documents link when the intersection of their sets is at least
    ``percent`` of the union. component_id is the smallest doc_id that links reach, and the
    first row with it is the one kept of the component. A null
    or empty text, or one without words, has an empty set and its own doc_id, and is kept;
    rows with one doc_id are rows of their own; a null doc_id comes last. An empty table gives no rows; further columns are ignored.
    """
    docs = numbered_rows(docs, text, row_id)
    texts = docs.select("row_id", "text")
    both = pin(
        texts.mapInArrow(
            trimmed(_facts(percent, width)), "row_id long, n long, d1 long, d2 long, token long, times long"
        )
    )
    facts = both.filter("row_id IS NOT NULL").select("row_id", "n", "d1", "d2")
    n_docs = facts.count()
    often = (
        both.filter("token IS NOT NULL")
        .groupBy("token")
        .agg(F.sum("times").alias("times"))
        .filter(F.col("times") >= max(16, FREQUENT_SHARE * n_docs))
        .orderBy(F.desc("times"), "token")
        .limit(FREQUENT_MOST)
        .select("token")
        .toPandas()["token"]
        .to_numpy(np.int64)
    )
    frequent = docs.sparkSession.sparkContext.broadcast(np.sort(often))

    ids = docs.select("row_id", "doc_id")
    classes = (
        facts.join(ids, "row_id")
        .groupBy(F.struct("d1", "d2").alias("d"))
        .agg(
            F.min("row_id").alias("row_id"),
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")).alias("best"),
            F.first("n").alias("n"),
        )
        .select("d.d1", "d.d2", "row_id", "best", "n")
    )
    classes = pin(classes)
    # of what leads to a result only that stays, since these tables are large
    with scratch(docs.sparkSession) as outside:
        one_each = pin(classes.filter("n > 0").select("row_id"))
        prefixes = pick_rows(texts, one_each, "left_semi").mapInArrow(
            trimmed(_prefixes(percent, width, frequent)), "token long, spread long, row_id long"
        )
        hits = pin(
            prefixes.repartition("token", "spread").sortWithinPartitions("token").mapInArrow(
                trimmed(_neighbours), "token long, row_id long"
            )
        )
        frequent.destroy()
        least = 1 + F.floor(EXTRA * F.ceil(percent * F.col("n") / 100) / 100)
        shared = hits.groupBy("row_id").agg(F.count("*").alias("k"))
        live = shared.join(classes.select("row_id", "n"), "row_id").filter(F.col("k") >= least).select("row_id")
        hits = pin(hits.join(live, "row_id").select("row_id", "token"))
        grouped = pin(hits.join(_met(hits), "token"), outside)
    sets = pin(
        pick_rows(texts, pin(grouped.select("row_id").distinct()), "left_semi").mapInArrow(
            trimmed(_sets(width)), "row_id long, tokens binary"
        )
    )

    first = grouped.groupBy("row_id").agg(F.min("token").alias("token"))
    size = first.groupBy(F.struct("token").alias("g")).agg(F.count("*").alias("m")).filter("m > 1")
    first = first.join(size.select("g.token", "m"), "token")
    ways = F.explode(F.when(F.col("m") > chunk, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    # a group too large for one chunk is cut in two ways, which connects its chunks
    first = first.select("token", "row_id", "m", ways.alias("way")).select(
        "token",
        (F.pmod(F.xxhash64("row_id", "way"), F.ceil(F.col("m") / chunk)) * 2 + F.col("way")).cast("int").alias("one"),
        F.lit(-1).alias("two"),
        F.lit(False).alias("other"),
        "row_id",
        F.col("row_id").alias("component"),
    )
    found = pin(_search(first, sets, percent))
    known = components(found).withColumnRenamed("node", "row_id")

    with scratch(docs.sparkSession) as outside:
        labelled = pin(
            grouped.join(known, "row_id", "left").select(
                "token", "row_id", F.coalesce("component", "row_id").alias("component")
            )
        )
        # sizes of a linked pair differ by a factor of 100 / percent at most: one zone, or the next
        step = F.floor(F.log("n") / F.log(F.lit(101.0 / percent))).cast("int")
        zones = pin(
            labelled.select("row_id").distinct().join(classes, "row_id").select("row_id", least.alias("least"), step.alias("step"))
        )
        still = labelled.join(_open(labelled, ["token"]), "token").join(zones, "row_id")
        still = still.select(
            "token", F.explode(F.array("step", F.col("step") - 1)).alias("zone"), "row_id", "component", "least"
        )
        for _ in range(2):  # each time, groups that are open no more take classes with them, and the reverse
            still = pin(still.join(_open(still, ["token", "zone"]), ["token", "zone"]))
            enough = still.groupBy("row_id", "zone", "least").agg(F.count("*").alias("k")).filter(F.col("k") >= F.col("least"))
            still = still.join(enough.select("row_id", "zone"), ["row_id", "zone"])
        node = F.xxhash64("row_id", "zone")
        still = pin(still.withColumn("node", node))
        groups = still.groupBy(F.struct("token", "zone").alias("g")).agg(F.count("*").alias("m"), F.min("node").alias("head"))
        still = pin(still.join(groups.select("g.token", "g.zone", "m", "head"), ["token", "zone"]))
        bundles = components(still.select(F.col("node").alias("a"), F.col("head").alias("b")))
        still = pin(still.join(bundles.select("node", F.col("component").alias("bundle")), "node"), outside)
    by_group = still.select("bundle", "token", "zone", "m").distinct().groupBy("bundle")
    by_group = by_group.agg(F.sum(F.col("m") * F.ceil(F.col("m") / chunk)).alias("by_group"))
    members = still.select("bundle", "row_id", "component").distinct()
    whole = members.groupBy("bundle").agg(F.count("*").alias("size")).join(by_group, "bundle")
    whole = pin(whole.withColumn("at_once", F.col("size") * F.ceil(F.col("size") / chunk) <= F.col("by_group")))
    searched = (
        members.join(whole.filter("at_once"), "bundle")
        .select(F.col("bundle").alias("token"), "row_id", "component", F.col("size").alias("m"))
        .unionByName(
            still.join(whole.filter("NOT at_once"), "bundle").select(
                F.xxhash64("token", "zone").alias("token"), "row_id", "component", "m"
            )
        )
        .withColumn("chunks", F.ceil(F.col("m") / chunk).cast("int"))
        .withColumn("mine", F.pmod(F.xxhash64("row_id"), F.col("chunks")).cast("int"))
    )
    met = searched.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("its")).select(
        "token",
        F.least("mine", "its").alias("one"),
        F.when(F.col("mine") == F.col("its"), -1).otherwise(F.greatest("mine", "its")).alias("two"),
        (F.col("mine") > F.col("its")).alias("other"),
        "row_id",
        "component",
    )
    more = _search(met, sets, percent)
    edges = pin(found.unionByName(more))
    final = components(edges).withColumnRenamed("node", "row_id")

    named = pin(classes.join(final, "row_id", "left").withColumn("component", F.coalesce("component", "row_id")))
    smallest = named.groupBy("component").agg(F.min("best").alias("best"))
    to_class = named.drop("best").join(smallest, "component").select(
        "d1", "d2", F.col("best.doc_id").alias("component_id"), F.col("best.row_id").alias("keep_row")
    )
    rows = facts.join(ids, "row_id").join(to_class, ["d1", "d2"])
    return rows.select(
        "row_id",
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        ((F.col("n") == 0) | (F.col("row_id") == F.col("keep_row"))).alias("kept"),
    )


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).drop("row_id", "kept")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []
    WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (shingle)
      WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
      WHERE 100 * k >= 75 * (nx.n + ny.n - k)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach(start, node) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT start, y FROM reach JOIN both_ways ON node = x)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(node) AS component_id
FROM documents d JOIN reach ON start = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
GROUP BY d.doc_id
"""

QUERIES = {"op1_ngram_join": (op1_ngram_join, SQL)}
