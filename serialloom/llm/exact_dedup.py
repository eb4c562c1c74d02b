"""Exact duplicates by deterministic block naming, in DataFrame functions only.

A normalised text is cut into blocks of a fixed number of bytes. The distinct blocks are
sorted and numbered, so a block becomes an integer name; then adjacent names are named
pairwise, level by level, until each document has one integer. Two documents have the
same (height, name) exactly if their normalised texts are the same: a name stands for
one block or one pair of names and nothing else, so there are no collisions.

Blocks find their names by a 64-bit hash, which keeps the bytes out of that join. Hashes
that two different blocks share are looked for each time; their blocks are named by a
join on the bytes themselves.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.pin import pin
from .common import SPACES, numbered_rows

BLOCK_BYTES = 2048
#: Stands where the last name of a document has no neighbour; no name has this value.
NONE = -(2**63)


def _blocks(docs: DataFrame, text: str, block_bytes: int, hash_of) -> DataFrame:
    """row_id, doc_id, original, body (normalised bytes) and blocks: array of (h, block)."""
    original = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select("row_id", "doc_id", original.alias("original")).withColumn(
        "body", F.regexp_replace("original", SPACES, "").cast("binary")
    )
    last = F.greatest(F.lit(0), F.ceil(F.octet_length("body") / block_bytes).cast("int") - 1)

    def block(i):
        return F.substring(F.col("body"), i * block_bytes + 1, F.lit(block_bytes))

    return rows.withColumn(
        "blocks",
        F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.struct(hash_of(block(i)).alias("h"), block(i).alias("block")),
        ),
    )


def _numbered(rows: DataFrame, by: str) -> DataFrame:
    """Distinct values of ``by``, sorted, each with an integer name of its own."""
    return (
        rows.select(by).distinct().sortWithinPartitions(by).withColumn("name", F.monotonically_increasing_id())
    )


def identities(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES, hash_of=F.xxhash64):
    """(facts, names): facts has row_id, doc_id, n_chars, text_sha256; names has row_id, height, name."""
    blocks = _blocks(docs, text, block_bytes, hash_of)
    facts = pin(
        blocks.select(
            "row_id",
            "doc_id",
            F.char_length("original").cast("long").alias("n_chars"),
            F.sha2("body", 256).alias("text_sha256"),
            F.transform("blocks", lambda b: b.h).alias("hashes"),
        )
    )
    # outer: else Spark infers a filter on the array, which makes it twice
    cut = blocks.select(F.explode_outer("blocks").alias("b")).select("b.h", "b.block").distinct()
    names = pin(
        cut.sortWithinPartitions("block").withColumn("name", F.monotonically_increasing_id()).select("h", "name")
    )
    shared = names.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1").select("h")
    clash = not shared.isEmpty()
    held = facts.select("row_id", F.size("hashes").alias("n"), F.posexplode("hashes").alias("pos", "h"))
    rows = held.join(names.join(shared, "h", "left_anti") if clash else names, "h")
    rows = rows.select("row_id", "n", "pos", "name")
    if clash:
        exact = (
            blocks.select("row_id", F.size("blocks").alias("n"), F.posexplode_outer("blocks").alias("pos", "b"))
            .select("row_id", "n", "pos", "b.h", "b.block")
            .join(shared, "h", "left_semi")
        )
        named = _numbered(exact, "block").select("block", (-1 - F.col("name")).alias("name"))
        rows = rows.unionByName(exact.join(named, "block").select("row_id", "n", "pos", "name"))
    rows = pin(rows)

    height, most = 0, facts.agg(F.max(F.size("hashes"))).first()[0] or 1
    done = [rows.filter("n = 1").select("row_id", F.lit(0).alias("height"), "name")]
    while most > 2**height:
        height += 1
        open_rows = rows.filter(F.col("n") > 2 ** (height - 1))
        pairs = open_rows.groupBy("row_id", "n", F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(NONE)).alias("right"),
        )
        pairs = pin(pairs)
        named = _numbered(pairs.select(F.struct("left", "right").alias("pair")), "pair")
        named = named.select("pair.left", "pair.right", "name")
        rows = pin(pairs.join(named, ["left", "right"]).select("row_id", "n", "pos", "name"))
        done.append(
            rows.filter(F.col("n") <= 2**height).select("row_id", F.lit(height).alias("height"), "name")
        )
    return facts.drop("hashes"), reduce(DataFrame.unionByName, done)


def exact_duplicates(docs: DataFrame, text: str = "text", row_id: str | None = None, **options) -> DataFrame:
    """One row per document: row_id, doc_id, keep_id, group_size, kept, text_sha256.

    ``docs`` needs doc_id and ``text``; ``row_id`` may name a column of its own that numbers
    the rows (see ``with_row_id``). Texts are equal when they are the same after all ASCII white space is deleted; a null text is an
    empty one. The row with the most code points stays, then the smallest doc_id (null
    last), then the first row of the table, so of rows repeated whole exactly one stays.
    An empty table gives no rows; other columns are not looked at.
    """
    facts, names = identities(numbered_rows(docs, text, row_id), "text", **options)
    rows = pin(facts.join(names, "row_id"))
    order = F.struct(
        (-F.col("n_chars")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("keep_id"),
        F.col("row_id").alias("keep_row"),
    )
    best = (
        rows.groupBy(F.struct("height", "name").alias("identity"))
        .agg(F.count("*").alias("group_size"), F.min(order).alias("best"))
        .select("identity.height", "identity.name", "group_size", "best.keep_id", "best.keep_row")
    )
    return rows.join(best, ["height", "name"]).select(
        "row_id",
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row_id") == F.col("keep_row")).alias("kept"),
        "text_sha256",
    )


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_duplicates(docs).drop("row_id")


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS original,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         row_number() OVER w AS rn, first_value(doc_id) OVER w AS keep_id
  FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(original) DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM r
"""

QUERIES = {"op4_exact_dedup": (op4_exact_dedup, SQL)}
