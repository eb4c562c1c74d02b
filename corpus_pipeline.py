"""The corpus pipeline: stages that each call one operator of ``serialloom.llm``.

Every stage gets the documents that the stages before it kept. All but the last return
documents with all their columns; the last returns the packed pieces.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serialloom.llm.common import batch_rows, free_name, pick_rows, with_row_id
from serialloom.llm.decontamination import contamination, judged
from serialloom.llm.exact_dedup import exact_duplicates
from serialloom.llm.language_id import accepted, learning_rows, train
from serialloom.llm.ngram_join import near_duplicates
from serialloom.llm.packing import packed_digest
from serialloom.plans.pin import pin, scratch

#: Rows of an Arrow batch; a worker holds few texts at a time, whatever stage it ran before.
BATCH_ROWS = 1_000


def _without(docs: DataFrame, dropped) -> DataFrame:
    """The documents but those that ``dropped`` gives the row numbers of. Only these and the
    numbered documents outlast it; what it pinned on the way is removed.

    ``dropped`` takes a table of row, doc_id and text, and the name of the row column.
    """
    spark, row = docs.sparkSession, free_name(docs, "pipeline_row")
    rows = with_row_id(docs, row)
    with batch_rows(spark, BATCH_ROWS), scratch(spark) as outside:
        found = dropped(rows.select(row, "doc_id", "text"), row)
        ids = pin(found.select(F.col("row_id").alias(row)), outside)
    return pick_rows(rows, ids, "left_anti", row).drop(row)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return accepted(docs, train(learning_rows(docs)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return _without(docs, lambda rows, row: exact_duplicates(rows, row_id=row).filter("NOT kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that near-duplicate links connect."""
    return _without(docs, lambda rows, row: near_duplicates(rows, row_id=row).filter("NOT kept"))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which less than a twentieth of the words repeats benchmark passages."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return _without(docs, lambda rows, row: judged(contamination(rows, bench, row_id=row)).filter("contaminated"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces with their places in sequences."""
    with batch_rows(spark, BATCH_ROWS):
        return packed_digest(docs.select("doc_id", "text"))


STAGES = [
    ("language ID", language),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("benchmark decontamination", uncontaminated),
    ("best-fit packing", packed),
]

#: SQL can't tokenise or find centroids; tests/llm checks the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = pin(stage(spark, docs, sf_dir))
    return docs
