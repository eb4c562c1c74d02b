"""Materialise an intermediate table that several outputs share."""

import tempfile
from contextlib import contextmanager
from contextvars import ContextVar
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

#: Where tables are pinned while a scratch folder is open.
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, a folder that all executors share.

    Only a local session without one gets a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="shared-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def pin(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the rows as a Parquet table in the shared folder and read that instead.

    This cuts the lineage, and unlike a checkpoint of rows it keeps column
    pruning and real sizes for what is built on it.
    """
    folder = folder or _scratch.get() or shared_folder(df.sparkSession)
    path = f"{folder}/pinned-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Tables pinned inside are removed at the end.

    What is to outlast them must be written before that, to a folder that is named: the
    value here is the one that was used outside.
    """
    outside = _scratch.get() or shared_folder(spark)
    folder = f"{outside}/scratch-{uuid4().hex}"
    opened = _scratch.set(folder)
    try:
        yield outside
    finally:
        _scratch.reset(opened)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
