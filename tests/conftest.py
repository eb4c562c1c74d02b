import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def values(df, *columns):
    """All rows, in a stable order."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def apply(spark, function, texts, kind="string"):
    """A column function over a list of values."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(list(enumerate(texts)), f"i int, c {kind}")
    picked = rows.select("i", function(F.col("c")).alias("v")).collect()
    return [r.v for r in sorted(picked)]
