import random

import pytest


SYLLABLES = "an ba co de er fi go hu in jo ka li mo nu on pa re sa ti un".split()


@pytest.fixture(scope="session")
def prose():
    """A maker of invented prose, the same each time."""

    def make(n, seed):
        rng = random.Random(seed)
        said = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n)]
        return " ".join(w.capitalize() + "." if i % 9 == 8 else w for i, w in enumerate(said))

    return make


@pytest.fixture(scope="session")
def odd_docs(prose):
    """Rows (doc_id, text): nulls, empty, white space, repeats, copies, near copies, a long one."""
    base = prose(60, 1)
    changed = base.split()
    changed[10] = "other"
    far = base.split()
    far[::6] = ["else"] * len(far[::6])
    return [
        (1, base), (2, " ".join(changed)), (3, " ".join(far)), (4, base.replace(" ", "\n")), (5, base.upper()),
        (6, None), (7, ""), (8, " \t\n"), (9, "one two three"), (10, "One  two\tthree"), (11, "one two"),
        (12, prose(30_000, 2)), (13, prose(30_000, 2) + " more"), (14, "x" * 200_000), (15, base + " "), (16, "é ü 字"),
        (17, "é\u00a0ü 字"), (18, prose(7, 3)), (19, prose(7, 3)), (20, "! ? ."),
    ]


@pytest.fixture(scope="session")
def frame(spark):
    """Rows as a table with extra columns whose names clash with those used inside."""
    from pyspark.sql import functions as F

    def make(rows, schema, extra=("n", "h", "token", "text_sha256", "score", "rank", "length", "component", "row_id", "pipeline_row", "hash")):
        from serialloom.plans.pin import pin

        df = spark.createDataFrame(rows, schema)
        return pin(df.select("*", *(F.lit("x").alias(c) for c in extra if c not in df.columns)))

    return make
