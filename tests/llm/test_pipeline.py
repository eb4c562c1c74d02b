"""The pipeline's stages against plain Python on the smallest tables."""

from pathlib import Path

import duckdb
import plain
import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


def rows_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    before = rows_of(docs)
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, SF)
        after.write.parquet(f"{tmp_path}/{at}")
        after = spark.read.parquet(f"{tmp_path}/{at}")
        if at == len(corpus_pipeline.STAGES) - 1:
            assert {r.doc_id for r in after.collect()} == set(before)
            break
        assert after.columns == docs.columns
        kept = rows_of(after)
        assert after.count() == len(kept)
        rows = sorted(before.items())
        if name == "exact dedup":
            assert set(kept) == {r[0] for r in plain.exact(rows) if r[3]}
        elif name == "n-gram Jaccard join":
            assert set(kept) == {c for _, _, c in plain.near(rows)}
        elif name == "benchmark decontamination":
            assert set(kept) == {r[0] for r in plain.contamination(rows, items) if not r[5]}
        else:
            assert {d for d, t in rows if any(c.isalpha() for c in t or "")} == set(kept)
        docs, before = after, kept


def test_odd_rows_pass_through(spark, tmp_path):
    rows = [(1, None, "en", "a", 0), (None, "some words here", None, None, None), (3, "", "en", "a", 0), (3, "", "en", "a", 0)]
    rows += [(10 + i, f"the plain words of text number {i} and more of it", "en", "b", 1) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in got.collect()} >= {None, *range(10, 30)} - {3}
    (tmp_path / "none").mkdir()
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/none/documents.parquet"
    )
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
