import random

import numpy as np
import plain
import pytest
from conftest import values
from llm_fixtures import frame, odd_docs, prose  # noqa: F401
from pyspark.sql import functions as F

from serialloom.llm import ngram_join, signature_tree
from serialloom.llm.common import Known, pick_rows, with_row_id
from serialloom.llm.components import components
from serialloom.llm.exact_dedup import exact_duplicates
from serialloom.llm.ngram_join import near_duplicates
from serialloom.plans import pin as pin_module

EXACT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def weak_hash(*columns):
    return F.pmod(F.xxhash64(*columns), F.lit(3))


@pytest.mark.parametrize("options", [{}, {"block_bytes": 7}, {"block_bytes": 16, "hash_of": weak_hash}])
def test_exact(frame, odd_docs, options):
    got = exact_duplicates(frame(odd_docs, "doc_id long, text string"), **options)
    assert values(got, *EXACT) == sorted(plain.exact(odd_docs), key=repr)


def test_exact_ties_and_nulls(frame):
    rows = [(None, "a b"), (3, "ab"), (3, "a b"), (3, "a b"), (2, "b"), (2, "b"), (None, None), (None, None)]
    got = exact_duplicates(frame(rows, "doc_id long, text string"))
    assert values(got, *EXACT) == sorted(plain.exact(rows), key=repr)
    assert got.filter("kept").count() == 3


def test_empty_tables(frame):
    docs = frame([], "doc_id long, text string")
    assert exact_duplicates(docs).count() == 0
    assert near_duplicates(docs).count() == 0


def test_near(frame, odd_docs):
    got = near_duplicates(frame(odd_docs, "doc_id long, text string"))
    assert values(got, "doc_id", "n_shingles", "component_id") == sorted(plain.near(odd_docs), key=repr)


def families(prose, seed, n_families=12, members=14):
    """Bases with copies of which some words are changed, around the threshold."""
    rng, docs = random.Random(seed), []
    for f in range(n_families):
        base = prose(rng.randint(5, 150), 1000 * seed + f).split()
        for _ in range(members):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                text[rng.randrange(len(text))] = f"w{rng.randrange(10**6)}"
            docs.append(" ".join(text))
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize(("seed", "chunk"), [(1, 1024), (2, 8), (3, 3)])
def test_near_families(frame, prose, seed, chunk):
    docs = families(prose, seed)
    got = near_duplicates(frame(docs, "doc_id long, text string"), chunk=chunk)
    assert values(got, "doc_id", "n_shingles", "component_id") == sorted(plain.near(docs), key=repr)


def test_near_keeps_one_of_repeated_rows(frame, prose):
    text = prose(40, 9)
    rows = [(None, text), (5, text), (5, text), (4, text + " end"), (7, None), (7, None)]
    got = near_duplicates(frame(rows, "doc_id long, text string"))
    assert values(got.filter("kept"), "doc_id", "component_id") == [(4, 4), (7, 7), (7, 7)]


def test_tree_loses_no_link():
    rng = np.random.default_rng(4)
    for _ in range(20):
        base = [rng.integers(-(2**62), 2**62, rng.integers(1, 80)) for _ in range(6)]
        sets = []
        for _ in range(90):
            s = base[rng.integers(6)].copy()
            s[rng.random(len(s)) < rng.random() * 0.2] = rng.integers(2**62)
            sets.append(np.unique(s))
        wanted = {
            (i, j)
            for i in range(len(sets))
            for j in range(i)
            if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))
        }
        found = signature_tree.links(sets, np.arange(len(sets)), 75)
        assert all((max(p), min(p)) in wanted for p in found)
        assert connected(len(sets), found) == connected(len(sets), wanted)
        cross = rng.random(len(sets)) < 0.5
        across = signature_tree.links(sets, np.arange(len(sets)), 75, cross)
        assert all(cross[i] != cross[j] for i, j in across)
        assert connected(len(sets), across) == connected(len(sets), [(i, j) for i, j in wanted if cross[i] != cross[j]])


def connected(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = [new if x == old else x for x in label]
    return label


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(7, 7)]
    got = components(spark.createDataFrame(chain, "a long, b long"))
    want = [(i, 0) for i in range(41)] + [(100, 100)] + [(200 + i, 100) for i in range(30)]
    assert values(got, "node", "component") == sorted(want, key=repr)


def test_shingle_sets_have_the_size_of_plain_ones(odd_docs):
    known = Known(ngram_join.xxhash.xxh3_64_intdigest, most=5)
    for _, text in odd_docs:
        assert len(ngram_join.shingles((text or "").encode(), known)) == len(plain.shingles(text))


# -- row numbers --------------------------------------------------------------------------

PARTS = "spark.sql.files.minPartitionNum"


@pytest.fixture
def split_table(spark, tmp_path, prose):  # noqa: F811
    """(rows, table): pairs of near copies, in files that a later scan splits otherwise."""
    rows = []
    for i in range(0, 120, 2):
        text = prose(60 + i, 900 + i)
        rows += [(i, text), (1000 - i, text + " more")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8, "doc_id").write.parquet(f"{tmp_path}/docs")
    spark.conf.set(PARTS, "8")
    yield rows, spark.read.parquet(f"{tmp_path}/docs")
    spark.conf.unset(PARTS)


def test_row_ids_stay_when_a_scan_is_split_otherwise(spark, split_table):
    numbered = with_row_id(split_table[1])
    before = values(numbered, "row_id", "doc_id")
    spark.conf.set(PARTS, "1")
    assert values(numbered, "row_id", "doc_id") == before


def test_near_when_scans_are_split_otherwise(spark, split_table, monkeypatch):
    def later(*a):
        spark.conf.set(PARTS, "1")
        return pick_rows(*a)

    rows, docs = split_table
    monkeypatch.setattr(ngram_join, "pick_rows", later)
    made = near_duplicates(docs)
    spark.conf.set(PARTS, "1")
    assert values(made, "doc_id", "n_shingles", "component_id") == sorted(plain.near(rows), key=repr)


def test_near_keeps_its_grouped_rows_once(frame, prose, spark, tmp_path):  # noqa: F811
    rows = [(i, prose(60, i % 40) + f" and {i % 5}") for i in range(120)]
    opened = pin_module._scratch.set(str(tmp_path / "held"))
    try:
        got = near_duplicates(frame(rows, "doc_id long, text string"))
    finally:
        pin_module._scratch.reset(opened)
    tables = [spark.read.parquet(str(p)) for p in (tmp_path / "held").glob("pinned-*")]
    assert sum(t.columns == ["token", "row_id"] for t in tables) == 1
    assert not any({"token", "zone", "least"} <= set(t.columns) and "bundle" not in t.columns for t in tables)
    assert not list((tmp_path / "held").glob("scratch-*"))
    assert got.count() == len(rows)
