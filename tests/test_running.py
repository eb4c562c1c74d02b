from datetime import datetime, timedelta

import pytest
from conftest import values
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from serialloom.operators.fetchlog import backoff_runs, fetch_outcome, fetch_schedule
from serialloom.operators.running import numbered, range_blocks

GAP = 500_000
SLOW = settings(
    max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
START = datetime(2024, 1, 1)


def _time(ms):
    return START + timedelta(milliseconds=ms)


def schedule_model(rows):
    last, out = {}, {}
    for host, ts, request in sorted(rows, key=lambda r: (r[1], r[2])):
        at = int((ts - datetime(1970, 1, 1)) / timedelta(microseconds=1))
        start = max(at, last.get(host, -(10**18)) + GAP)
        last[host] = start
        out[request] = start
    return out


@pytest.mark.parametrize("blocks", [1, 7])
@SLOW
@given(wanted=st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 5000)), min_size=1, max_size=60))
def test_fetch_schedule_matches_a_loop(spark, blocks, wanted):
    rows = [(host, _time(ms), i) for i, (host, ms) in enumerate(wanted)]
    df = spark.createDataFrame(rows, "host string, ts timestamp, request_id bigint")
    got = fetch_schedule(df, GAP, blocks=blocks)
    starts = {r.request_id: r.start_us for r in got.collect()}
    assert starts == schedule_model(rows)
    for host in "ab":
        slots = sorted(starts[i] for h, _, i in rows if h == host)
        assert all(b - a >= GAP for a, b in zip(slots, slots[1:]))
    assert got.where("delay_us < 0").count() == 0


def test_schedule_of_one_hot_host_at_one_instant(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("h"), F.col("id"))).otherwise("hot").alias("host"),
        F.lit(START).alias("ts"),
        F.col("id").alias("request_id"),
    )
    got = fetch_schedule(rows, GAP, blocks=40)
    hot = got.where("host = 'hot'").agg(F.count("*"), F.count_distinct("start_us"), F.max("delay_us")).first()
    assert hot[0] == hot[1] and hot[2] == (hot[0] - 1) * GAP


def test_blocks_of_a_dense_minute_are_even(spark):
    rows = spark.range(60_000).select(
        F.lit("hot").alias("host"), F.col("id").alias("_us"), (F.col("id") * 7 % 60_000).alias("request_id")
    )
    blocked, levels = range_blocks(rows, ["host"], ["_us", "request_id"], 8)
    sizes = [n for (n,) in values(blocked.groupBy("_block").count(), "count")]
    assert levels == [["_block"]] and len(sizes) == 8 and max(sizes) < 2 * 60_000 / 8


def backoff_model(rows):
    bounce, out = 0, {}
    for request, _, status in sorted(rows, key=lambda r: (r[1], r[0])):
        out[request] = (bounce, 8 * 2**bounce if bounce else 0)
        if status == 429:
            bounce = min(11, bounce + 1)
        elif not 400 <= status <= 599:
            bounce = 0
    return out


@pytest.mark.parametrize("blocks", [1, 7])
@SLOW
@given(
    answers=st.lists(
        st.tuples(st.integers(0, 4000), st.sampled_from([429, 429, 429, 429, 404, 500, 200, 301])),
        min_size=1,
        max_size=60,
    )
)
def test_backoff_matches_a_loop(spark, blocks, answers):
    rows = [(i, _time(ms), status) for i, (ms, status) in enumerate(answers)]
    df = spark.createDataFrame(rows, "request_id bigint, ts timestamp, status int")
    got = backoff_runs(df, blocks=blocks)
    assert {r.request_id: (r.bounce, r.wait_seconds) for r in got.collect()} == backoff_model(rows)


def test_backoff_is_capped(spark):
    rows = [(i, _time(i), 429) for i in range(20)] + [(20, _time(20), 200), (21, _time(21), 404)]
    df = spark.createDataFrame(rows, "request_id bigint, ts timestamp, status int")
    got = values(backoff_runs(df), "request_id", "bounce", "wait_seconds")
    bounces = [*range(12), *[11] * 9, 0]
    assert sorted(got) == [(i, b, 8 * 2**b if b else 0) for i, b in enumerate(bounces)]


def test_fetch_outcome(spark):
    rows = [(429, 0, "retry"), (429, 10, "retry"), (429, 11, "http_error"), (404, 0, "broken_link"),
            (500, 0, "http_error"), (403, 3, "http_error"), (200, 0, "ok"), (301, 0, "ok")]
    df = spark.createDataFrame(rows, "status int, bounce int, expected string")
    assert df.where(fetch_outcome(F.col("status"), F.col("bounce")) != F.col("expected")).count() == 0


@SLOW
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 10**6)), min_size=1, max_size=60, unique=True))
def test_numbered_is_a_permutation_in_order(spark, items):
    df = spark.createDataFrame(items, "k string, at bigint").withColumn("b", F.floor(F.col("at") / 1000))
    got = numbered(df, ["k"], [["b"]], ["at"], "n")
    for key in "abc":
        mine = sorted((r.at, r.n) for r in got.where(F.col("k") == key).collect())
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))


def test_a_scratch_folder_leaves_nothing_behind(spark):
    from pathlib import Path

    from serialloom.plans.pin import pin, scratch, shared_folder

    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    with scratch(spark) as outside:
        inner = pin(spark.range(5).toDF("n"))
        with scratch(spark):
            kept_inside = pin(inner.where("n > 1"), None)
            assert kept_inside.count() == 3
        kept = pin(inner.where("n > 2"), outside)
    assert kept.count() == 2
    assert len(set(folder.iterdir()) - before) == 1
    with pytest.raises(RuntimeError), scratch(spark):
        pin(spark.range(5))
        raise RuntimeError
    assert len(set(folder.iterdir()) - before) == 1
