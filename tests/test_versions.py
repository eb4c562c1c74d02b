"""Versions of tables, bytes by key, images of a run, and finished texts."""

import random
from datetime import datetime, timedelta
from hashlib import md5

import pytest
from conftest import values
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from serialloom import schemas
from serialloom.functions.rewrite import fold, rewrite
from serialloom.operators import assets, diff
from serialloom.plans import publish
from serialloom.plans.maintain import Crawled, Images, Run, Stored, render_texts, update_books
from serialloom.sinks.blobs import Blobs
from serialloom.sinks.versions import Versions

BOOK = "book_id string, v string"
TABLES = ("books", "parts")


@pytest.fixture
def kept(spark, tmp_path):
    schema = spark.createDataFrame([], BOOK).schema
    return Versions(spark, str(tmp_path / "lib"), {t: schema for t in TABLES}, buckets=8)


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), BOOK)


def state(kept, version=None):
    return {t: values(kept.read(t, version), "book_id", "v") for t in TABLES}


def ids(spark, *books):
    return spark.createDataFrame([(b,) for b in books], "book_id string")


def test_versions_follow_a_plain_model(spark, kept):
    """Random runs, compactions and repeats, against a dict."""
    rng, model, past = random.Random(3), {t: {} for t in TABLES}, {}
    for n in range(1, 7):
        books = [f"b{i}" for i in rng.sample(range(30), 8)]
        said = {t: [(b, f"{n}-{k}") for b in books for k in range(rng.randrange(3))] for t in TABLES}
        dfs = {t: rows(spark, *said[t]) for t in TABLES}
        assert kept.publish(dfs, f"run-{n}", ids(spark, *books)) == kept.publish(dfs, f"run-{n}", ids(spark, *books))
        for t in TABLES:
            model[t] = {b: v for b, v in model[t].items() if b not in books}
            for b, v in said[t]:
                model[t].setdefault(b, []).append(v)
        if n in (2, 5):
            kept.compact(f"tidy-{n}")
        now = {t: sorted(((b, v) for b, vs in model[t].items() for v in vs), key=repr) for t in TABLES}
        past[kept.newest()] = now
        assert state(kept) == now
    assert all(state(kept, v) == then for v, then in past.items())
    kept.compact("tidy-last")
    assert state(kept) == now and len({p.bucket for p in kept.pieces()}) == len(kept.pieces())
    assert kept.compact("tidy-nothing") == kept.newest()


def test_a_run_that_stops_between_two_tables_changes_nothing(spark, kept, monkeypatch):
    kept.publish({t: rows(spark, ("a", "1"), ("b", "1")) for t in TABLES}, "run-1", ids(spark, "a", "b"))
    before, write = state(kept), Versions._write

    def stops(self, name, df, version):
        if name == "parts":
            raise RuntimeError("lost")
        write(self, name, df, version)

    monkeypatch.setattr(Versions, "_write", stops)
    new = {t: rows(spark, ("a", "2")) for t in TABLES}
    with pytest.raises(RuntimeError):
        kept.publish(new, "run-2", ids(spark, "a"))
    assert kept.newest() == 1 and state(kept) == before
    monkeypatch.undo()
    assert kept.publish(new, "run-2", ids(spark, "a")) == 2
    assert state(kept)["parts"] == [("a", "2"), ("b", "1")] and state(kept, 1) == before


def test_a_commit_that_was_not_finished_is_not_seen(spark, kept, tmp_path):
    kept.publish({t: rows(spark, ("a", "1")) for t in TABLES}, "run-1", ids(spark, "a"))
    torn = tmp_path / "lib" / "commits" / "version=2" / "_temporary" / "0"
    torn.mkdir(parents=True)
    assert kept.newest() == 1
    assert kept.publish({"books": rows(spark, ("a", "2"))}, "run-2", ids(spark, "a")) == 2
    # a replaced book has no rows in a table that the run brought none for
    assert state(kept) == {"books": [("a", "2")], "parts": []}


def test_each_changed_bucket_is_written_once(spark, kept, tmp_path):
    many = [(f"b{i}", "1") for i in range(200)]
    kept.publish({t: rows(spark, *many) for t in TABLES}, "run-1", ids(spark, *[b for b, _ in many]))
    files = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    kept.publish({t: rows(spark, ("b7", "2")) for t in TABLES}, "run-2", ids(spark, "b7"))
    after = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    assert all(after[p] == t for p, t in files.items())
    # a row per table, the replaced key, the commit
    assert len(after) - len(files) == len(TABLES) + 2
    kept.compact("tidy")
    assert len(list((tmp_path / "lib" / "books" / "version=3").glob("bucket=*"))) == 1
    gone = [r.path for r in kept.unused().collect()]
    assert len(gone) == 2 * (len(TABLES) + 1) and all("version=3" not in p for p in gone)
    assert kept.unused(3).isEmpty()


def test_rows_of_other_books_are_refused(spark, kept):
    with pytest.raises(ValueError, match="not replaced"):
        kept.publish({"books": rows(spark, ("a", "1"), ("z", "1"))}, "run-1", ids(spark, "a"))
    with pytest.raises(ValueError, match="no such table"):
        kept.publish({"else": rows(spark, ("a", "1"))}, "run-1", ids(spark, "a"))
    assert kept.newest() == 0 and state(kept) == {t: [] for t in TABLES}
    with pytest.raises(ValueError, match="no version 4"):
        kept.read("books", 4)


def test_a_refusal_names_the_table(spark, kept, monkeypatch):
    read = []
    written = Versions._written
    monkeypatch.setattr(Versions, "_written", lambda self, name, *a: (read.append((name, a[1])), written(self, name, *a))[1])
    for at, strange in enumerate((("z", "1"), (None, "1"))):
        with pytest.raises(ValueError, match="rows of parts whose"):
            kept.publish({"books": rows(spark, ("a", "1"), ("a", "2")), "parts": rows(spark, strange)}, f"run-{at}", ids(spark, "a", None))
    assert kept.publish({"books": rows(spark, ("a", "1"), ("a", "2"))}, "run-3", ids(spark, "a", "b", None)) == 1
    # the replaced keys are read once for all tables
    assert read.count(("replaced", ["book_id"])) == 3


def test_rows_that_nothing_replaces_meet_no_keys(spark, kept, monkeypatch):
    for n in (1, 2, 3):
        kept.publish({t: rows(spark, ("a", str(n)), (f"b{n}", "x")) for t in TABLES}, f"run-{n}", ids(spark, "a", f"b{n}"))
    scanned = []
    scan = Versions._scan
    monkeypatch.setattr(Versions, "_scan", lambda self, name, pieces: (scanned.append((name, list(pieces))), scan(self, name, pieces))[1])
    assert state(kept)["books"] == [("a", "3"), ("b1", "x"), ("b2", "x"), ("b3", "x")]
    bucket = {p.bucket for p in kept.pieces(1)} & {p.bucket for p in kept.pieces() if p.version == 3}
    plain, older = [pieces for name, pieces in scanned if name == "books"]
    assert bucket and all(p.version == 3 for p in plain if p.bucket in bucket)
    assert older and all(p.version < 3 for p in older)


# --- bytes by key ------------------------------------------------------------


@pytest.fixture
def blobs(spark, tmp_path):
    store = Blobs(spark, str(tmp_path / "cache"), buckets=4)
    store.add(spark.range(300).selectExpr("CAST(id % 7 AS STRING) AS book_id", "id || '.png' AS filename", "unhex(lpad(hex(id), 16, '0')) AS bytes"), "load")
    return store


@pytest.mark.parametrize("part_bytes", [1 << 20, 600])
def test_bytes_of_wanted_keys(spark, blobs, part_bytes):
    wanted = spark.range(290, 310).selectExpr("CAST(id % 7 AS STRING) AS book_id", "id || '.png' AS filename", "id AS n")
    wanted = wanted.unionByName(wanted.limit(1))
    got = blobs.with_bytes(wanted, part_bytes)
    assert got.columns == ["book_id", "filename", "n", "bytes"]
    assert values(got.select("n", F.hex("bytes").cast("string").alias("h")), "n", "h") == sorted(
        [(290, f"{290:016X}"), *((n, f"{n:016X}") for n in range(290, 300))], key=repr
    )
    assert blobs.with_bytes(wanted.limit(0)).count() == 0
    assert sorted(r.n for r in blobs.missing(wanted).collect()) == list(range(300, 310))


def test_a_bucket_may_take_several_parts(spark, blobs):
    wanted = blobs.keys()
    assert blobs.with_bytes(wanted, 1_000).count() == 300
    assert blobs.with_bytes(wanted, 1_000).distinct().count() == 300


def test_chapters_take_the_texts_that_are_there(spark):
    """What a run has worked out of its texts is not worked out again for its chapters."""
    run = Run(*[None] * 9)
    run.content = spark.createDataFrame([("a", "1", "t"), ("a", "1", "t"), ("a", "3", "t")], "book_id string, identifier string, content string")
    chapters = "book_id string, identifier string, {} long, title string"
    run._stored_chapters = spark.createDataFrame([("a", "1", 1, "x"), ("a", "2", 2, "x")], chapters.format("pos"))
    run._new_chapters = spark.createDataFrame([("a", "3", 0, "y"), ("b", "1", 0, "y")], chapters.format("arr_pos"))
    assert values(run.chapters, "book_id", "identifier", "pos") == [("a", "1", 1), ("a", "3", 2)]


def test_many_keys_are_not_all_broadcast(spark, blobs):
    wanted = blobs.keys().withColumn("n", F.lit(1))
    wanted = wanted.unionByName(wanted.where("book_id = '3'")).unionByName(wanted.limit(1).withColumn("filename", F.lit("none")))
    few, many = (blobs.with_bytes(wanted, 1_000, most) for most in (100, 8))
    assert plan_of(few).count(") BroadcastExchange") > 8 and ") BroadcastExchange" not in plan_of(many)
    assert few.columns == many.columns and few.count() == 300 + 43
    assert few.exceptAll(many).isEmpty() and many.exceptAll(few).isEmpty()
    for most in (100, 8):
        sizes = blobs.with_bytes(wanted, 1_000, most, F.octet_length("bytes"))
        assert sizes.groupBy("bytes").count().collect() == [(8, 343)]


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_no_exchange_carries_bytes(spark, blobs, tmp_path):
    fetched = Blobs(spark, str(tmp_path / "fetched"), buckets=4)
    fetched.add(spark.createDataFrame([("1", "1.png", b"x")], "book_id string, filename string, bytes binary"), "load")
    wanted = spark.createDataFrame([("1", "1.png"), ("2", "2.png"), ("9", "q.png")], "book_id string, filename string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = assets.cache_aside(wanted, blobs, fetched)
        plan = plan_of(found)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    nodes = plan.split("\n\n")
    moves = [n for n in nodes if "Exchange" in n.split("\n")[0] and "Arguments" in n]
    assert moves and not any("bytes" in n for n in moves)
    scans = [n for n in nodes if n.startswith("(") and "Scan parquet" in n.split("\n")[0] and "bytes" in n]
    assert scans and all("bucket" in n and "PartitionFilters" in n for n in scans)
    assert values(found.select("filename", F.col("bytes").isNull().alias("none")), "filename", "none") == [
        ("1.png", False), ("2.png", False), ("q.png", True)]


# --- images of a run ---------------------------------------------------------

PNG, JPEG, PAGE, ELSE = b"\x89PNG\r\n\x1a\n..", b"\xff\xd8\xff..", b" <!DOCTYPE html><p>", b"BM...."


def resolved_model(wanted, cache, fetched):
    """The sequential rule of one book after the other, in the order of the urls' MD5."""
    out, usable = {}, {u for u, b in fetched.items() if b in (PNG, JPEG)}
    for book in {b for b, _, _ in wanted}:
        used, k = set(), 0
        for _, url, base in sorted((w for w in wanted if w[0] == book), key=lambda w: md5(w[1].encode()).hexdigest()):
            name = base
            if name is None:
                out[book, url] = (None, "failed")
                continue
            if name in used:
                name, k = f"{k}_{base}", k + 1
            state = "cached" if (book, name) in cache else "fetched" if url in usable else "failed"
            if state != "failed":
                used.add(name)
            out[book, url] = (name, state)
    return out


def test_images_are_resolved_like_one_after_the_other(spark, tmp_path):
    rng = random.Random(11)
    wanted = [(b, f"https://h{i}/{b}/{i % 5}.png", f"{i % 5}.png") for b in ("x", "y", "hot") for i in range(60 if b == "hot" else 9)]
    wanted += [("x", "..", None), ("z", "https://h/only.png", "only.png")]
    fetched = {u: rng.choice([PNG, JPEG, PAGE, ELSE]) for _, u, _ in wanted if rng.random() < 0.6}
    cached = {("x", "1.png"), ("x", "2.png"), ("hot", "3.png"), ("hot", "0_0.png"), ("hot", "4_1.png"), ("y", "nobody.png")}
    cache = Blobs(spark, str(tmp_path / "cache"), buckets=4)
    cache.add(spark.createDataFrame([(*k, b"old") for k in cached], "book_id string, filename string, bytes binary"), "load")
    store = Blobs(spark, str(tmp_path / "fetched"), ["url"], 4)
    store.add(spark.createDataFrame(list(fetched.items()), "url string, bytes binary"), "load")
    asked = spark.createDataFrame([w[:2] for w in [*wanted, wanted[0]]], "book_id string, url string")
    found = assets.resolve_assets(asked, cache, store)
    expected = resolved_model(wanted, cached, fetched)
    assert {(r.book_id, r.url): (r.filename, r.state) for r in found.collect()} == expected
    assert found.count() == len(expected)
    failed = found.where("state = 'failed'")
    assert failed.where("error IS NULL").isEmpty() and found.where("state <> 'failed' AND error IS NOT NULL").isEmpty()
    good = {k: v for k, v in expected.items() if v[1] != "failed"}
    held = {(r.book_id, r.url): bytes(r.bytes) for r in assets.asset_bytes(found, cache, store).collect()}
    assert held == {k: b"old" if s == "cached" else fetched[k[1]] for k, (_, s) in good.items()}
    for _ in range(2):
        assets.cache_resolved(found, cache, store, "run-1")
    new = {(b, name) for (b, _), (name, s) in good.items() if s == "fetched"}
    assert {(r.book_id, r.filename) for r in cache.keys().collect()} == cached | new
    assert cache.keys().count() == len(cached | new)


# --- finished texts ----------------------------------------------------------

PIECES = ["https://x/a", "https://x/a.png", "http://h/b", "https://q/?u=https://x/a", "rel.png", "../images/a", ".", "h", "htt", "://", " ", "<p>", "graph"]
text = st.lists(st.sampled_from(PIECES), max_size=14).map("".join)
address = st.lists(st.sampled_from(["https://x/a", "http://h/b", "https://x/ab", "https://c/d.png", "https://e/h", "https://f/."]), max_size=5)
any_source = st.lists(st.one_of(st.sampled_from(PIECES[:6]), text.filter(bool)), max_size=5)
file = st.sampled_from(["a", "a.png", "graph", "https", "b.jpg", "0_a", "x:y", ""])


@settings(max_examples=400, deadline=None)
@given(text, st.one_of(address, any_source), st.lists(file, min_size=5, max_size=5), st.integers(0, 5))
def test_one_pass_equals_the_fold(body, sources, files, known):
    named = dict(list(zip(sources, files))[:known])
    body = body + "".join(f'<img src="{s}">' for s in sources) + body
    assert rewrite(body, sources, named) == fold(body, sources, named)


def test_a_text_with_very_many_images_stays_linear():
    import time

    def took(n):
        sources = [f"https://cdn.example.org/books/{i}/picture.png" for i in range(n)]
        body = "".join(f'<p>{"text " * 20}<img src="{s}"/></p>' for s in sources)
        start = time.perf_counter()
        out = rewrite(body, sources, {s: f"{i}_picture.png" for i, s in enumerate(sources)})
        assert "https" not in out and out.count("../images/") == n
        return time.perf_counter() - start

    took(1_000)
    assert took(40_000) < 40 * max(took(4_000), 0.01)


def test_rendered_texts(spark):
    urls = [f"https://h/{i}/p.png" for i in range(3)]
    content = "".join(f'<p class="x"><img src="{u}"></p>' for u in urls) + f'<a href="{urls[0]}">'
    texts = spark.createDataFrame([("b", "1", content, None, "<br>"), ("b", "2", None, "", "no image")], schemas.CHAPTER_CONTENT)
    names = spark.createDataFrame([("b", urls[0], "p.png"), ("b", urls[2], "0_p.png")], "book_id string, url string, filename string")
    got = {r.identifier: r for r in render_texts(texts, names).collect()}
    assert got["1"].content == (
        '<p><img src="../images/p.png"/></p><p><img src="https://h/1/p.png"/></p><p><img src="../images/0_p.png"/></p><a href="../images/p.png">'
    )
    assert got["1"].note_end == "<br/>" and got["2"].content is None and got["2"].note_start == ""
    plain = {r.identifier: r for r in render_texts(texts).collect()}
    assert plain["1"].content.count('"../images/p.png"') == 4


# --- three runs over a library -----------------------------------------------


def test_three_runs_keep_the_newest_dates(spark, tmp_path):
    site, day = "https://www.royalroad.com", [datetime(2024, 1, 1) + timedelta(days=i) for i in range(9)]
    books = [(b, f"{site}/fiction/{b}/x", f"B{b}", "me", "", day[0], "https://c/o.png") for b in "123"]
    kept = publish.library(spark, str(tmp_path / "lib"), 4)
    first = {
        "books": spark.createDataFrame(books, schemas.BOOKS),
        "chapters": spark.createDataFrame([(b, "1", 1, day[1], "one", f"{site}/c/{b}/1") for b in "123"], schemas.CHAPTERS),
        "content": spark.createDataFrame([(b, "1", "old", None, None) for b in "123"], schemas.CHAPTER_CONTENT),
    }
    first["high_water"] = diff.library_high_water(first["chapters"])
    kept.publish(first, "load", first["books"].select("book_id"))
    images = Images(Blobs(spark, str(tmp_path / "cache"), buckets=2), Blobs(spark, str(tmp_path / "fetched"), ["url"], 2))
    images.fetched.add(spark.createDataFrame([("https://c/n.png", PNG), ("https://c/2.png", PAGE)], "url string, bytes binary"), "load")
    for n in (2, 3, 4):
        book = str(n - 1)
        listed = ",".join(
            f'{{"id":{i},"order":{i},"date":"2024-01-0{i}T00:00:00Z","title":"P{i}","url":"/c/{book}/{i}"}}' for i in range(1, n + 1)
        )
        index = f'<h1>N</h1><script>window.fictionCover = "https://c/n.png";\nwindow.chapters = [{listed}];\n</script>'
        page = '<div class="chapter-inner chapter-content"><img src="https://c/{i}.png">text {i}</div>'
        crawled = Crawled(
            spark.createDataFrame([(f"{site}/fiction/{book}/x", index)], "url string, html string"),
            spark.createDataFrame([(f"{site}/c/{book}/{i}", page.format(i=i)) for i in range(2, n + 1)], "url string, html string"),
        )
        feed = spark.createDataFrame([(b, "t", day[n] if b == book else day[0]) for b in "123"], schemas.FEED_ITEMS)
        now = publish.stored(kept)
        run = update_books(now, feed, crawled, day[8], images=images)
        assert publish.publish_run(run, kept, f"run-{n}") == n
        assert publish.publish_run(run, kept, f"run-{n}") == n
        assert values(run.manifest.where("section = '2_image'"), "item_id") == [("n.png",)]
        run.cache_images(f"run-{n}")
    full = diff.library_high_water(kept.read("chapters"))
    assert values(kept.read("high_water"), "book_id", "current_max") == values(full, "book_id", "current_max")
    gates = [diff.gate_up_to_date(w, diff.feed_high_water(feed)) for w in (kept.read("high_water"), full)]
    assert values(gates[0], "book_id", "up_to_date") == values(gates[1], "book_id", "up_to_date")
    assert "chapters" not in plan_of(gates[0]) and "chapters" in plan_of(gates[1])
    assert values(kept.read("chapters").groupBy("book_id").count(), "book_id", "count") == [("1", 2), ("2", 3), ("3", 4)]
    assert values(images.cache.keys(), "book_id", "filename") == [("1", "n.png"), ("2", "n.png"), ("3", "n.png")]
    assert values(kept.read("books", 1), "cover_url") == [("https://c/o.png",)] * 3
    assert isinstance(publish.stored(kept, 1), Stored)
