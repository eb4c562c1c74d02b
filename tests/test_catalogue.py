"""Routing, ignore lists, assets, tool logs, sinks, the stream and whole jobs."""

import re
from datetime import datetime, timedelta

import pytest
from conftest import values
from pyspark.sql import functions as F

from serialloom import schemas
from serialloom.fixed_values import COMPAT_HOSTS
from serialloom.operators import assets, ignore, routing
from serialloom.operators.toollog import classify_tool_log
from serialloom.plans import maintain
from serialloom.plans.maintain import Crawled, Stored, create_books, render_texts, stash_and_recreate, update_books
from serialloom.sinks import tables
from serialloom.sinks.blobs import Blobs
from serialloom.sources.elements import Rule, extract_by_source
from serialloom.sources.profiles import NATIVE, SourceProfile, profile_tables
from serialloom.streaming.feeds import FeedWatch, watch_feeds


def test_routing_takes_the_first_match(spark):
    urls = {
        "https://www.royalroad.com/fiction/1": "native",
        "https://www.royalroad.com/profile/1": "compat",
        "http://x/?u=https://www.royalroad.com/fiction/1": "compat",
        "https://forum.questionablequesting.com/t": "compat",
        "https://nowhere.example/": "unsupported",
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert dict(values(routing.route_sources(df), "url", "source")) == urls
    native = dict(values(routing.route_sources(df, routing.NATIVE_RULES), "url", "source"))
    assert list(native.values()).count("unsupported") == 4
    rules = [routing.SourceRule(2, "contains", "nowhere", "late"), routing.SourceRule(1, "prefix", "https://no", "early")]
    assert dict(values(routing.route_sources(df, rules), "url", "source"))["https://nowhere.example/"] == "early"


IGNORE = [
    # rules of /lib (by line), path below it, hidden?
    (["a.epub"], "a.epub", True),
    (["a.epub"], "x/a.epub", True),
    (["/a.epub"], "x/a.epub", False),
    (["/x/a.epub"], "x/a.epub", True),
    (["x/a.epub"], "y/x/a.epub", False),
    (["*.epub"], "x/y/a.epub", True),
    (["x/*.epub"], "x/y/a.epub", False),
    (["**/y/*.epub"], "x/y/a.epub", True),
    (["x/**/a.epub"], "x/a.epub", True),
    (["x/**"], "x/y/a.epub", True),
    (["x/"], "x/y/a.epub", True),
    (["a.epub/"], "a.epub", False),
    (["?.epub"], "ab.epub", False),
    (["[a-c].epub"], "b.epub", True),
    (["[!a-c].epub"], "b.epub", False),
    (["*.epub", "!a.epub"], "a.epub", False),
    (["!a.epub", "*.epub"], "a.epub", True),
    (["x/", "!x/a.epub"], "x/a.epub", True),
    (["# a.epub", ""], "a.epub", False),
    (["\\#a.epub"], "#a.epub", True),
    (["a.epub  "], "a.epub", True),
    (["a+b(1).epub", "c+*.epub"], "c+d.epub", True),
]


def test_ignore_rules(spark):
    files, rules = [], []
    for i, (lines, path, _) in enumerate(IGNORE):
        files.append((f"/lib{i}/{path}", i))
        rules += [(f"/lib{i}", n, line) for n, line in enumerate(lines)]
    got = ignore.apply_ignore_rules(
        spark.createDataFrame(files, "path string, i int"),
        spark.createDataFrame(rules, "dir string, line_no bigint, pattern string"),
    )
    shown = {r.i for r in got.collect()}
    for i, (lines, path, hidden) in enumerate(IGNORE):
        assert (i not in shown) == hidden, (lines, path)


def test_deeper_ignore_list_wins(spark):
    files = spark.createDataFrame([("/l/x/a.epub",), ("/l/y/a.epub",)], "path string")
    rules = spark.createDataFrame([("/l", 9, "*.epub"), ("/l/x/", 1, "!a.epub")], "dir string, line_no bigint, pattern string")
    assert values(ignore.apply_ignore_rules(files, rules), "path") == [("/l/x/a.epub",)]


def names_model(rows):
    """The sequential rule: later users of a name get a running number."""
    out = {}
    for book in {b for b, _, _ in rows}:
        used, k = set(), 0
        for _, url, base in sorted((r for r in rows if r[0] == book), key=lambda r: __import__("hashlib").md5(r[1].encode()).hexdigest()):
            name = base
            if base in used:
                name, k = f"{k}_{base}", k + 1
            used.add(base)
            out[book, url] = name
    return out


def test_asset_names(spark):
    rows = [("hot", f"https://h{i}/img.png", "img.png") for i in range(300)]
    rows += [("hot", f"https://h{i}/d/{i % 7}.png", f"{i % 7}.png") for i in range(50)]
    rows += [("b", "https://h/x/", ""), ("b", "https://h/y/", ""), ("b", "https://h/z.png", "z.png")]
    df = spark.createDataFrame([(b, u) for b, u, _ in rows] + [("b", ".."), ("b", "")], "book_id string, url string")
    got = {(r.book_id, r.url): r.filename for r in assets.asset_names(df).collect()}
    assert got == names_model(rows)


def test_book_assets_and_rewrite(spark):
    texts = spark.createDataFrame(
        [("b", "1", '<img src="https://h/1/p.png"><img src="https://h/2/p.png">', None, '<img src="https://h/failedtoload">'),
         ("b", "2", '<img src="https://h/1/p.png">', '<img src="rel.png">', None)],
        schemas.CHAPTER_CONTENT,
    )
    books = spark.createDataFrame([("b", "https://h/c.jpg")], "book_id string, cover_url string")
    found = assets.book_assets(books, texts)
    assert found.count() == 5
    names = assets.asset_names(assets.drop_failed_assets(found))
    assert {r.filename for r in names.collect()} == {"c.jpg", "p.png", "0_p.png", "rel.png"}
    final = {r.url: r.filename for r in names.collect()}
    rewritten = assets.rewrite_with_names(texts, names).where("identifier = '1'").first()
    assert rewritten.content == "".join(f'<img src="../images/{final[f"https://h/{i}/p.png"]}">' for i in (1, 2))
    assert rewritten.note_end == '<img src="https://h/failedtoload">' and rewritten.note_start is None
    plain = render_texts(texts).where("identifier = '1'").first()
    assert plain.content == '<img src="../images/p.png"/><img src="../images/p.png"/>'


def test_asset_cache(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "book_id string, filename string, bytes binary")
    wanted = spark.createDataFrame([("b", "1"), ("b", "2"), ("b", "3")], "book_id string, filename string")
    cache, fetched = (Blobs(spark, str(tmp_path / name), buckets=4) for name in ("cache", "fetched"))
    cache.add(rows(("b", "1", b"old")), "load")
    fetched.add(rows(("b", "1", b"new"), ("b", "2", b"two"), ("b", "9", b"x")), "load")
    assert values(assets.cache_aside(wanted, cache, fetched), "filename", "bytes") == [
        ("1", bytearray(b"old")), ("2", bytearray(b"two")), ("3", None)]
    assert values(assets.cache_misses(wanted, cache), "filename") == [("2",), ("3",)]
    for _ in range(2):
        cache.add(assets.cache_delta(wanted, cache, fetched), "run-1")
    assert values(cache.keys(), "filename") == [("1",), ("2",)]


TOOL = {
    "uptodate": ([("stdout", 1, "x.epub already contains 12 chapters.")], ("UpToDate", None)),
    "updated": ([("stdout", 1, "Do update - epub(3) vs url(10)")], ("Updated", 7)),
    "ahead": ([("stdout", 1, "x.epub contains 9 chapters, more than source: 4.")], ("MoreChapterThanSource", 5)),
    "skipped": ([("stdout", 1, "x.epub - Skipping")], ("Skipped", None)),
    "progress": ([("stdout", 1, "Updating x, URL: https://y - Skipping"), ("stdout", 2, "Do update - epub(1) vs url(2)")], ("Updated", 1)),
    "large": ([("stdout", 1, "Do update - epub(1) vs url(65536)"), ("stdout", 2, "x - Skipping")], ("Skipped", None)),
    "huge": ([("stdout", 1, "Do update - epub(1) vs url(99999999999999999999)"), ("stdout", 2, "x - Skipping")], ("Skipped", None)),
    "stderr": ([("stdout", 1, "x already contains 1 chapters."), ("stderr", 5, "y - Skipping")], ("Skipped", None)),
    "order": ([("stdout", 2, "x already contains 1 chapters."), ("stdout", 1, "y - Skipping")], ("Skipped", None)),
    "nothing": ([("stdout", 1, "hello"), ("stderr", 1, "already contains many chapters.")], ("Error", None)),
}


def test_tool_log(spark):
    lines = [(run, *line) for run, (rows, _) in TOOL.items() for line in rows]
    got = classify_tool_log(spark.createDataFrame(lines, schemas.TOOL_LOG))
    assert {r.book_id: (r.outcome, r.n) for r in got.collect()} == {run: want for run, (_, want) in TOOL.items()}
    assert values(got.where("error IS NOT NULL"), "book_id") == [("nothing",)]


def test_publish_replaces_only_changed_books(spark, tmp_path):
    base, stage = str(tmp_path / "t"), str(tmp_path / "s")
    first = spark.range(1000).selectExpr("CAST(id % 50 AS STRING) AS book_id", "CAST(id AS STRING) AS identifier", "'old' AS v")
    tables.publish_library(first, base, stage + "1", buckets=8)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    again = first.where("book_id = '7' AND identifier <> '7'").withColumn("v", F.lit("new"))
    tables.publish_library(again, base, stage + "2", buckets=8)
    now = tables.read_table(spark, base, first.schema)
    assert values(now.groupBy("v").count(), "v", "count") == [("new", 19), ("old", 980)]
    assert now.where("book_id = '7'").count() == 19
    kept = {p for p in (tmp_path / "t").rglob("*.parquet") if files.get(p) == p.stat().st_mtime_ns}
    assert len(kept) == len(files) - sum(1 for p in files if not p.exists()) and kept


def test_ignore_list_grows_once(spark, tmp_path):
    path = str(tmp_path / "rules")
    outcomes = spark.createDataFrame([("a", "Unsupported", None, None), ("b", "Unsupported", None, "no feed"), ("c", "UpToDate", None, None)], schemas.OUTCOMES)
    files = spark.createDataFrame([("a", "/x/a.epub"), ("b", "/x/b.epub"), ("c", "/x/c.epub")], "book_id string, path string")
    for run in (1, 2):
        existing = tables.read_table(spark, path, schemas.IGNORE_RULES)
        tables.append_ignore_rules(routing.unsupported_files(outcomes, files, existing), path, run)
    assert values(tables.read_table(spark, path, schemas.IGNORE_RULES), "dir", "line_no", "pattern") == [("/x", 1, "a.epub")]


def test_watch_feeds_says_only_news(spark, tmp_path):
    day = [datetime(2024, 1, 1) + timedelta(days=i) for i in range(6)]
    source, watch, said, fails = tmp_path / "items", FeedWatch(spark, str(tmp_path / "newest"), 4), [], [0]

    def say(news, batch):
        said.append((batch, values(news, "book_id", "newest_us")))
        if fails and fails.pop() == batch:
            raise RuntimeError("lost after the batch was known")

    def run():
        items = spark.readStream.schema("book_id string, published timestamp").parquet(str(source))
        writer = watch_feeds(items, watch, say).option("checkpointLocation", str(tmp_path / "state"))
        writer.trigger(availableNow=True).start().awaitTermination()

    def add(*rows):
        said.clear()
        spark.createDataFrame(list(rows), "book_id string, published timestamp").coalesce(1).write.mode("append").parquet(str(source))

    add(("a", day[1]), ("a", day[3]), ("b", day[2]), ("c", None))
    with pytest.raises(Exception, match="lost"):
        run()
    run()
    # the batch that failed is run again, and says the same
    assert len(said) == 2 and said[0] == said[1] and [b for b, _ in said[1][1]] == ["a", "b"]
    assert watch.kept.newest() == 1
    add(("a", day[3]), ("b", day[1]))
    run()
    assert [m for _, m in said] == [[]]
    add(("a", day[2]), ("b", day[4]), ("b", day[5]))
    run()
    assert [m for _, m in said] == [[("b", int((day[5] - datetime(1970, 1, 1)).total_seconds()) * 1_000_000)]]
    assert values(watch.newest(), "book_id") == [("a",), ("b",)]


def test_create_and_stash(spark, tmp_path):
    site = "https://www.royalroad.com/fiction"
    index = '<h1>N</h1>window.fictionCover = "c.png";\nwindow.chapters = [{"id":1,"order":0,"date":"2024-01-01T00:00:00Z","title":"P","url":"/c/1"}];\n'
    crawled = Crawled(
        spark.createDataFrame([(f"{site}/1/x", index), (f"{site}/3/x", "<p>")], "url string, html string"),
        spark.createDataFrame([("https://www.royalroad.com/c/1", '<div class="chapter-inner chapter-content">hi</div>')], "url string, html string"),
    )
    files = spark.createDataFrame(
        [(b, f"/lib/{b}.epub", u) for b, u in
         [("1", f"{site}/1/x"), ("2", f"{site}/2/x"), ("3", f"{site}/3/x"), ("4", "https://else/"), ("5", None), ("1b", f"{site}/1/x")]],
        "book_id string, path string, url string",
    )
    stashed, run = stash_and_recreate(files, crawled, datetime(2024, 1, 2, 3, 4))
    assert values(run.outcomes.where("outcome <> 'Unsupported'"), "book_id", "outcome", "n", "error") == [
        ("1", "Updated", 1, None), ("1b", "Updated", 1, None), ("2", "Error", None, "index page was not fetched"), ("3", "Error", None, "No title found")]
    assert run.outcomes.where("outcome = 'Unsupported'").count() == 1
    assert values(run.chapters, "book_id", "identifier", "pos") == [("1", "1", 1), ("1b", "1", 1)]
    texts = spark.createDataFrame([("1", "a"), ("5", "b")], "book_id string, v string")
    tables.write_stash(stashed, [texts], str(tmp_path), ["texts"], "2024-01-02")
    kept = spark.read.parquet(str(tmp_path / "texts"))
    assert values(kept, "book_id", "v", "stash_name") == [("1", "a", "1_2024-01-02_03h04.epub")]


def test_update_job_end_to_end(spark):
    site = "https://www.royalroad.com"
    day = [datetime(2024, 1, 1) + timedelta(days=i) for i in range(6)]
    books = [(b, f"{site}/fiction/{b}/x", f"B{b}", "me", "", day[0], "https://c/old.png") for b in "1234"]
    books.append(("9", "https://else/9", "B9", "me", "", day[0], ""))
    tool = f"https://{COMPAT_HOSTS[0]}/s"
    # the external updater's, with an update and without a run, and a source without a profile
    books += [(b, u, f"B{b}", "me", "", day[0], "") for b, u in (("5", f"{tool}/5"), ("6", f"{tool}/6"), ("7", "https://second/7"))]
    stored = Stored(
        spark.createDataFrame(books, schemas.BOOKS),
        spark.createDataFrame([(b, "1", 1, day[1], "one", f"{site}/c/{b}/1") for b in "1235"], schemas.CHAPTERS),
        spark.createDataFrame([(b, "1", "<p>old</p>", None, None) for b in "1235"], schemas.CHAPTER_CONTENT),
    )
    feed = spark.createDataFrame([("1", "t", day[3]), ("2", "t", day[1]), ("4", "t", day[1]), ("7", "t", day[1])], schemas.FEED_ITEMS)
    listed = ",".join(
        f'{{"id":{i},"order":{i},"date":"2024-01-0{i + 1}T00:00:00Z","title":"P{i}","url":"/c/1/{i}"}}' for i in (1, 2, 3)
    )
    index = f'<h1>N</h1><script>window.fictionCover = "https://c/new.png";\nwindow.chapters = [{listed}];\n</script>'
    text = '<div class="chapter-inner chapter-content"><img src="https://c/1.png">two<p class="cmZ">notice</p></div>'
    crawled = Crawled(
        spark.createDataFrame(
            [(f"{site}/fiction/1/x", index, day[2]), (f"{site}/fiction/2/x", index, day[2]), (f"{site}/fiction/1/x", "<p>old", day[1])],
            "url string, html string, fetched_at timestamp",
        ),
        # fetched twice at one moment, and once before
        spark.createDataFrame(
            [(f"{site}/c/1/2", text, day[3]), (f"{site}/c/1/2", text, day[3]), (f"{site}/c/1/2", "older", day[2]), (f"{site}/c/1/1", text, None)],
            "url string, html string, fetched_at timestamp",
        ),
    )
    log = spark.createDataFrame(
        [("8", "stdout", 1, "x - Skipping"), ("1", "stdout", 1, "x - Skipping"), ("5", "stdout", 1, "Do update - epub(1) vs url(3)")], schemas.TOOL_LOG
    )
    rules = (*routing.ALL_RULES, routing.SourceRule(0, "prefix", "https://second/", "second"))
    run = update_books(stored, feed, crawled, day[5], tool_log=log, rules=rules)
    assert run.outcomes.count() == stored.books.count()
    assert values(run.outcomes, "book_id", "outcome", "n", "error") == [
        ("1", "Updated", 2, None), ("2", "UpToDate", None, None),
        ("3", "Unsupported", None, "feed has no valid date"), ("4", "Error", None, "index page was not fetched"),
        ("5", "Updated", 2, None), ("6", "Error", None, "no run of the external updater"),
        ("7", "Error", None, "no profile for the source second"), ("9", "Unsupported", None, None)]
    assert values(run.books, "book_id", "title", "cover_url") == [("1", "B1", "https://c/new.png")]
    assert values(run.chapters, "identifier", "pos", "title") == [("1", 1, "one"), ("2", 2, "P2")]
    assert values(run.new_content, "identifier", "content") == [("2", '<img src="https://c/1.png">two')]
    assert values(run.notices, "identifier", "html") == [("2", "notice")]
    assert values(run.asset_names, "filename") == [("1.png",), ("new.png",)]
    assert run.manifest.count() == 8 and run.spine.count() == 3 and run.toc.count() == 3


def test_rules_of_several_sources_in_one_job(spark):
    second = SourceProfile("second", "https://s.example", (Rule("title", tag="b"),), (Rule("content", tag="pre"),), cover_script="c=(.*);", chapters_script=r"l=(\[.*\])")
    tables_ = profile_tables(spark, (NATIVE, second))
    assert values(tables_.rules.where("source = 'second'"), "page", "field", "tag") == [("chapter", "content", "pre"), ("index", "title", "b")]
    pages = spark.createDataFrame(
        [("native", 1, '<div class="chapter-inner chapter-content">a<p class="cmX">n</p></div><pre>no</pre>'),
         ("second", 2, '<div class="chapter-inner chapter-content">no</div><pre>b<p class="cmX">n</p></pre>'), ("else", 3, "<pre>x</pre>")],
        "source string, i int, html string",
    )
    joined = pages.join(tables_.of_pages("chapter").select("source", "rules"), "source")
    got = extract_by_source(joined, ["content", "note_start"], ["i"], notices=True)
    assert [(r.i, r.content, r.note_start, len(r.notices)) for r in got.orderBy("i").collect()] == [(1, "a", None, 1), (2, 'b<p class="cmX">n</p>', None, 0)]


def test_every_url_has_an_outcome(spark):
    site = "https://www.royalroad.com/fiction"
    urls = [f"{site}/12345/x", f"{site}/12345/y", f"https://{COMPAT_HOSTS[0]}/s/12345/1", "https://else/", "https://s.example/12345", f"{site}/12345/x"]
    index = '<b>T</b>c=u.jpg;l=[{"id":7,"order":0,"date":"2024-01-01T00:00:00Z","title":"P","url":"/7"}]'
    second = SourceProfile("second", "https://s.example", (Rule("title", tag="b"),), (Rule("content", tag="pre"),), cover_script="c=(.*?);", chapters_script=r"l=(\[.*\])")
    crawled = Crawled(
        spark.createDataFrame([("https://s.example/12345", index)], "url string, html string"),
        spark.createDataFrame([("https://s.example/7", "<pre>text</pre>")], "url string, html string"),
    )
    run = create_books(
        spark.createDataFrame([(u,) for u in urls], "url string"), crawled, datetime(2024, 1, 2),
        rules=(*routing.ALL_RULES, routing.SourceRule(0, "prefix", "https://s.example/", "second")), profiles=(NATIVE, second),
    )
    got = values(run.outcomes, "outcome", "n", "error")
    assert len(got) == len(set(urls)) and run.outcomes.select("book_id").distinct().count() == len(got)
    assert got == [
        ("Error", None, "index page was not fetched"), ("Error", None, "no run of the external updater"),
        ("Skipped", None, f"another url of the book 12345: {site}/12345/y"), ("Unsupported", None, None), ("Updated", 1, None)]
    assert values(run.chapters, "identifier", "url") == [("7", "https://s.example/7")]
    assert values(run.new_content, "content") == [("text",)]


def test_pages_are_never_broadcast(spark, capsys):
    # Spark knows how small these are
    pages = spark.sql(
        "SELECT * FROM VALUES ('u1', '<p>a</p>', TIMESTAMP '2024-01-01'), ('u1', '<p>b</p>', TIMESTAMP '2024-01-02'),"
        " ('u2', '<p>c</p>', NULL) t(url, html, fetched_at)"
    )
    wanted = spark.sql("SELECT * FROM VALUES ('u1', 'b1'), ('u1', 'b2'), ('u2', 'b3'), ('u3', 'b4') t(url, book_id)")
    for given in (pages, pages.where("url = 'u2'").drop("fetched_at")):
        found = maintain._latest(given, wanted)
        found.explain("formatted")
        broadcasts = re.findall(r"\) BroadcastExchange\nInput \[\d+\]: \[(.*)\]", capsys.readouterr().out)
        assert not [b for b in broadcasts if "html" in b]
        right = {("b1", "<p>b</p>"), ("b2", "<p>b</p>"), ("b3", "<p>c</p>")} if "fetched_at" in given.columns else {("b3", "<p>c</p>")}
        assert {(r.book_id, r.html) for r in found.collect()} == right
