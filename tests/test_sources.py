import os
import re
import zipfile
from datetime import datetime
from pathlib import Path

import pyarrow as pa
import pytest
from conftest import values

from serialloom.queries.ingest import _write_tree
from serialloom.sources import archives, files, listing
from serialloom.sources.chapter_pages import (
    CHAPTER_NOTICES,
    CHAPTER_RULES,
    ingest_chapter_pages,
    split_notices,
)
from serialloom.sources.compat import ingest_compat_chapters
from serialloom.sources.elements import Rule, pick, slices
from serialloom.sources.feeds import ingest_feeds
from serialloom.sources.fiction import ingest_fiction_pages

NOW = datetime(2024, 6, 1)


def test_feeds(spark):
    item = "<item><pubDate>{}</pubDate></item>"
    good, offset = "Mon, 01 Jan 2024 10:00:00 GMT", "Mon, 01 Jan 2024 10:00:00 +0200"
    docs = {
        "two": f"<rss><channel><title>T</title>{item.format(good)}{item.format(offset)}</channel></rss>",
        "junk": f"<rss><channel><title>T</title>{item.format('yesterday')}</channel></rss>",
        "none": "<rss><channel><title>T</title></channel></rss>",
        "torn": f"<rss><channel><title>T</title>{item.format(good)}<item><pubDa",
        "untitled": f"<rss><channel>{item.format(good)}</channel></rss>",
        "channel": f"<rss><channel><pubDate>{good}</pubDate><title>T</title></channel></rss>",
    }
    pages = spark.createDataFrame(list(docs.items()), "book_id string, html string")
    ten, eight = datetime(2024, 1, 1, 10), datetime(2024, 1, 1, 8)
    assert values(ingest_feeds(pages), "book_id", "published") == sorted(
        [("two", ten), ("two", eight), ("torn", ten), ("channel", ten)], key=repr
    )


HEAD = "<h1>My <i>Book</i></h1>"
AUTHOR = '<h4><span>by <a href="/p">Ann</a></span></h4>'
ABOUT = '<div class="description"><div class="hidden-content"><div>in</div>side</div></div>'
COVER = 'window.fictionCover = "https://cdn/c.jpg";\n'
LIST = (
    'window.chapters = [{"id":5,"order":1,"date":"2024-01-02T00:00:00Z","title":"B","url":"/f/5","x":{}},'
    '{"id":4,"order":0,"date":"2024-01-01T00:00:00+01:00","title":"A","url":"/f/4"}];\n'
)


def page(*parts):
    return "<html><body>" + "".join(parts) + "</body></html>"


def test_fiction_pages(spark):
    docs = {
        "1": page(HEAD, AUTHOR, ABOUT, "<script>", COVER, LIST, "</script>"),
        "2": page(HEAD, "<script>", COVER, "window.chapters = [];", "</script>"),
        "3": page("<h1></h1>", COVER, LIST),
        "4": page(HEAD, LIST),
        "5": page(HEAD, COVER),
        "6": page(HEAD, COVER, "window.chapters = [{];"),
        "7": page(HEAD, COVER, 'window.chapters = [1]; window.chapters = [2];'),
        "8": page(HEAD, COVER, LIST.replace('"id":5', '"id":4294967296')),
        "9": page(HEAD, COVER, LIST.replace("2024-01-02T00:00:00Z", "2024-01-02")),
        "10": page(HEAD, COVER, LIST.replace(',"title":"B"', "")),
    }
    pages = spark.createDataFrame(
        [(f"https://www.royalroad.com/fiction/{i}/x", h) for i, h in docs.items()], "url string, html string"
    )
    got = ingest_fiction_pages(pages, NOW)
    assert values(got.books, "book_id", "title", "author", "description", "date_published", "cover_url") == [
        ("1", "My <i>Book</i>", "Ann", "<div>in</div>side", datetime(2023, 12, 31, 23), "https://cdn/c.jpg"),
        ("2", "My <i>Book</i>", "<unknown>", "", NOW, "https://cdn/c.jpg"),
    ]
    assert values(got.chapters, "identifier", "arr_pos", "ord", "date_published", "title", "url") == [
        ("4", 1, 0, datetime(2023, 12, 31, 23), "A", "https://www.royalroad.com/f/4"),
        ("5", 0, 1, datetime(2024, 1, 2), "B", "https://www.royalroad.com/f/5"),
    ]
    errors = dict(values(got.rejects, "book_id", "error"))
    assert errors["3"] == "No title found" and errors["4"] == "No cover found"
    assert errors["5"] == "No chapters found" and set(errors) == set("3456789") | {"10"}


BEFORE = '<hr><div class="portlet"><h5>n</h5><div class="author-note">start</div></div>'
TEXT = '<div class="chapter-inner chapter-content"><p>one<p>two</p>{}<div>deep<div>er</div></div></div>'
AFTER = '<div class="portlet light"><div class="author-note">end</div></div>'


@pytest.mark.parametrize(
    "html, content, start, end",
    [
        (TEXT.format(""), "<p>one<p>two</p><div>deep<div>er</div></div>", None, None),
        (BEFORE + TEXT.format(""), "<p>one<p>two</p><div>deep<div>er</div></div>", "start", None),
        (TEXT.format("") + AFTER, "<p>one<p>two</p><div>deep<div>er</div></div>", None, "end"),
        (BEFORE + TEXT.format("") + AFTER, "<p>one<p>two</p><div>deep<div>er</div></div>", "start", "end"),
        ('<div class="chapter-content">no</div>', None, None, None),
        ('<div class="chapter-inner chapter-content"></div>', None, None, None),
        (f"<!-- {TEXT} --><script>'{TEXT}'</script>", None, None, None),
        (TEXT.format('<b class="cjx">steal</b><i class="x cj">stay</i>'),
         '<p>one<p>two</p><i class="x cj">stay</i><div>deep<div>er</div></div>', None, None),
        # A notice between the rule and the note does not part them.
        ('<hr><span class="cm1">n</span>' + BEFORE[4:] + TEXT.format(""),
         "<p>one<p>two</p><div>deep<div>er</div></div>", "start", None),
        # A note inside a notice goes with it.
        ('<hr><div class="cm1">' + BEFORE[4:] + "</div>" + TEXT.format(""),
         "<p>one<p>two</p><div>deep<div>er</div></div>", None, None),
    ],
)
def test_pick_from_chapter_pages(html, content, start, end):
    fields, _ = pick(page(html), CHAPTER_RULES, CHAPTER_NOTICES)
    assert (fields["content"], fields["note_start"], fields["note_end"]) == (content, start, end)


def test_notice_size_is_in_bytes():
    sizes = {"a" * 199: True, "a" * 200: False, "é" * 99: True, "é" * 100: False}
    for text, taken in sizes.items():
        _, notices = pick(f'<p class="cjA">{text}</p>', CHAPTER_RULES, CHAPTER_NOTICES)
        assert bool(notices) == taken


def test_pick_many_and_unclosed():
    rules = [Rule("all", tag="li", many=True), Rule("last", tag="div", classes=("z",))]
    fields, _ = pick("<ul><li>a</li><li>b<li>c</ul><DIV class='z y'>open", rules, None)
    assert fields["all"][0] == "a" and fields["last"] == "open"


def test_ingest_chapter_pages(spark):
    html = page(BEFORE, TEXT.format('<p class="cmQ">Do not republish.</p>'), AFTER)
    pages = spark.createDataFrame([("b", "1", html), ("b", "2", "nothing"), ("b", "3", None)],
                                  "book_id string, identifier string, html string")
    content, notices = ingest_chapter_pages(pages)
    assert values(content, "identifier", "note_start", "note_end") == [
        ("1", "start", "end"), ("2", None, None), ("3", None, None)]
    assert values(notices, "identifier", "class", "html") == [("1", "cmQ", "Do not republish.")]


def test_split_notices(spark):
    nodes = spark.createDataFrame(
        [("cj1", "x" * 199), ("cj1", "x" * 200), ("xcj", "x"), (None, "x"), ("cm", "é" * 100)], "class string, html string"
    )
    kept, taken = split_notices(nodes)
    assert kept.count() == 4 and values(taken, "class") == [("cj1",)]


def test_compat_chapters(spark):
    note = '<div class="author-note-portlet">{}</div>'
    shell = note.format("")
    head = '<h3 class="fff_chapter_title">T</h3>'
    docs = {
        "0": head + "<p>x</p>",
        "1": head + note.format("n1") + "<p>x</p>",
        "2": note.format("n1") + "<p>x</p>" + note.format("n2"),
        "3": note.format("n1") + note.format("n2") + note.format("n3") + "<p>x</p>",
    }
    raw = spark.createDataFrame([("b", i, "T", page(h)) for i, h in docs.items()],
                                "book_id string, identifier string, title string, html string")
    assert values(ingest_compat_chapters(raw), "identifier", "content", "note_start", "note_end") == [
        ("0", "<p>x</p>", None, None),
        ("1", shell + "<p>x</p>", None, "n1"),
        ("2", shell + "<p>x</p>" + shell, "n1", "n2"),
        ("3", note.format("n1") + shell + shell + "<p>x</p>", "n2", "n3"),
    ]


OPF = """<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">
{}</metadata><manifest><item id="t" href="t.xhtml" media-type="application/xhtml+xml"/>
<item id="nav.xhtml" href="nav.xhtml" media-type="application/xhtml+xml"/>
<item id="c1.xhtml" href="c%201.xhtml" media-type="application/xhtml+xml"/>
<item id="i" href="img/p.png" media-type="image/png"/><item id="gone" href="img/q.png" media-type="image/png"/>
</manifest><spine><itemref idref="t"/><itemref idref="nav.xhtml"/><itemref idref="c1.xhtml"/><itemref idref="lost"/></spine></package>"""


def _book(path, meta, chapter):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        z.writestr("O/c.opf", OPF.format(meta))
        z.writestr("O/t.xhtml", "title")
        z.writestr("O/c 1.xhtml", chapter)
        z.writestr("O/img/p.png", b"\x89PNG")


def test_library_of_archives(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    meta = "<dc:identifier>id1</dc:identifier><dc:source>https://s/fiction/1</dc:source><dc:title>T</dc:title><dc:date>bad</dc:date>"
    own = ('<html><head><title>C</title><meta name="generator" content="me"/><meta name="published" '
           'content="2024-01-01T00:00:00Z"/></head><body><h1>C</h1><div class="chapter-content">text</div></body></html>')  # fmt: skip
    _book(tmp_path / "a.epub", meta, own)
    _book(tmp_path / "sub" / "b.epub", "", "<html><body>plain</body></html>")
    (tmp_path / "sub" / "broken.epub").write_bytes(b"PK nothing")
    (tmp_path / "sub" / "skipped.epub").write_bytes(b"")
    (tmp_path / "note.txt").write_text("x")
    (tmp_path / ".hidden.epub").write_bytes(b"")
    rules = spark.createDataFrame([(str(tmp_path / "sub"), 1, "skip*")], "dir string, line_no bigint, pattern string")
    found = files.scan_library(spark, [str(tmp_path)], rules)
    paths = [r.path for r in found.orderBy("path").collect()]
    assert [p.rsplit("/", 1)[1] for p in paths] == ["a.epub", "b.epub", "broken.epub"]
    lib = archives.ingest_archives(archives.open_archives(archives.read_archives(spark, paths)), NOW, ("me",))
    books = {r.path.rsplit("/", 1)[1]: r for r in lib.books.collect()}
    assert books["a.epub"].book_id == "id1" and books["a.epub"].date_published == NOW
    assert books["b.epub"].title == "" and len(books["b.epub"].book_id) == 36
    mine = values(lib.chapters.where("book_id = 'id1'"), "identifier", "pos", "title", "date_published")
    assert mine == [("c1", 2, "C", datetime(2024, 1, 1)), ("lost", 3, "", NOW)]
    texts = values(lib.content.where("content IS NOT NULL"), "identifier", "content")
    assert texts == [("c1", "plain"), ("c1", "text")]
    assert values(lib.assets, "filename", "mime") == [("p.png", "image/png")] * 2
    assert lib.rejects.count() == 1


def test_ignore_files_are_read(spark, tmp_path):
    (tmp_path / "ignore.list").write_text("a.epub\n# no\n")
    got = files.read_ignore_files(spark, [str(tmp_path)], "ignore.list")
    assert values(got, "dir", "line_no", "pattern") == [(str(tmp_path), 0, "a.epub"), (str(tmp_path), 1, "# no"), (str(tmp_path), 2, "")]


def test_hidden_roots_are_read(spark, tmp_path):
    root = tmp_path / ".library"
    for name in ("a.epub", "sub/b.epub", ".trash/c.epub"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x")
    none = spark.createDataFrame([], "dir string, line_no long, pattern string")
    for given in (str(root), f"file://{root}/"):
        found = files.scan_library(spark, [given], none)
        assert [p for (p,) in values(found, "path")] == [f"{root}/a.epub", f"{root}/sub/b.epub"]


def test_two_archives_with_one_identifier_stay_two_books(spark, tmp_path):
    for name, text in (("b", "second"), ("a", "first"), ("c", "third")):
        meta = "<dc:identifier>same</dc:identifier>" if name != "c" else "<dc:identifier>other</dc:identifier>"
        _book(tmp_path / f"{name}.epub", meta, f"<html><body>{text}</body></html>")
    lib = archives.ingest_archives(archives.open_archives(archives.read_archives(spark, [str(tmp_path)])), NOW)
    ids = {r.path.rsplit("/", 1)[1]: r.book_id for r in lib.books.collect()}
    assert (ids["a.epub"], ids["c.epub"]) == ("same", "other") and len(ids["b.epub"]) == 36
    for rows in (lib.chapters, lib.content, lib.assets):
        assert {(r.path.rsplit("/", 1)[1], r.book_id) for r in rows.select("path", "book_id").collect()} == set(ids.items())
    assert {(r.book_id, r.content) for r in lib.content.where("identifier = 'c1'").collect()} == {
        ("same", "first"), (ids["b.epub"], "second"), ("other", "third")}


def test_an_archive_that_breaks_half_way_gives_no_rows(spark, tmp_path):
    _book(tmp_path / "a.epub", "<dc:identifier>x</dc:identifier>", "<html><body>" + "text " * 500 + "</body></html>")
    data = bytearray((tmp_path / "a.epub").read_bytes())
    at = data.find(b"text text")
    data[at : at + 4] = b"TEXT"
    (tmp_path / "a.epub").write_bytes(bytes(data))
    entries = archives.open_archives(archives.read_archives(spark, [str(tmp_path)]))
    assert values(entries, "kind", "text") == [("error", "BadZipFile: bad entry O/c 1.xhtml")]


def test_a_walk_sees_all_names(spark, tmp_path):
    root = tmp_path / ".library"
    names = ["a.epub", "_b.epub", ".c.epub", "d.txt", "x/_e.epub", "x/y/f.epub", "x/.z/g.epub", "_w/h.epub", "x/epub", "x/i.EPUB", "x/y/j.epub"]
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x")
    (root / ".autignore").write_text("h.epub\r\n# no\n")
    (root / "x" / ".autignore").write_text("y/*\n!f.epub\n")
    files_, rules = listing.walk_library(spark, [str(root), f"file://{root}/x", str(tmp_path / "nothing")])
    walk = {str(p) for p in root.rglob("*.epub") if p.name[0] != "." and ".z" not in p.parts}
    assert {r.path for r in files_.collect()} == walk and files_.count() == len(walk)
    assert values(rules, "line_no", "pattern") == [(0, "h.epub"), (0, "y/*"), (1, "!f.epub"), (1, "# no"), (2, ""), (2, "")]
    shown = {r.path.removeprefix(f"{root}/") for r in listing.scan_library(spark, [str(root)]).collect()}
    assert shown == {"a.epub", "_b.epub", "x/_e.epub", "x/y/f.epub"}


def test_ignore_lists_of_a_tree_are_written_once_per_task(tmp_path, monkeypatch):
    written = []
    write = Path.write_text
    monkeypatch.setattr(Path, "write_text", lambda self, text: (written.append(self), write(self, text)))
    batch = pa.RecordBatch.from_pydict({"o_orderkey": [8, 16, 11, 22], "o_orderstatus": ["F", "F", "F", "O"]})
    assert [b.num_rows for b in _write_tree(str(tmp_path))(iter([batch, batch]))] == [4, 4]
    assert len(written) == 6  # three shelves, each with the list of the folder above
    names = {str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file() and p.name != ".autignore"}
    assert names == {"F/shelf0/8.epub", "F/shelf0/16.epub", "F/shelf3/11.epub", "O/shelf2/22.epub"}


def test_files_of_one_content_share_their_bytes_on_disk(tmp_path, monkeypatch):
    orders = list(range(1, 61))
    batch = pa.RecordBatch.from_pydict({"o_orderkey": orders, "o_orderstatus": ["F", "O"] * 30})

    def made(folder):
        for _ in range(2):  # a task that is run again
            list(_write_tree(str(folder))(iter([batch])))
        files_ = [p for p in folder.rglob("*") if p.is_file() and p.name != ".autignore"]
        return {str(p.relative_to(folder)): p.read_bytes() for p in files_}, len({p.stat().st_ino for p in files_})

    names, blocks = made(tmp_path / "a")
    assert {int(re.sub(r"\D", "", n.rsplit("/", 1)[1])): len(b) for n, b in names.items()} == {k: k % 10 for k in orders}
    assert blocks <= 20
    monkeypatch.setattr(os, "link", lambda *_: (_ for _ in ()).throw(OSError("no more links")))
    assert made(tmp_path / "b") == (names, 60)


def test_batches_are_taken_apart_by_bytes():
    batch = pa.RecordBatch.from_pydict({"html": ["a" * 6, None, "b" * 3, "c" * 30, "", "é"]})
    parts = list(slices(batch, "html", 10))
    assert [p.num_rows for p in parts] == [3, 1, 2]
    assert [r for p in parts for r in p.column("html").to_pylist()] == batch.column("html").to_pylist()
    assert [p.num_rows for p in slices(batch.slice(0, 0), "html")] == [0]
