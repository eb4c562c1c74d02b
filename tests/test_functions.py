from datetime import datetime

import pytest
from conftest import apply
from pyspark.sql import functions as F

from serialloom.functions import dates, html, images, labels, urls

CLEANED = [
    (
        '<span style="color: rgba(0, 235, 255, 1); font-family: consolas, terminal, monaco">txt</span>',
        '<span style="color: rgba(0, 235, 255, 1);">txt</span>',
    ),
    (
        '<span style="font-family: consolas, terminal, monaco; color: rgba(0, 235, 255, 1)">txt</span>',
        '<span style="color: rgba(0, 235, 255, 1)">txt</span>',
    ),
    (
        '<p class="cnM5NDA4MTVmMmRlNzQ1ZjI5YmRmZDcxYjgxYTc5NGYx" style="text-align: center">&nbsp;</p>',
        "",
    ),
    (
        '<img src="https://site.com/img.gif" alt="image">',
        '<img src="https://site.com/img.gif" alt="image"/>',
    ),
    (
        '<img src="https://site.com/img.gif" alt="image"/>',
        '<img src="https://site.com/img.gif" alt="image"/>',
    ),
    ("<p> </p>a<br><hr>", "a<br/><hr/>"),
    ('<b style="font-weight: 400">x</b><i style="overflow:auto">y</i>', "<b>x</b><i>y</i>"),
]

REWRITTEN = [
    ('<img src="../images/file">', '<img src="../images/file">'),
    ('<img src="../images/../images/file">', '<img src="../images/file">'),
    (
        '<img src="https://h/a.png?x=1"><p>https://h/a.png?x=1</p>',
        '<img src="../images/a.png"><p>../images/a.png</p>',
    ),
    ('<img src=""><img src="..">', '<img src=""><img src="..">'),
    (None, None),
]


def test_clean_html(spark):
    assert apply(spark, html.clean_html, [a for a, _ in CLEANED]) == [b for _, b in CLEANED]


def test_rewrite_image_refs(spark):
    got = apply(spark, html.rewrite_image_refs, [a for a, _ in REWRITTEN])
    assert got == [b for _, b in REWRITTEN]


def test_image_urls_reads_real_tags_only(spark):
    text = (
        "<!-- <img src=a> --><script>'<img src=b>'</script>"
        "<img alt='x src=\"q\"' data-src=\"no\" SRC = 'https://h/x.png?a=1&amp;b=2'>"
        "<IMG src=plain.gif><image src='z'>"
    )
    assert apply(spark, html.image_urls, [text, None]) == [["https://h/x.png?a=1&b=2", "plain.gif"], []]


def test_head_fields(spark):
    text = (
        "<head><title></title><meta content='x&amp;y' name=chapterurl><meta name='published' content=''>"
        "</head><h1 class='a'>T <b>i</b></h1><h1>second</h1>"
    )
    assert apply(spark, lambda c: html.meta_content(c, "chapterurl"), [text]) == ["x&y"]
    assert apply(spark, lambda c: html.meta_content(c, "published"), [text]) == [None]
    assert apply(spark, lambda c: html.first_text(c, "h1"), [text, "x"]) == ["T <b>i</b>", None]
    assert apply(spark, lambda c: html.first_text(c, "title"), [text]) == [None]


def test_script_values_are_greedy_within_a_line(spark):
    text = 'window.fictionCover = "a";x";\n";window.chapters = [1];[2];\n];'
    assert apply(spark, html.cover_from_script, [text, "-", 'window.fictionCover = "";']) == ['a";x', None, ""]
    assert apply(spark, html.chapters_from_script, [text, "-"]) == ["[1];[2]", None]


URLS = {
    # url: host, second path part, file name
    "https://www.Site.com/fiction/123/x y": ("www.site.com", "123", "x_20y"),
    "http://a.b/c/d.png?x#y": ("a.b", "d.png", "d.png"),
    "../images/file": (None, None, "file"),
    "a/b/": (None, None, "b"),
    "": (None, None, None),
    "..": (None, None, None),
    "https://h": ("h", None, ""),
    "https://h/p/": ("h", "", ""),
    "data:image/png;base64,aa/bb": ("", None, "bb"),
    "https://h/a%20b[1].png": ("h", None, "a_20b_1_.png"),
    "https://u:p@h_x.com:80/x/y": ("h_x.com", "y", "y"),
    "https://[::1]:8/x": ("[::1]", None, "x"),
    "https://h/é{1}.png": ("h", None, "_C3_A9_7B1_7D.png"),
    " https://h\\a\\b.png ": ("h", "b.png", "b.png"),
    "http://": (None, None, "http_"),
    "mailto:a@b": ("", None, "mailto_a@b"),
}


def test_urls(spark):
    texts = list(URLS)
    got = zip(
        apply(spark, urls.url_host, texts),
        apply(spark, lambda c: urls.url_segment(c, 1), texts),
        apply(spark, urls.asset_filename, texts),
    )
    assert dict(zip(texts, got)) == URLS


def test_feed_and_absolute_urls(spark):
    got = apply(spark, urls.feed_url, ["https://www.royalroad.com/fiction/7/x", "https://else/7"])
    assert got == ["https://www.royalroad.com/fiction/syndication/7/x", None]
    assert apply(spark, urls.absolute_url, ["/fiction/1"]) == ["https://www.royalroad.com/fiction/1"]
    assert apply(spark, urls.safe_title, ['a/b:c*?"<>|%[]\\d']) == ["a_b_c__________d"]


def test_dates(spark):
    feed = [
        "Wed, 31 Jan 2024 10:00:00 GMT",
        "Thu, 31 Jan 2024 10:00:00 GMT",
        "31 Jan 2024 10:00 +0200",
        "Wed, 31 jan 2024 10:00:00 EST",
        "Wed, 31 Feb 2024 10:00:00 GMT",
        "31 Jan 2024 10:00:00 XYZ",
        "junk",
        None,
        "Wed, 31 Jan 24 10:00:00 GMT (with a note)",
        "31 Jan 99 10:00:00 GMT",
        "31 Jan 124 10:00:00 GMT",
        "Thu, 31 Jan 24 10:00:00 GMT",
    ]
    assert apply(spark, dates.rfc2822, feed) == [
        datetime(2024, 1, 31, 10), None, datetime(2024, 1, 31, 8), datetime(2024, 1, 31, 15),
        None, None, None, None,
        datetime(2024, 1, 31, 10), datetime(1999, 1, 31, 10), datetime(2024, 1, 31, 10), None,
    ]
    iso = ["2024-01-31T10:00:00+02:00", "2024-01-31", "2024-01-31T10:00:00.5Z", "2024-13-01T00:00:00Z"]
    assert apply(spark, dates.rfc3339, iso) == [
        datetime(2024, 1, 31, 8), None, datetime(2024, 1, 31, 10, 0, 0, 500000), None,
    ]


KINDS = [
    (b"\x89PNG\r\n\x1a\nx", "png"),
    (b"\x89PNG\r\n\x1a\n", None),
    (b"\xff\xd8\xff\x00", "jpeg"),
    (b"RIFFaaaaWEBP", "webp"),
    (b"RIFFaaaaWEB", None),
    (b"GIF8", "gif"),
    ("  <?XML".encode(), "svg"),
    (b" <svg", "svg"),
    (b"<!DOCTYPE html>", "html"),
    (b"<html lang", "html"),
    (b"text", None),
    (b"<svg\xff", None),
    (b"ab", None),
    (b"", None),
]


def test_image_kind(spark):
    got = apply(spark, images.image_kind, [bytearray(b) for b, _ in KINDS], "binary")
    assert got == [k for _, k in KINDS]


def test_image_plan(spark):
    plan = lambda c: images.image_plan(c, F.lit(1000), F.lit(333))
    got = [tuple(v) for v in apply(spark, plan, ["png", "webp", "jpeg", "gif", "html", None])]
    assert got == [
        ("resize", "png", None, 600, 199),
        ("resize", "png", None, 600, 199),
        ("resize", "jpeg", 80, 600, 199),
        ("keep", "gif", None, None, None),
        ("reject", None, None, None, None),
        ("reject", None, None, None, None),
    ]


@pytest.mark.parametrize(
    "outcome, n, line",
    [
        ("Updated", 3, "[  +3] "),
        ("Updated", 12345, "[+12345] "),
        ("MoreChapterThanSource", 12, "[ -12] "),
        ("Skipped", None, "[Skip] "),
        ("UpToDate", None, None),
        ("Error", None, None),
    ],
)
def test_summary_line(spark, outcome, n, line):
    title = "é" * 60
    row = spark.createDataFrame([(outcome, n)], "o string, n int").select(
        labels.summary_line(F.col("o"), F.col("n"), F.lit(title)).alias("v")
    )
    assert row.first().v == (line and line + title[:50])
