"""Column functions on HTML text that need no document tree.

Patterns carry ``(?U)`` where white space must include the no-break space, and
``(?d)`` where '.' must stop at '\\n' only.
"""

from pyspark.sql import Column, functions as F

from ..fixed_values import FAILED_ASSET_SUFFIX
from .urls import asset_filename

# Markup rewrites of the chapter cleanup, in the order they apply.
# (is a pattern, what, replacement)
CLEANUP = (
    (True, r'(?U)\s*font-family:[^;"]*(?:;\s*|("))', "$1"),
    (True, r'font-family:[^;"]*"', '"'),
    (True, r"(?U)font-weight:\s?normal", ""),
    (True, r"(?U)font-weight:\s?400", ""),
    (True, r' class="[^"]*"', ""),
    (True, r"(<img[^>]*[^/])>", "$1/>"),
    (False, "<br>", "<br/>"),
    (False, "<hr>", "<hr/>"),
    (False, "&nbsp;", " "),
    (True, r"(?U)<p[^>]*>\s*</p>", ""),
    (True, r"(?U)overflow:\s?auto", ""),
    (False, ' style=""', ""),
)

# Patterns of the two script variables on a book's index page.
COVER_SCRIPT = r'(?d)window\.fictionCover = "(.*)";'
CHAPTERS_SCRIPT = r"(?d)window\.chapters = (\[.*\]);"

_VALUE = r"""\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
_TAG_REST = r"""(?:"[^"]*+"|'[^']*+'|[^'">]++)*+"""


def clean_html(html: Column) -> Column:
    """Drop styling that e-readers get wrong and close the void tags."""
    for is_pattern, what, replacement in CLEANUP:
        html = (
            F.regexp_replace(html, what, replacement)
            if is_pattern
            else F.replace(html, F.lit(what), F.lit(replacement))
        )
    return html


def _tags(html: Column, tag: str) -> Column:
    """All start tags of one kind, leaving out comments and raw-text elements."""
    visible = F.regexp_replace(
        html, r"(?is)<!--.*?-->|<(script|style|textarea|title)\b[^>]*>.*?</\1\s*>", ""
    )
    return F.regexp_extract_all(visible, F.lit(rf"(?is)<{tag}\b{_TAG_REST}>"), F.lit(0))


def _attribute(tag_text: Column, name: str) -> Column:
    """Decoded value of an attribute of one start tag; NULL when it has none."""
    walk = (
        rf"(?is)^<[a-z][^\s/>]*(?:[\s/]+(?!{name}\s*=)[^\s=>/\"']+(?:{_VALUE})?)*[\s/]+{name}"
        r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    )
    value = F.concat(*[F.regexp_extract(tag_text, walk, i) for i in (1, 2, 3)])
    for entity, char in (
        ("&quot;", '"'),
        ("&#39;", "'"),
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("&amp;", "&"),
    ):
        value = F.replace(value, F.lit(entity), F.lit(char))
    return F.when(tag_text.rlike(walk), value)


def attribute_values(html: Column, tag: str, name: str) -> Column:
    """Values of one attribute over all tags of a kind, in document order."""
    values = F.transform(_tags(html, tag), lambda t: _attribute(t, name))
    return F.filter(values, lambda v: v.isNotNull())


def image_urls(html: Column) -> Column:
    """All image sources in document order; an empty list for NULL text."""
    return F.coalesce(
        attribute_values(html, "img", "src"), F.array().cast("array<string>")
    )


def first_text(html: Column, tag: str) -> Column:
    """Inner HTML of the first element of a kind, NULL when empty or absent."""
    found = F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>", 1)
    return F.nullif(found, F.lit(""))


def meta_content(html: Column, name: str) -> Column:
    """Content of the first meta tag with that name, NULL when empty or absent."""
    named = F.filter(_tags(html, "meta"), lambda t: _attribute(t, "name") == name)
    return F.nullif(
        F.try_element_at(F.transform(named, lambda t: _attribute(t, "content")), F.lit(1)),
        F.lit(""),
    )


def script_value(html: Column, pattern: Column) -> Column:
    """What the first group of a pattern finds first in the page, NULL when it finds nothing."""
    return F.try_element_at(F.regexp_extract_all(html, pattern, F.lit(1)), F.lit(1))


def cover_from_script(html: Column) -> Column:
    return script_value(html, F.lit(COVER_SCRIPT))


def chapters_from_script(html: Column) -> Column:
    return script_value(html, F.lit(CHAPTERS_SCRIPT))


def drop_failed(url: Column) -> Column:
    """True for an asset url that is worth fetching."""
    return ~F.endswith(url, F.lit(FAILED_ASSET_SUFFIX))


def rewrite_image_refs(html: Column, pairs: Column | None = None) -> Column:
    """Point every image source in the text at its file in the book.

    Each replacement runs over the whole text that the one before it left, in
    document order.  ``pairs`` (array of struct(src, file)) overrides the file
    names that are derived from the urls.
    """
    if pairs is None:
        pairs = F.transform(
            image_urls(html),
            lambda src: F.struct(src.alias("src"), asset_filename(src).alias("file")),
        )
    usable = F.filter(pairs, lambda p: p["file"].isNotNull())
    return F.aggregate(
        usable,
        html,
        lambda text, p: F.replace(text, p["src"], F.concat(F.lit("../images/"), p["file"])),
    )
