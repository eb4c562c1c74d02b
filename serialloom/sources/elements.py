"""Pick parts out of HTML pages by rules, as one job over a table of pages.

Nested elements cannot be cut out with patterns, so this is the one place where
pages go through Python: Arrow batches in, one output row per page.  A rule
names what an element must look like; a new site means new rules, not new code.
"""

import json
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import repeat
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T


class Rule(NamedTuple):
    """An element to pick.  The first that fits is taken, or all with ``many``."""

    field: str
    tag: str | None = None
    classes: tuple[str, ...] = ()
    inside_tag: str | None = None  # some ancestor
    parent_class: str | None = None  # its parent
    parent_after: str | None = None  # the element just before its parent
    many: bool = False


class NoticeRule(NamedTuple):
    """Short elements whose class attribute starts with a prefix are taken out."""

    class_prefixes: tuple[str, ...]
    max_bytes: int


NOTICE_TYPE = T.ArrayType(
    T.StructType([T.StructField("class", T.StringType()), T.StructField("html", T.StringType())])
)
_ARROW_NOTICES = pa.list_(pa.struct([("class", pa.string()), ("html", pa.string())]))

# Elements without an end tag, those that end an open paragraph, those
# that do not keep a paragraph open, and those whose content is plain text.
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr "
    "main nav ol p pre section table ul".split()
)
INLINE_TAGS = frozenset("a b big code em font i s small span strike strong tt u".split())


RAW_TEXT_TAGS = frozenset("script style textarea title".split())

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^'">]++|"[^"]*+"|'[^']*+')*+)>""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class _Element:
    __slots__ = ("tag", "css", "parent", "start", "inner", "end", "close")

    def __init__(self, tag, css, parent, start, inner):
        self.tag, self.css, self.parent = tag, css, parent
        self.start, self.inner = start, inner
        self.end = self.close = inner  # end of the content, end of the element


def _class_of(attributes: str) -> str | None:
    if "class" in attributes.lower():
        for name, *values in _ATTRIBUTE.findall(attributes):
            if name.lower() == "class":
                return "".join(values)
    return None


def _close_down_to(open_: list[_Element], depth: int, end: int, close: int) -> None:
    while len(open_) > depth:
        element = open_.pop()
        element.end = end
        element.close = close if len(open_) == depth else end


def _outline(text: str) -> list[_Element]:
    """Elements of a page in document order, with where they start and end."""
    elements: list[_Element] = []
    open_: list[_Element] = []
    at = 0
    while found := _MARKUP.search(text, at):
        start, at = found.span()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            for depth in range(len(open_) - 1, -1, -1):
                if open_[depth].tag == tag:
                    _close_down_to(open_, depth, start, at)
                    break
            continue
        if tag in ENDS_PARAGRAPH:
            depth = len(open_) - 1
            while depth >= 0 and open_[depth].tag in INLINE_TAGS:
                depth -= 1
            if depth >= 0 and open_[depth].tag == "p":
                _close_down_to(open_, depth, start, start)
        element = _Element(tag, _class_of(found[3]), open_[-1] if open_ else None, start, at)
        elements.append(element)
        if tag in RAW_TEXT_TAGS:
            ending = re.compile(rf"</{tag}\s*>", re.I).search(text, at)
            element.end = ending.start() if ending else len(text)
            element.close = at = ending.end() if ending else len(text)
        elif tag not in VOID_TAGS:
            open_.append(element)
    _close_down_to(open_, 0, len(text), len(text))
    return elements


def _has_class(element: _Element | None, name: str) -> bool:
    return element is not None and bool(element.css) and name in element.css.split()


def pick(text: str, rules: Sequence[Rule], notice: NoticeRule | None) -> tuple[dict, list]:
    """Inner HTML by field (None when absent or empty), and the notices taken out."""
    elements = _outline(text)
    cuts: list[_Element] = []
    notices = []
    if notice:
        for e in elements:
            if e.css and e.css.startswith(notice.class_prefixes):
                inner = text[e.inner : e.end]
                if len(inner.encode()) < notice.max_bytes:
                    notices.append({"class": e.css, "html": inner})
                    if not cuts or e.start >= cuts[-1].close:
                        cuts.append(e)
    left = elements
    if cuts:
        starts = [cut.start for cut in cuts]

        def is_cut(e):
            i = bisect_right(starts, e.start) - 1
            return i >= 0 and e.start < cuts[i].close

        left = [e for e in elements if not is_cut(e)]
    styled = [e for e in left if e.css]
    before: dict = {}
    if any(rule.parent_after for rule in rules):
        last: dict = {}
        for e in left:
            before[e] = last.get(e.parent)
            last[e.parent] = e

    def inner_html(e):
        out, at = [], e.inner
        for cut in cuts:
            if e.inner <= cut.start < e.end:
                out.append(text[at : cut.start])
                at = cut.close
        return "".join(out) + text[at : e.end]

    def fits(e, rule):
        if rule.tag and e.tag != rule.tag:
            return False
        for name in rule.classes:
            if not _has_class(e, name):
                return False
        if rule.parent_class and not _has_class(e.parent, rule.parent_class):
            return False
        if rule.parent_after:
            previous = before.get(e.parent)
            if previous is None or previous.tag != rule.parent_after:
                return False
        if rule.inside_tag:
            up = e.parent
            while up is not None and up.tag != rule.inside_tag:
                up = up.parent
            return up is not None
        return True

    fields = {}
    for rule in rules:
        hits = (inner_html(e) for e in (styled if rule.classes else left) if fits(e, rule))
        fields[rule.field] = list(hits) if rule.many else (next(hits, None) or None)
    return fields, notices


#: Pages are taken out of Arrow and picked from so many bytes at a time, or one page.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most so many bytes in that column, or of one row."""
    start = held = 0
    for at, size in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if at > start and held + (size or 0) > most:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size or 0
    yield batch.slice(start)


def _fields_of(rules: Sequence[Rule]) -> dict[str, bool]:
    """Each field, and whether it is a list."""
    return {r.field: r.many for r in rules}


def _extract(
    pages: DataFrame, keep: Sequence[str], html: str, fields: dict[str, bool], notices: bool, rules_of
) -> DataFrame:
    """``rules_of(batch)`` gives the rules and the notice rule of each of its rows."""
    keep = list(keep)
    out = [pages.schema[c] for c in keep]
    out += [
        T.StructField(name, T.ArrayType(T.StringType()) if many else T.StringType())
        for name, many in fields.items()
    ]
    if notices:
        out.append(T.StructField("notices", NOTICE_TYPE))
    names = [f.name for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, html)):
            texts = batch.column(html).to_pylist()
            picked = [pick(text or "", *rules) for text, rules in zip(texts, rules_of(batch))]
            columns = [batch.column(c) for c in keep]
            for name, many in fields.items():
                kind = pa.list_(pa.string()) if many else pa.string()
                columns.append(pa.array([found.get(name) for found, _ in picked], kind))
            if notices:
                columns.append(pa.array([taken for _, taken in picked], _ARROW_NOTICES))
            yield pa.RecordBatch.from_arrays(columns, names)

    return pages.mapInArrow(run, T.StructType(out))


def extract_elements(
    pages: DataFrame,
    rules: Sequence[Rule],
    keep: Sequence[str],
    html: str = "html",
    notice: NoticeRule | None = None,
) -> DataFrame:
    """The ``keep`` columns, one column per rule and, with a notice rule, ``notices``."""
    same = (tuple(rules), notice)
    return _extract(
        pages.select(*keep, html), keep, html, _fields_of(rules), notice is not None, lambda _: repeat(same)
    )


@lru_cache(maxsize=1024)
def _read_rules(packed: str) -> tuple[tuple[Rule, ...], NoticeRule | None]:
    said = json.loads(packed)
    rules = tuple(
        Rule(**{f: tuple(r[f]) if f == "classes" else r.get(f) for f in Rule._fields}) for r in said["rules"]
    )
    notice = said.get("notice")
    return rules, notice and NoticeRule(tuple(notice["notice_prefixes"]), notice["notice_bytes"])


def extract_by_source(
    pages: DataFrame,
    fields: Sequence[str],
    keep: Sequence[str],
    html: str = "html",
    notices: bool = False,
) -> DataFrame:
    """As :func:`extract_elements`, each page by the rules in its column ``rules``.

    Pages get that column from their source (``Profiles.of_pages``). A field that a source
    has no rule for is NULL there.
    """
    rules_of = lambda batch: map(_read_rules, batch.column("rules").to_pylist())
    return _extract(
        pages.select(*keep, html, "rules"), keep, html, dict.fromkeys(fields, False), notices, rules_of
    )
