"""Chapter pages: the text, the author's notes, and short notices set apart."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..fixed_values import NOTICE_MAX_BYTES
from .elements import NoticeRule, Rule, extract_elements

# Where the parts of a chapter page are.
CHAPTER_RULES = (
    Rule("content", classes=("chapter-inner", "chapter-content")),
    Rule("note_start", classes=("author-note",), parent_class="portlet", parent_after="hr"),
    Rule("note_end", classes=("author-note",), parent_class="portlet", parent_after="div"),
)
# Class prefixes of notices hidden between the paragraphs.
NOTICE_PREFIXES = ("cj", "cm")
CHAPTER_NOTICES = NoticeRule(NOTICE_PREFIXES, NOTICE_MAX_BYTES)


def split_notices(
    nodes: DataFrame,
    prefixes: Sequence[str] = NOTICE_PREFIXES,
    max_bytes: int = NOTICE_MAX_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """(nodes that stay, notices): a notice is short and its class has a prefix.

    Size is in bytes.  Notices ask not to publish a text elsewhere; they are kept
    in a table of their own, so that what was left out can be checked.
    """
    prefixed = F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith("class", p))
    notice = F.coalesce(prefixed & (F.octet_length("html") < max_bytes), F.lit(False))
    return nodes.where(~notice), nodes.where(notice)


def extract_chapter_pages(
    pages: DataFrame,
    keep: Sequence[str],
    rules: Sequence[Rule] = CHAPTER_RULES,
    notice: NoticeRule | None = CHAPTER_NOTICES,
) -> DataFrame:
    """``keep`` columns, content, note_start, note_end and the list of notices."""
    return extract_elements(pages, rules, keep, notice=notice)


def ingest_chapter_pages(
    pages: DataFrame,
    rules: Sequence[Rule] = CHAPTER_RULES,
    notice: NoticeRule = CHAPTER_NOTICES,
) -> tuple[DataFrame, DataFrame]:
    """(chapter_content, notices) of pages with book_id, identifier and html."""
    parsed = extract_chapter_pages(pages, ["book_id", "identifier"], rules, notice)
    content = parsed.select("book_id", "identifier", "content", "note_start", "note_end")
    notices = parsed.select("book_id", "identifier", F.inline("notices"))
    return content, notices
