"""Chapter files written by the external updater."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .elements import Rule, extract_elements

# Where that tool puts text and notes, and how it writes a heading.
COMPAT_RULES = (
    Rule("body", tag="body"),
    Rule("notes", classes=("author-note-portlet",), many=True),
)
HEADING = ('<h3 class="fff_chapter_title">', "</h3>")


def compat_columns(body: Column, notes: Column, title: Column) -> dict[str, Column]:
    """content, note_start and note_end from the body and the list of its notes.

    The last note is the end note and the one before it the start note, so a
    single note is an end note.
    """
    end = F.try_element_at(notes, F.lit(-1))
    start = F.try_element_at(notes, F.lit(-2))
    text = F.replace(body, F.concat(F.lit(HEADING[0]), title, F.lit(HEADING[1])), F.lit(""))
    for note in (start, end):
        text = F.when(note.isNull(), text).otherwise(F.replace(text, note, F.lit("")))
    return {"content": text, "note_start": start, "note_end": end}


def ingest_compat_chapters(
    raw: DataFrame, keep: Sequence[str] = ("book_id", "identifier"), html: str = "html"
) -> DataFrame:
    """chapter_content of chapter files with the ``keep`` columns, title and html."""
    keep = list(keep)
    parsed = extract_elements(raw, COMPAT_RULES, [*keep, "title"], html=html)
    made = compat_columns(F.col("body"), F.col("notes"), F.coalesce("title", F.lit("")))
    return parsed.select(*keep, *[c.alias(name) for name, c in made.items()])
