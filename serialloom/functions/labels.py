"""Column functions for names and report lines."""

from pyspark.sql import Column, functions as F

from ..fixed_values import TITLE_DISPLAY_CHARS


def strip_ext(item_id: Column) -> Column:
    return F.replace(item_id, F.lit(".xhtml"), F.lit(""))


def stable_id(seed: Column) -> Column:
    """An id in uuid form made from the seed, so that a task that runs twice
    gives the same one."""
    digest = F.md5(seed)
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in cuts])


def untitled(path: Column) -> Column:
    return F.concat(path, F.lit(" (No Title)"))


def summary_line(outcome: Column, n: Column, title: Column) -> Column:
    """'[  +3] Title' for a book worth reporting, NULL for a silent one."""
    signed = F.when(outcome == "Updated", n).when(outcome == "MoreChapterThanSource", -n)
    mark = (
        F.when(outcome == "Skipped", F.lit("Skip"))
        .otherwise(F.format_string("%+d", signed))
    )
    shown = outcome.isin("Updated", "MoreChapterThanSource", "Skipped")
    return F.when(
        shown,
        F.concat(
            F.lit("["),
            F.when(F.length(mark) < 4, F.lpad(mark, 4, " ")).otherwise(mark),
            F.lit("] "),
            F.substring(title, 1, TITLE_DISPLAY_CHARS),
        ),
    )
