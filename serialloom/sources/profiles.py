"""What the jobs know of the sites they read, as tables.

A site is a row of ``SOURCES`` and some rows of ``RULES``; pages of all sites go through one
job, each by the rules of its own source. Both tables are small: they are written by hand.
"""

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..fixed_values import NATIVE_SITE
from ..functions.html import CHAPTERS_SCRIPT, COVER_SCRIPT
from .chapter_pages import CHAPTER_NOTICES, CHAPTER_RULES
from .elements import NoticeRule, Rule
from .fiction import FICTION_RULES

INDEX, CHAPTER = "index", "chapter"


class SourceProfile(NamedTuple):
    """What the jobs must know of a site: its name in the source rules, where its
    links lead, and how to pick the parts out of its pages."""

    name: str
    site: str
    index_rules: Sequence[Rule] = FICTION_RULES
    chapter_rules: Sequence[Rule] = CHAPTER_RULES
    notices: NoticeRule | None = None
    cover_script: str = COVER_SCRIPT
    chapters_script: str = CHAPTERS_SCRIPT


NATIVE = SourceProfile("native", NATIVE_SITE, notices=CHAPTER_NOTICES)


class Profiles(NamedTuple):
    sources: DataFrame  # schemas.SOURCES
    rules: DataFrame  # schemas.ELEMENT_RULES

    def of_pages(self, page: str) -> DataFrame:
        """(source, site, cover_script, chapters_script, rules): a row per source, its rules for
        one kind of page as one text, which pages carry through their job.

        Someone has written each row by hand, so a join broadcasts them; pages of one source
        then need not meet.
        """
        listed = (
            self.rules.where(F.col("page") == page)
            .groupBy("source")
            .agg(F.sort_array(F.collect_list(F.struct("seq", *Rule._fields))).alias("_rules"))
        )
        notice = F.when(F.size("notice_prefixes") > 0, F.struct("notice_prefixes", "notice_bytes"))
        packed = F.to_json(F.struct(F.col("_rules").alias("rules"), notice.alias("notice")))
        known = self.sources.join(listed, "source").select(
            "source", "site", "cover_script", "chapters_script", packed.alias("rules")
        )
        return F.broadcast(known)


def profile_tables(spark: SparkSession, profiles: Sequence[SourceProfile] = (NATIVE,)) -> Profiles:
    """Profiles as tables, for keeping, editing and running."""
    sources, rules = [], []
    for p in profiles:
        notice = p.notices or NoticeRule((), 0)
        sources.append((p.name, p.site, p.cover_script, p.chapters_script, list(notice.class_prefixes), notice.max_bytes))
        for page, some in ((INDEX, p.index_rules), (CHAPTER, p.chapter_rules)):
            rules += [(p.name, page, seq, *rule._replace(classes=list(rule.classes))) for seq, rule in enumerate(some)]
    return Profiles(
        spark.createDataFrame(sources, schemas.SOURCES), spark.createDataFrame(rules, schemas.ELEMENT_RULES)
    )
