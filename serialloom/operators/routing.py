"""Which source takes care of a book url."""

from collections.abc import Sequence
from itertools import groupby
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas
from ..fixed_values import COMPAT_HOSTS, NATIVE_BOOK_PREFIX

NATIVE, COMPAT, UNSUPPORTED = "native", "compat", "unsupported"


class SourceRule(NamedTuple):
    priority: int
    match_kind: str  # "prefix" or "contains"
    pattern: str
    source: str


NATIVE_RULES = (SourceRule(0, "prefix", NATIVE_BOOK_PREFIX, NATIVE),)
COMPAT_RULES = tuple(
    SourceRule(1 + i, "contains", host, COMPAT) for i, host in enumerate(COMPAT_HOSTS)
)
ALL_RULES = NATIVE_RULES + COMPAT_RULES


def source_rules(spark: SparkSession, rules: Sequence[SourceRule] = ALL_RULES) -> DataFrame:
    """The rules as a table, for keeping and editing."""
    return spark.createDataFrame(list(rules), schemas.SOURCE_RULES)


def _any_hit(url: Column, patterns: Column, test) -> Column:
    return F.exists(patterns, lambda pattern: test(url, pattern))


def source_of(url: Column, rules: Sequence[SourceRule] = ALL_RULES) -> Column:
    """Source of the first rule, by priority, that the url matches."""
    tests = {"prefix": F.startswith, "contains": F.contains}
    ordered = sorted(rules, key=lambda rule: rule.priority)
    picks = []
    for (kind, source), run in groupby(ordered, key=lambda rule: (rule.match_kind, rule.source)):
        patterns = F.array(*[F.lit(rule.pattern) for rule in run])
        picks.append(F.when(_any_hit(url, patterns, tests[kind]), F.lit(source)))
    return F.coalesce(*picks, F.lit(UNSUPPORTED))


def route_sources(
    urls: DataFrame, rules: Sequence[SourceRule] = ALL_RULES, url: str = "url"
) -> DataFrame:
    """Add ``source``.  A row-wise expression: no join, no shuffle."""
    return urls.withColumn("source", source_of(F.col(url), rules))


def unsupported_files(outcomes: DataFrame, files: DataFrame, existing: DataFrame) -> DataFrame:
    """Ignore rules to add: the files of unsupported books not yet listed.

    ``files`` has book_id and path.  Each rule is the file's name in its own
    directory.
    """
    lost = outcomes.where((F.col("outcome") == "Unsupported") & F.col("error").isNull())
    named = files.join(lost.select("book_id"), "book_id", "left_semi").select(
        F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"),
        F.regexp_extract("path", r"([^/]*)$", 1).alias("pattern"),
    )
    return named.distinct().join(
        existing.select("dir", "pattern").distinct(), ["dir", "pattern"], "left_anti"
    )
