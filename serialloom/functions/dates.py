"""Column functions that read dates with a zone; anything else is NULL."""

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Zone names that a feed date may carry, and their offsets.
ZONE_OFFSETS = {
    "UT": "+0000",
    "GMT": "+0000",
    "Z": "+0000",
    "EST": "-0500",
    "EDT": "-0400",
    "CST": "-0600",
    "CDT": "-0500",
    "MST": "-0700",
    "MDT": "-0600",
    "PST": "-0800",
    "PDT": "-0700",
}


def rfc3339(text: Column) -> Column:
    """'2024-01-31T10:00:00+02:00' as an instant.

    The shape is tested first because a bare date would cast as well.
    """
    t = F.upper(text)
    shape = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
    return F.when(t.rlike(shape), t.try_cast("timestamp"))


def rfc2822(text: Column) -> Column:
    """'Wed, 31 Jan 2024 10:00:00 GMT' as an instant.

    The weekday is optional, but one that contradicts the date makes the text
    invalid.  Seconds are optional, and so are comments in brackets.  Years of two
    digits are 1950 to 2049, those of three count from 1900.
    """
    shape = (
        r"(?i)^\s*(?:([a-z]{3})\s*,)?\s*(\d{1,2}\s+[a-z]{3})\s+(\d{2,4})\s+"
        r"(\d{2}:\d{2})(:\d{2})?\s*([+-]\d{4}|[a-z]{1,3})\s*$"
    )

    text = F.regexp_replace(text, r"\([^()]*\)", " ")
    # One match gives all parts; the lambda binds them, so it runs once per text.
    parts = F.split(F.regexp_replace(text, shape, "$1|$2|$3|$4|$5|$6"), r"\|")
    offsets = F.create_map(*[F.lit(x) for pair in ZONE_OFFSETS.items() for x in pair])

    def parse(p):
        zone = F.upper(p[5])
        offset = F.when(zone.rlike("^[+-]"), zone).otherwise(F.try_element_at(offsets, zone))
        digits, year = F.length(p[2]), p[2].cast("int")
        year = year + F.when(digits == 4, 0).when((digits == 2) & (year < 50), 2000).otherwise(1900)
        day = F.concat(F.initcap(F.regexp_replace(p[1], r"\s+", " ")), F.lit(" "), year.cast("string"))
        seconds = F.when(p[4] == "", F.lit(":00")).otherwise(p[4])
        moment = F.try_to_timestamp(
            F.concat(day, F.lit(" "), p[3], seconds, F.lit(" "), offset),
            F.lit("d MMM yyyy HH:mm:ss Z"),
        )
        named = F.date_format(F.try_to_timestamp(day, F.lit("d MMM yyyy")), "EEE")
        return F.when((p[0] == "") | (F.lower(p[0]) == F.lower(named)), moment)

    matched = F.filter(F.array(text), lambda t: t.rlike(shape))
    return F.try_element_at(
        F.transform(F.transform(matched, lambda _: parts), parse), F.lit(1)
    )


def time_literal(moment: datetime, kind: T.DataType) -> Column:
    """A moment (UTC unless it has a zone) as a timestamp with or without zone."""
    aware = moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)
    text = aware.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(kind, T.TimestampNTZType):
        return F.lit(text).cast(kind)
    return F.lit(text + "Z").cast("timestamp")


def epoch_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970; a timestamp without zone is taken as UTC."""
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        start = F.lit("1970-01-01").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", start, F.col(name))
    return F.unix_micros(F.col(name).cast("timestamp"))
