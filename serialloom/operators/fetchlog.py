"""Pacing and audit of requests, as tables."""

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import BACKOFF_BASE_SECONDS, BACKOFF_CAP, REQUESTS_PER_SECOND
from ..functions.dates import epoch_micros
from .running import range_blocks, running


def fetch_schedule(
    requests: DataFrame,
    gap_micros: int = 1_000_000 // REQUESTS_PER_SECOND,
    blocks: int | None = None,
) -> DataFrame:
    """Earliest start of each request when a host takes one request per gap.

    ``requests`` has host, ts, request_id (unique).  Per host in (ts, id) order
    the start of request i is the larger of its own time and the previous start
    plus the gap, which in closed form is max over j <= i of (t_j - j*gap) + i*gap.
    Adds ``start_us`` (microseconds since the epoch) and ``delay_us``.
    """
    timed = requests.withColumn("_us", epoch_micros(requests, "ts"))
    blocked, levels = range_blocks(timed, ["host"], ["_us", "request_id"], blocks)
    paced = running(
        blocked,
        ["host"],
        levels,
        ["_us", "request_id"],
        add=F.lit(gap_micros),
        peak=F.col("_us"),
        sign=-1,
        sum_as="_spent",
        peak_as="_lead",
    )
    start = F.col("_lead") + F.col("_spent")
    return paced.select(
        *requests.columns, start.alias("start_us"), (start - F.col("_us")).alias("delay_us")
    )


def backoff_runs(
    fetch_log: DataFrame,
    partition_by: str | None = None,
    blocks: int | None = None,
) -> DataFrame:
    """How often the client had been told to slow down before each request.

    ``fetch_log`` has request_id (unique), ts, status.  Adds ``bounce`` (answers
    429 since the last success, at most the cap) and ``wait_seconds`` (0, or the
    base times 2 to the bounce).  Other error answers neither count nor reset.
    The order is global unless ``partition_by`` names a column; either way only
    block summaries meet in one task.
    """
    limited = F.col("status") == 429
    success = ~F.col("status").between(400, 599)
    timed = fetch_log.withColumn("_us", epoch_micros(fetch_log, "ts"))
    keys = [partition_by] if partition_by else []
    blocked, levels = range_blocks(timed, keys, ["_us", "request_id"], blocks)
    counted = running(
        blocked,
        keys,
        levels,
        ["_us", "request_id"],
        add=F.when(limited, 1).otherwise(0),
        peak=F.when(success, 0),
        own_row=False,
        sum_as="_limited",
        peak_as="_at_success",
    )
    since = F.col("_limited") - F.coalesce("_at_success", F.lit(0))
    bounce = F.least(since, F.lit(BACKOFF_CAP)).cast("int")
    return counted.select(
        *fetch_log.columns,
        bounce.alias("bounce"),
        wait_seconds(bounce).alias("wait_seconds"),
    )


def wait_seconds(bounce: Column) -> Column:
    """Pause before a request after ``bounce`` refusals in a row."""
    return F.when(bounce > 0, F.lit(BACKOFF_BASE_SECONDS) * F.pow(F.lit(2), bounce)).otherwise(
        0
    ).cast("long")


def fetch_outcome(status: Column, bounce: Column) -> Column:
    """What an answer means: try again, broken link, error, or a page."""
    return (
        F.when((status == 429) & (bounce < BACKOFF_CAP), F.lit("retry"))
        .when(status == 404, F.lit("broken_link"))
        .when(status.between(400, 599), F.lit("http_error"))
        .otherwise(F.lit("ok"))
    )
