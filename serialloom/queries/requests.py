"""Queries on requests and on the logs of fetches and tools."""

from pyspark.sql import functions as F

from ..operators import fetchlog
from ..operators.toollog import classify_tool_log
from .inputs import table, tool_log

GAP_US = 600_000_000
STATUS = """CASE event_type WHEN 'error' THEN 429 WHEN 'signup' THEN 404
  WHEN 'purchase' THEN 500 ELSE 200 END"""


def _log(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS request_id", "user_id", "ts", f"{STATUS} AS status"
    )


def schedule(spark, sf_dir):
    wanted = table(spark, sf_dir, "events").selectExpr(
        "event_type AS host", "ts", "event_id AS request_id"
    )
    return fetchlog.fetch_schedule(wanted, gap_micros=GAP_US)


def schedule_of_bursts(spark, sf_dir):
    """All requests of a day are made at midnight: many rows share one instant."""
    wanted = table(spark, sf_dir, "events").selectExpr(
        "event_type AS host", "CAST(CAST(ts AS DATE) AS TIMESTAMP_NTZ) AS ts", "event_id AS request_id"
    )
    return fetchlog.fetch_schedule(wanted, gap_micros=GAP_US, blocks=40)


def _schedule_sql(ts):
    return f"""
WITH r AS (SELECT event_type AS host, {ts} AS ts, event_id AS request_id,
                  epoch_us({ts}) AS us,
                  row_number() OVER (PARTITION BY event_type ORDER BY {ts}, event_id) AS i FROM events),
s AS (SELECT *, CAST(max(us - i * {GAP_US}) OVER (PARTITION BY host ORDER BY i
               ROWS UNBOUNDED PRECEDING) + i * {GAP_US} AS BIGINT) AS start_us FROM r)
SELECT host, ts, request_id, start_us, start_us - us AS delay_us FROM s
"""


def backoff(spark, sf_dir):
    return fetchlog.backoff_runs(_log(spark, sf_dir))


def backoff_per_user(spark, sf_dir):
    return fetchlog.backoff_runs(_log(spark, sf_dir), partition_by="user_id")


def _backoff_sql(key):
    part = f"PARTITION BY {key}" if key else ""
    islands = f"PARTITION BY {key}, island" if key else "PARTITION BY island"
    return f"""
WITH log AS (SELECT event_id AS request_id, user_id, ts, {STATUS} AS status FROM events),
cut AS (SELECT *, coalesce(sum(CASE WHEN status = 200 THEN 1 ELSE 0 END) OVER ({part}
          ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM log),
run AS (SELECT *, least(11, coalesce(sum(CASE WHEN status = 429 THEN 1 ELSE 0 END) OVER ({islands}
          ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS b FROM cut)
SELECT request_id, user_id, ts, status, CAST(b AS INTEGER) AS bounce,
       CAST(CASE WHEN b > 0 THEN 8 * pow(2, b) ELSE 0 END AS BIGINT) AS wait_seconds FROM run
"""


def outcomes(spark, sf_dir):
    runs = fetchlog.backoff_runs(_log(spark, sf_dir))
    return runs.select(
        "request_id", fetchlog.fetch_outcome(F.col("status"), F.col("bounce")).alias("outcome")
    )


def tool_outcomes(spark, sf_dir):
    return classify_tool_log(tool_log(spark, sf_dir))


TOOL_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS book_id,
       CASE WHEN o_orderkey % 12 = 1 THEN 'Skipped'
            WHEN o_orderkey % 6 = 0 THEN 'UpToDate' WHEN o_orderkey % 6 = 1 THEN 'Updated'
            WHEN o_orderkey % 6 = 2 THEN 'MoreChapterThanSource'
            WHEN o_orderkey % 6 IN (3, 4) THEN 'Skipped' ELSE 'Error' END AS outcome,
       CAST(CASE WHEN o_orderkey % 12 = 1 THEN NULL WHEN o_orderkey % 6 = 1 THEN 7
                 WHEN o_orderkey % 6 = 2 THEN 4 END AS INTEGER) AS n,
       CASE WHEN o_orderkey % 6 = 5 THEN 'no known line in the tool''s output' END AS error
FROM orders
"""


QUERIES = {
    "fetch_schedule": (schedule, _schedule_sql("ts")),
    "fetch_schedule_bursts": (
        schedule_of_bursts,
        _schedule_sql("CAST(CAST(ts AS DATE) AS TIMESTAMP)"),
    ),
    "backoff_runs": (backoff, _backoff_sql(None)),
    "backoff_runs_per_key": (backoff_per_user, _backoff_sql("user_id")),
    "fetch_outcome": (
        outcomes,
        f"""SELECT request_id, CASE WHEN status = 429 AND bounce < 11 THEN 'retry'
            WHEN status = 404 THEN 'broken_link' WHEN status >= 400 THEN 'http_error'
            ELSE 'ok' END AS outcome FROM ({_backoff_sql(None)})""",
    ),
    "classify_tool_log": (tool_outcomes, TOOL_SQL),
}
