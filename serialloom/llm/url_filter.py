"""URL filters: a trie over reversed host labels and path segments, longest match wins."""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes

#: Rules in one broadcast trie; more are refused, as a trie must fit into each worker.
MOST_RULES = 1_000_000
DEFAULT = "allow"

#: (host, path, verdict)
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def split_url(url: bytes) -> tuple[bytes, bytes]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, mark, rest = url.partition(b"://")
    if not mark:
        return b"", b""
    ends = [at for c in (b"/", b"?", b"#") if (at := rest.find(c)) >= 0]
    host = rest[: min(ends)] if ends else rest
    path = rest[len(host) :].partition(b"#")[0].partition(b"?")[0]
    return host.translate(_LOWER), path


class Trie:
    """Nodes are dicts of children by label or segment; whole hosts lead to path tries.

    A path is cut behind each slash. A rule's last segment without a slash matches the
    beginning of a segment, so such rests stand in a list at their node.
    """

    def __init__(self, rules: list[tuple[bytes, bytes, str]]):
        self.root = {"next": {}, "paths": None}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.split(b".")) if host else []:
                node = node["next"].setdefault(label, {"next": {}, "paths": None})
            if node["paths"] is None:
                node["paths"] = {"next": {}, "rule": None, "rests": {}}
            at = node["paths"]
            *segments, rest = path.split(b"/")
            for segment in segments:
                at = at["next"].setdefault(segment, {"next": {}, "rule": None, "rests": {}})
            held = at["rests"].get(rest) if rest else at["rule"]
            # of a rule that is both allowed and blocked, block holds
            rule = (host + path, "block" if held and "block" in (held[1], verdict) else verdict)
            if rest:
                at["rests"][rest] = rule
            else:
                at["rule"] = rule

    def match(self, host: bytes, path: bytes) -> tuple[bytes, str] | None:
        """The rule with the longest text; of equals, the one with the longer host."""
        node, best = self.root, None
        labels = host.split(b".") if host else []
        *segments, last = path.split(b"/")
        for label in [None, *reversed(labels)]:
            if label is not None:
                node = node["next"].get(label)
                if node is None:
                    break
            at = node["paths"]
            if at is None:
                continue
            for k in range(len(segments) + 1):
                for rest, rule in at["rests"].items():
                    following = segments[k] if k < len(segments) else last
                    if following.startswith(rest):
                        best = self._better(best, rule)
                if at["rule"]:
                    best = self._better(best, at["rule"])
                if k == len(segments):
                    break
                at = at["next"].get(segments[k])
                if at is None:
                    break
        return best

    @staticmethod
    def _better(best, rule):
        return rule if best is None or len(rule[0]) >= len(best[0]) else best


def _judge(rules, default: str):
    def run(batches):
        trie = Trie(rules.value)
        for batch in batches:
            out = []
            for url in as_bytes(batch.column("url")):
                host, path = split_url(url)
                rule = trie.match(host, path)
                out.append((host, path, rule and rule[0], rule[1] if rule else default))
            columns = [pa.array([o[i] for o in out], pa.binary()).cast(pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *columns, pa.array([o[3] for o in out], pa.string())],
                ["key", "host", "path", "rule", "verdict"],
            )

    return run


def filter_urls(
    pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = DEFAULT
) -> DataFrame:
    """A row per page: ``key``, host, path, rule, verdict.

    ``rules`` has host, path and verdict (allow or block). A rule fits its host and all
    subdomains if the path starts with the rule's; the longest rule (host and path written
    together) wins, of equal length the one with the longer host, of the same rule twice
    the blocking one. Pages that no rule fits get a null rule and ``default``. A null url,
    or one without ``://``, has an empty host and path. A rule with a null host fits every
    host, one with a null path every path, one with a null verdict is left out. Repeated
    rows and further columns change nothing; an empty table gives no rows.
    """
    kind = pages.schema[key].dataType.simpleString()
    texts = rules.select(
        F.coalesce(F.lower("host"), F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    )
    held = texts.filter("verdict IS NOT NULL").distinct().limit(MOST_RULES + 1).collect()
    if len(held) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    sent = pages.sparkSession.sparkContext.broadcast(
        sorted((r.host.encode(), r.path.encode(), r.verdict) for r in held)
    )
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"))
    schema = f"key {kind}, host string, path string, rule string, verdict string"
    return rows.mapInArrow(_judge(sent, default), schema).withColumnRenamed("key", key)


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"))


SQL = r"""
WITH u AS (
  SELECT row_number() OVER () AS rid, page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT rid, page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM u),
r(h, q, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT rid, h || q AS rule, verdict,
         row_number() OVER (PARTITION BY rid ORDER BY length(h || q) DESC, length(h) DESC) AS k
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM p LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (rid)
"""

QUERIES = {"op9_url_filter": (op9_url_filter, SQL)}
