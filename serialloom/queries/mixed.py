"""Jobs over books of several sources at once."""

from pyspark.sql import functions as F

from ..fixed_values import COMPAT_HOSTS, NATIVE_BOOK_PREFIX
from ..operators import routing
from ..plans.maintain import Crawled, Stored, create_books, update_books
from ..sources.elements import Rule
from ..sources.profiles import NATIVE, SourceProfile
from . import inputs
from .inputs import RUN_TS, table
from .library import JOB, shelf

SECOND = SourceProfile(
    "second",
    "https://second.example",
    index_rules=(Rule("title", tag="h2", classes=("name",)), Rule("author", tag="span", classes=("writer",)), Rule("description", tag="blockquote")),
    chapter_rules=(Rule("content", tag="article"), Rule("note_end", classes=("after",))),
    cover_script=r'(?d)cover="(.*)";',
    chapters_script=r"(?d)list=(\[.*\])",
)
RULES = (
    *routing.ALL_RULES,
    routing.SourceRule(0, "prefix", f"{SECOND.site}/", "second"),
    routing.SourceRule(0, "prefix", "https://third.example/", "third"),
)
PROFILES = (NATIVE, SECOND)

KIND = """CASE WHEN o_orderkey % 11 = 0 THEN 'none' WHEN o_orderkey % 17 = 0 THEN 'third' WHEN o_orderkey % 3 = 2 THEN 'compat'
  WHEN o_orderkey % 3 = 1 THEN 'second' ELSE 'native' END"""
URL = f"""CASE {KIND} WHEN 'none' THEN 'https://nowhere.example/' || {{k}} WHEN 'third' THEN 'https://third.example/' || {{k}}
  WHEN 'compat' THEN 'https://{COMPAT_HOSTS[0]}/s/' || {{k}} WHEN 'second' THEN '{SECOND.site}/b/' || {{k}}
  ELSE '{NATIVE_BOOK_PREFIX}' || {{k}} || '/book' END"""
BROKEN = "o_orderkey % 13 = 0"


def _second_pages(spark, sf_dir):
    """Index and chapter pages of the second source, which look quite different."""
    orders = table(spark, sf_dir, "orders").where(f"{KIND} = 'second'")
    entry = (
        "'{{\"id\":' || (o_orderkey * 10 + {n}) || ',\"order\":{n},\"date\":\"' || "
        "date_format(o_orderdate + INTERVAL {n} DAY, \"yyyy-MM-dd'T'HH:mm:ss\") || 'Z\"'"
        " || ',\"title\":\"Page {n}\",\"url\":\"/b/' || o_orderkey || '/{n}\"}}'"
    )
    listed = " || ',' || ".join(entry.format(n=n) for n in (1, 2, 3))
    index = orders.selectExpr(
        f"'{SECOND.site}/b/' || o_orderkey AS url",
        "'<h2 class=\"big name\">Title ' || o_orderkey || '</h2><span class=\"writer\">w</span><script>cover=\"https://cdn2/'"
        f" || o_orderkey || '.jpg\";\\nlist=[' || {listed} || ']\\n</script>' AS html",
    )
    chapters = orders.where("o_orderkey % 7 <> 0").selectExpr(
        f"'{SECOND.site}/b/' || o_orderkey || '/3' AS url",
        "'<nav>menu</nav><article><p>Other ' || o_orderkey || '</p></article><div class=\"after\">bye</div>' AS html",
    )
    return index, chapters


def _crawled(spark, sf_dir):
    _, _, native = shelf(spark, sf_dir)
    index, chapters = _second_pages(spark, sf_dir)
    return Crawled(native.index_pages.unionByName(index), native.chapter_pages.unionByName(chapters))


def _update(spark, sf_dir):
    stored, feed, _ = shelf(spark, sf_dir)
    kinds = table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS book_id",
        f"CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE {URL.format(k='o_orderkey')} END AS url",
    )
    books = stored.books.drop("url").join(kinds, "book_id").select(*stored.books.columns)
    broken = table(spark, sf_dir, "orders").where(BROKEN).selectExpr(
        "'/lib/' || o_orderkey || '.epub' AS path", "'BadZipFile' AS error"
    )
    log = inputs.tool_log(spark, sf_dir).where("CAST(run_id AS BIGINT) % 2 = 0")
    return update_books(
        Stored(books, stored.chapters, stored.content), feed, _crawled(spark, sf_dir), RUN_TS,
        rules=RULES, profiles=PROFILES, tool_log=log, unreadable=broken,
    )


def update_outcomes(spark, sf_dir):
    """One outcome per book of any source, and per file that is no book."""
    return _update(spark, sf_dir).outcomes


def update_content(spark, sf_dir):
    return _update(spark, sf_dir).new_content


def create_outcomes(spark, sf_dir):
    """One outcome per url of any source."""
    orders = table(spark, sf_dir, "orders")
    urls = orders.selectExpr(f"{URL.format(k='o_orderkey')} AS url")
    more = orders.where("o_orderkey % 10 = 0").selectExpr(f"'{NATIVE_BOOK_PREFIX}' || o_orderkey || '/zz' AS url")
    return create_books(urls.unionByName(more), _crawled(spark, sf_dir), RUN_TS, rules=RULES, profiles=PROFILES).outcomes


def fetched_twice(spark, sf_dir):
    """New texts where every chapter was fetched twice, some of them twice at one moment."""
    stored, feed, crawled = shelf(spark, sf_dir)
    pages = crawled.chapter_pages
    early = F.lit("2024-05-01 00:00:00").cast("timestamp")
    late = F.lit("2024-05-02 00:00:00").cast("timestamp")
    old = pages.select("url", F.regexp_replace("html", "Text", "Draft").alias("html"), early.alias("fetched_at"))
    new = pages.withColumn("fetched_at", late)
    again = new.where("length(url) % 2 = 0")
    index = crawled.index_pages.withColumn("fetched_at", early)
    both = Crawled(index.unionByName(index), old.unionByName(new).unionByName(again))
    return update_books(stored, feed, both, RUN_TS).new_content


TOOL = """CASE WHEN k % 6 = 0 THEN 'UpToDate' WHEN k % 6 = 2 THEN 'MoreChapterThanSource' ELSE 'Skipped' END"""
KINDS_SQL = f"""{JOB}, kinds AS (
  SELECT *, o_orderkey AS k, {KIND} AS kind, {URL.format(k='book_id')} AS url FROM j),
judged AS (
  SELECT *, CASE WHEN kind = 'native' THEN error WHEN kind = 'third' THEN 'no profile for the source third' END AS fault
  FROM kinds)"""
UUID = "h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32]"

QUERIES = {
    "update_job_mixed_sources": (
        update_outcomes,
        f"""WITH {KINDS_SQL}
            SELECT book_id, CASE WHEN kind = 'none' THEN 'Unsupported' WHEN kind = 'compat' THEN CASE WHEN k % 2 = 0 THEN {TOOL} ELSE 'Error' END
                WHEN current THEN 'UpToDate' WHEN fault IS NOT NULL THEN 'Error' ELSE 'Updated' END AS outcome,
              CAST(CASE WHEN kind = 'compat' AND k % 6 = 2 THEN 4
                WHEN kind IN ('native', 'second') AND NOT current AND fault IS NULL THEN CASE WHEN k % 4 = 0 THEN 2 ELSE 1 END END AS INTEGER) AS n,
              CASE WHEN kind = 'compat' THEN CASE WHEN k % 2 = 1 THEN 'no run of the external updater' END WHEN NOT current THEN fault END AS error
            FROM judged
            UNION ALL
            SELECT {UUID}, 'Unsupported', NULL, NULL FROM (SELECT md5('/lib/' || CAST(o_orderkey AS VARCHAR) || '.epub') AS h FROM orders WHERE {BROKEN})""",
    ),
    "update_job_mixed_content": (
        update_content,
        f"""WITH {KINDS_SQL}
            SELECT book_id, third AS identifier, CASE kind WHEN 'second' THEN '<p>Other ' || book_id || '</p>'
              ELSE '<p class="x">Text 3 of ' || book_id || '</p><img src="https://cdn/' || book_id || '/3.png">' END AS content,
              CAST(NULL AS VARCHAR) AS note_start, CASE kind WHEN 'second' THEN 'bye' END AS note_end
            FROM judged WHERE kind IN ('native', 'second') AND NOT current AND fault IS NULL AND k % 7 <> 0""",
    ),
    "create_job_mixed_sources": (
        create_outcomes,
        f"""WITH {KINDS_SQL}, ided AS (SELECT *, md5(url) AS h FROM judged)
            SELECT CASE WHEN kind = 'native' THEN book_id ELSE {UUID} END AS book_id,
              CASE WHEN kind = 'none' THEN 'Unsupported' WHEN kind = 'compat' OR fault IS NOT NULL THEN 'Error' ELSE 'Updated' END AS outcome,
              CAST(CASE WHEN kind IN ('native', 'second') AND fault IS NULL THEN 3 END AS INTEGER) AS n,
              CASE WHEN kind = 'compat' THEN 'no run of the external updater' ELSE fault END AS error FROM ided
            UNION ALL
            SELECT CASE WHEN kind = 'native' THEN {UUID.replace('h[', 'h2[')} ELSE book_id END,
              CASE WHEN kind = 'native' THEN 'Skipped' ELSE 'Error' END, NULL,
              CASE WHEN kind = 'native' THEN 'another url of the book ' || book_id || ': {NATIVE_BOOK_PREFIX}' || book_id || '/zz'
                   ELSE 'index page was not fetched' END
            FROM (SELECT *, md5(book_id || ' {NATIVE_BOOK_PREFIX}' || book_id || '/zz') AS h2 FROM judged WHERE k % 10 = 0)""",
    ),
    "update_job_fetched_twice": (
        fetched_twice,
        f"""WITH {JOB} SELECT book_id, third AS identifier,
            '<p class="x">Text 3 of ' || book_id || '</p><img src="https://cdn/' || book_id || '/3.png">' AS content,
            CAST(NULL AS VARCHAR) AS note_start, CAST(NULL AS VARCHAR) AS note_end
            FROM u WHERE o_orderkey % 7 <> 0""",
    ),
}
