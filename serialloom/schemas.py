"""Table schemas.  Schemas are always given, never inferred."""

from pyspark.sql import types as T


def _struct(*fields):
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


_s, _i, _l, _ts, _b, _d = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.TimestampType(),
    T.BinaryType(),
    T.DoubleType(),
)

BOOKS = _struct(
    ("book_id", _s, False),
    ("url", _s, False),
    ("title", _s, False),
    ("author", _s, False),
    ("description", _s, False),
    ("date_published", _ts, False),
    ("cover_url", _s, False),
)
CHAPTERS = _struct(
    ("book_id", _s, False),
    ("identifier", _s, False),
    ("pos", _l, False),
    ("date_published", _ts, False),
    ("title", _s, False),
    ("url", _s, False),
)
CHAPTER_CONTENT = _struct(
    ("book_id", _s, False),
    ("identifier", _s, False),
    ("content", _s, True),
    ("note_start", _s, True),
    ("note_end", _s, True),
)
HIGH_WATER = _struct(("book_id", _s, False), ("current_max", _ts, True))
FETCHED_BOOKS = BOOKS
FETCHED_CHAPTERS = _struct(
    ("book_id", _s, False),
    ("identifier", _s, False),
    ("ord", _l, False),
    ("arr_pos", _l, False),
    ("date_published", _ts, False),
    ("title", _s, False),
    ("url", _s, False),
)
FEED_ITEMS = _struct(
    ("book_id", _s, False),
    ("feed_title", _s, True),
    ("published", _ts, True),
)
PAGES = _struct(("url", _s, False), ("html", _s, False), ("fetched_at", _ts, True))
ASSETS = _struct(
    ("book_id", _s, False),
    ("filename", _s, False),
    ("url", _s, True),
    ("mime", _s, True),
    ("bytes", _b, True),
)
ASSET_NAMES = _struct(("book_id", _s, False), ("url", _s, False), ("filename", _s, False))
SOURCE_RULES = _struct(
    ("priority", _i, False),
    ("match_kind", _s, False),
    ("pattern", _s, False),
    ("source", _s, False),
)
_list = T.ArrayType(_s)
SOURCES = _struct(
    ("source", _s, False),
    ("site", _s, False),
    ("cover_script", _s, False),
    ("chapters_script", _s, False),
    ("notice_prefixes", _list, False),
    ("notice_bytes", _i, False),
)
ELEMENT_RULES = _struct(
    ("source", _s, False),
    ("page", _s, False),
    ("seq", _i, False),
    ("field", _s, False),
    ("tag", _s, True),
    ("classes", _list, False),
    ("inside_tag", _s, True),
    ("parent_class", _s, True),
    ("parent_after", _s, True),
    ("many", T.BooleanType(), False),
)
IGNORE_RULES = _struct(("dir", _s, False), ("line_no", _l, False), ("pattern", _s, False))
FETCH_LOG = _struct(
    ("request_id", _l, False),
    ("host", _s, False),
    ("ts", _ts, False),
    ("status", _i, False),
)
TOOL_LOG = _struct(
    ("run_id", _s, False),
    ("stream", _s, False),
    ("line_no", _l, False),
    ("line", _s, False),
)
PROGRESS = _struct(("book_id", _s, False), ("percent_finished", _d, False))
OUTCOMES = _struct(
    ("book_id", _s, False),
    ("outcome", _s, False),
    ("n", _i, True),
    ("error", _s, True),
)
