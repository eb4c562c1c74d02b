"""What a book file is made of: table of contents, manifest and spine.

Chapters come with ``pos`` 1..n from reading_order, so play order needs no
ranking here; everything below is row-wise.
"""

from pyspark.sql import Column, DataFrame, functions as F

# The entries that every book has.
PAGE_TYPE = "application/xhtml+xml"
TITLE_PAGE = "text/title.xhtml"
FIXED_ITEMS = (
    # seq, item id, href, media type, properties
    (0, "title", "text/title.xhtml", PAGE_TYPE, None),
    (1, "stylesheet", "styles/stylesheet.css", "text/css", None),
    (2, "toc", "toc.ncx", PAGE_TYPE, None),
    (3, "nav", "nav.xhtml", PAGE_TYPE, "nav"),
)


def chapter_path(identifier: Column) -> Column:
    return F.concat(F.lit("text/"), identifier, F.lit(".xhtml"))


def table_of_contents(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """Cover (0) and chapters (1..n) per book; ``in_nav`` leaves out the cover."""
    cover = books.select(
        "book_id",
        F.lit(0).cast("long").alias("play_order"),
        F.lit("cover").alias("nav_id"),
        F.lit("Cover").alias("label"),
        F.lit(TITLE_PAGE).alias("target"),
        F.lit(False).alias("in_nav"),
    )
    rest = chapters.select(
        "book_id",
        F.col("pos").cast("long").alias("play_order"),
        F.col("identifier").alias("nav_id"),
        F.col("title").alias("label"),
        chapter_path(F.col("identifier")).alias("target"),
        F.lit(True).alias("in_nav"),
    )
    return cover.unionByName(rest)


def manifest(books: DataFrame, chapters: DataFrame, names: DataFrame) -> DataFrame:
    """One row per item: the fixed ones, one per image, one per chapter.

    Items sort by (section, seq, item_id) within a book.
    """
    fixed = books.select(
        "book_id",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit("1_fixed").alias("section"),
                        F.lit(seq).cast("long").alias("seq"),
                        F.lit(item).alias("item_id"),
                        F.lit(href).alias("href"),
                        F.lit(media).alias("media_type"),
                        F.lit(properties).cast("string").alias("properties"),
                    )
                    for seq, item, href, media, properties in FIXED_ITEMS
                ]
            )
        ),
    )
    none = F.lit(None).cast("string").alias("properties")
    images = names.select(
        "book_id",
        F.lit("2_image").alias("section"),
        F.lit(0).cast("long").alias("seq"),
        F.col("filename").alias("item_id"),
        F.concat(F.lit("images/"), "filename").alias("href"),
        F.concat(F.lit("image/"), F.substring_index("filename", ".", -1)).alias("media_type"),
        none,
    )
    pages = chapters.select(
        "book_id",
        F.lit("3_chapter").alias("section"),
        F.col("pos").cast("long").alias("seq"),
        F.col("identifier").alias("item_id"),
        chapter_path(F.col("identifier")).alias("href"),
        F.lit(PAGE_TYPE).alias("media_type"),
        none,
    )
    return fixed.unionByName(images).unionByName(pages)


def spine(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """Reading sequence: the title page (0), then the chapters (1..n)."""
    title = books.select(
        "book_id", F.lit(0).cast("long").alias("seq"), F.lit("title").alias("idref")
    )
    return title.unionByName(
        chapters.select(
            "book_id", F.col("pos").cast("long").alias("seq"), F.col("identifier").alias("idref")
        )
    )
