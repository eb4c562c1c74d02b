"""Column functions on image bytes: the kind of an image and what to do with it."""

from pyspark.sql import Column, functions as F

from ..fixed_values import IMAGE_BOX_WIDTH, JPEG_QUALITY


#: Kinds that a book can hold, as they are or re-encoded.
USABLE_KINDS = ("png", "jpeg", "webp", "gif", "svg")


def image_kind(data: Column) -> Column:
    """png, jpeg, webp, gif by magic bytes; svg, html by text; else NULL."""
    size = F.octet_length(data)
    head = F.hex(F.substring(data, 1, 12))
    text = F.try_validate_utf8(data.cast("string"))
    return (
        F.when((size > 8) & head.startswith("89504E470D0A1A0A"), F.lit("png"))
        .when((size > 3) & head.startswith("FFD8FF"), F.lit("jpeg"))
        .when(
            (size > 11) & head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"),
            F.lit("webp"),
        )
        .when((size > 3) & head.startswith("47494638"), F.lit("gif"))
        .when(text.rlike(r"(?iU)^\s*<(?:\?xml|svg)"), F.lit("svg"))
        .when(text.rlike(r"(?iU)^\s*<(?:!doctype html>|html)"), F.lit("html"))
    )


def image_plan(kind: Column, width: Column, height: Column) -> Column:
    """struct(action, format, quality, box_width, box_height) for one image.

    Web pages are rejected, animations and vector images are kept as they are,
    the rest is fitted into a box as wide as an e-reader page.  The plan is a
    column only; no pixel is touched.
    """
    resizable = kind.isin("png", "jpeg", "webp")
    action = (
        F.when(resizable, F.lit("resize"))
        .when(kind.isin("gif", "svg"), F.lit("keep"))
        .otherwise(F.lit("reject"))
    )
    target = (
        F.when(kind.isin("png", "webp"), F.lit("png"))
        .when(kind == "jpeg", F.lit("jpeg"))
        .when(kind.isin("gif", "svg"), kind)
    )
    box_height = F.when(
        width > 0,
        F.call_function("div", F.lit(IMAGE_BOX_WIDTH).cast("long") * height, width),
    )
    return F.struct(
        action.alias("action"),
        target.alias("format"),
        F.when(kind == "jpeg", F.lit(JPEG_QUALITY)).alias("quality"),
        F.when(resizable, F.lit(IMAGE_BOX_WIDTH)).alias("box_width"),
        F.when(resizable, box_height).alias("box_height"),
    )
