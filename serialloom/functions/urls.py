"""Column functions on urls and file names."""

from pyspark.sql import Column, functions as F

from ..fixed_values import (
    FORBIDDEN_CHARACTERS,
    NATIVE_BOOK_PREFIX,
    NATIVE_FEED_PREFIX,
    NATIVE_SITE,
)
from .binding import bound

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
_HOST = _SCHEME + r"//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^:/?#]*)"
_ABSOLUTE = _SCHEME + "//"
_PATH = _SCHEME + r"//[^/?#]*([^?#]*)"
_HOSTLESS = r"(?i)^(?:https?|ftp|wss?):/*(?:[?#]|$)"

# Fixed value: characters that a url path holds in percent form.
_TO_ENCODE = r"""[ "<>`{}]|[^\x00-\x7F]"""


def _plain(url: Column) -> Column:
    """A url without outer blanks and with '/' for '\\', as url parsers read it."""
    return F.translate(F.trim(url), "\\", "/")


def _url_path(url: Column) -> Column:
    """Path of an absolute url ('/' when it has none); NULL for anything else."""

    def path(plain):
        found = F.regexp_extract(plain, _PATH, 1)
        return F.when(
            plain.rlike(_ABSOLUTE) & ~plain.rlike(_HOSTLESS),
            F.when(F.startswith(found, F.lit("/")), found).otherwise(F.lit("/")),
        )

    return bound(_plain(url), path)


def url_host(url: Column) -> Column:
    """Lower-case host, '' for a url without one, NULL for text that is no url."""
    return bound(
        _plain(url),
        lambda plain: F.when(
            plain.rlike(_SCHEME) & ~plain.rlike(_HOSTLESS),
            F.lower(F.regexp_extract(plain, _HOST, 1)),
        ),
    )


def _percent_encoded(name: Column) -> Column:
    """Blanks and whatever else a url path holds in percent form only."""
    letters = F.transform(
        F.split(name, ""),
        lambda c: F.when(c == " ", F.lit("%20"))
        .when(c.rlike(_TO_ENCODE), F.url_encode(c))
        .otherwise(c),
    )
    return F.when(name.rlike(_TO_ENCODE), F.array_join(letters, "")).otherwise(name)


def url_segment(url: Column, n: int, fallback: Column | None = None) -> Column:
    """The n-th (0-based) part of the url path, else the fallback."""
    part = F.try_element_at(F.split(_url_path(url), "/"), F.lit(n + 2))
    return part if fallback is None else F.coalesce(part, fallback)


def safe_title(name: Column) -> Column:
    """Text with every character that a file name may not hold turned into '_'."""
    return F.translate(name, FORBIDDEN_CHARACTERS, "_" * len(FORBIDDEN_CHARACTERS))


def asset_filename(url: Column) -> Column:
    """File name of an asset: last part of the url path, else of a plain path.

    A url that ends in '/' gives ''.  NULL when there is no name at all.
    """
    def from_path(text):
        last = F.regexp_extract(F.regexp_replace(text, r"(?:/+\.?)+$", ""), r"([^/]*)$", 1)
        return bound(last, lambda name: F.when(~name.isin("", ".", ".."), name))

    def named(path):
        return F.when(path.isNull(), from_path(url)).otherwise(
            bound(F.substring_index(path, "/", -1), _percent_encoded)
        )

    return safe_title(bound(_url_path(url), named))


def absolute_url(path: Column, site: str | Column = NATIVE_SITE) -> Column:
    return F.concat(site if isinstance(site, Column) else F.lit(site), path)


def feed_url(
    book_url: Column,
    book_prefix: str = NATIVE_BOOK_PREFIX,
    feed_prefix: str = NATIVE_FEED_PREFIX,
) -> Column:
    """Address of a book's feed; NULL when the book is not of that site."""
    return F.when(
        F.startswith(book_url, F.lit(book_prefix)),
        F.replace(book_url, F.lit(book_prefix), F.lit(feed_prefix)),
    )
