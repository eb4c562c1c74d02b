"""Every registered query with the SQL that checks it."""

from . import chapters, editions, ingest, library, mixed, pages, requests

REGISTRY = {
    **chapters.QUERIES,
    **pages.QUERIES,
    **requests.QUERIES,
    **ingest.QUERIES,
    **library.QUERIES,
    **editions.QUERIES,
    **mixed.QUERIES,
}
