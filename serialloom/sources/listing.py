"""Walk the folders of a library inside tasks, a folder each.

Spark's own file listing leaves out names that start with ``_`` or ``.``; books may have the
first kind of name and ignore lists have the second. This source lists a tree itself, through
the file system that the root's address names, and gives the files and the lines of the
ignore lists it meets on the way.
"""

import json
import posixpath
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..fixed_values import IGNORE_FILE
from ..operators.ignore import apply_ignore_rules
from ..plans.pin import pin
from .files import BOOK_EXTENSION

SCHEMA = "path string, modified timestamp, length bigint, line_no bigint, line string"


class _Folder(InputPartition):
    """A folder to list: with all below it, or only its own files."""

    def __init__(self, root: str, path: str, whole: bool):
        self.root, self.path, self.whole = root, path, whole


def _open(root: str) -> tuple[fs.FileSystem, str]:
    if ":" in root.split("/", 1)[0]:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


def _children(system: fs.FileSystem, path: str) -> list[fs.FileInfo]:
    """What a folder holds; nothing if it can't be read."""
    try:
        return system.get_file_info(fs.FileSelector(path))
    except OSError:
        return []


def _ignore_lines(system: fs.FileSystem, path: str) -> list[str]:
    try:
        with system.open_input_stream(path) as stream:
            return stream.read().decode("utf-8", "replace").split("\n")
    except OSError:
        return []


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.roots = json.loads(options["roots"])
        self.extension = options.get("extension", BOOK_EXTENSION)
        self.ignore_file = options.get("ignorefile", IGNORE_FILE)

    def partitions(self) -> Sequence[InputPartition]:
        """Each root's own files, and each folder right below a root."""
        out = []
        for root in self.roots:
            system, path = _open(root)
            out.append(_Folder(root, path, False))
            for info in _children(system, path):
                if info.type == fs.FileType.Directory and not info.base_name.startswith("."):
                    out.append(_Folder(root, info.path, True))
        return out

    def read(self, partition: _Folder) -> Iterator[tuple]:
        system, _ = _open(partition.root)
        left = [partition.path]
        while left:
            for info in _children(system, left.pop()):
                hidden = info.base_name.startswith(".")
                if info.type == fs.FileType.Directory:
                    if partition.whole and not hidden:
                        left.append(info.path)
                elif info.base_name == self.ignore_file:
                    for n, line in enumerate(_ignore_lines(system, info.path)):
                        yield info.path, None, None, n, line.removesuffix("\r")
                elif not hidden and posixpath.splitext(info.base_name)[1] == f".{self.extension}":
                    modified = datetime.fromtimestamp((info.mtime_ns or 0) / 1e9, timezone.utc)
                    yield info.path, modified, info.size, None, None


class LibraryWalk(DataSource):
    """``spark.read.format("library_walk").option("roots", '["/lib"]')``"""

    @classmethod
    def name(cls) -> str:
        return "library_walk"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def walk_library(
    spark: SparkSession, roots: Sequence[str], extension: str = BOOK_EXTENSION
) -> tuple[DataFrame, DataFrame]:
    """(files, rules): path, modified, length of the book files below the roots, hidden ones
    left out (a root may be hidden itself), and dir, line_no, pattern of the ignore lists.

    The tree is walked once. Folders that can't be read are left out.
    """
    spark.dataSource.register(LibraryWalk)
    found = pin(
        spark.read.format("library_walk").option("roots", json.dumps(list(roots))).option("extension", extension).load()
    )
    # a tree below two roots is one tree
    files = found.where("line_no IS NULL").select("path", "modified", "length").dropDuplicates(["path"])
    rules = found.where("line_no IS NOT NULL").select(
        F.regexp_replace("path", r"/[^/]*$", "").alias("dir"), "line_no", F.col("line").alias("pattern")
    )
    return files, rules.distinct()


def scan_library(spark: SparkSession, roots: Sequence[str], extension: str = BOOK_EXTENSION) -> DataFrame:
    """(path, modified, length) of the books below the roots that no ignore list hides."""
    return apply_ignore_rules(*walk_library(spark, roots, extension))
