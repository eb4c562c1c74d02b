"""Point the image sources of a text at files, in one pass over the text.

By definition each source, in document order, is replaced everywhere in the text that the
replacements before it left. That reads the whole text once per image. For sources that
cannot get in each other's way, all of them can be replaced where they stand.

Why that is the same. Let every source be an address (``http://`` or ``https://``) that has
``http`` nowhere but at its start, does not end with ``h``, ``ht`` or ``htt``, does not end
with ``.`` and has no ``../``; let none be a prefix of another; let no file name have a ``:``
or end with a beginning of ``https``. Then

* two places of sources in the text never overlap: at one start, one would be a prefix of the
  other; else the later one's ``http`` would lie inside the earlier one or begin at its end;
* no replacement ``../images/…`` makes a new place: one that reaches into it from the left
  would end with ``.`` or hold ``../``, one that starts inside would need its ``:`` from
  after it, so the file name would end with a beginning of ``https``.

So the places are those of the original text, whatever the order.
"""

import re
from bisect import bisect_right
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame

IMAGE_FOLDER = "../images/"
_ADDRESS = re.compile(r"https?://(?!.*http)(?!.*\.\./).*(?<!h)(?<!ht)(?<!htt)(?<!\.)", re.S)
_ENDS_LIKE_ADDRESS = re.compile(r"(?:h|ht|htt|http|https)\Z")
_START = re.compile(r"https?://")


def fold(text: str, sources: Sequence[str], files: Mapping[str, str]) -> str:
    """The definition: one replacement after the other."""
    for source in sources:
        if source in files:
            text = text.replace(source, IMAGE_FOLDER + files[source])
    return text


def rewrite(text: str, sources: Sequence[str], files: Mapping[str, str]) -> str:
    """What :func:`fold` gives, in one pass where the sources allow it."""
    known = sorted({s for s in sources if s in files})
    apart = not any(b.startswith(a) for a, b in zip(known, known[1:]))
    if not apart or not all(
        _ADDRESS.fullmatch(s) and ":" not in files[s] and not _ENDS_LIKE_ADDRESS.search(files[s]) for s in known
    ):
        return fold(text, sources, files)
    longest = max(map(len, known), default=0)
    out, at = [], 0
    for found in _START.finditer(text):
        start = found.start()
        # none is a prefix of another, so only the last one not after this can be it
        i = bisect_right(known, text[start : start + longest]) - 1
        if i >= 0 and text.startswith(known[i], start):
            out += (text[at:start], IMAGE_FOLDER, files[known[i]])
            at = start + len(known[i])
    return "".join(out) + text[at:]


def rewrite_sources(rows: DataFrame, texts: Sequence[str], sources: Mapping[str, Column], files: Column) -> DataFrame:
    """``rows`` with the texts rewritten.

    ``sources`` has each text's own sources in document order, ``files`` is an array of
    struct(src, file); a source without a file stays.
    """
    names, changed = rows.columns, frozenset(texts)
    asked = rows.select(*names, *[sources[t].alias(f"_of_{t}") for t in texts], files.alias("_files"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("_files").to_pylist()
            known = [{f["src"]: f["file"] for f in fs or () if f["file"] is not None} for fs in found]

            def rewritten(name, batch=batch, known=known):
                each = zip(batch.column(name).to_pylist(), batch.column(f"_of_{name}").to_pylist(), known)
                return pa.array([rewrite(t, s, f) if t and s else t for t, s, f in each], pa.string())

            columns = [rewritten(c) if c in changed else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return asked.mapInArrow(run, rows.schema)
