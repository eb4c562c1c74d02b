r"""Chat formatting on token level.

Every segment is encoded on its own; what marks turns are reserved ids behind the
vocabulary, which no text can give. A conversation is

    BOS, then per turn: role marker [role text, colon] text, end of turn

and the loss mask covers the ids of assistant texts only. In the written form of the same,
control strings inside texts are escaped with a backslash behind their first character
(``<\/s>``), and what looks escaped already gets one more, so that reading it back is exact.
"""

import re
from collections.abc import Sequence
from hashlib import sha256
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, sorted_groups
from .tokens import default_path, encoder

#: Written form of the reserved ids, in the order of these ids.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[ROLE]", "[TEXT]"]
BOS, END, USER, ASSISTANT, SYSTEM, ROLE, TEXT = range(len(CONTROLS))
MARKERS = {"user": USER, "assistant": ASSISTANT, "system": SYSTEM}

_ESCAPE = re.compile("|".join(rf"(?<={re.escape(c[0])})(?=\\*{re.escape(c[1:])})" for c in CONTROLS))
_UNESCAPE = re.compile("|".join(rf"(?<={re.escape(c[0])})\\(?=\\*{re.escape(c[1:])})" for c in CONTROLS))


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub("", text)


class Segment(NamedTuple):
    """One turn: its ids, the range of them that is under the loss mask, its written form."""

    ids: bytes
    start: int
    end: int
    written: str


def segment(enc, role: str, text: str) -> Segment:
    base = enc.size
    control = [np.array([base + i], "<u4").tobytes() for i in range(len(CONTROLS))]
    marker, inside = MARKERS.get(role), escape(text)
    head = control[ROLE] + enc.encode_plain(escape(role)) + control[TEXT] if marker is None else control[marker]
    said = CONTROLS[ROLE] + escape(role) + CONTROLS[TEXT] if marker is None else CONTROLS[marker]
    ids = enc.encode_plain(inside)
    start = len(head) // 4
    return Segment(
        head + ids + control[END], start, start + (len(ids) // 4 if marker == ASSISTANT else 0), said + inside + CONTROLS[END]
    )


def spliced(enc, segments: Sequence[tuple[bytes, int, int]], first: bool) -> tuple[bytes, bytes]:
    """(ids, mask) of segments (ids, start, end) that follow each other; ``first`` ones have BOS before them.

    Where a segment begins is the running sum of the lengths before it. The mask is a byte
    per id: the prefix sums of marks, 1 where a range begins and -1 where it ends.
    """
    before = np.array([enc.size + BOS], "<u4").tobytes() if first else b""
    lengths = np.array([len(before), *(len(ids) for ids, _, _ in segments)]) // 4
    at = np.cumsum(lengths)
    marks = np.zeros(at[-1] + 1, np.int64)
    np.add.at(marks, at[:-1] + [start for _, start, _ in segments], 1)
    np.add.at(marks, at[:-1] + [end for _, _, end in segments], -1)
    return b"".join([before, *(ids for ids, _, _ in segments)]), np.cumsum(marks[:-1]).astype(np.int8).tobytes()


def assemble(enc, turns: list[tuple[str, str]]) -> tuple[bytes, bytes, str]:
    """(ids, mask, written) of a conversation's (role, text) turns."""
    segments = [segment(enc, role, text) for role, text in turns]
    ids, mask = spliced(enc, [s[:3] for s in segments], True)
    return ids, mask, CONTROLS[BOS] + "".join(s.written for s in segments)


def read_back(enc, ids: bytes, mask: bytes) -> tuple[list[tuple[str, str]], str]:
    """The turns, and all text under the mask, from the ids and the mask alone.

    ids may be a conversation's, or some whole turns of it, as every turn ends with an id of its own.
    """
    values, base, table = np.frombuffer(ids, "<u4"), enc.size, enc.bytes_of
    on = np.frombuffer(mask, np.int8).astype(bool)
    names = {marker: role for role, marker in MARKERS.items()}

    def text(part) -> str:
        return unescape(b"".join([table[i] for i in part]).decode("utf-8", "surrogatepass"))

    turns, loss, role, start = [], [], "", 0
    for at in np.flatnonzero(values >= base).tolist():
        what = int(values[at]) - base
        if what in names:
            role = names[what]
        elif what == TEXT:
            role = text(values[start:at])
        elif what == END:
            turns.append((role, text(values[start:at])))
            if on[start:at].any():
                loss.append(text(values[start:at][on[start:at]]))
        start = at + 1
    return turns, "".join(loss)


def _format(path: str):
    def run(batches):
        enc = encoder(path)
        for rows in sorted_groups(batches, ["none", "group"]):
            turns = list(zip(rows.column("role").to_pylist(), rows.column("text").to_pylist(), strict=True))
            ids, mask, written = assemble(enc, turns)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("conv_id").slice(0, 1).combine_chunks(),
                    pa.array([len(turns)], pa.int64()),
                    pa.array([ids], pa.binary()),
                    pa.array([mask], pa.binary()),
                    pa.array([written], pa.string()),
                ],
                ["conv_id", "n_turns", "ids", "mask", "formatted"],
            )

    return run


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def format_chats(conversations: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """A row per conversation: conv_id, n_turns, ids, mask, formatted.

    ``conversations`` has conv_id, turn, role and text. ids are little-endian unsigned
    32-bit integers, mask a byte per id. Turns go by turn (null first), then role, then
    text, so ties have one order and repeated rows are repeated turns. A null text or role
    is empty; rows with a null conv_id are one conversation. An empty table gives no rows;
    further columns are ignored. A conversation is one row here, so it must fit one cell
    and one task; ``format_turns`` has no such bound.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    dealt = _turns(conversations).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    # numpy knows no null in whole numbers, so null is a column of its own
    dealt = dealt.select(
        "conv_id", "role", "text", F.coalesce("conv_id", F.lit(0)).alias("group"), F.col("conv_id").isNull().alias("none")
    )
    return dealt.mapInArrow(
        _format(tokenizer or default_path()),
        f"conv_id {kind}, n_turns long, ids binary, mask binary, formatted string",
    )


def _segments(path: str):
    def run(batches):
        enc = encoder(path)
        for batch in by_size(batches):
            made = [segment(enc, *x) for x in zip(*(batch.column(c).to_pylist() for c in ("role", "text")), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("conv_id", "turn", "role", "text")),
                    pa.array([m.ids for m in made], pa.binary()),
                    pa.array([m.start for m in made], pa.int64()),
                    pa.array([m.end for m in made], pa.int64()),
                    pa.array([m.written for m in made], pa.string()),
                ],
                ["conv_id", "turn", "role", "text", "ids", "loss_start", "loss_end", "formatted"],
            )

    return run


def format_turns(conversations: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """A row per turn: conv_id, turn, role, text, ids, loss_start, loss_end, formatted.

    The segments of a conversation, behind one BOS and in the order that ``format_chats``
    names, are what it makes of the conversation; ``spliced`` gives the mask of any of them
    that follow each other. No rows meet for it.
    """
    conv, turn = (conversations.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    return _turns(conversations).mapInArrow(
        _segments(tokenizer or default_path()),
        f"conv_id {conv}, turn {turn}, role string, text string, ids binary, loss_start long, loss_end long, formatted string",
    )


class _Sums:
    """What is said of a conversation, turn by turn."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, len(CONTROLS[BOS])
        self.whole, self.loss = sha256(), sha256()

    def add(self, enc, segments: list[tuple[bytes, int, int]], chars: int):
        """Splice the next turns to what there is, and read them back from the ids and the mask."""
        turns, loss = read_back(enc, *spliced(enc, segments, not self.turns))
        self.turns += len(turns)
        for role, text in turns:
            self.whole.update(f"{role}\n{text}\n".encode())
        self.loss.update(loss.encode())
        self.loss_chars += len(loss)
        self.chars += chars

    def row(self) -> dict:
        return {
            "conv_id": self.conv_id, "n_turns": self.turns, "turns_sha256": self.whole.hexdigest(),
            "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars,
        }


def _digest(path: str):
    """A row per conversation from its segments in order; a slice of them is held at a time."""
    schema = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ])

    def run(batches):
        enc, held = encoder(path), None
        for batch in by_size(batches, "ids"):
            out = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "loss_start", "loss_end", "chars")), strict=True)
            for conv_id, turns in groupby(rows, key=itemgetter(0)):
                if held is None or held.conv_id != conv_id:
                    if held is not None:
                        out.append(held.row())
                    held = _Sums(conv_id)
                turns = list(turns)
                held.add(enc, [t[1:4] for t in turns], sum(t[4] for t in turns))
            yield pa.RecordBatch.from_pylist(out, schema)
        if held is not None:
            yield pa.RecordBatch.from_pylist([held.row()], schema)

    return run


#: Added to the given conversations: its texts are control strings.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    made = format_turns(given.unionByName(probe))
    made = made.withColumn("chars", F.char_length("formatted").cast("long")).drop("formatted")
    dealt = made.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "ids", "loss_start", "loss_end", "chars").mapInArrow(
        _digest(default_path()),
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


QUERIES = {"op8_chat_format": (op8_chat_format, None)}
