"""Chat formatting: conversations assembled into one Arrow buffer per batch, with a loss mask."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

# A turn is OPEN role SEP text CLOSE. None of these stands in a role or text after escaping: a
# backslash goes before every backslash and after the first character of every such string.
OPEN, SEP, INST_END, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = tuple(x.encode() for x in (OPEN, SEP, INST_END, CLOSE))
_HEAD, _GAP, _FOOT = OPEN.encode(), SEP.encode(), (INST_END + CLOSE).encode()
LEARNED = "assistant"

# Bytes of a conversation from which it is cut into slices that are formatted on their own.
HOT_BYTES = 1 << 22
# Bytes of a batch that are moved at a time.
_STRETCH = 1 << 20
_PART_BITS = 33

FORMATTED = "part long, n_turns long, formatted string, loss array<struct<start: int, stop: int>>"


class Texts(NamedTuple):
    """A column of texts end to end: ``units[offsets[i]:offsets[i+1]]`` is row i."""

    units: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        units = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        return cls(units[offsets[0] : offsets[-1]], offsets - offsets[0])


def _escapes(texts: Texts) -> np.ndarray:
    """Places before which a backslash goes, in order."""
    units, offsets = texts
    found = [np.flatnonzero(units == ord("\\"))]
    for control in CONTROL:
        at = np.flatnonzero(units == control[0])
        at = at[at + len(control) <= len(units)]
        for k in range(1, len(control)):
            at = at[units[at + k] == control[k]]
        row = np.searchsorted(offsets, at, "right") - 1
        found.append(at[at + len(control) <= offsets[row + 1]] + 1)  # within one text
    return np.sort(np.concatenate(found))


def _escaped_sizes(texts: Texts, escapes: np.ndarray) -> np.ndarray:
    return np.diff(texts.offsets) + np.diff(np.searchsorted(escapes, texts.offsets))


def _scatter(out: np.ndarray, texts: Texts, escapes: np.ndarray, begin: np.ndarray) -> None:
    """Copy row i, escaped, to ``out`` from ``begin[i]`` on; ``out`` has backslashes in it already."""
    units, offsets = texts
    shift = begin - offsets[:-1] - np.searchsorted(escapes, offsets[:-1])
    for low in range(0, len(units), _STRETCH):
        high = min(low + _STRETCH, len(units))
        own = np.diff(np.clip(offsets, low, high))
        place = np.arange(low, high)
        out[place + np.repeat(shift, own) + np.searchsorted(escapes, place, "right")] = units[low:high]


def _repeat(out: np.ndarray, begin: np.ndarray, fixed: bytes) -> None:
    out[begin[:, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray, learned: str = LEARNED) -> tuple[pa.Array, pa.Array]:
    """Formatted conversations and their loss spans, from turns in order.

    ``first`` holds the rows at which conversations begin. Sizes come first, then offsets; the one
    buffer of the result is allocated once and filled by scatter indices. Loss spans are bytes of
    the formatted text.
    """
    role, text = Texts.of(roles), Texts.of(texts)
    of_role, of_text = _escapes(role), _escapes(text)
    role_size, text_size = _escaped_sizes(role, of_role), _escaped_sizes(text, of_text)
    size = len(_HEAD) + role_size + len(_GAP) + text_size + len(_FOOT)
    stop = np.cumsum(size)
    begin = stop - size
    buffer = pa.allocate_buffer(int(size.sum()), resizable=False)
    out = np.frombuffer(buffer, np.uint8)
    out[:] = ord("\\")
    _repeat(out, begin, _HEAD)
    _scatter(out, role, of_role, begin + len(_HEAD))
    _repeat(out, begin + len(_HEAD) + role_size, _GAP)
    text_begin = begin + len(_HEAD) + role_size + len(_GAP)
    _scatter(out, text, of_text, text_begin)
    _repeat(out, text_begin + text_size, _FOOT)

    edges = np.append(first, len(size))
    offsets = np.append(begin, stop[-1:] if len(stop) else 0)[edges]
    formatted = pa.Array.from_buffers(
        pa.large_string(), len(first), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), buffer]
    )
    is_loss = pc.fill_null(pc.equal(roles, learned), False).to_numpy(zero_copy_only=False)
    own = np.repeat(offsets[:-1], np.diff(edges))
    low = (text_begin - own)[is_loss]
    spans = pa.StructArray.from_arrays(
        [pa.array(low, pa.int32()), pa.array(low + text_size[is_loss], pa.int32())], ["start", "stop"]
    )
    loss = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(is_loss)])[edges], pa.int32()), spans)
    return formatted, loss


def _formatted(hot_bytes: int, learned: str, id_type: pa.DataType):
    """From turns in order to rows ``(conv_id, part, n_turns, formatted, loss)``.

    A conversation is formatted when its last turn was read, or in slices of ``hot_bytes``.
    """
    names = ["conv_id", "part", "n_turns", "formatted", "loss"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = (TaskContext.get().partitionId() if TaskContext.get() else 0) << _PART_BITS

        def done(rows: pa.Table, first: np.ndarray) -> pa.RecordBatch:
            nonlocal part
            roles, texts, ids = (rows.column(i).combine_chunks() for i in (1, 2, 0))
            formatted, loss = assemble(roles, texts, first, learned)
            numbers = pa.array(part + np.arange(len(first)), pa.int64())
            part += len(first)
            n_turns = pa.array(np.diff(np.append(first, rows.num_rows)), pa.int64())
            return pa.RecordBatch.from_arrays(
                [ids.take(pa.array(first, pa.int64())).cast(id_type), numbers, n_turns, formatted.cast(pa.string()), loss], names
            )

        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            if not rows.num_rows:
                continue
            ids = rows.column(0).to_pylist()
            sizes = pc.fill_null(pc.binary_length(rows.column(2)), 0).to_numpy()
            first, size = [0], int(sizes[0])
            for i in range(1, len(ids)):
                size += int(sizes[i])
                if ids[i] != ids[i - 1] or size > hot_bytes:
                    first.append(i)
                    size = int(sizes[i])
            whole, held = rows.slice(0, first[-1]), rows.slice(first[-1])
            # not many bytes at a time, whatever the size of a batch
            low = 0
            while low < len(first) - 1:
                high, size = low, 0
                while high < len(first) - 1 and (high == low or size < hot_bytes):
                    size += int(sizes[first[high] : first[high + 1]].sum())
                    high += 1
                yield done(whole.slice(first[low], first[high] - first[low]), np.array(first[low:high]) - first[low])
                low = high
        if held is not None and held.num_rows:
            yield done(held, np.array([0]))

    return run


def format_conversations(turns: DataFrame, *, learned: str = LEARNED, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Conversations as formatted texts with a loss mask: ``(conv_id, part, n_turns, formatted, loss,
    sliced)``.

    ``turns`` has ``conv_id, turn, role, text``; rows of a conversation come in the order of turn
    (null first), role and text. Every turn becomes ``<s>role[INST]text[/INST]</s>``, with control
    strings in roles and texts escaped. ``loss`` holds the byte spans of the texts of the role
    ``learned``. A conversation is one row with a ``part`` of its own; only one of more than
    ``hot_bytes`` bytes of text is dealt out by ranges of its turns and comes as several rows, in the
    order of ``part``, with ``sliced`` true. So no task formats or holds a whole hot conversation.

    A null role or text counts as empty; a null ``conv_id`` is a conversation too; repeated rows are
    repeated turns; an empty table gives no rows. Other columns are not read. A single text is
    formatted whole, however long it is.
    """
    rows = turns.select("conv_id", "turn", "role", "text")
    id_type = rows.schema["conv_id"].dataType
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))
    hot = rows.groupBy("conv_id").agg(size.alias("_size")).where(F.col("_size") > hot_bytes)
    hot = hot.select(F.col("conv_id").alias("_hot"))
    order = ["conv_id", "turn", "role", "text"]
    of_hot: Column = F.col("conv_id").eqNullSafe(F.col("_hot"))

    def formatted(df: DataFrame, sliced: bool) -> DataFrame:
        wanted = df.sortWithinPartitions(*order).select("conv_id", "role", "text")
        arrow_id = _arrow_type(id_type.simpleString())
        done = wanted.mapInArrow(
            _formatted(hot_bytes, learned, arrow_id), f"conv_id {id_type.simpleString()}, {FORMATTED}"
        )
        return done.withColumn("sliced", F.lit(sliced))

    if hot.isEmpty():
        return formatted(rows.repartition("conv_id"), False)
    cold = formatted(rows.join(hot, of_hot, "left_anti").repartition("conv_id"), False)
    return cold.union(formatted(rows.join(hot, of_hot, "left_semi").repartitionByRange(*order), True))


def _arrow_type(name: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[name]


_UNESCAPE = re.compile(rb"\\(.)", re.DOTALL)


def unescape(piece: bytes) -> bytes:
    return _UNESCAPE.sub(rb"\1", piece) if b"\\" in piece else piece


def turns_of(formatted: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Roles and texts, read back from the formatted text alone."""
    for turn in formatted.split(_FOOT)[:-1]:
        role, text = turn[len(_HEAD) :].split(_GAP, 1)
        yield unescape(role), unescape(text)


def _chars(piece: bytes) -> int:
    return len(piece.decode())


class _Read:
    """What is read back of a conversation, a part at a time."""

    def __init__(self, conv_id: object):
        self.conv_id, self.n_turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.turns, self.loss = sha256(), sha256()

    def add(self, formatted: bytes, loss: list[dict]) -> None:
        for role, text in turns_of(formatted):
            self.n_turns += 1
            self.turns.update(b"%b\n%b\n" % (role, text))
        for span in loss:
            learned = unescape(formatted[span["start"] : span["stop"]])
            self.loss.update(learned)
            self.loss_chars += _chars(learned)
        self.chars += _chars(formatted)

    def row(self) -> tuple:
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of every conversation, from its formatted text and loss spans alone:
    ``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``.

    ``turns_sha256`` is of role, newline, text, newline of every turn. Only the slices of a sliced
    conversation move: they meet in order in one task, as a digest is made in order, and that task
    holds one of them at a time.
    """
    id_type = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [_arrow_type(id_type), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Read | None = None
        for batch in batches:
            done = []
            for conv_id, text, loss in zip(*[batch.column(i) for i in range(3)]):
                conv_id = conv_id.as_py()
                if now is None or conv_id != now.conv_id:
                    done += [now.row()] if now else []
                    now = _Read(conv_id)
                now.add(text.as_py(), loss.as_py())
            yield batch_of(done)
        if now:
            yield batch_of([now.row()])

    schema = f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    wanted = ["conv_id", F.col("formatted").cast("binary"), "loss"]
    sliced = formatted.where("sliced").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    whole = formatted.where("not sliced").select(*wanted).mapInArrow(run, schema)
    return whole.union(sliced.select(*wanted).mapInArrow(run, schema))
