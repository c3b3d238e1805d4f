"""Fill-in-the-middle over texts that are kept as seekable compressed frames."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

# Bytes of text in a frame, before compression.
FRAME_BYTES = 1 << 16
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
# Of 100 texts those that are transformed, and of 100 transformed ones those with the suffix first.
RATE, SUFFIX_FIRST, SEED = 90, 20, 1

FRAMED = "frames array<binary>, units array<long>, chars array<long>, marked boolean"

_ASCII = np.arange(256)
_IS_LETTER = (_ASCII >= ord("A")) & (_ASCII <= ord("Z")) | (_ASCII >= ord("a")) & (_ASCII <= ord("z"))
#: Bytes that begin a character of UTF-8.
_BEGINS = (_ASCII & 0xC0) != 0x80


def _unit_starts(part: bytes, within_run: bool) -> np.ndarray:
    """Where units begin: runs of the letters A-Z and a-z, and single other characters.

    ``within_run`` tells that a letter stands before ``part``.
    """
    units = np.frombuffer(part, dtype=np.uint8)
    is_letter = _IS_LETTER[units]
    after_letter = np.concatenate([[within_run], is_letter[:-1]])
    return np.flatnonzero(np.where(is_letter, ~after_letter, _BEGINS[units]))


def _n_chars(part: bytes) -> int:
    return int(np.count_nonzero(_BEGINS[np.frombuffer(part, dtype=np.uint8)]))


def _pieces(text: bytes, frame_bytes: int) -> Iterator[bytes]:
    """``text`` in pieces of about ``frame_bytes`` bytes that are whole characters."""
    low = 0
    while low < len(text):
        high = min(low + frame_bytes, len(text))
        while high < len(text) and not _BEGINS[text[high]]:
            high += 1
        yield text[low:high]
        low = high


class Framed:
    """A text as independent frames; ``units[i]`` and ``chars[i]`` count what begins before frame i,
    and their last entries count all of it."""

    def __init__(self, frames: list[bytes], units: list[int], chars: list[int]):
        self.frames, self.units, self.chars = frames, units, chars
        self._reader = zstandard.ZstdDecompressor()

    def part(self, i: int) -> bytes:
        return self._reader.decompress(self.frames[i])

    def cut_at(self, unit: int) -> tuple[int, int, int]:
        """Where a unit begins (or the end): ``(frame, byte in it, characters before)``. Only that
        frame is decompressed."""
        if unit >= self.units[-1]:
            return len(self.frames), 0, self.chars[-1]
        i = int(np.searchsorted(self.units, unit, "right")) - 1
        part = self.part(i)
        starts = _unit_starts(part, False)
        # a letter at the head of a frame begins no unit if its run began before
        starts = starts[len(starts) - (self.units[i + 1] - self.units[i]) :]
        at = int(starts[unit - self.units[i]])
        return i, at, self.chars[i] + _n_chars(part[:at])


def frame_text(text: bytes, frame_bytes: int, writer: zstandard.ZstdCompressor, markers: tuple[bytes, ...]) -> tuple:
    """``(frames, units, chars, marked)`` of one text; marked: it has one of the markers."""
    frames, units, chars, within_run = [], [0], [0], False
    for part in _pieces(text, frame_bytes):
        frames.append(writer.compress(part))
        units.append(units[-1] + len(_unit_starts(part, within_run)))
        chars.append(chars[-1] + _n_chars(part))
        within_run = bool(_IS_LETTER[part[-1]])
    return frames, units, chars, any(m in text for m in markers)


def store_frames(docs: DataFrame, frame_bytes: int = FRAME_BYTES, markers: tuple[str, ...] = MARKERS) -> DataFrame:
    """Every text as independent zstandard frames with cumulative counts: ``(doc_id, frames, units,
    chars, marked)``, one row for each row of ``docs``.

    ``units`` and ``chars`` have one entry more than ``frames``; ``marked`` tells that the text has
    a marker. A null or empty text has no frames. A frame is whole characters, about ``frame_bytes``
    bytes of them, so that a very long text is many frames. Other columns are not read. Write the
    rows to a table to read parts of long texts later.
    """
    needles = tuple(m.encode() for m in markers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            rows = [frame_text(t.as_py() or b"", frame_bytes, writer, needles) for t in batch.column(1)]
            columns = [[r[i] for r in rows] for i in range(4)]
            kinds = [pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["doc_id", "frames", "units", "chars", "marked"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {id_type}, {FRAMED}")


def _draws(doc_id: object, seed: int) -> list[int]:
    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4)]


def _between(text: Framed, low: tuple, high: tuple, writer: zstandard.ZstdCompressor) -> list[bytes]:
    """The frames of a stretch of the text: those at its ends are cut, the others go on as they are."""
    out = []
    for i in range(low[0], min(high[0] + 1, len(text.frames))):
        begin = low[1] if i == low[0] else 0
        end = high[1] if i == high[0] else None
        if begin == 0 and end is None:
            out.append(text.frames[i])
        elif end is None or end > begin:
            out.append(writer.compress(text.part(i)[begin:end]))
    return out


def _transformed(doc_id, frames, units, chars, marked, rate, suffix_first, seed, writer) -> tuple:
    """``(n, form, prefix_chars, middle_chars, output)`` of one framed text."""
    text, n = Framed(frames, units, chars), units[-1]
    h1, h2, h3, h4 = _draws(doc_id, seed)
    if not frames or marked or h3 % 100 >= rate:
        return n, "plain", None, None, frames
    first, second = (text.cut_at(c) for c in sorted((h1 % (n + 1), h2 % (n + 1))))
    start, end = (0, 0, 0), (len(frames), 0, chars[-1])
    prefix, middle, suffix = (
        _between(text, a, b, writer) for a, b in ((start, first), (first, second), (second, end))
    )
    p, s, m = (writer.compress(x.encode()) for x in MARKERS)
    if h4 % 100 < suffix_first:
        form, output = "spm", [s, *suffix, p, *prefix, m, *middle]
    else:
        form, output = "psm", [p, *prefix, s, *suffix, m, *middle]
    return n, form, first[2], second[2] - first[2], output


def fill_in_middle(
    framed: DataFrame, *, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED
) -> DataFrame:
    """Transform texts framed by `store_frames`: ``(doc_id, n, form, prefix_chars, middle_chars,
    output)``, one row for each.

    A text of ``n`` units is cut at two places drawn by ``doc_id``; ``output`` is the frames of
    ``<P>prefix<S>suffix<M>middle`` (``psm``) or ``<S>suffix<P>prefix<M>middle`` (``spm``). Of 100
    texts ``rate`` are transformed; the others, empty texts and texts with a marker are ``plain``,
    without a cut. Only frames at the two cuts are decompressed. A null ``doc_id`` draws as an empty
    one; repeated rows give repeated rows; an empty table gives none.
    """
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            rows = [
                _transformed(*[x.as_py() for x in row], rate, suffix_first, seed, writer)
                for row in zip(*batch.columns)
            ]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
            )

    id_type = framed.schema["doc_id"].dataType.simpleString()
    return framed.select("doc_id", "frames", "units", "chars", "marked").mapInArrow(
        run,
        f"doc_id {id_type}, n long, form string, prefix_chars long, middle_chars long, output array<binary>",
    )


def _stream(frames: list[bytes]) -> Iterator[bytes]:
    reader = zstandard.ZstdDecompressor()
    return (reader.decompress(f) for f in frames)


def _marker_places(frames: list[bytes], markers: tuple[bytes, ...]) -> tuple[list[int], int]:
    """Where each marker begins in the output, which has each once, and the output's size."""
    longest, found, size, tail = max(map(len, markers)), {}, 0, b""
    for part in _stream(frames):
        seen = tail + part
        for m in markers:
            at = seen.find(m)
            if at >= 0:
                found.setdefault(m, size - len(tail) + at)
        size += len(part)
        tail = seen[-(longest - 1) :]
    return [found[m] for m in markers], size


def _stretch(frames: list[bytes], low: int, high: int) -> Iterator[bytes]:
    """The output's bytes from ``low`` to ``high``, a frame at a time."""
    at = 0
    for part in _stream(frames):
        if at + len(part) > low and at < high:
            yield part[max(0, low - at) : high - at]
        at += len(part)


def restored(frames: list[bytes], form: str) -> Iterator[bytes]:
    """The text before the transformation, from the output and its form alone, in pieces."""
    if form == "plain":
        yield from _stream(frames)
        return
    markers = tuple(m.encode() for m in MARKERS)
    (p, s, m), size = _marker_places(frames, markers)
    of_p, of_s, of_m = (len(x) for x in markers)
    prefix, suffix = ((p + of_p, s), (s + of_s, m)) if form == "psm" else ((p + of_p, m), (s + of_s, p))
    for low, high in (prefix, (m + of_m, size), suffix):
        yield from _stretch(frames, low, high)


def _digest(pieces: Iterator[bytes]) -> str:
    digest = sha256()
    for piece in pieces:
        digest.update(piece)
    return digest.hexdigest()


def with_digests(transformed: DataFrame) -> DataFrame:
    """``output_sha256`` and ``restored_sha256`` in place of ``output``; frames are streamed in order,
    so that no more than one of them is in memory as text."""
    names = [c for c in transformed.columns if c != "output"]
    kept = [f"{c} {transformed.schema[c].dataType.simpleString()}" for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outputs, forms = batch.column(len(names)).to_pylist(), batch.column(names.index("form")).to_pylist()
            digests = [[_digest(_stream(o)) for o in outputs], [_digest(restored(o, f)) for o, f in zip(outputs, forms)]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], *[pa.array(d, pa.string()) for d in digests]],
                [*names, "output_sha256", "restored_sha256"],
            )

    return transformed.select(*names, "output").mapInArrow(
        run, ", ".join([*kept, "output_sha256 string", "restored_sha256 string"])
    )


def output_text(transformed: DataFrame) -> DataFrame:
    """``output`` as text in place of its frames, for a writer that wants strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([b"".join(_stream(o)).decode() for o in batch.column(batch.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], batch.schema.names)

    names = [c for c in transformed.columns if c != "output"]
    kept = [f"{c} {transformed.schema[c].dataType.simpleString()}" for c in names]
    return transformed.select(*names, "output").mapInArrow(run, ", ".join([*kept, "output string"]))
