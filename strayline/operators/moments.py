"""Sums of doubles that are exact, so that no order of rows and no partitioning changes a bit of them.

Every double is a whole number times a power of two. Whole numbers of the same power are added as
such, in two halves that cannot overflow; the few powers that occur in a feature are put together
with unbounded integers at the end, and rounded once.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

# Kinds of partial sums: values, squares, how many values, and how many of them are not finite.
_VALUES, _SQUARES, _COUNT, _ODD = range(4)
_HALF = 27
# Rows and values that are split at a time: a worker keeps the most memory it ever held.
_ROWS = 2_048
_CHUNK = 1 << 17
_SPLITTER = float(2**27 + 1)

_PARTIAL = "kind int, pos int, power int, high long, low long"


def _add(into: dict, kind: int, pos: np.ndarray, values: np.ndarray) -> None:
    """Add finite values to ``into[kind, pos, power] = [high, low]``."""
    keep = values != 0
    pos, values = pos[keep], values[keep]
    if not len(values):
        return
    fraction, power = np.frexp(values)
    whole = np.ldexp(fraction, 53).astype(np.int64)
    first, span = int(power.min()), int(power.max() - power.min()) + 1
    key = pos * span + (power - first)
    # whole numbers below 2**27, at most 2**17 of them: their sums are exact in doubles
    high = np.bincount(key, (whole >> _HALF).astype(float))
    low = np.bincount(key, (whole & ((1 << _HALF) - 1)).astype(float))
    for k in np.flatnonzero((high != 0) | (low != 0)).tolist():
        sums = into[kind, k // span, k % span + first]
        sums[0] += int(high[k])
        sums[1] += int(low[k])


def _squares(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``x * x`` rounded, and what the rounding left, exactly."""
    scaled = x * _SPLITTER
    head = scaled - (scaled - x)
    tail = x - head
    square = x * x
    return square, ((head * head - square) + 2 * head * tail) + tail * tail


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict = defaultdict(lambda: [0, 0])
    for part in (batch.slice(low, _ROWS) for batch in batches for low in range(0, batch.num_rows, _ROWS)):
        lists = part.column(0).drop_null()
        sizes = pc.list_value_length(lists).to_numpy()
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        pos = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        for low in range(0, len(values), _CHUNK):
            x, at = values[low : low + _CHUNK], pos[low : low + _CHUNK]
            for k, n in enumerate(np.bincount(at).tolist()):
                sums[_COUNT, k, 0][0] += n
            finite = np.isfinite(x)
            for k, n in enumerate(np.bincount(at[~finite]).tolist()):
                sums[_ODD, k, 0][0] += n
            x, at = x[finite], at[finite]
            _add(sums, _VALUES, at, x)
            for part in _squares(x):
                _add(sums, _SQUARES, at, part)
    rows = [(*key, high, low) for key, (high, low) in sums.items()]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
    yield pa.RecordBatch.from_arrays(columns, ["kind", "pos", "power", "high", "low"])


def _exact(parts: list[dict], kind: int) -> Fraction:
    of_kind = [p for p in parts if p["kind"] == kind]
    least = min((p["power"] for p in of_kind), default=0)
    total = sum(((int(p["high"]) << _HALF) + int(p["low"])) << (p["power"] - least) for p in of_kind)
    return Fraction(total) * Fraction(2) ** (least - 53)


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for pos, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n = sum(int(p["high"]) for p in parts if p["kind"] == _COUNT)
            if any(p["kind"] == _ODD and p["high"] for p in parts):
                rows.append((pos, n, math.nan, math.nan, math.nan))
                continue
            total, squares = _exact(parts, _VALUES), _exact(parts, _SQUARES)
            variance = (n * squares - total * total) / (n * n)
            rows.append((pos, n, float(total), float(total / n), math.sqrt(max(variance, 0))))
        kinds = [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, ["pos", "n", "total", "mean", "stdev"])


def exact_moments(vectors: DataFrame, column: str = "features") -> DataFrame:
    """Per position of an array column: ``(pos, n, total, mean, stdev)``, population deviation.

    Every figure is the exact one, rounded, whatever the order and the partitions of the rows are
    (squares: of values between 1e-140 and 1e140). A position that holds a value which is missing or
    not finite has NaN. A partition sends one row per position and power of two that occurs in it,
    and a position's figures are finished from those alone.
    """
    partial = vectors.select(F.col(column).cast("array<double>")).mapInArrow(_partial, _PARTIAL)
    summed = partial.groupBy("kind", "pos", "power").agg(
        *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    )
    parts = F.collect_list(F.struct("kind", "power", "high", "low")).alias("parts")  # at most 4,200
    return summed.groupBy("pos").agg(parts).mapInArrow(
        _finished, "pos int, n long, total double, mean double, stdev double"
    )
