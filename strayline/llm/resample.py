"""Importance resampling towards a target: hashed n-gram buckets, gains, and a Gumbel top draw."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from strayline.llm.common import cut

# The draw: buckets of n-grams, words a document must have, percent of such documents.
BUCKETS, FEWEST_WORDS, PERCENT = 10_000, 20, 10
NGRAM, SEED = 1, 2024
# Bytes of text that share a table of n-grams; a longer text has a table of its own.
_CHUNK = 1 << 21
# Bits that number the rows of a partition in monotonically_increasing_id.
_ROW_BITS = 33

# The primes of XXH64.
_PRIMES = np.array(
    [0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5],
    dtype=np.uint64,
)

_ASCII = np.arange(256)
#: Bytes of words: digits, letters and all bytes beyond ASCII.
_IS_WORD = (
    (_ASCII >= 0x80)
    | (_ASCII >= ord("0")) & (_ASCII <= ord("9"))
    | (_ASCII >= ord("A")) & (_ASCII <= ord("Z"))
    | (_ASCII >= ord("a")) & (_ASCII <= ord("z"))
)
#: Lower case of A-Z, a space for what separates words.
_LOWER = np.where(_IS_WORD, np.where((_ASCII >= ord("A")) & (_ASCII <= ord("Z")), _ASCII + 32, _ASCII), 32).astype(np.uint8)


class Grams(NamedTuple):
    """The n-grams of some texts: slices of ``joined``, where one space follows every word."""

    joined: bytes
    start: np.ndarray
    stop: np.ndarray
    text_of: np.ndarray
    words: np.ndarray  # words of each text


def grams_of(texts: list[bytes], longest: int) -> Grams:
    """All runs of 1 to ``longest`` consecutive words of each text."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    is_word = _IS_WORD[raw]
    after = np.zeros_like(is_word)
    after[1:] = is_word[:-1]
    joined = _LOWER[raw][is_word | after]
    stop = np.flatnonzero(joined == 32)
    start = np.concatenate([[0], stop[:-1] + 1])[: len(stop)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    before = np.searchsorted(np.flatnonzero(is_word & ~after), np.concatenate([[0], ends]))
    words = np.diff(before)
    text_of = np.repeat(np.arange(len(texts)), words)
    runs = []
    for n in range(1, longest + 1):
        first = np.arange(max(0, len(start) - n + 1))
        first = first[text_of[first] == text_of[first + n - 1]] if n > 1 else first
        runs.append((start[first], stop[first + n - 1], text_of[first]))
    return Grams(joined.tobytes(), *[np.concatenate(x) for x in zip(*runs)], words)


class Interned(NamedTuple):
    """An open-addressed table: bucket and count by slot, and the slot of every occurrence."""

    bucket: np.ndarray
    count: np.ndarray
    slot_of: np.ndarray


def _equal(units: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the slices of ``size`` bytes (none is empty) that begin at ``a`` and ``b`` agree."""
    if not len(a):
        return np.zeros(0, dtype=bool)
    first = np.cumsum(size) - size
    within = np.arange(int(size.sum())) - np.repeat(first, size)
    alike = units[np.repeat(a, size) + within] == units[np.repeat(b, size) + within]
    return np.logical_and.reduceat(alike, first)


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def _whole(joined: bytes, kind: str, at: np.ndarray) -> np.ndarray:
    """Little-endian whole numbers that begin at the given bytes, wherever those are."""
    width = np.dtype(kind).itemsize
    every = np.ndarray(max(0, len(joined) - width + 1), kind, joined, strides=(1,))
    return every[at].astype(np.uint64)


def xxhash64(joined: bytes, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """XXH64 with seed 0 of the slices; those of less than 32 bytes, nearly all, are hashed at once."""
    size = stop - start
    hashed = np.full(len(size), _PRIMES[4], dtype=np.uint64) + size.astype(np.uint64)
    short = size < 32
    for lane in range(3):
        some = np.flatnonzero(short & (size >= 8 * (lane + 1)))
        k = _turned(_whole(joined, "<u8", start[some] + 8 * lane) * _PRIMES[1], 31) * _PRIMES[0]
        hashed[some] = _turned(hashed[some] ^ k, 27) * _PRIMES[0] + _PRIMES[3]
    at = start + size // 8 * 8
    some = np.flatnonzero(short & (size % 8 >= 4))
    k = _whole(joined, "<u4", at[some]) * _PRIMES[0]
    hashed[some] = _turned(hashed[some] ^ k, 23) * _PRIMES[1] + _PRIMES[2]
    at = start + size // 4 * 4
    for byte in range(3):
        some = np.flatnonzero(short & (size % 4 > byte))
        k = _whole(joined, "u1", at[some] + byte) * _PRIMES[4]
        hashed[some] = _turned(hashed[some] ^ k, 11) * _PRIMES[0]
    hashed = (hashed ^ hashed >> np.uint64(33)) * _PRIMES[1]
    hashed = (hashed ^ hashed >> np.uint64(29)) * _PRIMES[2]
    hashed ^= hashed >> np.uint64(32)
    some = np.flatnonzero(~short)
    hashed[some] = [xxhash.xxh64_intdigest(joined[a:b]) for a, b in zip(start[some].tolist(), stop[some].tolist())]
    return hashed


def intern(grams: Grams, buckets: int, key=xxhash64) -> Interned:
    """Give every distinct n-gram a slot, by linear probing.

    All occurrences that have no slot yet probe at once: the first to reach a free slot takes it,
    and whoever meets an owner of its own key compares bytes with it. Keys may collide: such
    n-grams go on to other slots.
    """
    joined, start, stop = grams.joined, grams.start, grams.stop
    total = len(start)
    keys = key(joined, start, stop)
    mask = (1 << max(1, (2 * total).bit_length())) - 1
    units, size = np.frombuffer(joined, dtype=np.uint8), stop - start
    owner = np.full(mask + 1, -1, dtype=np.int64)
    slot = (keys & np.uint64(mask)).astype(np.int64)
    todo = np.arange(total)
    while len(todo):
        at = slot[todo]
        free = owner[at] < 0
        owner[at[free][::-1]] = todo[free][::-1]  # the last assignment stands: the first occurrence
        holder = owner[at]
        same = (holder == todo) | (keys[holder] == keys[todo]) & (size[holder] == size[todo])
        unsure = np.flatnonzero(same & (holder != todo))
        mine, theirs = todo[unsure], holder[unsure]
        same[unsure] = _equal(units, start[mine], start[theirs], size[mine])
        todo = todo[~same]
        slot[todo] = (slot[todo] + 1) & mask
    bucket = np.zeros(mask + 1, dtype=np.int64)
    used = np.flatnonzero(owner >= 0)
    first = owner[used]
    bucket[used] = [crc32(joined[a:b]) % buckets for a, b in zip(start[first].tolist(), stop[first].tolist())]
    return Interned(bucket, np.bincount(slot, minlength=mask + 1), slot)


def _chunks(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > _CHUNK:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def _texts(column: pa.Array) -> Iterator[bytes]:
    return (t.as_py() or b"" for t in column)


def bucket_counts(docs: DataFrame, longest: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """Occurrences by bucket of all n-grams of the column ``text``: ``(bucket, n)``, none without any.

    A partition adds up its buckets and sends one row for each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for texts in _chunks(_texts(batch.column(0))):
                table = intern(grams_of(texts, longest), buckets)
                used = np.flatnonzero(table.count)
                np.add.at(total, table.bucket[used], table.count[used])
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], ["bucket", "n"])

    found = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, longest: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket: ``floor(1000 * ln((t+1) (S+buckets) / ((s+1) (T+buckets))))``.

    ``s`` and ``t`` are the bucket's occurrences in ``docs`` and ``target``, ``S`` and ``T`` all of
    them. The driver holds one number per bucket, whatever the tables' size.
    """

    def counted(df: DataFrame) -> np.ndarray:
        counts = np.zeros(buckets, dtype=np.int64)
        for row in bucket_counts(df, longest, buckets).collect():
            counts[row["bucket"]] = row["n"]
        return counts

    s, t = counted(docs).astype(float), counted(target).astype(float)
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weigh(gains: np.ndarray, longest: int):
    buckets = len(gains)

    def of(texts: list[bytes]) -> list[np.ndarray]:
        grams = grams_of(texts, longest)
        table = intern(grams, buckets)
        gained = gains[table.bucket][table.slot_of]
        weight = np.zeros(len(texts), dtype=np.int64)
        np.add.at(weight, grams.text_of, gained)
        return [grams.words, np.bincount(grams.text_of, minlength=len(texts)), weight]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [of(texts) for texts in _chunks(_texts(batch.column(2)))]
            figures = [pa.array(np.concatenate([p[i] for p in parts]) if parts else [], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *figures], ["doc_id", "text_hash", "n_words", "n_features", "weight"]
            )

    return run


def _noise(doc_id: Column, seed: int) -> Column:
    """``floor(-1000 ln(-ln u))`` for u from the first 32 bits of sha256(``seed:doc_id``)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with their place ``at`` (from 1) in a global order, by a distributed sort.

    Rows are dealt by ranges of the order and sorted in them; what comes before a range is the sum
    of the counts of the ranges before it, one number for each. Rows that are equal in the order are
    told apart by where they were read, so that many of them do not share a range.
    """
    tie = F.col("_tie")
    sorted_rows = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order, tie)
    sorted_rows = sorted_rows.sortWithinPartitions(*order, tie).drop("_tie")
    sorted_rows = cut(sorted_rows.withColumn("_nr", F.monotonically_increasing_id()))
    part = F.shiftright("_nr", _ROW_BITS)
    parts = sorted_rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # a row for each range
    at = F.col("_before") + F.col("_nr").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1
    return sorted_rows.withColumn("_part", part).join(F.broadcast(parts), "_part").withColumn("at", at).drop(
        "_part", "_nr", "_before"
    )


def importance(
    docs: DataFrame, target: DataFrame, *, longest: int = NGRAM, buckets: int = BUCKETS,
    percent: int = PERCENT, fewest_words: int = FEWEST_WORDS, seed: int = SEED,
) -> DataFrame:
    """Weight, score and rank of every document, drawn towards the n-grams of ``target``.

    Rows ``(doc_id, text_hash, n_words, n_features, weight, score, rank)``, one for each row of
    ``docs``; ``text_hash`` is ``xxhash64(text)``. ``weight`` adds the gains of all n-grams of 1 to
    ``longest`` words, ``score`` adds Gumbel noise by ``doc_id``. Of the N documents with at least
    ``fewest_words`` words, the ``percent * N div 100`` highest scores are drawn; equal scores: the
    smaller ``doc_id``, null last. ``rank`` numbers those from 1 and is null for all others.

    A null or empty text has no words and weight 0; a null ``doc_id`` counts as an empty one in the
    noise; repeated rows are as many rows and have ranks of their own. Without documents there are
    no rows, and an empty target gives gains by the documents alone. Other columns are not read. A
    text is read whole, in a table of n-grams of its own if it is long. ``percent`` is whole.
    """
    gains = bucket_gains(docs, target, longest, buckets)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    weighed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    weighed = weighed.mapInArrow(
        _weigh(gains, longest), f"doc_id {id_type}, text_hash long, n_words long, n_features long, weight long"
    )
    scored = weighed.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed))
    is_long = F.col("n_words") >= fewest_words
    order = [F.desc("_long"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("text_hash")]
    placed = _numbered(cut(scored.withColumn("_long", is_long)), order)  # the sort reads its rows twice
    drawn = placed.agg(F.floor(F.count_if("_long") * percent / 100)).scalar()
    rank = F.when(F.col("_long") & (F.col("at") <= F.col("_drawn")), F.col("at"))
    return placed.withColumn("_drawn", drawn).select(
        "doc_id", "text_hash", "n_words", "n_features", "weight", "score", rank.alias("rank")
    )


def resample(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The documents that `importance` draws, with all columns of ``docs``.

    Rows equal in ``doc_id`` and text are drawn together if one of them is.
    """
    drawn = importance(docs, target, **how).where("rank is not null")
    drawn = drawn.select(F.col("doc_id").alias("__drawn_id"), F.col("text_hash").alias("__drawn_text")).distinct()
    same = docs["doc_id"].eqNullSafe(drawn["__drawn_id"]) & (F.xxhash64(docs["text"]) == drawn["__drawn_text"])
    return docs.join(drawn, same, "left_semi")
