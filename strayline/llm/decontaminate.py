"""Benchmark decontamination by spaced seeds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strayline.llm.common import cut

# Which words of a window of 12 count; the others may differ.
SEEDS = ["111011010011", "110100110111", "101101101101"]
SPAN = 12
# Words of an overlap that prove contamination (a shorter item: all of its words), the share of them
# that must agree, and the words of an item too short to prove anything.
OVERLAP, AGREE, SHORTEST = 13, 0.8, 8
# Words on either side of a hit that are kept for verification.
AROUND = 64
_BITMAP_BITS = 23
_CHUNK_BYTES = 1 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 2**64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts (A-Z lower-cased), and where each text's words begin."""
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    data = _LOWER[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    starts = np.concatenate([[0], ends]).astype(np.int64)
    is_word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[starts] = True
    first = np.flatnonzero(is_word & (edge[:-1] | ~np.concatenate([[False], is_word[:-1]])))
    after = np.flatnonzero(is_word & (edge[1:] | ~np.concatenate([is_word[1:], [False]]))) + 1
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=sums[1:])
    h = (sums[after] - sums[first]) * _powers(_INVERSE, len(data) + 1)[first]
    return _mixed(h), np.searchsorted(first, starts)


def _offsets(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def window_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of every window of ``len(mask)`` words, from the words that the mask selects."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.full(n, np.uint64(int(mask.replace("0", "2"), 3)))
    for i in _offsets(mask):
        h = (h ^ words[i : i + n]) * _MULTIPLIER
        h ^= h >> np.uint64(29)
    return _mixed(h)


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about _CHUNK_BYTES, so that memory follows the longest text, not a batch."""
    texts, size, at = [], 0, 0
    for k, t in enumerate(batch.column(1)):
        texts.append(t.as_py() or b"")
        size += len(texts[-1])
        if size >= _CHUNK_BYTES:
            yield at, texts
            texts, size, at = [], 0, k + 1
    if texts:
        yield at, texts


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [word_hashes([t.as_py() or b""])[0].view(np.int64) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([w.tolist() for w in words], pa.list_(pa.int64()))], ["item_id", "item"]
        )


def _item_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        out = []
        for key, item in zip(frame["key"], frame["item"]):
            words = np.asarray(item, dtype=np.int64)
            for mask in SEEDS if len(words) >= SPAN else ["1" * len(words)]:
                h = window_hashes(words.view(np.uint64), mask).view(np.int64)
                out.append(pd.DataFrame({"hash": h, "item_at": np.arange(len(h)), "key": key}))
        yield pd.concat(out) if out else pd.DataFrame({"hash": [], "item_at": [], "key": []})


def _regions(masks: list[str], bitmap: np.ndarray):
    """Parts of texts that may hold an item: windows whose hash has both its bits set, with the words
    around them, in one row for windows that are near each other."""
    shift, low_bits = np.uint64(64 - _BITMAP_BITS), np.uint64((1 << _BITMAP_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, words, hits = [], [], [], []
            for at, texts in _groups(batch):
                hashes, begins = word_hashes(texts)
                found_at, found = [], []
                for mask in masks:
                    h = window_hashes(hashes, mask)
                    k = np.flatnonzero(bitmap[h >> shift])
                    k = k[bitmap[h[k] & low_bits]]
                    text_of = np.searchsorted(begins, k, side="right") - 1
                    k = k[k + len(mask) <= begins[text_of + 1]]
                    found_at.append(k)
                    found.append(h[k])
                k, h = np.concatenate(found_at), np.concatenate(found)
                order = np.argsort(k, kind="stable")
                k, h = k[order], h[order]
                text_of = np.searchsorted(begins, k, side="right") - 1
                new = np.flatnonzero((np.diff(k, prepend=-1) > AROUND) | (np.diff(text_of, prepend=-1) != 0))
                for a, b in zip(new, [*new[1:], len(k)]):
                    doc = text_of[a]
                    start = max(begins[doc], k[a] - AROUND)
                    stop = min(begins[doc + 1], k[b - 1] + SPAN + AROUND)
                    ids.append(at + int(doc))
                    starts.append(int(start - begins[doc]))
                    words.append(hashes[start:stop].view(np.int64).tolist())
                    hits.append([{"hash": int(x), "at": int(y)} for x, y in zip(h[a:b].view(np.int64), k[a:b] - start)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(ids, pa.int64())),
                    pa.array(starts, pa.int64()),
                    pa.array(words, pa.list_(pa.int64())),
                    pa.array(hits, pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int64())]))),
                ],
                ["doc_id", "start", "words", "hits"],
            )

    return run


def best_overlap(words: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """The stretch of a diagonal (word ``i`` of the item at ``i + shift``) with the most words that
    agree, of those where at least AGREE do: these words, its length, and where it begins."""
    low, high = max(0, -shift), min(len(item), len(words) - shift)
    if high <= low:
        return 0, 0, 0
    same = words[low + shift : high + shift] == item[low:high]
    # a stretch is good if its sum is not negative: the sums before and after it tell
    cost = round(AGREE / (1 - AGREE), 6)
    total = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0, -cost))])
    agree = np.concatenate([[0], np.cumsum(same)])
    begins = np.searchsorted(-np.minimum.accumulate(total), -total, side="left")
    end = int((agree - agree[begins]).argmax())
    begin = int(begins[end])
    while begin < end and not same[begin]:
        begin += 1
    return int(agree[end] - agree[begin]), end - begin, begin + low


def _overlap(words: pd.Series, item: pd.Series, shift: pd.Series) -> pd.DataFrame:
    found = [best_overlap(np.asarray(w), np.asarray(i), int(s)) for w, i, s in zip(words, item, shift)]
    return pd.DataFrame(found, columns=["agree", "length", "at"])


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Benchmark passages in documents: ``(doc_id, item_id, start, n_words, n_agree)``.

    ``docs`` has ``doc_id, text``; ``benchmark`` has ``item_id, text``. Words are compared with A-Z
    in lower case. Every window of SPAN words is hashed under each of SEEDS, which ignore some
    positions, so a window with a substituted word still meets the benchmark's under a mask that
    ignores it. Around each meeting document and item are aligned, and the best stretch counts if
    at least OVERLAP words agree (or all of a shorter item) and AGREE of its words do; ``start`` is
    its first word in the document. An item of SHORTEST to SPAN - 1 words must occur unchanged; a
    shorter or null one proves nothing and is passed over. Identical items are compared once and
    reported each; for a document and an item the longest overlap is given once, also where rows
    are repeated. Null or empty texts contain nothing; empty tables give an empty result; other
    columns are not read.

    Training windows stay where they are read: a bitmap of fixed size, set by the benchmark's
    hashes, lets through those that may match. A larger benchmark lets more through and stays
    exact. The rest is joined by hash.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    items = benchmark.select("item_id", F.col("text").cast("binary")).mapInArrow(
        _item_words, f"item_id {item_type}, item array<long>"
    )
    items = cut(items.where(F.size("item") >= SHORTEST))
    # a window names its item by a hash; the words are joined where a meeting is verified
    by_key = items.select("item").distinct().select(F.xxhash64("item").alias("key"), "item")
    windows = cut(by_key.mapInPandas(_item_windows, "hash long, item_at long, key long"))
    places = F.array(
        F.shiftrightunsigned("hash", 64 - _BITMAP_BITS), F.col("hash").bitwiseAND(F.lit((1 << _BITMAP_BITS) - 1))
    )
    cells = (
        windows.select(F.explode(places).alias("place"))
        .selectExpr("place >> 6 as cell", "1L << cast(place & 63 as int) as bit")
        .groupBy("cell")
        .agg(F.bit_or("bit").alias("bits"))
        .toPandas()
    )  # a row per 64 bits of the bitmap at most
    packed = np.zeros(1 << (_BITMAP_BITS - 6), dtype=np.uint64)
    packed[cells["cell"].to_numpy(np.int64)] = cells["bits"].to_numpy(np.int64).view(np.uint64)
    bitmap = np.unpackbits(packed.view(np.uint8), bitorder="little").view(bool)
    lengths = [r[0] for r in items.where(F.size("item") < SPAN).select(F.size("item")).distinct().collect()]
    masks = SEEDS + ["1" * n for n in sorted(lengths)]
    regions = docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(
        _regions(masks, bitmap),
        f"doc_id {id_type}, start long, words array<long>, hits array<struct<hash:long,at:long>>",
    )
    regions = cut(regions.withColumn("region", F.xxhash64("doc_id", "start", "words")))
    hits = regions.select("region", F.explode("hits").alias("hit"))
    meetings = hits.join(windows, F.col("hit.hash") == F.col("hash")).select(
        "region", "key", (F.col("hit.at") - F.col("item_at")).alias("shift")
    )
    meetings = meetings.distinct()
    found = regions.select("region", "doc_id", "start", "words").dropDuplicates(["region"]).join(meetings, "region").join(by_key, "key")
    measured = F.pandas_udf(_overlap, "struct<agree:int,length:int,at:int>")
    found = found.select("doc_id", "start", "shift", "item", measured("words", "item", "shift").alias("o"))
    need = F.least(F.lit(OVERLAP), F.size("item"))
    found = found.where((F.col("o.agree") >= need) & (F.col("o.agree") >= F.lit(AGREE) * F.col("o.length")))
    found = found.select("doc_id", "item", F.struct(
        F.col("o.agree").alias("n_agree"), F.col("o.length").alias("n_words"),
        (-(F.col("start") + F.col("shift") + F.col("o.at"))).alias("before"),
    ).alias("o"))
    best = found.join(items, "item").groupBy("doc_id", "item_id").agg(F.max("o").alias("o"))
    return best.select(
        "doc_id", "item_id", (-F.col("o.before")).alias("start"), F.col("o.n_words").alias("n_words"), F.col("o.n_agree").alias("n_agree")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose own text has no benchmark passage, with all columns.

    Rows are told by ``doc_id`` and text, so that a null or repeated ``doc_id`` decides nothing about
    other texts. Null and empty texts stay; an empty table stays empty, and an empty benchmark drops
    nothing; columns may have any names.
    """
    own = F.struct("doc_id", F.xxhash64("text").alias("h"), F.hash("text").alias("g"))
    bad = overlaps(docs.select(own.alias("doc_id"), "text"), benchmark)
    bad = bad.select(*[F.col(f"doc_id.{c}").alias(f"__bad_{c}") for c in ("doc_id", "h", "g")]).distinct()
    of_text = (F.xxhash64(docs["text"]) == bad["__bad_h"]) & (F.hash(docs["text"]) == bad["__bad_g"])
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__bad_doc_id"]) & of_text, "left_anti")
