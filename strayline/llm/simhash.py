"""SimHash near-duplicates by balls of variants that meet in the middle."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from strayline.llm.common import components, cut

RADIUS = 3
SEED = 42
# Shingles whose bits are counted at a time.
_CHUNK = 1 << 16
# Blocks of bits: of 7, a distance of RADIUS leaves 4 alike.
_BLOCKS = [range(0, 10)] + [range(i, i + 9) for i in range(10, 64, 9)]


def _signed(masks: list[int]) -> np.ndarray:
    return np.array(masks, dtype=np.uint64).view(np.int64)


def _masks() -> np.ndarray:
    kept = combinations(_BLOCKS, len(_BLOCKS) - RADIUS)
    return _signed([sum(1 << i for block in some for i in block) for some in kept])


def _flips() -> tuple[np.ndarray, np.ndarray]:
    """Masks of at most one bit, and of two bits of the same half."""
    ones = [0] + [1 << i for i in range(64)]
    halves = (range(0, 32), range(32, 64))
    return _signed(ones), _signed([1 << i | 1 << j for h in halves for i, j in combinations(h, 2)])


def fingerprint(text: bytes | None) -> int:
    """The 64 bits of a text: lower-cased A-Z, 3-word shingles, each bit set in over half of the
    XXH64 hashes. A text without words has 0; one or two words are a single shingle."""
    words = (text or b"").lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    if len(words) < 3:
        words = [b" ".join(words)]
        shingles = words
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), dtype=np.uint8)
    n = len(hashes) // 8
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, n, _CHUNK):
        bits = np.unpackbits(hashes[8 * i : 8 * (i + _CHUNK)].reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def _text_key() -> tuple[Column, Column]:
    return F.xxhash64("text").alias("h"), F.hash("text").alias("g")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *batch.columns[2:], pa.array(found, pa.int64())], ["doc_id", "h", "g", "fp"]
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows ``(doc_id, h, g, fp)``, one for each row of ``docs``; a null text counts as empty. ``h``
    and ``g`` are two hashes that tell the text."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary"), *_text_key()).mapInArrow(
        _fingerprints, f"doc_id {id_type}, h long, g int, fp long"
    )


def link(prints: DataFrame) -> DataFrame:
    """Links ``(u, v)`` that connect all fingerprints ``fp`` (distinct) within RADIUS bits.

    Every fingerprint emits its variants, rows meet by variant, and links go to the least
    fingerprint that reached it by one flip at most. Nothing in such a meeting needs a further
    check: two fingerprints one flip from a variant differ in at most 2 bits, and one flip and two
    flips make at most 3. Distance 3 is odd and two of its bits lie in one half; so it is enough
    that fingerprints with an even number of bits flip two bits of one half, and all flip one. Rows
    are linear in the fingerprints, and links in the rows: a meeting of many gives a star.

    A fingerprint whose blocks of bits nowhere agree with another's cannot be within RADIUS of one,
    so only the others emit variants.
    """
    blocks = prints.select("fp", F.explode(F.lit(_masks())).alias("mask"))
    blocks = blocks.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("part"), "fp")
    shared = (
        blocks.groupBy("mask", "part")
        .agg(F.min("fp").alias("low"), F.max("fp").alias("high"))
        .where("low < high")
        .select("mask", "part")
    )
    near = cut(blocks.join(shared, ["mask", "part"], "left_semi").select("fp").distinct())
    ones, twos = _flips()
    is_even = F.bit_count("fp") % 2 == 0
    flips = F.when(is_even, F.lit(np.concatenate([ones, twos]))).otherwise(F.lit(ones))
    variants = near.select("fp", F.posexplode(flips).alias("nr", "flip")).select(
        F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"),
        "fp",
        (F.col("nr") < len(ones)).alias("close"),
    )
    center = F.min(F.when(F.col("close"), F.col("fp"))).over(Window.partitionBy("variant"))
    return (
        variants.select(center.alias("u"), F.col("fp").alias("v"))
        .where("u is not null and u <> v")
        .distinct()
    )


def _rooted(prints: DataFrame) -> DataFrame:
    """Rows ``(fp, first, root)``: distinct fingerprints, their least ``doc_id`` and their group."""
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(link(nodes.select("fp")))
    return nodes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Fingerprint and group of every document: ``(doc_id, fingerprint, component_id)``.

    Fingerprints link at RADIUS or fewer differing bits; ``component_id`` is the smallest
    ``doc_id`` that links reach, a document's own included. Equal fingerprints are one node, so a
    large group of copies costs one node. A null or wordless text has fingerprint 0 and links like
    any other. A null ``doc_id`` is never the smallest; a group of nothing else has a null
    ``component_id``. Repeated rows stay as many rows; an empty table gives none; other columns are
    not read.
    """
    prints = cut(fingerprints(docs).select("doc_id", "fp"))
    rooted = _rooted(prints)
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of every group, with all columns.

    Rows are told by ``doc_id`` and text, so that a group decides on its own rows only. The row of
    the least ``(doc_id, fingerprint)`` stays, one without ``doc_id`` only if its group has no
    other; of rows equal in ``doc_id`` and text any one stays. A null or wordless text has fingerprint
    0, so of all such rows one stays. An empty table stays empty; columns may have any names.
    """
    prints = cut(fingerprints(docs))
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp", "h", "g")
    least = prints.groupBy("fp").agg(F.min(own).alias("least"))
    kept = _rooted(prints).join(least, "fp").groupBy("root").agg(F.min("least").alias("k"))
    kept = cut(kept.select(*[F.col(f"k.{c}").alias(f"__kept_{c}") for c in ("doc_id", "h", "g")]))
    h, g = _text_key()
    rows = docs.select("*", h.alias("__sim_h"), g.alias("__sim_g"))

    def same(right: DataFrame, prefix: str) -> Column:
        of_text = (rows["__sim_h"] == right[f"{prefix}h"]) & (rows["__sim_g"] == right[f"{prefix}g"])
        return rows["doc_id"].eqNullSafe(right[f"{prefix}doc_id"]) & of_text

    # rows that are equal to a kept one in id and text: few, so only those meet to leave one
    twice = prints.groupBy("doc_id", "h", "g").count().where("count > 1")
    twice = cut(twice.select(*[F.col(c).alias(f"__twice_{c}") for c in ("doc_id", "h", "g")]))
    rows = rows.join(kept, same(kept, "__kept_"), "left_semi")
    once = rows.join(twice, same(twice, "__twice_"), "left_anti")
    again = rows.join(twice, same(twice, "__twice_"), "left_semi").dropDuplicates(["doc_id", "__sim_h", "__sim_g"])
    return once.union(again).select(docs.columns)
