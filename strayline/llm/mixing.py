"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strayline.llm.common import cut, n_words, uniform

# A mix takes no document more often than this.
MOST_COPIES = 3
# Fractional documents that one task folds together in a step of the reduction tree (on average).
FAN = 64


def source_targets(sizes: DataFrame) -> DataFrame:
    """Target size of each source, from rows ``(source, size, n)`` with ``n`` equal documents.

    Sources in code point order, null last, weigh 1, 2, 3, 1, ... They share the whole size; a
    source stops at MOST_COPIES times its own size and the excess goes to the others by weight. The
    fixed point is ``min(weight * level, cap)``. The total taken is concave in the level, a minimum
    of straight lines, one for each number of capped sources; so the level is the largest at which
    a line reaches the whole size. One row per source is all that is sorted here, but by one task:
    this is for sources by name, up to some millions, and not for a source per document.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    per = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    per = per.withColumn("weight", (F.col("rank") - 1) % 3 + 1)
    per = per.withColumn("cap", F.col("source_size") * MOST_COPIES)
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    capped = F.coalesce(
        F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    free = F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    whole = F.sum("source_size").over(Window.partitionBy())
    per = per.withColumn("reach", (whole - capped) / free)
    level = F.max("reach").over(Window.partitionBy())
    target = F.least(F.col("weight") * level, F.col("cap").cast("double"))
    return per.select("source", "source_size", target.alias("target"))


def _pair(seed: int, level: int):
    """One step of the fold: words move between the open document and the next one until one of
    the two is taken as a whole or not at all; the other stays open. The expected share of both and
    the words of the pair do not change."""

    def merge(s: Column, x: Column) -> Column:
        a, b, p, q = s["size"], x["size"], s["p"], x["p"]
        gain = F.least((1 - p) * a, q * b)
        loss = F.least(p * a, (1 - q) * b)
        u = uniform(F.lit(seed), F.lit(level), s["doc_id"], s["copy"], x["doc_id"], x["copy"])
        rises = u * (gain + loss) < loss
        ends = F.when(rises, (1 - p) * a <= q * b).otherwise(p * a <= (1 - q) * b)
        if_ended = F.when(rises, q - (1 - p) * a / b).otherwise(q + p * a / b)
        if_open = F.when(rises, p + q * b / a).otherwise(p - (1 - q) * b / a)
        p_next = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(ends, if_ended).otherwise(if_open)))
        done = F.struct(
            *[F.when(ends, s[c]).otherwise(x[c]).alias(c) for c in ("doc_id", "copy", "size")],
            (rises == ends).cast("int").alias("up"),
        )
        return F.struct(
            F.array_append(s["done"], done).alias("done"),
            *[F.when(ends, x[c]).otherwise(s[c]).alias(c) for c in ("doc_id", "copy", "size")],
            p_next.alias("p"),
        )

    return merge


def _fold(items: Column, id_type: str, seed: int, level: int) -> Column:
    nothing = F.array().cast(f"array<struct<doc_id:{id_type},copy:bigint,size:bigint,up:int>>")
    first = F.element_at(items, 1)
    start = F.struct(
        nothing.alias("done"), *[first[c].alias(c) for c in ("doc_id", "copy", "size", "p")]
    )
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), start, _pair(seed, level))


def mix(docs: DataFrame, seed: int = 0, fan: int = FAN) -> DataFrame:
    """How many words of every document a mix with the weights of `source_targets` takes.

    ``docs`` has ``doc_id, text, source``. Rows ``(doc_id, size, source_size, target, taken)``, one
    for each row of ``docs``. A document is expected ``target / source_size`` times: the whole part
    is taken for sure; the fractions of a source are rounded together, so that its words stay near
    the target (off by less than one document) while each document keeps its own probability.

    Fractions are rounded in groups of about ``fan`` documents of a source; every group leaves one
    document open, and those are grouped again until one is left, which is drawn. A hot source has
    many groups and no larger ones. Draws are hashes of seed, level, ids and copy, so reruns agree.

    A null text has no words; a document without words is never taken; a null source is a source of
    its own; an empty table gives an empty result. Repeated rows are counted, then told apart by
    their number and drawn on their own. Other columns are not read.
    """
    sizes = cut(
        docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
        .groupBy("doc_id", "source", "size")
        .agg(F.count("*").alias("n"))
    )
    id_type = sizes.schema["doc_id"].dataType.simpleString()
    targets = cut(source_targets(sizes))
    share = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    rows = (
        sizes.alias("d")
        .join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        .select("doc_id", "d.source", "size", (share - F.floor(share)).alias("p"),
                F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    )
    takes_part = (F.col("p") > 0) & (F.col("size") > 0)
    drawn = [rows.where(~takes_part).select("source", "doc_id", "size", F.lit(0).alias("up"))]
    is_open = rows.where(takes_part).select("source", "doc_id", "copy", "size", "p")
    level, most = 0, 2
    while most > 1:
        groups = is_open.groupBy("source").agg(F.ceil(F.count("*") / fan).alias("groups"))
        place = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "doc_id", "copy", "size"), F.col("groups"))
        item = F.struct(F.xxhash64(F.lit(seed), "doc_id", "copy").alias("h"), "doc_id", "copy", "size", "p")
        folded = cut(
            is_open.alias("o")
            .join(groups.alias("g"), F.col("o.source").eqNullSafe(F.col("g.source")))
            .groupBy("o.source", place.alias("place"))
            .agg(F.array_sort(F.collect_list(item)).alias("items"))
            .select("source", "place", _fold(F.col("items"), id_type, seed, level).alias("s"))
        )
        drawn.append(
            folded.select("source", F.explode("s.done").alias("d"))
            .select("source", "d.doc_id", "d.size", "d.up")
        )
        is_open = folded.select("source", "s.doc_id", "s.copy", "s.size", "s.p")
        most = (folded.agg(F.max("place")).first()[0] or 0) + 1
        level += 1
    last = uniform(F.lit(seed), F.lit("last"), "doc_id", "copy") < F.col("p")
    drawn.append(is_open.select("source", "doc_id", "size", last.cast("int").alias("up")))
    every = drawn[0]
    for part in drawn[1:]:
        every = every.union(part)
    copies = F.floor(share) + F.col("up")
    return (
        every.alias("d")
        .join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"))
    )
