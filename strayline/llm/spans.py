"""Substring deduplication over runs of consecutive sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strayline.llm.common import let

# Sentences of a run; the parts of a sentence between commas count as well, so that a passage that
# begins or ends inside a long sentence still has whole runs.
RUN = 3
# A piece ends with a mark and one white space, or with a line; the pieces of a text make the text.
BOUNDARY = r"(?<=[.!?;:,][\x20\x09\x0B-\x0D])|(?<=\n)"


def _pieces(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), BOUNDARY)


def _runs(pieces: Column) -> Column:
    """Runs of a text in order: first and last piece, two hashes, and whether an equal run of the
    same text comes before. Pieces without a word belong to no run; a text of fewer than RUN others
    is one run."""
    def piece(p: Column, i: Column) -> Column:
        norm = F.lower(F.btrim(p, F.lit(" \t\r\n\x0b\x0c")))
        return let(norm, lambda x: F.struct(
            i.alias("i"), (x != "").alias("full"), F.xxhash64(x).alias("h"), F.hash(x).alias("g")
        ))

    sentences = F.filter(F.transform(pieces, piece), lambda x: x["full"])

    def of(s: Column) -> Column:
        count = F.least(F.lit(RUN), F.size(s))

        def run(i: Column) -> Column:
            parts = [F.get(s, i + k) for k in range(RUN)]  # null beyond the end of a short text
            return F.struct(
                F.xxhash64(*[x["h"] for x in parts]).alias("h"), F.hash(*[x["g"] for x in parts]).alias("g"),
                parts[0]["i"].alias("first"), F.get(s, i + count - 1)["i"].alias("last"),
            )

        every = F.transform(F.sequence(F.lit(0), F.size(s) - count), run)
        none = F.array().cast("array<struct<h:bigint,g:int,first:int,last:int>>")
        return F.when(F.size(s) == 0, none).otherwise(every)

    def marked(r: Column) -> Column:
        return F.transform(
            r,
            lambda x, i: F.struct(
                x["h"].alias("h"), x["g"].alias("g"), x["first"].alias("first"), x["last"].alias("last"),
                F.coalesce((F.get(r, i - 1)["h"] == x["h"]) & (F.get(r, i - 1)["g"] == x["g"]), F.lit(False)).alias("again"),
            ),
        )

    return let(F.array_sort(let(sentences, of)), marked)


def repeated_runs(docs: DataFrame) -> DataFrame:
    """Runs that are not the first of their kind: ``(doc_id, row, first, last, kept_doc_id)``.

    ``row`` is a hash of the text, ``first`` and ``last`` are pieces of it, and ``kept_doc_id`` is
    the least document with the run, where its first occurrence stays. A run that many documents
    share combines before the shuffle to its least document, and meets the rest as one row on one
    side of a join.
    """
    runs = docs.select("doc_id", F.hash("text").alias("row"), F.explode(_runs(_pieces("text"))).alias("r"))
    least = runs.groupBy("r.h", "r.g").agg(F.count("*").alias("n"), F.min("doc_id").alias("kept_doc_id"))
    least = least.where("n > 1").select("h", "g", "kept_doc_id")
    runs = runs.select("doc_id", "row", "r.h", "r.g", "r.first", "r.last", "r.again").join(least, ["h", "g"])
    is_other = F.col("kept_doc_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("kept_doc_id"))
    return runs.where(F.col("again") | is_other).select("doc_id", "row", "first", "last", "kept_doc_id")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without the pieces that repeated runs cover; all other columns stay, and
    ``removed`` (pieces) and ``kept_doc_ids`` (documents that have the removed runs first) follow, in place of columns of these names.

    Every run of RUN consecutive sentences is hashed, and all but its first occurrence go: another
    document's, or an earlier one in the same text. A document is told by its ``doc_id``: rows that
    share one are one document and keep what they share; a null ``doc_id`` is never first, and runs
    that only rows without id have stay. A null text stays null, an empty one empty; an empty table
    stays empty.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    again = repeated_runs(docs).groupBy(F.col("doc_id").alias("__span_doc"), F.col("row").alias("__span_row")).agg(
        F.collect_set(F.struct("first", "last")).alias("__span_again"),
        F.array_sort(F.collect_set("kept_doc_id")).alias("__span_kept"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("__span_doc")) & (F.hash("text") == F.col("__span_row"))
    rows = docs.join(again, same, "left").withColumn("__span_pieces", _pieces("text"))
    runs = F.coalesce("__span_again", F.array().cast("array<struct<first:int,last:int>>"))
    every = F.transform(runs, lambda r: F.sequence(r["first"], r["last"]))
    rows = rows.withColumn("__span_covered", F.array_distinct(F.flatten(every)))
    left = F.array_except(F.sequence(F.lit(0), F.size("__span_pieces") - 1), "__span_covered")
    text = F.array_join(F.transform(left, lambda i: F.get("__span_pieces", i)), "")
    text = F.when(F.size("__span_covered") == 0, F.col("text")).otherwise(text)
    return rows.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in ("removed", "kept_doc_ids")],
        F.size("__span_covered").alias("removed"),
        F.coalesce("__span_kept", F.array().cast(f"array<{id_type}>")).alias("kept_doc_ids"),
    )
