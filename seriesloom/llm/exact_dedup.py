"""Exact deduplication with a two-pass Bloom filter, in DataFrame functions only.

Pass one counts the cells of a Bloom filter that the hashes of all texts hit and keeps, as bitmaps,
the cells hit at least twice. Pass two asks of every row whether all cells of its hash are among
them: only such rows can have an equal partner. They alone are shuffled and grouped by the SHA-256
of the whole text; every other row goes straight through.

Defined cases: a null text counts as empty; a null identifier sorts below every other; rows that
repeat an identifier together with its text are one in ``marks`` as to their flags, and exactly one
of them is kept by ``distinct_rows``; an empty table gives an empty table; columns of any name pass
through ``distinct_rows`` unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import Scratch, utf8

PAGE = 32768  # bits of one bitmap page, fixed by Spark's bitmap functions


@dataclass(frozen=True)
class RepeatFilter:
    """Pages of cells hit at least twice: ``page`` and ``bits``, and how many pages there can be."""

    pages: DataFrame
    count: int
    probes: int
    broadcast: bool

    def mark(self, rows: DataFrame, hashed: Column, name: str) -> DataFrame:
        """Append the boolean ``name``: may another row have the same hash?"""
        flags = []
        for probe in range(self.probes):
            cell = _cell(hashed, probe, self.count)
            side = self.pages.select(
                F.col("page").alias(f"__page{probe}"), F.col("bits").alias(f"__bits{probe}")
            )
            if self.broadcast:
                side = F.broadcast(side)
            rows = rows.withColumn(f"__cell{probe}", cell)
            rows = rows.join(side, F.floor(F.col(f"__cell{probe}") / PAGE) == F.col(f"__page{probe}"), "left")
            at = F.pmod(F.col(f"__cell{probe}"), F.lit(PAGE)).cast("int")
            octet = F.ascii(F.decode(F.substring(f"__bits{probe}", (at / 8).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
            hit = F.shiftright(octet, 0).bitwiseAND(F.expr(f"shiftleft(1, cast(pmod(__cell{probe}, 8) as int))")) != 0
            flags.append(F.coalesce(hit, F.lit(False)))
        out = flags[0]
        for flag in flags[1:]:
            out = out & flag
        helpers = [f"__{kind}{p}" for p in range(self.probes) for kind in ("cell", "page", "bits")]
        return rows.withColumn(name, out).drop(*helpers)


def _cell(hashed: Column, probe: int, pages: int) -> Column:
    return F.pmod(F.xxhash64(hashed, F.lit(probe)), F.lit(pages * PAGE))


def repeat_filter(
    hashes: DataFrame,
    column: str,
    rows: int,
    bits_per_row: int = 16,
    probes: int = 2,
    broadcast_bytes: int = 64 << 20,
) -> RepeatFilter:
    """Pass one over a column of 64-bit hashes; ``rows`` is their number.

    The filter has ``bits_per_row`` bits for each row. It is broadcast while its size, known from
    ``rows`` before it is built, stays within ``broadcast_bytes``; beyond that it is joined by page.
    """
    pages = max(1, -(-rows * bits_per_row // PAGE))
    cells = hashes.select(
        F.explode(F.array(*[_cell(F.col(column), p, pages) for p in range(probes)])).alias("cell")
    )
    # A hash whose probes coincide hits that cell twice by itself; it is then only a false positive.
    twice = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("hits")).filter("hits > 1")
    bitmaps = twice.groupBy(F.floor(F.col("cell") / PAGE).alias("page")).agg(
        F.bitmap_construct_agg(F.pmod("cell", F.lit(PAGE))).alias("bits")
    )
    return RepeatFilter(bitmaps, pages, probes, pages * PAGE // 8 <= broadcast_bytes)


def marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest identifier stays. The text is read once; what is
    written, counted and shuffled afterwards is an identifier and hashes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    body = utf8(text_col)
    slim = scratch.write(
        docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(body, 256)).alias("sha"), F.xxhash64(body).alias("hashed"))
    )
    found = repeat_filter(slim, "hashed", slim.count())
    pages = scratch.write(found.pages)
    seen = RepeatFilter(pages, found.count, found.probes, found.broadcast).mark(slim, F.col("hashed"), "maybe")
    single = seen.filter("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    several = seen.filter("maybe").select("doc_id", "sha")
    groups = several.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    several = several.join(groups, "sha").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "sha"
    )
    return single.unionByName(several).select(
        F.col("doc_id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )


def distinct_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows that the filter clears pass without a shuffle. The others are reduced per SHA-256 where
    they lie and then once more across tasks, so a text that fills a third of the table costs each
    task one row.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    hashes = scratch.write(docs.select(F.xxhash64(utf8(text_col)).alias("hashed")))
    found = repeat_filter(hashes, "hashed", hashes.count())
    pages = scratch.write(found.pages)
    packed = docs.select(
        F.struct("*").alias("__row"), F.col(id_col).alias("__id"), F.xxhash64(utf8(text_col)).alias("__hash"), utf8(text_col).alias("__body")
    )
    seen = RepeatFilter(pages, found.count, found.probes, found.broadcast).mark(packed, F.col("__hash"), "__maybe")
    single = seen.filter("not __maybe").select("__row")
    best = (
        seen.filter("__maybe")
        .groupBy(F.unhex(F.sha2("__body", 256)).alias("__sha"))
        .agg(F.max_by("__row", F.struct("__id")).alias("__row"))
        .select("__row")
    )
    return single.unionByName(best).select("__row.*")
