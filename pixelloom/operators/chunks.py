"""Chunk sequences as windows: positions, rules of order, joined image data, metadata that counts.

chunks has file_id, ord, type, data. Rules are flags on rows; a file's error is that of its first row that breaks one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import COLOR_CHUNKS, KNOWN_CHUNKS, PLACED_CHUNKS
from ..functions.expressions import is_safe_to_copy
from .files import map_rows

SINGLE = ("gAMA", "cHRM", "sRGB", "iCCP", "cICP", "pHYs", "tIME", "eXIf")


def before(kind: str) -> Column:
    """How many chunks of a type come before this one."""
    window = Window.partitionBy("file_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum((F.col("type") == kind).cast("int")).over(window), F.lit(0))


def placed(chunks: DataFrame) -> DataFrame:
    """Chunks with their position: before the palette, before image data or after it has begun."""
    return chunks.withColumn("position", F.when(before("IDAT") > 0, "AfterImageData").when(before("PLTE") > 0, "BeforeImageData").otherwise("BeforePalette"))


def outcomes(chunks: DataFrame, indexed: Column | None = None) -> DataFrame:
    """(file_id, outcome): OK, or the error that reading in order meets first; nothing after IEND counts. indexed: whether
    a file's colors are indices, so that image data needs a palette before it; by default none are."""
    indexed = F.lit(False) if indexed is None else indexed
    window = Window.partitionBy("file_id").orderBy("ord")
    seen = chunks.select("file_id", "ord", "type", before("IDAT").alias("images"), before("PLTE").alias("palettes"), before("tRNS").alias("keys"), F.lag("type").over(window).alias("previous"), indexed.alias("indexed"))
    kind, after = F.col("type"), F.col("images") > 0
    rule = (
        F.when((kind == "PLTE") & after, "PaletteAfterImageData")
        .when((kind == "PLTE") & (F.col("keys") > 0), "TransparencyBeforePalette")
        .when((kind == "PLTE") & (F.col("palettes") > 0), "DuplicatePalette")
        .when((kind == "tRNS") & after, "TransparencyAfterImageData")
        .when((kind == "tRNS") & (F.col("keys") > 0), "DuplicateTransparency")
        .when((kind == "IDAT") & after & (F.col("previous") != "IDAT"), "NonConsecutiveImageData")
        .when((kind == "IDAT") & ~after & F.col("indexed") & (F.col("palettes") == 0), "MissingPalette")
        .when(kind == "IEND", F.when(after, "OK").otherwise("MissingImageData"))
    )
    first = F.min(F.when(F.col("rule").isNotNull(), F.struct("ord", "rule")))["rule"]
    return seen.withColumn("rule", rule).groupBy("file_id").agg(F.coalesce(first, F.lit("MissingImageEnd")).alias("outcome"))


def joined(chunks: DataFrame, kind: str = "IDAT") -> DataFrame:
    """The data of all chunks of a type, one after the other: file_id, pieces, data."""
    parts = chunks.where(F.col("type") == kind).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("ord", "data"))).alias("parts"))
    key = chunks.schema["file_id"].dataType.simpleString()
    one = lambda row: [{"file_id": row["file_id"], "pieces": len(row["parts"]), "data": b"".join(p["data"] for p in row["parts"])}]
    return map_rows(parts, f"file_id {key}, pieces int, data binary", one)


def known_error(kind: Column, position: Column) -> Column:
    """MisplacedChunk where a known chunk may not stand."""
    wrong = (kind.isin(*COLOR_CHUNKS) & (position != "BeforePalette")) | (kind.isin(*PLACED_CHUNKS) & (position == "AfterImageData"))
    return F.when(wrong, "MisplacedChunk")


def settled(chunks: DataFrame, error: Column) -> DataFrame:
    """What becomes of each ancillary chunk: stored, appended (text), skipped (unknown) or its error.

    error is that of the chunk's own data, null if it is good. Position comes first; then a second chunk after a
    stored one is a duplicate, good or bad; the first good one is stored."""
    rows = placed(chunks).where(~F.col("type").isin("PLTE", "tRNS", "IDAT", "IEND"))
    rows = rows.withColumn("own", error).withColumn("place", known_error(F.col("type"), F.col("position")))
    good = F.col("type").isin(*SINGLE) & F.col("place").isNull() & F.col("own").isNull()
    earlier = Window.partitionBy("file_id", "type").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    stored = F.coalesce(F.max(good.cast("int")).over(earlier), F.lit(0)) == 1
    status = (
        F.when(F.col("place").isNotNull(), F.col("place"))
        .when(F.col("type").isin(*SINGLE) & stored, "DuplicateChunk")
        .when(F.col("own").isNotNull(), F.col("own"))
        .when(F.col("type").isin(*SINGLE), "stored")
        .when(F.col("type").isin("tEXt", "zTXt", "iTXt"), "appended")
        .otherwise("skipped")
    )
    return rows.withColumn("status", status).drop("own", "place")


def unknown(chunks: DataFrame) -> DataFrame:
    return chunks.where(~F.col("type").isin(*KNOWN_CHUNKS))


def rewritten(chunks: DataFrame, written: DataFrame, keep_unsafe: bool = False) -> DataFrame:
    """Ancillary chunks that a re-encoded file keeps: safe to copy (or asked for), and not written from a typed value:
    written has file_id, type."""
    kept = chunks if keep_unsafe else chunks.where(is_safe_to_copy(F.col("type")))
    texts = F.explode(F.array(*map(F.lit, ("tEXt", "zTXt", "iTXt"))))
    blocked = written.where(~F.col("type").isin("tEXt", "zTXt", "iTXt")).unionByName(
        written.where(F.col("type").isin("tEXt", "zTXt", "iTXt")).select("file_id").distinct().withColumn("type", texts)
    )
    return kept.where(~F.col("type").isin("acTL", "fcTL", "fdAT")).join(blocked, ["file_id", "type"], "left_anti")
