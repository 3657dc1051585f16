"""Palettes as joins and aggregates: lookups, and lossless reduction to at most 256 colors.

px has img, pos, r, g, b, a. A palette is a table (img, idx, r, g, b); alphas are (img, idx, a)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST = 256


def with_alpha(palette: DataFrame, alphas: DataFrame, image: str = "img") -> DataFrame:
    """Entries without an alpha of their own are opaque."""
    return palette.join(alphas, [image, "idx"], "left").withColumn("a", F.coalesce("a", F.lit(255)))


def looked_up(indexed: DataFrame, palette: DataFrame, image: str = "img") -> DataFrame:
    """indexed has img, pos, idx; colors are null where the palette has no such entry. An image's palette has at most
    256 rows, but palettes grow with the images, so the join is left to Spark."""
    return indexed.join(palette, [image, "idx"], "left")


def first_out_of_range(indexed: DataFrame, entries: DataFrame, image: str = "img") -> DataFrame:
    """entries has img, entries: of each image that has one, the first index beyond its palette."""
    beyond = indexed.join(entries, image).where("idx >= entries")
    return beyond.groupBy(image, "entries").agg(F.min(F.struct("pos", "idx")).alias("first")).select(image, F.col("first.idx").alias("index"), "entries")


def keyed(px: DataFrame, keys: DataFrame, image: str = "img") -> DataFrame:
    """Alpha from a color key (img, kr, kg, kb): samples equal at their own depth are transparent."""
    same = (F.col("r") == F.col("kr")) & (F.col("g") == F.col("kg")) & (F.col("b") == F.col("kb"))
    return px.join(keys, image, "left").withColumn("a", F.when(same, 0).otherwise(255)).drop("kr", "kg", "kb")


def colors_of(px: DataFrame, image: str = "img") -> DataFrame:
    """Distinct colors and where each first appears: partial sums first, so few rows are exchanged."""
    return px.groupBy(image, "r", "g", "b", "a").agg(F.min("pos").alias("first"))


def reduced(px: DataFrame, image: str = "img", order: str = "pos") -> DataFrame:
    """Palettes of images with at most MOST colors: img, idx, r, g, b, a, depth. Translucent entries come first, then
    colors by first appearance; depth is the least that holds all."""
    colors = px.groupBy(image, "r", "g", "b", "a").agg(F.min(order).alias("first"))
    counts = colors.groupBy(image).agg(F.count("*").alias("n")).where(F.col("n") <= MOST)
    depth = F.when(F.col("n") <= 2, 1).when(F.col("n") <= 4, 2).when(F.col("n") <= 16, 4).otherwise(8)
    place = Window.partitionBy(image).orderBy((F.col("a") == 255).cast("int"), "first")
    return colors.join(counts, image).select(image, (F.row_number().over(place) - 1).alias("idx"), "r", "g", "b", "a", depth.alias("depth"))


def rejected(px: DataFrame, image: str = "img") -> DataFrame:
    """Images with too many colors for a palette."""
    return colors_of(px, image).groupBy(image).agg(F.count("*").alias("n_colors")).where(F.col("n_colors") > MOST)


def indexed(px: DataFrame, palette: DataFrame, image: str = "img") -> DataFrame:
    """Pixels as indices into their reduced palette."""
    return px.join(palette, [image, "r", "g", "b", "a"]).select(*[c for c in px.columns if c not in "rgba"], "idx", "depth")


def packed(index: DataFrame, width: int, image: str = "img") -> DataFrame:
    """Indices packed most significant bits first into rows padded with zeros: img, y, at, byte."""
    place = index.withColumn("y", F.expr(f"pos div {width}")).withColumn("x", F.expr(f"pos % {width}")).withColumn("per", F.expr("8 div depth"))
    bits = F.expr("cast(shiftleft(cast(idx as int), cast(8 - depth * (x % per + 1) as int)) as int)")
    return place.withColumn("at", F.expr("x div per")).groupBy(image, "y", "at").agg(F.sum(bits).cast("int").alias("byte"))
