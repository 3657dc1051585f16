"""Interlacing as arithmetic on places: which pass a pixel belongs to, and where in it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import ADAM7


def pass_of(x: Column, y: Column) -> Column:
    """1 to 7: the pass whose grid has the pixel."""
    on = lambda p: (F.pmod(x, F.lit(p[2])) == p[0]) & (F.pmod(y, F.lit(p[3])) == p[1])
    return reduce(lambda found, n: F.when(on(ADAM7[n - 1]), n).otherwise(found), range(6, 0, -1), F.lit(7))


def by_pass(kind: Column, place: int) -> Column:
    return reduce(lambda found, n: F.when(kind == n, ADAM7[n - 1][place]).otherwise(found), range(6, 0, -1), F.lit(ADAM7[6][place]))


def interlaced(px: DataFrame) -> DataFrame:
    """Pixels with their pass and their place (px, py) in it."""
    px = px.withColumn("pass", pass_of(F.col("x"), F.col("y")))
    place = lambda at, i: ((F.col(at) - by_pass(F.col("pass"), i)) / by_pass(F.col("pass"), i + 2)).cast("int")
    return px.withColumn("px", place("x", 0)).withColumn("py", place("y", 1))


def deinterlaced(px: DataFrame) -> DataFrame:
    """Pixels back at x and y from pass, px, py."""
    at = lambda place, i: by_pass(F.col("pass"), i) + F.col(place) * by_pass(F.col("pass"), i + 2)
    return px.withColumn("x", at("px", 0)).withColumn("y", at("py", 1))


def in_file_order(px: DataFrame) -> DataFrame:
    """px has width and height of its image: pixels with their place `at` in the file. A pass's pixels begin after those
    of all passes before it, so each pixel knows its place from its own row; nothing is sorted or dealt."""
    side = lambda size, start, step: F.greatest(F.lit(0), F.floor((F.col(size) - start + step - 1) / step))
    sizes = [(side("width", x0, dx), side("height", y0, dy)) for x0, y0, dx, dy in ADAM7]
    before, found, wide = F.lit(0), F.lit(0), sizes[0][0]
    for n, (w, h) in enumerate(sizes, 1):
        found, wide = F.when(F.col("pass") == n, before).otherwise(found), F.when(F.col("pass") == n, w).otherwise(wide)
        before = before + w * h
    return interlaced(px).withColumn("at", (found + F.col("py") * wide + F.col("px")).cast("int"))


def pass_sizes(images: DataFrame) -> DataFrame:
    """images with width, height: a row for each pass, 0 by 0 where it has no pixels in one direction."""
    grid = F.explode(F.array(*[F.struct(F.lit(n).alias("pass"), *[F.lit(v).alias(k) for k, v in zip(("x0", "y0", "dx", "dy"), p)]) for n, p in enumerate(ADAM7, 1)])).alias("p")
    size = lambda side, start, step: F.greatest(F.lit(0), F.ceil((F.col(side) - F.col(f"p.{start}")) / F.col(f"p.{step}"))).cast("long")
    return images.select("*", grid).select(*images.columns, "p.pass", size("width", "x0", "dx").alias("pass_width"), size("height", "y0", "dy").alias("pass_height"))
