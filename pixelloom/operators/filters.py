"""Row filters and their choice, as windows and aggregates over bytes: px has img, y, x, v (and pass, if interlaced).

x counts the bytes of one place in the pixel, so a byte's left neighbour is the one before it: for pixels of several
bytes, partition by the byte's place as well (`lane`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.expressions import prediction
from . import files

#: Rows of an image that one task takes at least; the last row of each band goes to the next one as well.
BAND = 64
BYTES = tuple(f"byte{kind}" for kind in range(5))


def neighbours(px: DataFrame, image: tuple[str, ...] = ("img",)) -> DataFrame:
    """a (left), b (above) and c (corner) of every byte; 0 beyond the edges. Images are dealt out in bands of rows, each
    with the row above it, so one exchange serves both windows and no image has to fit a task."""
    band = F.floor(F.col("y") / BAND)
    px = px.withColumn("band", F.explode(F.sequence(band, F.floor((F.col("y") + 1) / BAND)))).repartition(*image, "band")
    rows, columns = Window.partitionBy(*image, "band", "y").orderBy("x"), Window.partitionBy(*image, "band", "x").orderBy("y")
    px = px.withColumn("a", F.coalesce(F.lag("v").over(rows), F.lit(0)))
    px = px.withColumn("b", F.coalesce(F.lag("v").over(columns), F.lit(0))).withColumn("c", F.coalesce(F.lag("a").over(columns), F.lit(0)))
    return px.where(F.col("band") == band).drop("band")


def five_bytes(px: DataFrame, image: tuple[str, ...] = ("img",)) -> DataFrame:
    """Every byte under each of the five filters, in columns byte0 to byte4."""
    byte = lambda kind: F.pmod(F.col("v") - prediction(F.lit(kind), F.col("a"), F.col("b"), F.col("c")), F.lit(256)).cast("int")
    return neighbours(px, image).select("*", *[byte(kind).alias(name) for kind, name in enumerate(BYTES)]).drop("a", "b", "c")


def filtered(px: DataFrame, kind) -> DataFrame:
    """Every byte under the filter that the column `kind` gives for its row: byte."""
    return five_bytes(px).withColumn("kind", kind).withColumn("byte", F.element_at(F.array(*BYTES), F.col("kind") + 1)).drop(*BYTES)


def chosen(px: DataFrame, image: tuple[str, ...] = ("img",)) -> DataFrame:
    """Of each row the filter whose bytes have the least sum of magnitudes as signed numbers, the first where they tie."""
    magnitude = lambda name: F.when(F.col(name) > 127, 256 - F.col(name)).otherwise(F.col(name))
    costs = five_bytes(px, image).groupBy(*image, "y").agg(*[F.sum(magnitude(name)).alias(name) for name in BYTES])
    best = F.least(*[F.struct(F.col(name).alias("cost"), F.lit(kind).alias("kind")) for kind, name in enumerate(BYTES)])
    return costs.withColumn("best", best).select(*image, "y", "best.kind", "best.cost")


def reconstructed(rows: DataFrame, image: str = "img", bpp: int = 1) -> DataFrame:
    """Undoes filters: rows has img, y, kind, bytes (array<int>); gives img, y, x, v. A row depends on the one above it
    down to the first, so an image's rows go to the file kernel together."""
    kind = rows.schema[image].dataType.simpleString()
    ordered = rows.groupBy(image).agg(F.array_sort(F.collect_list(F.struct("y", "kind", "bytes"))).alias("rows"))

    def one(row: dict) -> list[dict]:
        raw = codec.rows_of([[r["kind"], *r["bytes"]] for r in row["rows"]])
        lines = codec.unfilter(raw, bpp).tolist()
        return [{image: row[image], "y": r["y"], "line": line} for r, line in zip(row["rows"], lines)]

    lines = files.map_rows(ordered, f"{image} {kind}, y int, line array<int>", one)
    return lines.select(image, "y", F.posexplode("line").alias("x", "v"))
