"""Animations: layout and rules as windows over chunks, cropping as a comparison of frames, rendering as a pass over
the frames of many pixels at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec


def laid_out(chunks: DataFrame) -> DataFrame:
    """chunks has file_id, ord, type: pieces of data with the number of their frame, from 0. Image data before the
    first frame control belongs to no frame."""
    number = F.sum((F.col("type") == "fcTL").cast("int")).over(Window.partitionBy("file_id").orderBy("ord")) - 1
    return chunks.withColumn("frame", number).where(F.col("type").isin("IDAT", "fdAT") & (F.col("frame") >= 0))


def first_errors(chunks: DataFrame, canvas: DataFrame) -> DataFrame:
    """(file_id, outcome): OK, or the first rule of animations that a file breaks.

    chunks has file_id, ord, type, seq (fcTL, fdAT), frames (acTL), length, w, h, fx, fy (fcTL); canvas has file_id,
    width, height. What can be said of a row comes by file order, what only of the whole file after that."""
    window = Window.partitionBy("file_id").orderBy("ord")
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    count = lambda condition, over: F.coalesce(F.sum(condition.cast("int")).over(over), F.lit(0))
    kind = F.col("type")
    numbered, data = kind.isin("fcTL", "fdAT"), kind.isin("IDAT", "fdAT")
    rows = chunks.join(canvas, "file_id").select(
        "*", count(numbered, earlier).alias("expected"), count(kind == "IDAT", earlier).alias("images"), count(kind == "fcTL", earlier).alias("started"),
        count(kind == "acTL", earlier).alias("controls"), F.lag("type").over(window).alias("previous"),
        F.max(F.when(kind == "fcTL", F.col("ord"))).over(earlier).alias("frame_at"), F.max(F.when(kind == "IDAT", F.col("ord"))).over(earlier).alias("image_at"),
        F.max(F.when(data, F.col("ord"))).over(earlier).alias("data_at"), F.min(F.when(kind == "IDAT", F.col("ord"))).over(Window.partitionBy("file_id")).alias("first_image"),
    )
    seen, out_of_order = F.col("images") > 0, F.col("seq") != F.col("expected")
    covers = (F.col("fx") == 0) & (F.col("fy") == 0) & (F.col("w") == F.col("width")) & (F.col("h") == F.col("height"))
    fits = (F.col("fx") + F.col("w") <= F.col("width")) & (F.col("fy") + F.col("h") <= F.col("height"))
    unfinished = (F.col("started") > 0) & (F.coalesce(F.col("data_at"), F.lit(-(2**62))) < F.col("frame_at"))
    still = F.col("frame_at") < F.coalesce("first_image", F.lit(2**62))  # the frame begun is the still image
    rule = (
        F.when((kind == "acTL") & seen, "MisplacedChunk")
        .when((kind == "acTL") & (F.col("controls") > 0), "DuplicateChunk")
        .when((kind == "acTL") & (F.col("frames") == 0), "InvalidChunkData")
        .when((kind == "fcTL") & out_of_order, "FrameSequenceMismatch")
        .when((kind == "fcTL") & ~seen & (F.col("started") > 0), "MisplacedChunk")
        .when((kind == "fcTL") & ~seen & ~covers, "InvalidChunkData")
        .when((kind == "fcTL") & ~fits, "FrameOutOfBounds")
        .when((kind == "fcTL") & unfinished, "MissingFrameData")
        .when((kind == "fdAT") & ((F.col("started") == 0) | still), "MisplacedChunk")
        .when((kind == "fdAT") & (F.col("length") < 4), "InvalidChunkLength")
        .when((kind == "fdAT") & out_of_order, "FrameSequenceMismatch")
    )
    found = rows.withColumn("rule", rule).groupBy("file_id").agg(
        F.min(F.when(F.col("rule").isNotNull(), F.struct("ord", "rule")))["rule"].alias("rule"), F.max("frames").alias("said"),
        F.sum((kind == "fcTL").cast("int")).alias("n"), F.max(F.when(kind == "fcTL", F.col("ord"))).alias("last"), F.max(F.when(data, F.col("ord"))).alias("filled"),
    )
    whole = (
        F.when(F.col("rule").isNotNull(), F.col("rule")).when(F.col("said").isNull(), "NotAnimated")
        .when((F.col("n") > 0) & (F.coalesce("filled", F.lit(-(2**62))) < F.col("last")), "MissingFrameData").when(F.col("n") != F.col("said"), "FrameCountMismatch").otherwise("OK")
    )
    return found.select("file_id", whole.alias("outcome"))


def rendered(px: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """What each pixel shows at each frame: keys, k, r, g, b, a.

    px has the keys of a pixel, k, covered, dispose, blend and r, g, b, a. Pixels don't touch each other, so each is
    a pass over its own frames, in order; a batch of pixels goes through its first frames together, then its second ones,
    and so on. The state is a pixel's color and, where the frame before leaves something to settle, the color to go back
    to. On the first frame there is nothing to go back to but an empty canvas."""
    from ..plans.shipping import ship

    ship(px.sparkSession)
    whole = {c: "long" if c == "k" else "boolean" if c == "covered" else "int" for c in ("k", "covered", "dispose", "blend", *"rgba")}
    frame = F.struct(*[F.col(c).cast(kind).alias(c) for c, kind in whole.items()])
    ordered = px.groupBy(*keys).agg(F.array_sort(F.collect_list(frame)).alias("frames"))
    kinds = {f.name: f.dataType.simpleString() for f in px.schema.fields if f.name in keys}
    names = [*keys, "k", *"rgba"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keys))
            sizes = pc.list_value_length(lists).to_numpy()
            flat, starts = lists.flatten(), np.cumsum(sizes) - sizes
            k, covered, dispose, blend, *color = (pc.fill_null(flat.field(i), False if i == 1 else 0).to_numpy(zero_copy_only=False) for i in range(len(whole)))
            above, out = np.stack(color, 1).astype(np.uint8), np.zeros((len(k), 4), np.uint8)
            canvas, back, settle = np.zeros((len(sizes), 4), np.uint8), np.zeros((len(sizes), 4), np.uint8), np.zeros(len(sizes), bool)
            for step in range(int(sizes.max(initial=0))):
                live = np.flatnonzero(sizes > step)
                at = starts[live] + step
                before = np.where(settle[live, None], back[live], canvas[live])
                drawn = np.where(blend[at, None] == 0, above[at], codec.blend_over(before, above[at]))
                canvas[live] = out[at] = np.where(covered[at, None], drawn, before)
                settle[live] = covered[at] & (dispose[at] != 0)
                back[live] = np.where((dispose[at, None] == 1) | (k[at, None] == 0), 0, before)
            row = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            columns = [*(batch.column(i).take(row) for i in range(len(keys))), pa.array(k), *(pa.array(out[:, i].astype(np.int32)) for i in range(4))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keys), "k long", *(f"{c} int" for c in "rgba")])
    return ordered.select(*keys, "frames").mapInArrow(run, schema)


def changed_areas(px: DataFrame, keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """px has keys, k, x, y, v: the box around what differs from the frame before, null where nothing does. Each pixel
    meets its own past only, so no frame is joined with another."""
    past = F.lag("v").over(Window.partitionBy(*keys, "x", "y").orderBy("k"))
    differs = ~F.col("v").eqNullSafe(F.col("before"))
    compared = px.withColumn("before", past).where("k > 0")
    side = lambda f, at: f(F.when(differs, F.col(at)))
    return compared.groupBy(*keys, "k").agg(side(F.min, "x").alias("left"), side(F.min, "y").alias("top"), side(F.max, "x").alias("right"), side(F.max, "y").alias("bottom"))


def cropped(controls: DataFrame, areas: DataFrame, width: int, height: int) -> DataFrame:
    """controls has file_id, k, dispose, blend of frames that cover the canvas: the area that each writes. A frame over
    an unchanged canvas writes only what differs, one pixel if nothing does."""
    window = Window.partitionBy("file_id").orderBy("k")
    plain = (F.lag("blend").over(window) == 0) & (F.lag("dispose").over(window) == 0) & (F.col("blend") == 0) & (F.col("dispose") != 1)
    both = controls.withColumn("plain", F.coalesce(plain, F.lit(False))).join(areas, ["file_id", "k"], "left")
    w, h = F.col("right") - F.col("left") + 1, F.col("bottom") - F.col("top") + 1
    pick = lambda changed, none, whole: F.when(~F.col("plain"), whole).when(F.col("left").isNull(), none).otherwise(changed).cast("long")
    return both.select("file_id", "k", pick(F.col("left"), 0, 0).alias("x"), pick(F.col("top"), 0, 0).alias("y"), pick(w, 1, width).alias("w"), pick(h, 1, height).alias("h"))
