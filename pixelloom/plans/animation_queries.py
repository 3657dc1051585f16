"""Queries over animations: layout, rules, rendering, cropping; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import animation as A
from .rasters import FRAMES, frames, table

CANVAS = 8


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Animations as chunk rows, some of them damaged: a control, then a frame control and data for every event."""
    rows = frames(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("u")))
    seq, size = F.when(F.col("k") == 0, 0).otherwise(2 * F.col("k") - 1), F.lit(CANVAS).cast("long")
    common = [F.col("u").alias("file_id")]
    control = rows.where("k = 0 and u % 13 <> 0").select(
        *common, F.explode(F.when(F.col("u") % 17 == 0, F.expr("array(-2L, -1L)")).otherwise(F.expr("array(-1L)"))).alias("ord"), F.lit("acTL").alias("type"),
        F.lit(None).cast("long").alias("seq"), (F.col("n") + (F.col("u") % 11 == 0).cast("int")).alias("frames"), F.lit(8).alias("length"), *[F.lit(None).cast("long").alias(c) for c in ("w", "h", "fx", "fy")],
    )
    place = F.when(F.col("k") == 0, 0).otherwise(F.col("event_id") % 3).cast("long")
    w = F.when(F.col("event_id") % 839 == 3, size + 1).when(F.col("k") == 0, size).otherwise(size - 2)
    frame = rows.select(
        *common, (2 * F.col("k")).cast("long").alias("ord"), F.lit("fcTL"), (seq + (F.col("event_id") % 997 == 5).cast("int")).cast("long").alias("seq"), F.lit(None).cast("long"), F.lit(26), w,
        F.when(F.col("k") == 0, size).otherwise(size - 2), place, place,
    )
    data = rows.where("event_id % 887 <> 7").select(
        *common, (2 * F.col("k") + 1).cast("long"), F.when(F.col("k") == 0, "IDAT").otherwise("fdAT"), F.when(F.col("k") > 0, 2 * F.col("k")).cast("long"), F.lit(None).cast("long"),
        F.when(F.col("event_id") % 797 == 11, 3).otherwise(20), *[F.lit(None).cast("long")] * 4,
    )
    return control.union(frame).union(data)


_CHUNKS = f"""n AS (SELECT *, count(*) OVER (PARTITION BY u) AS n FROM frames), chunks AS (
SELECT u AS file_id, unnest(CASE WHEN u % 17 = 0 THEN [-2, -1] ELSE [-1] END) AS ord, 'acTL' AS type, NULL AS seq, n + CAST(u % 11 = 0 AS INT) AS frames, 8 AS length, NULL AS w, NULL AS h, NULL AS fx, NULL AS fy FROM n WHERE k = 0 AND u % 13 <> 0
UNION ALL SELECT u, 2 * k, 'fcTL', CASE WHEN k = 0 THEN 0 ELSE 2 * k - 1 END + CAST(event_id % 997 = 5 AS INT), NULL, 26, CASE WHEN event_id % 839 = 3 THEN {CANVAS + 1} WHEN k = 0 THEN {CANVAS} ELSE {CANVAS - 2} END,
CASE WHEN k = 0 THEN {CANVAS} ELSE {CANVAS - 2} END, CASE WHEN k = 0 THEN 0 ELSE event_id % 3 END, CASE WHEN k = 0 THEN 0 ELSE event_id % 3 END FROM n
UNION ALL SELECT u, 2 * k + 1, CASE WHEN k = 0 THEN 'IDAT' ELSE 'fdAT' END, CASE WHEN k > 0 THEN 2 * k END, NULL, CASE WHEN event_id % 797 = 11 THEN 3 ELSE 20 END, NULL, NULL, NULL, NULL FROM n WHERE event_id % 887 <> 7)"""


def q_anim_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which frame each piece of data belongs to."""
    return A.laid_out(_chunks(spark, sf_dir)).groupBy("file_id", "frame").agg(F.count("*").alias("pieces"), F.sum("length").alias("bytes"))


SQL_ANIM_LAYOUT = f"""WITH {FRAMES}, {_CHUNKS}, f AS (SELECT *, sum(CAST(type = 'fcTL' AS INT)) OVER (PARTITION BY file_id ORDER BY ord) - 1 AS frame FROM chunks)
SELECT file_id, CAST(frame AS BIGINT) AS frame, count(*) AS pieces, CAST(sum(length) AS BIGINT) AS bytes FROM f WHERE type IN ('IDAT', 'fdAT') AND frame >= 0 GROUP BY file_id, frame"""


def q_anim_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    canvas = chunks.select("file_id").distinct().select("file_id", F.lit(CANVAS).alias("width"), F.lit(CANVAS).alias("height"))
    return A.first_errors(chunks, canvas)


SQL_ANIM_ERRORS = f"""WITH RECURSIVE {FRAMES}, {_CHUNKS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ord) AS i FROM chunks),
walk(file_id, i, ctl, img, nxt, started, still, filled, outcome) AS (SELECT DISTINCT file_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), 0, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0, 0, CAST(NULL AS VARCHAR) FROM numbered UNION ALL
SELECT w.file_id, c.i, CASE WHEN c.type = 'acTL' THEN c.frames ELSE w.ctl END, CASE WHEN c.type = 'IDAT' THEN 1 ELSE w.img END, w.nxt + CAST(c.type IN ('fcTL', 'fdAT') AS INT),
w.started + CAST(c.type = 'fcTL' AS INT), CASE WHEN c.type = 'fcTL' THEN 1 - w.img ELSE w.still END,
CASE WHEN c.type = 'fcTL' THEN 0 WHEN c.type = 'fdAT' OR (c.type = 'IDAT' AND w.still = 1) THEN 1 ELSE w.filled END,
CASE WHEN c.type = 'acTL' AND w.img = 1 THEN 'MisplacedChunk' WHEN c.type = 'acTL' AND w.ctl IS NOT NULL THEN 'DuplicateChunk' WHEN c.type = 'acTL' AND c.frames = 0 THEN 'InvalidChunkData'
WHEN c.type = 'fcTL' AND c.seq <> w.nxt THEN 'FrameSequenceMismatch' WHEN c.type = 'fcTL' AND w.img = 0 AND w.started > 0 THEN 'MisplacedChunk'
WHEN c.type = 'fcTL' AND w.img = 0 AND NOT (c.fx = 0 AND c.fy = 0 AND c.w = {CANVAS} AND c.h = {CANVAS}) THEN 'InvalidChunkData'
WHEN c.type = 'fcTL' AND (c.fx + c.w > {CANVAS} OR c.fy + c.h > {CANVAS}) THEN 'FrameOutOfBounds' WHEN c.type = 'fcTL' AND w.started > 0 AND w.filled = 0 THEN 'MissingFrameData'
WHEN c.type = 'fdAT' AND (w.started = 0 OR w.still = 1) THEN 'MisplacedChunk' WHEN c.type = 'fdAT' AND c.length < 4 THEN 'InvalidChunkLength' WHEN c.type = 'fdAT' AND c.seq <> w.nxt THEN 'FrameSequenceMismatch' END
FROM walk w JOIN numbered c ON c.file_id = w.file_id AND c.i = w.i + 1 WHERE w.outcome IS NULL)
SELECT file_id, coalesce(outcome, CASE WHEN ctl IS NULL THEN 'NotAnimated' WHEN started > 0 AND filled = 0 THEN 'MissingFrameData' WHEN started <> ctl THEN 'FrameCountMismatch' ELSE 'OK' END) AS outcome
FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY i DESC) AS last FROM walk) WHERE last = 1"""


def q_frame_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether frames fit on and cover a canvas, and how long they show."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", "event_id % 5 as x", "event_id % 7 as y", "event_id % 9 + 1 as w", "event_id % 6 + 3 as h", "event_id % 7 as num", "event_id % 3 * 50 as den")
    fits = (F.col("x") + F.col("w") <= CANVAS) & (F.col("y") + F.col("h") <= CANVAS)
    covers = (F.col("x") == 0) & (F.col("y") == 0) & (F.col("w") == CANVAS) & (F.col("h") == CANVAS)
    return e.select("event_id", fits.alias("fits"), covers.alias("covers"), X.delay_seconds(F.col("num"), F.col("den")).alias("seconds"))


SQL_FRAME_CONTROL = f"""WITH e AS (SELECT event_id, event_id % 5 AS x, event_id % 7 AS y, event_id % 9 + 1 AS w, event_id % 6 + 3 AS h, event_id % 7 AS num, event_id % 3 * 50 AS den FROM events)
SELECT event_id, x + w <= {CANVAS} AND y + h <= {CANVAS} AS fits, x = 0 AND y = 0 AND w = {CANVAS} AND h = {CANVAS} AS covers, num / CASE WHEN den = 0 THEN 100 ELSE den END AS seconds FROM e"""


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames over a canvas of 2x2, each covering it from column event_id % 3 - 1 on."""
    at = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in (0, 1) for x in (0, 1)])).alias("at")
    px = frames(spark, sf_dir).select("*", at).select("u", "k", "event_id", "at.y", "at.x", "v", "al", "dop", "bop")
    value = F.expr("(v + 7 * x + 13 * y) % 256")
    return px.select(
        F.col("u").alias("file_id"), "y", "x", "k", (F.col("x") >= F.col("event_id") % 3 - 1).alias("covered"), F.col("dop").alias("dispose"), F.col("bop").alias("blend"),
        value.alias("r"), F.expr("(v * 3 + y) % 256").alias("g"), F.expr("(255 - v + x) % 256").alias("b"), F.col("al").alias("a"),
    )


def q_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame as it is shown, with all ways of disposing and blending."""
    return A.rendered(_pixels(spark, sf_dir), ("file_id", "y", "x"))


_MIX = "CAST(({c} * (sa * 255) + {d} * (da * (255 - sa)) + (sa * 255 + da * (255 - sa)) // 2) // (sa * 255 + da * (255 - sa)) AS INT)"


def _shown(c: str) -> str:
    """A channel after blending, from base colors dr, dg, db, da."""
    mixed = "CAST((sa * 255 + da * (255 - sa) + 127) // 255 AS INT)" if c == "a" else _MIX.format(c=f"s{c}", d=f"d{c}")
    return f"CASE WHEN NOT covered THEN d{c} WHEN blend = 0 OR sa = 255 THEN s{c} WHEN sa = 0 THEN d{c} ELSE {mixed} END"


SQL_COMPOSITE = f"""WITH RECURSIVE {FRAMES}, px AS (SELECT u AS file_id, y, x, k, x >= event_id % 3 - 1 AS covered, dop AS dispose, bop AS blend, (v + 7 * x + 13 * y) % 256 AS sr, (v * 3 + y) % 256 AS sg, (255 - v + x) % 256 AS sb, al AS sa
FROM frames, (SELECT unnest([0, 1]) AS y), (SELECT unnest([0, 1]) AS x)),
walk(file_id, y, x, k, r, g, b, a, br, bg, bb, ba) AS (SELECT DISTINCT file_id, y, x, CAST(-1 AS BIGINT), 0, 0, 0, 0, CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS INT) FROM px UNION ALL
SELECT file_id, y, x, k, {", ".join(_shown(c) for c in "rgba")}, {", ".join(f"CASE WHEN NOT covered OR dispose = 0 THEN NULL WHEN dispose = 1 OR k = 0 THEN 0 ELSE d{c} END" for c in "rgba")}
FROM (SELECT p.*, {", ".join(f"coalesce(w.b{c}, w.{c}) AS d{c}" for c in "rgba")} FROM walk w JOIN px p ON p.file_id = w.file_id AND p.y = w.y AND p.x = w.x AND p.k = w.k + 1))
SELECT file_id, y, x, k, r, g, b, a FROM walk WHERE k >= 0"""


def _gray_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 6x4 gray pixels that change little from one to the next."""
    at = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in range(4) for x in range(6)])).alias("at")
    px = frames(spark, sf_dir).select("*", at).select("u", "k", "event_id", "at.y", "at.x", "v")
    return px.select(F.col("u").alias("file_id"), "k", "x", "y", F.expr("case when x = v % 6 and y >= v % 4 and v % 5 > 0 then v div 32 else 0 end").alias("v"))


_GRAY_FRAMES = """px AS (SELECT u AS file_id, k, x, y, CASE WHEN x = v % 6 AND y >= v % 4 AND v % 5 > 0 THEN v // 32 ELSE 0 END AS v FROM frames, (SELECT unnest(range(4)) AS y), (SELECT unnest(range(6)) AS x)),
areas AS (SELECT p.file_id, p.k, min(CASE WHEN p.v <> q.v THEN p.x END) AS "left", min(CASE WHEN p.v <> q.v THEN p.y END) AS top, max(CASE WHEN p.v <> q.v THEN p.x END) AS "right", max(CASE WHEN p.v <> q.v THEN p.y END) AS bottom
FROM px p JOIN px q ON p.file_id = q.file_id AND p.x = q.x AND p.y = q.y AND p.k = q.k + 1 GROUP BY p.file_id, p.k)"""


def q_crop_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.changed_areas(_gray_frames(spark, sf_dir)).select("file_id", "k", *[F.col(c).cast("long").alias(c) for c in ("left", "top", "right", "bottom")])


SQL_CROP_BBOX = f"""WITH {FRAMES}, {_GRAY_FRAMES} SELECT file_id, k, CAST("left" AS BIGINT) AS "left", CAST(top AS BIGINT) AS top, CAST("right" AS BIGINT) AS "right", CAST(bottom AS BIGINT) AS bottom FROM areas"""


def q_crop_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each frame writes when only changes are kept."""
    controls = frames(spark, sf_dir).select(F.col("u").alias("file_id"), "k", F.expr("case when event_id % 4 = 0 then dop else 0 end").alias("dispose"), F.expr("case when event_id % 8 = 1 then 1 else 0 end").alias("blend"))
    return A.cropped(controls, A.changed_areas(_gray_frames(spark, sf_dir)), 6, 4)


SQL_CROP_FRAMES = f"""WITH {FRAMES}, {_GRAY_FRAMES}, c AS (SELECT u AS file_id, k, CASE WHEN event_id % 4 = 0 THEN dop ELSE 0 END AS dispose, CASE WHEN event_id % 8 = 1 THEN 1 ELSE 0 END AS blend FROM frames),
p AS (SELECT c.*, coalesce(d.blend = 0 AND d.dispose = 0 AND c.blend = 0 AND c.dispose <> 1, false) AS plain FROM c LEFT JOIN c d ON d.file_id = c.file_id AND d.k = c.k - 1)
SELECT p.file_id, p.k, CAST(CASE WHEN NOT plain THEN 0 ELSE coalesce("left", 0) END AS BIGINT) AS x, CAST(CASE WHEN NOT plain THEN 0 ELSE coalesce(top, 0) END AS BIGINT) AS y,
CAST(CASE WHEN NOT plain THEN 6 ELSE coalesce("right" - "left" + 1, 1) END AS BIGINT) AS w, CAST(CASE WHEN NOT plain THEN 4 ELSE coalesce(bottom - top + 1, 1) END AS BIGINT) AS h
FROM p LEFT JOIN areas USING (file_id, k)"""
