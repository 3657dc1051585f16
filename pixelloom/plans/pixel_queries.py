"""Queries over pixels: filters, interlacing, conversion, palettes, checksums; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import adam7, filters, palettes
from .rasters import COLORS, FRAMES, GRAY, colors, frames, gray, table

_NEIGHBOURS = """near AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY {i}, y ORDER BY x), 0) AS c FROM (
SELECT *, coalesce(lag(v) OVER (PARTITION BY {i}, y ORDER BY x), 0) AS a, coalesce(lag(v) OVER (PARTITION BY {i}, x ORDER BY y), 0) AS b FROM {t}))"""
_GUESS = """CASE kind WHEN 0 THEN 0 WHEN 1 THEN a WHEN 2 THEN b WHEN 3 THEN (a + b) // 2 ELSE
CASE WHEN abs(b - c) <= abs(a - c) AND abs(b - c) <= abs(a + b - 2 * c) THEN a WHEN abs(a - c) <= abs(a + b - 2 * c) THEN b ELSE c END END"""
_BYTES = "bytes AS (SELECT *, ((v - {g}) % 256 + 256) % 256 AS byte FROM near, (SELECT unnest(range(5)) AS kind))".format(g=_GUESS)
_COST = "sum(CASE WHEN byte > 127 THEN 256 - byte ELSE byte END)"


def _filter_sql(image: str, source: str) -> str:
    return _NEIGHBOURS.format(i=image, t=source) + ", " + _BYTES


def q_filter_msad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which filter the adaptive choice takes for each scanline, and at what cost."""
    return filters.chosen(gray(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n_rows"), F.sum("cost").alias("total_cost"))


SQL_FILTER_MSAD = f"""WITH {GRAY}, {_filter_sql("img", "gray")}, costs AS (SELECT img, y, kind, {_COST} AS cost FROM bytes GROUP BY ALL)
SELECT kind, count(*) AS n_rows, CAST(sum(cost) AS BIGINT) AS total_cost FROM (
SELECT *, row_number() OVER (PARTITION BY img, y ORDER BY cost, kind) AS n FROM costs) WHERE n = 1 GROUP BY kind"""


def q_filter_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every byte under every filter, summed by image and filter with a weight for its place."""
    place = F.col("y") * 8 + F.col("x") + 1
    sums = [F.struct(F.lit(kind).alias("kind"), F.sum(name).alias("total"), F.sum(F.col(name) * place).alias("weighted")) for kind, name in enumerate(filters.BYTES)]
    return filters.five_bytes(gray(spark, sf_dir)).groupBy("img").agg(F.array(*sums).alias("sums")).select("img", F.inline("sums"))


SQL_FILTER_BYTES = f"""WITH {GRAY}, {_filter_sql("img", "gray")}
SELECT img, kind, CAST(sum(byte) AS BIGINT) AS total, CAST(sum(byte * (y * 8 + x + 1)) AS BIGINT) AS weighted FROM bytes GROUP BY img, kind"""


def q_unfilter_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows filtered by type y mod 5, then reconstructed: the raster again."""
    mixed = filters.filtered(gray(spark, sf_dir), F.col("y") % 5)
    rows = mixed.groupBy("img", "y", "kind").agg(F.array_sort(F.collect_list(F.struct("x", "byte"))).alias("o")).select("img", "y", "kind", F.col("o.byte").alias("bytes"))
    return filters.reconstructed(rows)


SQL_UNFILTER_FOLD = f"WITH {GRAY} SELECT img, y, x, v FROM gray"


def q_adam7_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = gray(spark, sf_dir).withColumns({"width": F.lit(8), "height": F.lit(8)})
    return adam7.in_file_order(sized).select("img", "at", "pass", "px", "py", "x", "y", "v")


_PASS = """CASE WHEN x % 8 = 0 AND y % 8 = 0 THEN 1 WHEN x % 8 = 4 AND y % 8 = 0 THEN 2 WHEN x % 4 = 0 AND y % 8 = 4 THEN 3 WHEN x % 4 = 2 AND y % 4 = 0 THEN 4
WHEN x % 2 = 0 AND y % 4 = 2 THEN 5 WHEN x % 2 = 1 AND y % 2 = 0 THEN 6 ELSE 7 END"""
_GRID = "grid(pass, x0, y0, dx, dy) AS (VALUES (1, 0, 0, 8, 8), (2, 4, 0, 8, 8), (3, 0, 4, 4, 8), (4, 2, 0, 4, 4), (5, 0, 2, 2, 4), (6, 1, 0, 2, 2), (7, 0, 1, 1, 2))"
_LACED = f"laced AS (SELECT p.*, (x - x0) // dx AS px, (y - y0) // dy AS py FROM (SELECT *, {_PASS} AS pass FROM gray) p JOIN grid USING (pass))"
SQL_ADAM7_ORDER = f"""WITH {GRAY}, {_GRID}, {_LACED}
SELECT img, row_number() OVER (PARTITION BY img ORDER BY pass, py, px) - 1 AS at, pass, px, py, x, y, v FROM laced"""


def q_adam7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places scattered back from passes."""
    return adam7.deinterlaced(adam7.interlaced(gray(spark, sf_dir)).drop("x", "y")).select("img", "x", "y", "v")


SQL_ADAM7_ROUND_TRIP = f"WITH {GRAY} SELECT img, x, y, v FROM gray"


def q_adam7_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("width"), F.expr("p_partkey % 23 + 1").alias("height")).distinct()
    return adam7.pass_sizes(sizes)


SQL_ADAM7_SIZES = f"""WITH {_GRID}, sizes AS (SELECT DISTINCT CAST(p_size AS BIGINT) AS width, p_partkey % 23 + 1 AS height FROM part)
SELECT width, height, pass, greatest(0, CAST(ceil((width - x0) / dx) AS BIGINT)) AS pass_width, greatest(0, CAST(ceil((height - y0) / dy) AS BIGINT)) AS pass_height FROM sizes, grid"""


def q_adam7_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive choice within passes: the first row of each has nothing above it."""
    laced = adam7.interlaced(gray(spark, sf_dir)).select("img", "pass", F.col("px").alias("x"), F.col("py").alias("y"), "v")
    return filters.chosen(laced, ("img", "pass")).groupBy("pass", "kind").agg(F.count("*").alias("n_rows"), F.sum("cost").alias("total_cost"))


SQL_ADAM7_FILTER = f"""WITH {GRAY}, {_GRID}, {_LACED}, inner_px AS (SELECT img, pass, px AS x, py AS y, v FROM laced),
{_filter_sql("img, pass", "inner_px")}, costs AS (SELECT img, pass, y, kind, {_COST} AS cost FROM bytes GROUP BY ALL)
SELECT pass, kind, count(*) AS n_rows, CAST(sum(cost) AS BIGINT) AS total_cost FROM (
SELECT *, row_number() OVER (PARTITION BY img, pass, y ORDER BY cost, kind) AS n FROM costs) WHERE n = 1 GROUP BY pass, kind"""


def q_header_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes that follow from headers."""
    types = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("img"), F.col("p_size").cast("long").alias("width"), F.expr("p_partkey % 31 + 1").alias("height"), F.expr("cast(element_at(array(0,2,3,4,6), cast(p_partkey % 5 + 1 as int)) as int)").alias("color_type"))
    depth = F.when(F.col("color_type").isin(0, 3), F.expr("cast(element_at(array(1,2,4,8), cast(p_partkey % 4 + 1 as int)) as int)".replace("p_partkey", "img"))).otherwise(F.expr("cast(8 + 8 * (img % 2) as int)"))
    sized = types.withColumn("bit_depth", depth).withColumn("bits", X.channels(F.col("color_type")) * F.col("bit_depth"))
    stride = X.row_bytes(F.col("width"), F.col("bits"))
    return sized.select("img", "bits", stride.alias("stride"), (stride * F.col("height")).alias("image_size"), ((stride + 1) * F.col("height")).alias("scanline_size"), X.filter_bpp(F.col("bits")).alias("filter_bpp"))


SQL_HEADER_SIZES = """WITH t AS (SELECT p_partkey AS img, CAST(p_size AS BIGINT) AS width, p_partkey % 31 + 1 AS height, [0, 2, 3, 4, 6][p_partkey % 5 + 1] AS color_type FROM part),
d AS (SELECT *, CASE color_type WHEN 0 THEN 1 WHEN 3 THEN 1 WHEN 2 THEN 3 WHEN 4 THEN 2 ELSE 4 END * CASE WHEN color_type IN (0, 3) THEN [1, 2, 4, 8][img % 4 + 1] ELSE CAST(8 + 8 * (img % 2) AS INT) END AS bits FROM t),
s AS (SELECT *, (width * bits + 7) // 8 AS stride FROM d)
SELECT img, bits, stride, stride * height AS image_size, (stride + 1) * height AS scanline_size, CAST((bits + 7) // 8 AS INT) AS filter_bpp FROM s"""


def _depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    depths = gray(spark, sf_dir).withColumn("depth", F.explode(F.array(*map(F.lit, (1, 2, 4, 8, 16)))))
    coarse = F.when(F.col("depth") == 16, F.col("v") * 256 + F.col("x") * 8 + F.col("y")).otherwise(F.expr("shiftright(v, 8 - depth)"))
    return depths.withColumn("s", coarse.cast("int"))


def q_scale_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of every depth as 8 bits."""
    return _depths(spark, sf_dir).groupBy("img", "depth", "y").agg(F.sum(X.scale_to_8(F.col("s"), F.col("depth"))).alias("total"))


_DEPTHS = """depths AS (SELECT g.*, depth, CASE WHEN depth = 16 THEN v * 256 + x * 8 + y ELSE v >> (8 - depth) END AS s FROM gray g, (SELECT unnest([1, 2, 4, 8, 16]) AS depth))"""
SQL_SCALE_DEPTHS = f"""WITH {GRAY}, {_DEPTHS}
SELECT img, depth, y, CAST(sum(CASE depth WHEN 16 THEN s >> 8 WHEN 8 THEN s ELSE s * 255 // ((1 << depth) - 1) END) AS BIGINT) AS total FROM depths GROUP BY img, depth, y"""


def q_unpack_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples packed into rows of bytes, and read out of them again."""
    per = F.expr("case when depth = 16 then 1 else 8 div depth end")
    part = F.when(F.col("depth") == 16, F.lpad(F.hex("s"), 4, "0"))
    whole = _depths(spark, sf_dir).withColumn("per", per)
    wide = whole.where("depth = 16").select("img", "depth", "y", F.col("x").alias("at"), part.alias("code"))
    bits = F.expr("shiftleft(s, 8 - depth * (x % per + 1))")
    narrow = whole.where("depth < 16").groupBy("img", "depth", "y", F.expr("x div per").cast("int").alias("at")).agg(F.lpad(F.hex(F.sum(bits)), 2, "0").alias("code"))
    rows = wide.union(narrow).groupBy("img", "depth", "y").agg(F.array_sort(F.collect_list(F.struct("at", "code"))).alias("o"))
    packed = rows.select("img", "depth", "y", F.unhex(F.array_join("o.code", "")).alias("row"))
    read = packed.select("img", "depth", "y", "row", F.explode(F.array(*map(F.lit, range(8)))).alias("x"))
    return read.select("img", "depth", "y", "x", X.sample_at(F.col("row"), F.col("x"), F.col("depth")).alias("s"))


SQL_UNPACK_SAMPLES = f"WITH {GRAY}, {_DEPTHS} SELECT img, depth, y, x, s FROM depths"


def _rgba(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = gray(spark, sf_dir).select(F.lit("gray").alias("source"), "img", F.expr("y * 8 + x").cast("long").alias("pos"), *[F.col("v").alias(c) for c in "rgb"], F.lit(255).alias("a"))
    return one.unionByName(colors(spark, sf_dir).select(F.lit("colors").alias("source"), "img", F.col("pos").cast("long").alias("pos"), *"rgba"))


_RGBA = "rgba AS (SELECT 'gray' AS source, img, y * 8 + x AS pos, v AS r, v AS g, v AS b, 255 AS a FROM gray UNION ALL SELECT 'colors', img, pos, r, g, b, a FROM colors)"


def _digest(channels: str) -> list:
    """Order-bound sums of each channel."""
    return [F.sum(F.col(c) * (F.col("pos") % 251 + 1)).alias(f"sum_{c}") for c in channels]


def _digest_sql(channels: str) -> str:
    return ", ".join(f"CAST(sum({c} * (pos % 251 + 1)) AS BIGINT) AS sum_{c}" for c in channels)


def q_to_rgba8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rgba(spark, sf_dir).groupBy("source", "img").agg(F.count("*").alias("n"), *_digest("rgba"))


def q_to_rgb8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without opacity."""
    return _rgba(spark, sf_dir).groupBy("source", "img").agg(F.count("*").alias("n"), *_digest("rgb"))


SQL_TO_RGBA8 = f"WITH {GRAY}, {COLORS}, {_RGBA} SELECT source, img, count(*) AS n, {_digest_sql('rgba')} FROM rgba GROUP BY source, img"
SQL_TO_RGB8 = f"WITH {GRAY}, {COLORS}, {_RGBA} SELECT source, img, count(*) AS n, {_digest_sql('rgb')} FROM rgba GROUP BY source, img"


def q_color_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pixel's color as the key: what equals it is transparent."""
    px = colors(spark, sf_dir).drop("a")
    keys = px.where("pos = 0").select("img", F.col("r").alias("kr"), F.col("g").alias("kg"), F.col("b").alias("kb"))
    return palettes.keyed(px, keys).groupBy("img", "a").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


SQL_COLOR_KEY = f"""WITH {COLORS}, k AS (SELECT img, r AS kr, g AS kg, b AS kb FROM colors WHERE pos = 0),
p AS (SELECT img, pos, CASE WHEN r = kr AND g = kg AND b = kb THEN 0 ELSE 255 END AS a FROM colors JOIN k USING (img))
SELECT img, a, count(*) AS n, min(pos) AS first FROM p GROUP BY img, a"""

_REDUCED = """found AS (SELECT img, r, g, b, a, min(pos) AS first FROM colors GROUP BY img, r, g, b, a), counted AS (SELECT img, count(*) AS n FROM found GROUP BY img),
pal AS (SELECT img, row_number() OVER (PARTITION BY img ORDER BY a = 255, first) - 1 AS idx, r, g, b, a,
CASE WHEN n <= 2 THEN 1 WHEN n <= 4 THEN 2 WHEN n <= 16 THEN 4 ELSE 8 END AS depth FROM found JOIN counted USING (img) WHERE n <= 256)"""


def q_palettize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return palettes.reduced(colors(spark, sf_dir))


SQL_PALETTIZE = f"WITH {COLORS}, {_REDUCED} SELECT img, idx, r, g, b, a, depth FROM pal"


def q_palettize_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return palettes.rejected(colors(spark, sf_dir))


SQL_PALETTIZE_REJECT = f"WITH {COLORS}, {_REDUCED} SELECT img, n AS n_colors FROM counted WHERE n > 256"


def q_palettize_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alphas that a reduced image's tRNS lists: those of the leading translucent entries."""
    listed = palettes.reduced(colors(spark, sf_dir)).where("a < 255").groupBy("img").agg(F.array_sort(F.collect_list(F.struct("idx", "a"))).alias("o"))
    return listed.select("img", F.array_join(F.transform("o", lambda e: e["a"].cast("string")), " ").alias("alphas"))


SQL_PALETTIZE_ALPHA = f"WITH {COLORS}, {_REDUCED} SELECT img, string_agg(CAST(a AS VARCHAR), ' ' ORDER BY idx) AS alphas FROM pal WHERE a < 255 GROUP BY img"


def q_palette_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels as indices, packed into rows of 13 pixels."""
    px = colors(spark, sf_dir)
    return palettes.packed(palettes.indexed(px, palettes.reduced(px)), 13)


SQL_PALETTE_PACK = f"""WITH {COLORS}, {_REDUCED}, ind AS (SELECT img, pos // 13 AS y, pos % 13 AS x, idx, depth, 8 // depth AS per FROM colors JOIN pal USING (img, r, g, b, a))
SELECT img, y, x // per AS at, CAST(sum(idx << (8 - depth * (x % per + 1))) AS INT) AS byte FROM ind GROUP BY img, y, x // per"""


def q_palettize_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One palette for all frames of an animation."""
    px = frames(spark, sf_dir).select(F.col("u").alias("img"), F.col("k").alias("pos"), *[F.col("v").alias(c) for c in "rgb"], F.col("al").alias("a"))
    return palettes.reduced(px)


SQL_PALETTIZE_SHARED = f"WITH {FRAMES}, colors AS (SELECT u AS img, k AS pos, v AS r, v AS g, v AS b, al AS a FROM frames), {_REDUCED} SELECT img, idx, r, g, b, a, depth FROM pal"


def _palette(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Palettes of 64 + img % 128 entries, alphas for the first img % 40 of them."""
    images = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img"))
    entry = images.select("img", F.explode(F.expr("sequence(0, cast(63 + img % 128 as int))")).alias("idx"))
    palette = entry.select("img", "idx", *[F.expr(f"cast((idx * {m} + img) % 256 as int)").alias(c) for c, m in zip("rgb", (71, 113, 157))])
    return palette, entry.where("idx < img % 40").select("img", "idx", F.expr("cast(idx * 5 % 255 as int)").alias("a"))


_PALETTE = """entry AS (SELECT vec_id AS img, unnest(range(64 + vec_id % 128)) AS idx FROM embeddings),
pal AS (SELECT img, idx, (idx * 71 + img) % 256 AS r, (idx * 113 + img) % 256 AS g, (idx * 157 + img) % 256 AS b, CASE WHEN idx < img % 40 THEN idx * 5 % 255 ELSE 255 END AS a FROM entry),
ind AS (SELECT img, y * 8 + x AS pos, v AS idx FROM gray)"""


def _indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gray(spark, sf_dir).select("img", F.expr("cast(y * 8 + x as long)").alias("pos"), F.col("v").alias("idx"))


def q_palette_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices as colors, with opacity from a shorter list; what the palette lacks is counted."""
    palette, alphas = _palette(spark, sf_dir)
    found = palettes.looked_up(_indices(spark, sf_dir), palettes.with_alpha(palette, alphas))
    return found.groupBy("img").agg(F.sum(F.col("r").isNull().cast("int")).alias("missing"), *_digest("rgba"))


SQL_PALETTE_LOOKUP = f"""WITH {GRAY}, {_PALETTE} SELECT img, CAST(sum(CAST(r IS NULL AS INT)) AS BIGINT) AS missing, {_digest_sql("rgba")}
FROM ind LEFT JOIN pal USING (img, idx) GROUP BY img"""


def q_palette_oob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PaletteIndexOutOfRange: the first offending index of each image."""
    entries = _palette(spark, sf_dir)[0].groupBy("img").agg(F.count("*").alias("entries"))
    return palettes.first_out_of_range(_indices(spark, sf_dir), entries)


SQL_PALETTE_OOB = f"""WITH {GRAY}, {_PALETTE}, size AS (SELECT img, count(*) AS entries FROM pal GROUP BY img)
SELECT img, arg_min(idx, pos) AS index, any_value(entries) AS entries FROM ind JOIN size USING (img) WHERE idx >= entries GROUP BY img"""


def q_adler32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sums in closed form: aggregates that combine, so partial ones travel."""
    n = F.lit(64)
    at = F.expr("cast(y * 8 + x as long)")
    sums = gray(spark, sf_dir).groupBy("img").agg(F.sum("v").alias("s"), F.sum((n - at) * F.col("v")).alias("w"))
    low, high = F.pmod(1 + F.col("s"), F.lit(65521)), F.pmod(n + F.col("w"), F.lit(65521))
    return sums.select("img", (F.shiftleft(high, 16) + low).alias("adler"))


SQL_ADLER32 = f"""WITH {GRAY} SELECT img, CAST((64 + sum((64 - (y * 8 + x)) * v)) % 65521 * 65536 + (1 + sum(v)) % 65521 AS BIGINT) AS adler FROM gray GROUP BY img"""


def q_zlib_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two bytes of a stream by level and strategy, checked by their remainder."""
    levels = table(spark, sf_dir, "part").select(F.expr("p_size % 10").alias("level"), F.expr("p_partkey % 2 = 0").alias("dynamic")).distinct()
    head = X.zlib_head(F.col("level"), F.col("dynamic"))
    return levels.select("level", "dynamic", head.alias("head"), (head % 31).alias("rest"))


SQL_ZLIB_HEADER = """WITH l AS (SELECT DISTINCT p_size % 10 AS level, p_partkey % 2 = 0 AS dynamic FROM part),
h AS (SELECT *, 30720 + 64 * CASE WHEN NOT dynamic OR level < 2 THEN 0 WHEN level < 6 THEN 1 WHEN level = 6 THEN 2 ELSE 3 END AS h FROM l)
SELECT level, dynamic, CAST(h + (31 - h % 31) % 31 AS INT) AS head, 0 AS rest FROM h"""
