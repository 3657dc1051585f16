"""Images derived from the driver's tables, each as a DataFrame and as the same table in DuckDB's SQL.

gray: 8x8 gray pixels from embeddings. colors: RGBA pixels from lineitem. frames: animation frames of one pixel from
events. stream: chunk sequences from conversations. Payloads come from MD5 digests, as both engines know them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The chunk type that each first hex digit of a digest stands for.
STREAM_TYPES = "IDAT IDAT PLTE tRNS IDAT tEXt gAMA IDAT PLTE tRNS IDAT teSt pHYs PLTE tRNS IDAT".split()
LINEITEM = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
DISPOSE = {"view": 0, "click": 0, "purchase": 1, "signup": 2, "error": 2}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img, y, x, v"""
    pixels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img"), F.posexplode("embedding").alias("p", "e"))
    return pixels.select("img", F.expr("p div 8").cast("int").alias("y"), F.expr("p % 8").cast("int").alias("x"), F.expr("cast(floor((cast(e as double) + 1) * 127.5) as int)").alias("v"))


GRAY = """gray AS (SELECT vec_id AS img, i // 8 AS y, i % 8 AS x, CAST(floor((CAST(embedding[i + 1] AS DOUBLE) + 1) * 127.5) AS INT) AS v
FROM embeddings, (SELECT unnest(range(64)) AS i))"""


def colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img, pos, r, g, b, a"""
    lines = table(spark, sf_dir, "lineitem").withColumn("img", F.expr("l_orderkey div 1024"))
    return lines.select(
        "img", (F.row_number().over(Window.partitionBy("img").orderBy(*LINEITEM)) - 1).alias("pos"), F.expr("cast(l_quantity * 5 as int)").alias("r"),
        F.expr("cast((img % 8) * round(l_discount * 100) as int)").alias("g"), F.lit(0).alias("b"), F.expr("case l_returnflag when 'A' then 0 when 'R' then 128 else 255 end").alias("a"),
    )


COLORS = f"""colors AS (SELECT l_orderkey // 1024 AS img, row_number() OVER (PARTITION BY l_orderkey // 1024 ORDER BY {", ".join(LINEITEM)}) - 1 AS pos,
CAST(l_quantity * 5 AS INT) AS r, CAST((l_orderkey // 1024 % 8) * round(l_discount * 100) AS INT) AS g, 0 AS b,
CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 128 ELSE 255 END AS a FROM lineitem)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u, k, event_id, v, al, dop, bop"""
    dispose = "case event_type " + " ".join(f"when '{t}' then {d}" for t, d in DISPOSE.items()) + " end"
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("u"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("k"), "event_id",
        F.expr("cast(floor(value) as int) % 256").alias("v"), F.expr("cast(event_id % 4 * 85 as int)").alias("al"), F.expr(dispose).alias("dop"), F.expr("cast(event_id % 2 as int)").alias("bop"),
    )


FRAMES = f"""frames AS (SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, event_id, CAST(floor(value) AS INT) % 256 AS v,
CAST(event_id % 4 * 85 AS INT) AS al, CASE event_type {" ".join(f"WHEN '{t}' THEN {d}" for t, d in DISPOSE.items())} END AS dop, CAST(event_id % 2 AS INT) AS bop FROM events)"""


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, ord, type, data (the text's bytes), digest (16 bytes), text"""
    types = F.array(*map(F.lit, STREAM_TYPES))
    turns = table(spark, sf_dir, "conversations").withColumn("m", F.md5(F.concat("text", F.col("turn").cast("string"))))
    last = F.col("turn") == F.max("turn").over(Window.partitionBy("conv_id"))
    kind = F.when(last & (F.col("conv_id") % 9 != 0), F.lit("IEND")).otherwise(F.element_at(types, (F.conv(F.substring("m", 1, 1), 16, 10).cast("int") + 1)))
    return turns.select(F.col("conv_id").alias("file_id"), F.col("turn").alias("ord"), kind.alias("type"), F.col("text").cast("binary").alias("data"), F.unhex("m").alias("digest"), "text")


STREAM = f"""stream AS (SELECT conv_id AS file_id, turn AS ord, text, m,
CASE WHEN turn = max(turn) OVER (PARTITION BY conv_id) AND conv_id % 9 <> 0 THEN 'IEND'
ELSE ['{"', '".join(STREAM_TYPES)}'][strpos('0123456789abcdef', substr(m, 1, 1))] END AS type
FROM (SELECT *, md5(concat(text, CAST(turn AS VARCHAR))) AS m FROM conversations))"""


def byte(i: int, digest: str = "m") -> str:
    """Byte i of a hex digest, in SQL."""
    digit = lambda at: f"(strpos('0123456789abcdef', substr({digest}, {at}, 1)) - 1)"
    return f"({digit(2 * i + 1)} * 16 + {digit(2 * i + 2)})"


def u32(i: int, digest: str = "m") -> str:
    """The big-endian number in bytes i to i + 3, in SQL."""
    return "(" + " + ".join(f"CAST({byte(i + j, digest)} AS BIGINT) * {256 ** (3 - j)}" for j in range(4)) + ")"
