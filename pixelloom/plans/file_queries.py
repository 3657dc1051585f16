"""Queries over whole files: encoded from rasters, read again, and held against the raster's SQL."""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..operators import files
from .rasters import COLORS, FRAMES, GRAY, colors, frames, gray, table


def _bytes_of(px: DataFrame, keys: list[str], order: str, value: str = "v") -> DataFrame:
    """Rows of byte values as one binary, in order."""
    rows = px.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(value).alias("b")))).alias("o"))
    code = F.transform("o", lambda e: F.lpad(F.hex(e["b"]), 2, "0"))
    return rows.select(*keys, F.unhex(F.array_join(code, "")).alias("data"))


def _gray_images(spark: SparkSession, sf_dir: str, interlace: int = 0) -> DataFrame:
    px = gray(spark, sf_dir).withColumn("at", F.expr("y * 8 + x"))
    sizes = [F.lit(v).alias(k) for k, v in (("width", 8), ("height", 8), ("bit_depth", 8), ("color_type", 0), ("interlace", interlace))]
    return _bytes_of(px, ["img"], "at").select(F.col("img").alias("file_id"), *sizes, "data")


def _color_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group of lines as one row of RGBA pixels."""
    px = colors(spark, sf_dir).select("img", "pos", F.posexplode(F.array("r", "g", "b", "a")).alias("c", "v")).withColumn("at", F.col("pos") * 4 + F.col("c"))
    whole = _bytes_of(px, ["img"], "at")
    return whole.select(F.col("img").alias("file_id"), F.expr("octet_length(data) div 4").alias("width"), F.lit(1).alias("height"), F.lit(8).alias("bit_depth"), F.lit(6).alias("color_type"), "data")


def _values(df: DataFrame, key: str = "file_id") -> DataFrame:
    """Bytes of data as rows: key, at, v."""
    digits = F.posexplode(F.transform(F.sequence(F.lit(1), F.octet_length("data")), lambda i: F.conv(F.hex(F.substring(F.col("data"), i, F.lit(1))), 16, 10).cast("int"))).alias("at", "v")
    return df.select(key, digits)


def q_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray images to PNG bytes and back."""
    content = files.write(_gray_images(spark, sf_dir))
    return _values(files.read(content)).select(F.col("file_id").alias("img"), "at", "v")


def q_encode_decode_adam7(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = files.write(_gray_images(spark, sf_dir, 1))
    return _values(files.read(content)).select(F.col("file_id").alias("img"), "at", "v")


SQL_ENCODE_DECODE = f"WITH {GRAY} SELECT img, CAST(y * 8 + x AS INT) AS at, v FROM gray"
SQL_ENCODE_DECODE_ADAM7 = SQL_ENCODE_DECODE


def q_encode_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RGBA images written with palettes where they have few colors, and read as bitmaps."""
    content = files.write(_color_images(spark, sf_dir), codec.EncodeOptions(palette="auto"))
    return files.read(content, "bitmap").select(F.col("file_id").alias("img"), "width", F.md5("data").alias("digest"))


SQL_ENCODE_PALETTE = f"""WITH {COLORS} SELECT img, count(*) AS width, md5(unhex(string_agg(concat(lpad(to_hex(r), 2, '0'), lpad(to_hex(g), 2, '0'), lpad(to_hex(b), 2, '0'), lpad(to_hex(a), 2, '0')), '' ORDER BY pos))) AS digest
FROM colors GROUP BY img"""


def q_to_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray files as RGB8 bitmaps."""
    content = files.write(_gray_images(spark, sf_dir))
    return files.read(content, "bitmap", alpha=False).select(F.col("file_id").alias("img"), F.md5("data").alias("digest"))


SQL_TO_BITMAP = f"WITH {GRAY} SELECT img, md5(unhex(string_agg(repeat(lpad(to_hex(v), 2, '0'), 3), '' ORDER BY y, x))) AS digest FROM gray GROUP BY img"


def _varied_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray images of one row and 1 to 9 pixels, every third interlaced."""
    width = (F.col("file_id") % 9 + 1).alias("width")
    sizes = [width, F.lit(1).alias("height"), F.lit(8).alias("bit_depth"), F.lit(0).alias("color_type"), (F.col("file_id") % 3 == 0).cast("int").alias("interlace")]
    return _gray_images(spark, sf_dir).select("file_id", *sizes, F.substring(F.col("data"), F.lit(1), (F.col("file_id") % 9 + 1).cast("int")).alias("data"))


def q_read_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers by the kernel, and by fixed places in the bytes with no Python at all."""
    content = files.write(_varied_images(spark, sf_dir))
    kernel = files.read(content, "header").select("file_id", "width", "height", "bit_depth", "color_type", "interlace")
    from ..operators.metadata import header

    places = content.select("file_id", header(F.col("content")).alias("h")).select("file_id", *[F.col(f"h.{c}").alias(f"{c}_at") for c in ("width", "height", "interlace")])
    return kernel.join(places, "file_id").withColumnRenamed("file_id", "img")


SQL_READ_HEADER = """SELECT vec_id AS img, vec_id % 9 + 1 AS width, 1 AS height, 8 AS bit_depth, 0 AS color_type, CAST(vec_id % 3 = 0 AS INT) AS interlace,
vec_id % 9 + 1 AS width_at, 1 AS height_at, CAST(vec_id % 3 = 0 AS INT) AS interlace_at FROM embeddings"""

#: What is wrong with each seventh image: its header's or data's flaw, and the error it must give.
FLAWS = (None, "InvalidImageDataLength", "InvalidBitDepth", "InvalidDimensions", "MissingPalette", "UnexpectedCriticalChunk", "UnexpectedTransparency")


def q_validate_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images checked before they are written."""
    n = F.col("file_id") % len(FLAWS)
    key = F.struct(F.lit("gray").alias("kind"), F.array(F.lit(1)).alias("values"))
    chunk = F.struct(F.lit("LOOM").alias("type"), F.lit(b"x").alias("data"), F.lit(0).cast("long").alias("crc"), F.lit(codec.BEFORE_PALETTE).alias("position"))
    flawed = (
        _gray_images(spark, sf_dir).withColumn("data", F.when(n == 1, F.substring("data", 1, 63)).otherwise(F.col("data"))).withColumn("bit_depth", F.when(n == 2, 3).otherwise(F.col("bit_depth")))
        .withColumn("width", F.when(n == 3, 0).otherwise(F.col("width"))).withColumn("color_type", F.when(n == 4, codec.INDEXED).when(n == 6, codec.GRAY_ALPHA).otherwise(F.col("color_type")))
        .withColumn("data", F.when(n == 6, F.concat("data", "data")).otherwise(F.col("data"))).withColumn("transparency", F.when(n == 6, key)).withColumn("chunks", F.when(n == 5, F.array(chunk)))
    )
    return files.write(flawed).select(F.col("file_id").alias("img"), F.col("error.code").alias("code"))


SQL_VALIDATE_IMAGES = "SELECT vec_id AS img, [{}][vec_id % {} + 1] AS code FROM embeddings".format(", ".join(f"'{e}'" if e else "NULL" for e in FLAWS), len(FLAWS))


def q_color_key_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RGB images with a key color, written with palettes: the key becomes an entry without opacity."""
    rgb = colors(spark, sf_dir).select("img", "pos", F.posexplode(F.array("r", "g", "b")).alias("c", "v")).withColumn("at", F.col("pos") * 3 + F.col("c"))
    images = _bytes_of(rgb, ["img"], "at").select(
        F.col("img").alias("file_id"), F.expr("octet_length(data) div 3").alias("width"), F.lit(1).alias("height"), F.lit(8).alias("bit_depth"), F.lit(2).alias("color_type"), "data",
        F.struct(F.lit("rgb").alias("kind"), F.array(F.lit(50), F.lit(0), F.lit(0)).alias("values")).alias("transparency"),
    )
    return files.read(files.write(images, codec.EncodeOptions(palette="auto")), "bitmap").select(F.col("file_id").alias("img"), "width", F.md5("data").alias("digest"))


SQL_COLOR_KEY_FOLDED = f"""WITH {COLORS} SELECT img, count(*) AS width, md5(unhex(string_agg(concat(lpad(to_hex(r), 2, '0'), lpad(to_hex(g), 2, '0'), '00', CASE WHEN r = 50 AND g = 0 THEN '00' ELSE 'FF' END), '' ORDER BY pos))) AS digest
FROM colors GROUP BY img"""


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray images with typed metadata and raw chunks."""
    text = F.array(F.struct(F.lit("zTXt").alias("kind"), F.lit("Title").alias("keyword"), F.lit("").alias("language"), F.lit("").alias("translated"), F.lit(True).alias("compressed"), F.concat(F.lit("image "), F.col("file_id").cast("string")).alias("text")))
    metadata = F.struct((F.col("file_id") + 1).alias("gamma"), F.when(F.col("file_id") % 2 == 0, F.lit(1)).alias("srgb"), F.array(F.lit(2835), F.lit(2835), F.lit(1)).cast("array<long>").alias("phys"), text.alias("text"))
    raw = lambda kind, position: F.struct(F.lit(kind).alias("type"), F.lit(kind.lower()).cast("binary").alias("data"), F.lit(0).cast("long").alias("crc"), F.lit(position).alias("position"))
    chunks = F.array(raw("loOm", codec.BEFORE_PALETTE), raw("loOM", codec.AFTER_IMAGE), raw("gAMA", codec.BEFORE_PALETTE))
    return _gray_images(spark, sf_dir).withColumn("metadata", metadata).withColumn("chunks", chunks)


def q_read_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk types in file order; raw chunks are dropped where a typed value is written or they are unsafe to copy."""
    found = files.read(files.write(_described(spark, sf_dir)), "raw").groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("ord", "type"))).alias("o"))
    return found.select(F.col("file_id").alias("img"), F.array_join("o.type", " ").alias("types"))


SQL_READ_CHUNKS = "SELECT vec_id AS img, concat('IHDR ', CASE WHEN vec_id % 2 = 0 THEN 'sRGB ' ELSE '' END, 'gAMA loOm pHYs zTXt IDAT IEND') AS types FROM embeddings"


def q_read_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = files.read(files.write(_described(spark, sf_dir)), "chunks")
    return m.select(F.col("file_id").alias("img"), (F.col("metadata.gamma") / 100000).alias("gamma"), F.col("metadata.srgb").alias("srgb"), F.element_at("metadata.text", 1)["text"].alias("title"), F.size("chunks").alias("n_chunks"))


SQL_READ_METADATA = """SELECT vec_id AS img, (vec_id + 1) / 100000 AS gamma, CASE WHEN vec_id % 2 = 0 THEN 1 END AS srgb, concat('image ', vec_id) AS title,
CASE WHEN vec_id % 2 = 0 THEN 8 ELSE 7 END AS n_chunks FROM embeddings"""


def q_reencode_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded, encoded again with metadata stripped to what colors need, decoded once more."""
    once = files.read(files.write(_described(spark, sf_dir)))
    again = files.read(files.write(once.drop("error"), codec.EncodeOptions(strip="safe")))
    m = F.col("metadata")
    return again.select(F.col("file_id").alias("img"), m["gamma"].alias("gamma"), F.size(F.coalesce(m["text"], F.array())).alias("n_texts"), F.size("chunks").alias("n_chunks"), F.md5("data").alias("digest"))


SQL_REENCODE_STRIP = f"""WITH {GRAY}, d AS (SELECT img, md5(unhex(string_agg(lpad(to_hex(v), 2, '0'), '' ORDER BY y, x))) AS digest FROM gray GROUP BY img)
SELECT img, img + 1 AS gamma, 0 AS n_texts, CASE WHEN img % 2 = 0 THEN 3 ELSE 2 END AS n_chunks, digest FROM d"""


def _animations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An animation for every user: a 6x4 gray canvas with one column that moves."""
    data = F.unhex(F.array_join(F.expr("transform(sequence(0, 23), at -> case when at % 6 = v % 6 and v % 5 > 0 then lpad(hex(v), 2, '0') else '00' end)"), ""))
    zero = F.lit(0).cast("long")
    frame = F.struct(F.col("k"), F.lit(6).cast("long").alias("width"), F.lit(4).cast("long").alias("height"), zero.alias("x"), zero.alias("y"), (F.col("event_id") % 100).alias("delay_num"), F.lit(100).alias("delay_den"), F.lit(0).alias("dispose"), F.lit(0).alias("blend"), data.alias("data"))
    sizes = [F.lit(v).alias(k) for k, v in (("width", 6), ("height", 4), ("bit_depth", 8), ("color_type", 0))]
    return frames(spark, sf_dir).groupBy("u").agg(F.collect_list(frame).alias("frames")).select(F.col("u").alias("file_id"), *sizes, "frames", F.lit(3).alias("plays"))


def q_anim_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Animations written with frames cropped to their changes, read, and rendered to full frames again."""
    shown = files.read(files.write_animations(_animations(spark, sf_dir), codec.EncodeOptions(crop=True)), "composited")
    return shown.select(F.col("file_id").alias("u"), F.col("k").cast("long").alias("k"), F.col("delay_num").cast("long").alias("delay_num"), "plays", F.md5("data").alias("digest"))


SQL_ANIM_ROUNDTRIP = f"""WITH {FRAMES} SELECT u, k, any_value(event_id % 100) AS delay_num, 3 AS plays,
md5(unhex(string_agg(concat(repeat(lpad(to_hex(CASE WHEN place % 6 = v % 6 AND v % 5 > 0 THEN v ELSE 0 END), 2, '0'), 3), 'FF'), '' ORDER BY place))) AS digest
FROM frames, (SELECT unnest(range(24)) AS place) GROUP BY u, k"""


def q_chunk_animations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Animations by their chunks alone; of every seventh file the last frame's data is lost, so it reads as a still image."""
    whole = files.write_animations(_animations(spark, sf_dir))

    def cut(row: dict) -> list[dict]:
        chunks = [(c.type, c.data) for c in codec.scan(row["content"])]
        if row["file_id"] % 7 == 0:
            place = max((i for i, (kind, _) in enumerate(chunks) if kind == "fdAT"), default=None)
            chunks = [c for i, c in enumerate(chunks) if i != place]
        return [{"file_id": row["file_id"], "content": codec.SIGNATURE + b"".join(codec.chunk_bytes(k, d) for k, d in chunks)}]

    found = files.read(files.map_rows(whole, "file_id long, content binary", cut), "chunks")
    delays = F.aggregate("frame_controls", F.lit(0).cast("long"), lambda done, c: done + c["delay_num"])
    return found.select(F.col("file_id").alias("u"), "animation.frames", "animation.plays", F.size("frame_controls").alias("n_controls"), delays.alias("delays"), F.size("chunks").alias("n_chunks"))


SQL_CHUNK_ANIMATIONS = f"""WITH {FRAMES}, n AS (SELECT u, count(*) AS n, CAST(sum(event_id % 100) AS BIGINT) AS delays, u % 7 = 0 AND count(*) > 1 AS lost FROM frames GROUP BY u)
SELECT u, CASE WHEN NOT lost THEN n END AS frames, CASE WHEN NOT lost THEN 3 END AS plays, CASE WHEN lost THEN 0 ELSE n END AS n_controls, CASE WHEN lost THEN 0 ELSE delays END AS delays,
2 * n + 3 - CAST(lost AS INT) AS n_chunks FROM n"""


def q_anim_keep_smaller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small animations are written with a palette only where that is smaller."""
    colored = _animations(spark, sf_dir).withColumns({"color_type": F.lit(codec.RGB), "width": F.lit(2)})
    fewer = F.transform("frames", lambda f: f.withField("width", F.lit(2).cast("long")))  # 24 bytes are 2 by 4 RGB pixels
    size = lambda options, name: files.write_animations(colored.withColumn("frames", fewer), options).select("file_id", F.octet_length("content").alias(name))
    both = size(codec.EncodeOptions(), "plain").join(size(codec.EncodeOptions(palette="auto"), "auto"), "file_id")
    small = colored.select("file_id", (F.size("frames") * 24 <= codec.SMALL_IMAGE).alias("small"))
    return both.join(small, "file_id").select(F.col("file_id").alias("u"), F.when(F.col("small"), F.col("auto") <= F.col("plain")).alias("no_larger"))


SQL_ANIM_KEEP_SMALLER = f"WITH {FRAMES} SELECT u, CASE WHEN count(*) * 24 <= {codec.SMALL_IMAGE} THEN true END AS no_larger FROM frames GROUP BY u"

#: A damage and the error that it must give.
DAMAGES = (
    ("none", None), ("cut", "UnexpectedEndOfInput"), ("signature", "InvalidSignature"), ("crc", "CrcMismatch"), ("empty", "UnexpectedEndOfInput"), ("type", "InvalidChunkType"),
    ("width", "InvalidDimensions"), ("no image", "MissingImageData"), ("no end", "MissingImageEnd"), ("filter", "InvalidFilterType"), ("short", "ImageDataTooShort"), ("long", "ImageDataTooLong"), ("zlib", "Decompression"), ("adler", "Decompression"),
)


def damaged(content: bytes, how: str) -> bytes:
    chunks = [(c.type, c.data) for c in codec.scan(content)]
    raw = zlib.decompress(b"".join(d for k, d in chunks if k == "IDAT"))
    whole = lambda parts: codec.SIGNATURE + b"".join(codec.chunk_bytes(k, d) for k, d in parts)
    with_data = lambda data: whole([(k, data if k == "IDAT" else d) for k, d in chunks])
    return {
        "none": lambda: content, "cut": lambda: content[:-9], "signature": lambda: b"?" + content[1:], "crc": lambda: content[:30] + bytes([content[30] ^ 1]) + content[31:], "empty": lambda: b"",
        "type": lambda: content[:-8] + b"1END" + content[-4:], "width": lambda: whole([("IHDR", bytes(4) + chunks[0][1][4:])] + chunks[1:]), "no image": lambda: whole([c for c in chunks if c[0] != "IDAT"]),
        "no end": lambda: whole(chunks[:-1]), "filter": lambda: with_data(zlib.compress(b"\x05" + raw[1:])), "short": lambda: with_data(zlib.compress(raw[:-3])), "long": lambda: with_data(zlib.compress(raw + b"x")), "adler": lambda: with_data(zlib.compress(raw)[:-1] + bytes([zlib.compress(raw)[-1] ^ 1])),
        "zlib": lambda: with_data(b"\x00\x01\x02\x03"),
    }[how]()


def q_error_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged files in PERMISSIVE mode: each damage's error, or none."""
    content = files.write(_gray_images(spark, sf_dir))
    names = [how for how, _ in DAMAGES]
    hurt = files.map_rows(content, "file_id long, content binary", lambda row: [{"file_id": row["file_id"], "content": damaged(row["content"], names[row["file_id"] % len(names)])}])
    return files.read(hurt).select(F.col("file_id").alias("img"), F.col("error.code").alias("code"))


SQL_ERROR_MODES = "SELECT vec_id AS img, [{}][vec_id % {} + 1] AS code FROM embeddings".format(", ".join(f"'{e}'" if e else "NULL" for _, e in DAMAGES), len(DAMAGES))


def q_error_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in DROPMALFORMED mode: only whole files are left."""
    content = files.write(_gray_images(spark, sf_dir))
    names = [how for how, _ in DAMAGES]
    hurt = files.map_rows(content, "file_id long, content binary", lambda row: [{"file_id": row["file_id"], "content": damaged(row["content"], names[row["file_id"] % len(names)])}])
    return files.read(hurt, "header", on_error="DROPMALFORMED").select(F.col("file_id").alias("img"), "width")


SQL_ERROR_DROPPED = f"""SELECT vec_id AS img, 8 AS width FROM embeddings WHERE vec_id % {len(DAMAGES)} NOT IN ({", ".join(str(i) for i, (how, _) in enumerate(DAMAGES) if how in ("signature", "crc", "empty", "width"))})"""


def q_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents compressed in segments by many tasks, joined into one stream each, and inflated: the text again."""
    raw = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("raw"))
    streams = files.joined_segments(files.compressed_segments(files.segments(raw, "doc_id", 1000), "doc_id"), "doc_id")
    checked = files.map_rows(streams, "doc_id long, n_segments int, adler long, whole binary", lambda r: [{"doc_id": r["doc_id"], "n_segments": r["n_segments"], "adler": r["adler"], "whole": zlib.decompress(r["stream"])}])
    return checked.select("doc_id", "n_segments", F.md5("whole").alias("digest"))


SQL_SEGMENTS = "SELECT doc_id, CAST(greatest(1, ceil(strlen(text) / 1000)) AS INT) AS n_segments, md5(text) AS digest FROM documents"


def q_prepare_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding in two phases over two exchanges; of every eleventh file a segment is lost on the way."""
    whole = files.prepared(_gray_images(spark, sf_dir))
    sent = files.compressed_segments(whole.where("file_id % 11 <> 0").select("file_id", "seg_no", "part").repartition("file_id", "seg_no"))
    done = files.finished(whole, sent)
    read = files.read(done.where("error is null")).select("file_id", F.md5("data").alias("digest"))
    return done.join(read, "file_id", "left").select(F.col("file_id").alias("img"), F.col("error.code").alias("code"), "digest")


SQL_PREPARE_FINISH = f"""WITH {GRAY} SELECT img, CASE WHEN img % 11 = 0 THEN 'InvalidSegmentCount' END AS code,
CASE WHEN img % 11 <> 0 THEN md5(unhex(string_agg(lpad(to_hex(v), 2, '0'), '' ORDER BY y, x))) END AS digest FROM gray GROUP BY img"""


def q_meta_inflate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as compressed iTXt chunks, parsed with a bound on their size."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def one(row: dict) -> list[dict]:
        data = b"Title\0\1\0\0\0" + zlib.compress(row["text"].encode())
        try:
            return [{"doc_id": row["doc_id"], "text": codec.parse_known("iTXt", data)["text"]["text"], "code": None}]
        except codec.PngError as e:
            return [{"doc_id": row["doc_id"], "text": None, "code": e.code}]

    return files.map_rows(docs, "doc_id long, text string, code string", one, 1024).select("doc_id", F.md5("text").alias("digest"), "code")


SQL_META_INFLATE = "SELECT doc_id, md5(text) AS digest, CAST(NULL AS VARCHAR) AS code FROM documents"


def q_meta_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as color profiles in iCCP chunks; every fifth has a method that is not known, every eleventh a stream cut short."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def one(row: dict) -> list[dict]:
        stream = zlib.compress(row["text"].encode())
        data = b"Profile\0" + (b"\1" if row["doc_id"] % 5 == 0 else b"\0") + (stream[:-5] if row["doc_id"] % 11 == 0 else stream)
        try:
            name, profile = codec.parse_known("iCCP", data)["icc"]
            return [{"doc_id": row["doc_id"], "name": name, "digest": hashlib.md5(profile).hexdigest(), "code": None}]
        except codec.PngError as e:
            return [{"doc_id": row["doc_id"], "name": None, "digest": None, "code": e.code}]

    return files.map_rows(docs, "doc_id long, name string, digest string, code string", one, 1024)


SQL_META_PROFILE = """SELECT doc_id, CASE WHEN bad THEN NULL ELSE 'Profile' END AS name, CASE WHEN bad THEN NULL ELSE md5(text) END AS digest, CASE WHEN bad THEN 'InvalidChunkData' END AS code
FROM (SELECT *, doc_id % 5 = 0 OR doc_id % 11 = 0 AS bad FROM documents)"""


def q_keep_smaller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small images are written with a palette only where that is smaller; which is, depends on the DEFLATE library."""
    plain = files.write(_color_images(spark, sf_dir)).select("file_id", F.octet_length("content").alias("plain"))
    auto = files.write(_color_images(spark, sf_dir), codec.EncodeOptions(palette="auto")).select("file_id", F.octet_length("content").alias("auto"))
    small = _color_images(spark, sf_dir).select("file_id", (F.octet_length("data") <= codec.SMALL_IMAGE).alias("small"))
    return plain.join(auto, "file_id").join(small, "file_id").select(F.col("file_id").alias("img"), F.when(F.col("small"), F.col("auto") <= F.col("plain")).alias("no_larger"))


SQL_KEEP_SMALLER = f"WITH {COLORS} SELECT img, CASE WHEN count(*) * 4 <= {codec.SMALL_IMAGE} THEN true END AS no_larger FROM colors GROUP BY img"
