"""Queries over chunk sequences and their payloads; each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions.codec import KNOWN_CHUNKS
from ..operators import chunks as C
from ..operators import metadata as M
from .rasters import STREAM, byte, stream, table, u32


def q_crc32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream(spark, sf_dir).select("file_id", "ord", X.chunk_crc(F.col("type"), F.col("data")).alias("crc"))


SQL_CRC32 = f"""WITH {STREAM}, bytes AS (SELECT file_id, ord, list_transform(range(length(h) // 2), lambda i: (strpos('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1) AS b
FROM (SELECT file_id, ord, hex(encode(concat(type, text))) AS h FROM stream)),
tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS v FROM (SELECT unnest(range(256)) AS i)))
SELECT file_id, ord, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(t[xor(c, x) % 256 + 1], c // 256))) AS crc FROM bytes, tab"""


def q_chunk_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("type")
    props = {"critical": X.is_critical, "public": X.is_public, "reserved_ok": X.is_reserved_bit_valid, "safe": X.is_safe_to_copy, "letters": X.is_chunk_type}
    return stream(spark, sf_dir).groupBy("type", *[f(kind).alias(n) for n, f in props.items()]).agg(F.count("*").alias("n"))


SQL_CHUNK_PROPS = f"""WITH {STREAM} SELECT type, ord1 AS critical, ord2 AS public, ord3 AS reserved_ok, NOT ord4 AS safe, true AS letters, count(*) AS n FROM (
SELECT type, {", ".join(f"unicode(substr(type, {i}, 1)) BETWEEN 65 AND 90 AS ord{i}" for i in range(1, 5))} FROM stream) GROUP BY ALL"""


def q_chunk_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole chunks as they are written, by their head and length."""
    whole = X.chunk_bytes(F.col("type"), F.col("data"))
    return stream(spark, sf_dir).select("file_id", "ord", F.lower(F.hex(F.substring(whole, 1, 8))).alias("head"), F.octet_length(whole).alias("size"), F.md5(F.substring(whole, F.lit(9), F.octet_length("data"))).alias("inside"))


SQL_CHUNK_BYTES = f"""WITH {STREAM} SELECT file_id, ord, concat(lpad(lower(to_hex(strlen(text))), 8, '0'), lower(hex(encode(type)))) AS head, CAST(strlen(text) + 12 AS INT) AS size, md5(text) AS inside FROM stream"""

_BEFORE = "coalesce(sum(CAST(type = '{t}' AS INT)) OVER (PARTITION BY file_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
_PLACED = f"""placed AS (SELECT *, CASE WHEN {_BEFORE.format(t="IDAT")} > 0 THEN 'AfterImageData' WHEN {_BEFORE.format(t="PLTE")} > 0 THEN 'BeforeImageData' ELSE 'BeforePalette' END AS position FROM stream)"""


def q_chunk_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.placed(stream(spark, sf_dir)).select("file_id", "ord", "type", "position")


SQL_CHUNK_POSITIONS = f"WITH {STREAM}, {_PLACED} SELECT file_id, ord, type, position FROM placed"


def q_chunk_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.outcomes(stream(spark, sf_dir))


SQL_CHUNK_ERRORS = f"""WITH RECURSIVE {STREAM}, numbered AS (SELECT file_id, type, row_number() OVER (PARTITION BY file_id ORDER BY ord) AS n FROM stream),
walk(file_id, n, img, pal, tr, outcome) AS (SELECT DISTINCT file_id, CAST(0 AS BIGINT), 0, 0, 0, CAST(NULL AS VARCHAR) FROM numbered UNION ALL
SELECT w.file_id, s.n, CASE WHEN s.type = 'IDAT' THEN 1 WHEN w.img > 0 THEN 2 ELSE 0 END, w.pal + CAST(s.type = 'PLTE' AS INT), w.tr + CAST(s.type = 'tRNS' AS INT),
CASE WHEN s.type = 'PLTE' AND w.tr > 0 AND w.img = 0 THEN 'TransparencyBeforePalette' WHEN s.type = 'PLTE' AND w.img > 0 THEN 'PaletteAfterImageData' WHEN s.type = 'PLTE' AND w.pal > 0 THEN 'DuplicatePalette'
WHEN s.type = 'tRNS' AND w.img > 0 THEN 'TransparencyAfterImageData' WHEN s.type = 'tRNS' AND w.tr > 0 THEN 'DuplicateTransparency' WHEN s.type = 'IDAT' AND w.img = 2 THEN 'NonConsecutiveImageData'
WHEN s.type = 'IEND' AND w.img = 0 THEN 'MissingImageData' WHEN s.type = 'IEND' THEN 'OK' END
FROM walk w JOIN numbered s ON s.file_id = w.file_id AND s.n = w.n + 1 WHERE w.outcome IS NULL)
SELECT file_id, coalesce(max(outcome), 'MissingImageEnd') AS outcome FROM walk GROUP BY file_id"""


def q_chunk_errors_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where every second file has indexed colors, so that image data needs a palette before it."""
    return C.outcomes(stream(spark, sf_dir), F.col("file_id") % 2 == 1)


SQL_CHUNK_ERRORS_INDEXED = SQL_CHUNK_ERRORS.replace("WHEN s.type = 'IEND' AND w.img = 0", "WHEN s.type = 'IDAT' AND w.img = 0 AND w.pal = 0 AND w.file_id % 2 = 1 THEN 'MissingPalette' WHEN s.type = 'IEND' AND w.img = 0", 1)


def q_animation_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """acTL from eight bytes of a digest, the first four modulo 3, so that some have no frame; some lack a byte."""
    data = F.concat(F.unhex(F.lpad(F.hex(X.uint(F.col("digest"), 0, 4) % 3), 8, "0")), F.substring("digest", 5, 4))
    error, value = M.animation_control(F.when(F.col("ord") % 5 == 4, F.substring(data, 1, 7)).otherwise(data))
    return stream(spark, sf_dir).select("file_id", "ord", error.alias("error"), F.when(error.isNull(), value).alias("v")).select("file_id", "ord", "error", "v.frames", "v.plays")


SQL_ANIMATION_CONTROL = f"""WITH {STREAM}, p AS (SELECT file_id, ord, {u32(0)} % 3 AS frames, {u32(4)} AS plays FROM stream),
e AS (SELECT *, CASE WHEN ord % 5 = 4 THEN 'InvalidChunkLength' WHEN frames = 0 THEN 'InvalidChunkData' END AS error FROM p)
SELECT file_id, ord, error, CASE WHEN error IS NULL THEN frames END AS frames, CASE WHEN error IS NULL THEN plays END AS plays FROM e"""


def q_frame_control_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fcTL from a digest: areas from its bytes, operations modulo 4 and 3, so that some are not known."""
    d = F.col("digest")
    operations = F.unhex(F.concat(F.lpad(F.hex(X.uint(d, 14, 1) % 4), 2, "0"), F.lpad(F.hex(X.uint(d, 15, 1) % 3), 2, "0")))
    data = F.concat(F.substring(d, 1, 4), F.lit(b"\0\0"), F.substring(d, 5, 2), F.lit(b"\0\0\0"), F.substring(d, 7, 1), F.substring(d, 1, 8), F.substring(d, 9, 4), operations)
    error, value = M.frame_control(data)
    names = ("sequence", "width", "height", "x", "y", "delay_num", "delay_den", "dispose", "blend")
    return stream(spark, sf_dir).select("file_id", "ord", error.alias("error"), F.when(error.isNull(), value).alias("v")).select("file_id", "ord", "error", *[F.col(f"v.{n}").cast("long").alias(n) for n in names])


_FRAME = {"sequence": u32(0), "width": f"{byte(4)} * 256 + {byte(5)}", "height": byte(6), "x": u32(0), "y": u32(4), "delay_num": f"{byte(8)} * 256 + {byte(9)}", "delay_den": f"{byte(10)} * 256 + {byte(11)}", "dispose": f"{byte(14)} % 4", "blend": f"{byte(15)} % 3"}
SQL_FRAME_CONTROL_PARSE = f"""WITH {STREAM}, p AS (SELECT file_id, ord, {", ".join(f"{v} AS {n}" for n, v in _FRAME.items())} FROM stream),
e AS (SELECT *, CASE WHEN dispose > 2 OR blend > 1 THEN 'InvalidChunkData' WHEN width = 0 OR height = 0 THEN 'InvalidDimensions' END AS error FROM p)
SELECT file_id, ord, error, {", ".join(f"CASE WHEN error IS NULL THEN CAST({n} AS BIGINT) END AS {n}" for n in _FRAME)} FROM e"""


def q_idat_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.joined(stream(spark, sf_dir)).select("file_id", "pieces", F.octet_length("data").alias("size"), F.md5("data").alias("digest"))


SQL_IDAT_JOIN = f"""WITH {STREAM} SELECT file_id, CAST(count(*) AS INT) AS pieces, CAST(sum(strlen(text)) AS INT) AS size, md5(string_agg(text, '' ORDER BY ord)) AS digest
FROM stream WHERE type = 'IDAT' GROUP BY file_id"""


def _own_error(data: Column) -> Column:
    """gAMA from four digest bytes, pHYs from nine, of which one in three has a bad unit; keywords of tEXt from hex."""
    four, nine = F.substring(data, 1, 4), F.concat(F.substring(data, 1, 8), F.unhex(F.lpad(F.hex(X.uint(data, 8, 1) % 3), 2, "0")))
    return F.when(F.col("type") == "gAMA", M.gamma(four)[0]).when(F.col("type") == "pHYs", M.physical(nine)[0])


def q_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of ancillary chunks: the first good one of a kind is stored."""
    return C.settled(stream(spark, sf_dir), _own_error(F.col("digest"))).select("file_id", "ord", "type", "status")


_SETTLED = f"""own AS (SELECT *, CASE WHEN type = 'pHYs' AND {byte(8)} % 3 = 2 THEN 'InvalidChunkData' WHEN type = 'gAMA' AND {u32(0)} = 0 THEN 'InvalidChunkData' END AS error,
CASE WHEN type = 'gAMA' AND position <> 'BeforePalette' THEN 'MisplacedChunk' WHEN type = 'pHYs' AND position = 'AfterImageData' THEN 'MisplacedChunk' END AS place
FROM placed WHERE type NOT IN ('PLTE', 'tRNS', 'IDAT', 'IEND')),
settled AS (SELECT *, CASE WHEN place IS NOT NULL THEN place WHEN type IN ('gAMA', 'pHYs') AND coalesce(max(CAST(place IS NULL AND error IS NULL AS INT))
OVER (PARTITION BY file_id, type ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'DuplicateChunk'
WHEN error IS NOT NULL THEN error WHEN type IN ('gAMA', 'pHYs') THEN 'stored' WHEN type = 'tEXt' THEN 'appended' ELSE 'skipped' END AS status FROM own)"""
SQL_FIRST_WINS = f"WITH {STREAM}, {_PLACED}, {_SETTLED} SELECT file_id, ord, type, status FROM settled"


def q_unknown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.unknown(stream(spark, sf_dir)).groupBy("file_id", "type").agg(F.count("*").alias("n"))


SQL_UNKNOWN_CHUNKS = f"""WITH {STREAM} SELECT file_id, type, count(*) AS n FROM stream WHERE type NOT IN ('{"', '".join(KNOWN_CHUNKS)}') GROUP BY file_id, type"""


def q_chunks_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream(spark, sf_dir).where("type = 'tEXt'").select("file_id", "ord", F.octet_length("data").alias("size"))


SQL_CHUNKS_OF_TYPE = f"WITH {STREAM} SELECT file_id, ord, CAST(strlen(text) AS INT) AS size FROM stream WHERE type = 'tEXt'"


def q_extra_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw ancillary chunks that re-encoding would write again, by place."""
    settled = C.settled(stream(spark, sf_dir), _own_error(F.col("digest")))
    written = settled.where("status in ('stored', 'appended')").select("file_id", "type")
    return C.rewritten(settled, written).select("file_id", "ord", "type", "position")


SQL_EXTRA_CHUNKS = f"""WITH {STREAM}, {_PLACED}, {_SETTLED}, typed AS (SELECT DISTINCT file_id, type FROM settled WHERE status IN ('stored', 'appended'))
SELECT s.file_id, s.ord, s.type, s.position FROM settled s WHERE substr(s.type, 4, 1) = lower(substr(s.type, 4, 1)) AND NOT EXISTS (SELECT 1 FROM typed t WHERE t.file_id = s.file_id AND t.type = s.type)"""


def _colors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Palette data of 0 to 15 bytes from digests, under every color type and depth."""
    rows = stream(spark, sf_dir).withColumn("size", X.uint("digest", 15, 1) % 16)
    return rows.select(
        "file_id", "ord", F.expr("substring(digest, 1, cast(size as int))").alias("data"), F.expr("element_at(array(0,2,3,4,6), cast(file_id % 5 + 1 as int))").alias("color_type"),
        F.expr("element_at(array(1,2,4,8), cast(ord % 4 + 1 as int))").alias("depth"), (X.uint("digest", 14, 1) % 7).alias("palette_size"),
    )


def q_plte_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = M.palette_error(F.col("data"), F.col("color_type"), F.col("depth"))
    rows = _colors_of(spark, sf_dir).withColumn("error", error).withColumn("entries", F.when(F.col("error").isNull(), M.palette_entries(F.col("data"))))
    last = F.element_at("entries", -1)
    return rows.select("file_id", "ord", "error", F.size(F.coalesce("entries", F.array())).alias("n"), (last["r"] * 65536 + last["g"] * 256 + last["b"]).alias("last"))


def _at(place: str) -> str:
    """A digest byte at a computed place, in SQL."""
    return f"((strpos('0123456789abcdef', substr(m, 2 * ({place}) + 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(m, 2 * ({place}) + 2, 1)) - 1)"


_COLOR_ROWS = f"""cr AS (SELECT file_id, ord, m, {byte(15)} % 16 AS n, [0, 2, 3, 4, 6][file_id % 5 + 1] AS color_type, [1, 2, 4, 8][ord % 4 + 1] AS depth, {byte(14)} % 7 AS palette_size FROM stream)"""
SQL_PLTE_PARSE = f"""WITH {STREAM}, {_COLOR_ROWS}, e AS (SELECT *, CASE WHEN color_type IN (0, 4) THEN 'UnexpectedPalette' WHEN n = 0 OR n % 3 <> 0 THEN 'InvalidPaletteLength'
WHEN color_type = 3 AND n // 3 > 1 << depth THEN 'TooManyPaletteEntries' END AS error FROM cr)
SELECT file_id, ord, error, CASE WHEN error IS NULL THEN CAST(n // 3 AS INT) ELSE 0 END AS n, CASE WHEN error IS NULL THEN CAST({_at("n - 3")} * 65536 + {_at("n - 2")} * 256 + {_at("n - 1")} AS INT) END AS last FROM e"""


def q_trns_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = M.transparency_error(F.col("data"), F.col("color_type"), F.col("palette_size"))
    return _colors_of(spark, sf_dir).select("file_id", "ord", error.alias("error"))


SQL_TRNS_PARSE = f"""WITH {STREAM}, {_COLOR_ROWS} SELECT file_id, ord, CASE WHEN color_type IN (4, 6) THEN 'UnexpectedTransparency' WHEN color_type = 3 AND palette_size = 0 THEN 'TransparencyBeforePalette'
WHEN color_type = 3 AND n = 0 THEN 'InvalidTransparencyLength' WHEN color_type = 3 AND n > palette_size THEN 'TooManyTransparencyEntries'
WHEN color_type = 0 AND n <> 2 THEN 'InvalidTransparencyLength' WHEN color_type = 2 AND n <> 6 THEN 'InvalidTransparencyLength' END AS error FROM cr"""


def q_trns_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of good transparency: key samples cut to the depth, or alphas."""
    color, size = F.expr("element_at(array(0, 2, 3), cast(file_id % 3 + 1 as int))"), F.expr("element_at(array(2, 6, cast(ord % 7 + 1 as int)), cast(file_id % 3 + 1 as int))")
    depth = F.expr("element_at(array(1, 2, 4, 8, 16), cast(ord % 5 + 1 as int))")
    rows = stream(spark, sf_dir).select("file_id", "ord", F.substring(F.col("digest"), F.lit(1), size).alias("data"), color.alias("color_type"), depth.alias("depth"))
    values = M.transparency_values(F.col("data"), F.col("color_type"), F.col("depth"))
    return rows.select("file_id", "ord", F.array_join(F.transform(values, lambda v: v.cast("string")), " ").alias("key"))


_KEYS = [" || ' ' || ".join(f"CAST(({byte(2 * i)} * 256 + {byte(2 * i + 1)}) % (1 << depth) AS VARCHAR)" for i in range(n)) for n in (1, 3)]
SQL_TRNS_VALUES = f"""WITH {STREAM}, d AS (SELECT *, [1, 2, 4, 8, 16][ord % 5 + 1] AS depth FROM stream)
SELECT file_id, ord, CASE file_id % 3 WHEN 0 THEN {_KEYS[0]} WHEN 1 THEN {_KEYS[1]} ELSE array_to_string(list_transform(range(ord % 7 + 1), lambda i: {_at("i")}), ' ') END AS key FROM d"""


def _bytes(*values: Column) -> Column:
    return F.concat(*[F.unhex(F.lpad(F.hex(v.cast("long")), 2, "0")) for v in values])


def q_meta_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of fixed layout, with good and bad payloads from digest bytes."""
    d = F.col("digest")
    b = lambda i: X.uint(d, i, 1)
    time = F.concat(F.substring(d, 1, 2), _bytes(b(2) % 14, b(3) % 33, b(4) % 26, b(5) % 62, b(6) % 63))
    parsed = {
        "gamma": M.gamma(F.substring(d, 1, 4)),
        "srgb": M.rendering_intent(_bytes(b(0) % 6)),
        "time": M.time(time),
        "cicp": M.code_points(_bytes(b(0), b(1), b(2) % 2, b(3) % 3)),
        "phys": M.physical(F.concat(F.substring(d, 1, 8), _bytes(b(8) % 3))),
        "exif": M.exif(F.concat(F.when(b(0) % 3 == 0, F.unhex(F.lit("49492A00"))).when(b(0) % 3 == 1, F.unhex(F.lit("4D4D002A"))).otherwise(F.substring(d, 1, 4)), F.substring(d, 5, 12))),
        "chrm": M.chromaticities(F.concat(d, d)),
    }
    rows = stream(spark, sf_dir).select("file_id", "ord", *[c.alias(f"{n}_{w}") for n, pair in parsed.items() for c, w in zip(pair, ("error", "value"))])
    good = lambda n, c: F.when(F.col(f"{n}_error").isNull(), c)
    total = F.aggregate("chrm_value", F.lit(0).cast("long"), lambda a, v: a + v)
    t = F.col("time_value")
    return rows.select(
        "file_id", "ord", "srgb_error", "time_error", "cicp_error", "phys_error", "exif_error", good("gamma", F.col("gamma_value")).alias("gamma"), good("srgb", F.col("srgb_value")).alias("srgb"),
        good("time", t["year"] * 10000 + t["month"] * 100 + t["day"]).alias("day"), good("time", t["hour"] * 3600 + t["minute"] * 60 + t["second"]).alias("second"),
        good("phys", F.col("phys_value.x")).alias("phys_x"), good("phys", F.col("phys_value.dpi_x")).alias("dpi_x"), good("exif", F.col("exif_value")).alias("byte_order"), total.alias("chrm_total"),
    )


SQL_META_FIXED = f"""WITH {STREAM}, b AS (SELECT file_id, ord, {", ".join(f"{byte(i)} AS b{i}" for i in range(9))}, {u32(0)} AS w0, {u32(4)} AS w4, {u32(8)} AS w8, {u32(12)} AS w12 FROM stream),
e AS (SELECT *, CASE WHEN b0 % 6 > 3 THEN 'InvalidChunkData' END AS srgb_error,
CASE WHEN b2 % 14 NOT BETWEEN 1 AND 12 OR b3 % 33 NOT BETWEEN 1 AND 31 OR b4 % 26 > 23 OR b5 % 62 > 59 OR b6 % 63 > 60 THEN 'InvalidChunkData' END AS time_error,
CASE WHEN b2 % 2 <> 0 OR b3 % 3 > 1 THEN 'InvalidChunkData' END AS cicp_error, CASE WHEN b8 % 3 > 1 THEN 'InvalidChunkData' END AS phys_error,
CASE WHEN b0 % 3 = 2 AND w0 NOT IN (1229531648, 1296891946) THEN 'InvalidChunkData' END AS exif_error FROM b)
SELECT file_id, ord, srgb_error, time_error, cicp_error, phys_error, exif_error, CASE WHEN w0 <> 0 THEN w0 / 100000 END AS gamma, CASE WHEN srgb_error IS NULL THEN CAST(b0 % 6 AS BIGINT) END AS srgb,
CASE WHEN time_error IS NULL THEN CAST((b0 * 256 + b1) * 10000 + b2 % 14 * 100 + b3 % 33 AS BIGINT) END AS day, CASE WHEN time_error IS NULL THEN CAST(b4 % 26 * 3600 + b5 % 62 * 60 + b6 % 63 AS BIGINT) END AS second,
CASE WHEN phys_error IS NULL THEN w0 END AS phys_x, CASE WHEN phys_error IS NULL AND b8 % 3 = 1 THEN CAST(w0 AS DOUBLE) * CAST(0.0254 AS DOUBLE) END AS dpi_x,
CASE WHEN exif_error IS NULL THEN CASE WHEN b0 % 3 = 0 OR (b0 % 3 = 2 AND w0 = 1229531648) THEN 'LittleEndian' ELSE 'BigEndian' END END AS byte_order,
2 * (w0 + w4 + w8 + w12) AS chrm_total FROM e"""


def _first_line() -> Column:
    return F.substring_index("text", "\n", 1)


def q_keyword_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of every document as a keyword."""
    line = _first_line()
    return table(spark, sf_dir, "documents").groupBy(X.keyword_is_valid(line).alias("valid"), X.printable(line).alias("printable")).agg(F.count("*").alias("n"), F.sum(F.length(line)).alias("chars"))


SQL_KEYWORD_RULE = r"""WITH k AS (SELECT split_part(text, chr(10), 1) AS line FROM documents),
p AS (SELECT line, NOT regexp_matches(line, '[^ -~\x{00a1}-\x{00ff}]') AS printable FROM k)
SELECT length(line) BETWEEN 1 AND 79 AND printable AND line NOT LIKE ' %' AND line NOT LIKE '% ' AND line NOT LIKE '%  %' AS valid, printable, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars
FROM p GROUP BY 1, 2"""


def q_meta_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tEXt: the first word is the keyword, the rest Latin-1 text; what isn't, or holds a zero, is an error."""
    fits = ~F.col("text").rlike("[^\\x01-\\xff]")
    text = F.when(fits, F.col("text"))
    data = F.concat(F.encode(F.substring_index(text, " ", 1), "ISO-8859-1"), F.unhex(F.lit("00")), F.encode(text, "ISO-8859-1"))
    bad, value = M.plain_text(F.col("data"))
    rows = table(spark, sf_dir, "documents").select("doc_id", data.alias("data"), fits.alias("fits"))
    error = F.when(~F.col("fits"), M.DATA).otherwise(bad)
    good = lambda c: F.when(error.isNull(), c)
    return rows.select("doc_id", error.alias("error"), good(value["keyword"]).alias("keyword"), good(F.md5(value["text"].cast("binary"))).alias("digest"))


_WORD_OK = r"length(word) BETWEEN 1 AND 79 AND NOT regexp_matches(word, '[^ -~\x{00a1}-\x{00ff}]') AND word NOT LIKE ' %' AND word NOT LIKE '% ' AND word NOT LIKE '%  %'"
SQL_META_TEXT = rf"""WITH k AS (SELECT doc_id, text, split_part(text, ' ', 1) AS word, NOT regexp_matches(text, '[^\x{{0001}}-\x{{00ff}}]') AS fits FROM documents),
e AS (SELECT *, CASE WHEN NOT fits OR NOT ({_WORD_OK}) THEN 'InvalidChunkData' END AS error FROM k)
SELECT doc_id, error, CASE WHEN error IS NULL THEN word END AS keyword, CASE WHEN error IS NULL THEN md5(text) END AS digest FROM e"""


def q_meta_international(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as iTXt without compression, in UTF-8; one with a zero in it is an error."""
    zero = F.unhex(F.lit("00"))
    data = F.concat(F.lit("Title").cast("binary"), zero, zero, F.when(F.expr("doc_id % 7 = 0"), F.unhex(F.lit("01"))).otherwise(zero), F.col("lang").cast("binary"), zero, F.col("source").cast("binary"), zero, F.col("text").cast("binary"))
    bad, value = M.international_text(F.col("data"))
    rows = table(spark, sf_dir, "documents").select("doc_id", data.alias("data"), F.col("text").contains("\0").alias("zero"))
    error = F.when(F.col("zero"), M.DATA).otherwise(bad)
    good = lambda c: F.when(error.isNull(), c)
    return rows.select("doc_id", error.alias("error"), good(value["language"]).alias("language"), good(value["translated"]).alias("translated"), good(F.md5(value["text"].cast("binary"))).alias("digest"))


SQL_META_INTERNATIONAL = """SELECT doc_id, CASE WHEN bad THEN 'InvalidChunkData' END AS error, CASE WHEN NOT bad THEN lang END AS language,
CASE WHEN NOT bad THEN source END AS translated, CASE WHEN NOT bad THEN md5(text) END AS digest FROM (SELECT *, doc_id % 7 = 0 OR strpos(text, chr(0)) > 0 AS bad FROM documents)"""


def q_meta_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types of each file in the order they are written."""
    return M.in_writing_order(stream(spark, sf_dir).select("file_id", "type").distinct())


SQL_META_ORDER = f"""WITH {STREAM}, r(type, rank) AS (VALUES {", ".join(f"('{t}', {i})" for i, t in enumerate(M.WRITING_ORDER))})
SELECT file_id, string_agg(type, ' ' ORDER BY rank) AS written FROM (SELECT DISTINCT file_id, type FROM stream) JOIN r USING (type) GROUP BY file_id"""


def q_header_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers from digest bytes: the first rule that each breaks."""
    d = F.col("digest")
    b = lambda i: X.uint(d, i, 1)
    data = F.concat(_bytes(F.lit(0), F.lit(0), b(0) % 2, b(1) % 3, F.lit(0), F.lit(0), F.lit(0), b(2) % 9, F.element_at(F.array(*map(F.lit, (1, 2, 4, 8, 16, 3))), (b(3) % 6 + 1).cast("int")), b(4) % 7), _bytes((b(5) % 8 == 0).cast("int"), (b(6) % 8 == 0).cast("int"), b(7) % 3))
    return stream(spark, sf_dir).select("file_id", "ord", M.header_error(F.when(b(8) % 10 == 0, F.substring(data, 1, 12)).otherwise(data)).alias("error"))


SQL_HEADER_PARSE = f"""WITH {STREAM}, b AS (SELECT file_id, ord, {", ".join(f"{byte(i)} AS b{i}" for i in range(9))} FROM stream),
f AS (SELECT *, b0 % 2 * 256 + b1 % 3 AS width, b2 % 9 AS height, [1, 2, 4, 8, 16, 3][b3 % 6 + 1] AS depth, b4 % 7 AS color FROM b)
SELECT file_id, ord, CASE WHEN b8 % 10 = 0 THEN 'InvalidImageHeaderLength' WHEN width = 0 OR height = 0 THEN 'InvalidDimensions' WHEN color NOT IN (0, 2, 3, 4, 6) THEN 'InvalidColorType'
WHEN NOT (CASE color WHEN 0 THEN depth IN (1, 2, 4, 8, 16) WHEN 3 THEN depth IN (1, 2, 4, 8) ELSE depth IN (8, 16) END) THEN 'InvalidBitDepth' WHEN b5 % 8 = 0 THEN 'InvalidCompressionMethod'
WHEN b6 % 8 = 0 THEN 'InvalidFilterMethod' WHEN b7 % 3 > 1 THEN 'InvalidInterlaceMethod' END AS error FROM f"""
