"""Parsers of fixed-layout chunks as column expressions: each gives an error code (null if the data is good) and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import keyword_is_valid, uint

LENGTH, DATA = "InvalidChunkLength", "InvalidChunkData"
#: Where typed chunks stand in a written file.
WRITING_ORDER = "cICP iCCP sRGB gAMA cHRM PLTE tRNS pHYs eXIf tIME tEXt zTXt iTXt IDAT IEND".split()


def checked(data: Column, length: int | None, good: Column) -> Column:
    wrong = F.octet_length(data) != length if length else F.lit(False)
    return F.when(wrong, LENGTH).when(~good, DATA)


def header_error(data: Column) -> Column:
    """The first rule that a header's bytes break."""
    depth, color = uint(data, 8, 1), uint(data, 9, 1)
    fits = lambda n: n.between(1, 2**31 - 1)
    allowed = F.when(color == 0, depth.isin(1, 2, 4, 8, 16)).when(color == 3, depth.isin(1, 2, 4, 8)).otherwise(depth.isin(8, 16))
    return (
        F.when(F.octet_length(data) != 13, "InvalidImageHeaderLength")
        .when(~(fits(uint(data, 0, 4)) & fits(uint(data, 4, 4))), "InvalidDimensions")
        .when(~color.isin(0, 2, 3, 4, 6), "InvalidColorType")
        .when(~allowed, "InvalidBitDepth")
        .when(uint(data, 10, 1) != 0, "InvalidCompressionMethod")
        .when(uint(data, 11, 1) != 0, "InvalidFilterMethod")
        .when(uint(data, 12, 1) > 1, "InvalidInterlaceMethod")
    )


def header(content: Column) -> Column:
    """The header fields at their fixed places in a file's bytes; no more of the file is looked at."""
    names = ("width", 16, 4), ("height", 20, 4), ("bit_depth", 24, 1), ("color_type", 25, 1), ("interlace", 28, 1)
    return F.struct(*[uint(content, at, n).alias(name) for name, at, n in names])


def gamma(data: Column) -> tuple[Column, Column]:
    return checked(data, 4, uint(data, 0, 4) != 0), uint(data, 0, 4) / 100000


def chromaticities(data: Column) -> tuple[Column, Column]:
    return checked(data, 32, F.lit(True)), F.array(*[uint(data, 4 * i, 4) for i in range(8)])


def rendering_intent(data: Column) -> tuple[Column, Column]:
    return checked(data, 1, uint(data, 0, 1) <= 3), uint(data, 0, 1)


def physical(data: Column) -> tuple[Column, Column]:
    """Dots per inch where the unit is the meter."""
    inch = lambda at: F.when(uint(data, 8, 1) == 1, uint(data, at, 4) * F.lit(0.0254))
    return checked(data, 9, uint(data, 8, 1) <= 1), F.struct(uint(data, 0, 4).alias("x"), uint(data, 4, 4).alias("y"), uint(data, 8, 1).alias("unit"), inch(0).alias("dpi_x"), inch(4).alias("dpi_y"))


def time(data: Column) -> tuple[Column, Column]:
    """Integers, not a timestamp: a second of 60 is legal, and days aren't checked against months."""
    parts = [uint(data, i, 1) for i in range(2, 7)]
    good = parts[0].between(1, 12) & parts[1].between(1, 31) & (parts[2] <= 23) & (parts[3] <= 59) & (parts[4] <= 60)
    names = ("month", "day", "hour", "minute", "second")
    return checked(data, 7, good), F.struct(uint(data, 0, 2).alias("year"), *[p.alias(n) for p, n in zip(parts, names)])


def code_points(data: Column) -> tuple[Column, Column]:
    return checked(data, 4, (uint(data, 2, 1) == 0) & (uint(data, 3, 1) <= 1)), F.array(*[uint(data, i, 1) for i in range(4)])


def exif(data: Column) -> tuple[Column, Column]:
    head = F.hex(F.substring(data, 1, 4))
    little = head == "49492A00"
    error = F.when(F.octet_length(data) < 8, LENGTH).when(~(little | (head == "4D4D002A")), DATA)
    return error, F.when(little, "LittleEndian").otherwise("BigEndian")


def animation_control(data: Column) -> tuple[Column, Column]:
    """acTL: how many frames, and how often they play (0: for ever)."""
    return checked(data, 8, uint(data, 0, 4) != 0), F.struct(uint(data, 0, 4).alias("frames"), uint(data, 4, 4).alias("plays"))


def frame_control(data: Column) -> tuple[Column, Column]:
    """fcTL: a frame's place in the sequence, area, delay and operations."""
    names = ("sequence", 0, 4), ("width", 4, 4), ("height", 8, 4), ("x", 12, 4), ("y", 16, 4), ("delay_num", 20, 2), ("delay_den", 22, 2), ("dispose", 24, 1), ("blend", 25, 1)
    fits = lambda at: uint(data, at, 4).between(1, 2**31 - 1)
    error = checked(data, 26, (uint(data, 24, 1) <= 2) & (uint(data, 25, 1) <= 1))
    return F.coalesce(error, F.when(~(fits(4) & fits(8)), "InvalidDimensions")), F.struct(*[uint(data, at, n).alias(name) for name, at, n in names])


def is_empty(metadata: Column, names: list[str]) -> Column:
    """Whether a struct of typed metadata with these fields has none."""
    empty = lambda f: F.size(F.coalesce(metadata[f], F.array())) == 0 if f == "text" else metadata[f].isNull()
    every = F.lit(True)
    for name in names:
        every = every & empty(name)
    return F.coalesce(metadata.isNull() | every, F.lit(True))


def plain_text(data: Column) -> tuple[Column, Column]:
    """tEXt: a keyword, a zero byte and Latin-1 text."""
    text = F.decode(data, "ISO-8859-1")
    mark = F.instr(text, "\0")
    keyword = F.substring(text, F.lit(1), mark - 1)
    rest = F.substring(text, mark + 1, F.length(text))
    return F.when((mark == 0) | ~keyword_is_valid(keyword), DATA), F.struct(keyword.alias("keyword"), rest.alias("text"))


def international_text(data: Column) -> tuple[Column, Column]:
    """iTXt without compression: keyword, flag, method, language, translated keyword, UTF-8 text."""
    code = F.hex(data)

    def field(text: Column, n: int) -> Column:
        return F.element_at(F.split(text, "\0", -1), n)

    latin = F.decode(data, "ISO-8859-1")
    mark = F.instr(latin, "\0")
    keyword = F.substring(latin, F.lit(1), mark - 1)
    flags = F.substring(code, 2 * mark + 1, F.lit(4))
    tail = F.substring(data, mark + 3, F.octet_length(data))
    text = F.decode(tail, "UTF-8")
    good = (mark > 0) & keyword_is_valid(keyword) & (flags == "0000") & (F.size(F.split(F.decode(tail, "ISO-8859-1"), "\0", -1)) >= 3) & F.is_valid_utf8(tail)
    body = F.regexp_replace(text, "(?s)^[^\\x00]*\\x00[^\\x00]*\\x00", "")
    return F.when(~good, DATA), F.struct(keyword.alias("keyword"), field(text, 1).alias("language"), field(text, 2).alias("translated"), body.alias("text"))


def palette_error(data: Column, color_type: Column, depth: Column) -> Column:
    n = F.octet_length(data)
    return (
        F.when(color_type.isin(0, 4), "UnexpectedPalette")
        .when((n == 0) | (n % 3 != 0) | (n > 768), "InvalidPaletteLength")
        .when((color_type == 3) & (n / 3 > F.pow(F.lit(2), depth)), "TooManyPaletteEntries")
    )


def palette_entries(data: Column) -> Column:
    count = F.floor(F.octet_length(data) / 3).cast("int")
    entry = lambda i: F.struct(*[F.conv(F.hex(F.substring(data, i * 3 + c, F.lit(1))), 16, 10).cast("int").alias(n) for c, n in ((1, "r"), (2, "g"), (3, "b"))])
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), entry))


def transparency_error(data: Column, color_type: Column, palette_size: Column) -> Column:
    """palette_size: entries read so far, 0 for none."""
    n = F.octet_length(data)
    return (
        F.when(color_type.isin(4, 6), "UnexpectedTransparency")
        .when((color_type == 3) & (palette_size == 0), "TransparencyBeforePalette")
        .when((color_type == 3) & (n == 0), "InvalidTransparencyLength")
        .when((color_type == 3) & (n > palette_size), "TooManyTransparencyEntries")
        .when((color_type == 0) & (n != 2), "InvalidTransparencyLength")
        .when((color_type == 2) & (n != 6), "InvalidTransparencyLength")
    )


def transparency_values(data: Column, color_type: Column, depth: Column) -> Column:
    """Of good data: the key's samples, cut to the file's depth, or the alpha of each palette entry."""
    sample = lambda i: uint(data, 2 * i, 2).bitwiseAND((F.pow(F.lit(2), depth) - 1).cast("long"))
    alphas = F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long"))
    return F.when(color_type == 0, F.array(sample(0))).when(color_type == 2, F.array(*map(sample, range(3)))).otherwise(alphas)


def in_writing_order(types: DataFrame) -> DataFrame:
    """types has file_id, type: the types of each file in the order they are written."""
    rank = F.array_position(F.array(*map(F.lit, WRITING_ORDER)), F.col("type"))
    ranked = types.withColumn("rank", rank).where("rank > 0").groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("rank", "type"))).alias("o"))
    return ranked.select("file_id", F.array_join("o.type", " ").alias("written"))
