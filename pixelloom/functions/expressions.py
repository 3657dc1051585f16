"""The format's arithmetic as column expressions, all inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uint(data: Column | str, start: int, length: int) -> Column:
    """The big-endian number in bytes start to start + length of a binary column."""
    column = F.col(data) if isinstance(data, str) else data
    return F.conv(F.hex(F.substring(column, start + 1, length)), 16, 10).cast("long")


def to_bytes(value: Column, length: int) -> Column:
    """A number as big-endian bytes."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * length, "0"))


def channels(color_type: Column) -> Column:
    return F.when(color_type == 2, 3).when(color_type == 4, 2).when(color_type == 6, 4).otherwise(1)


def row_bytes(width: Column, bits_per_pixel: Column) -> Column:
    return F.floor((width.cast("long") * bits_per_pixel + 7) / 8).cast("long")


def filter_bpp(bits_per_pixel: Column) -> Column:
    return F.floor((bits_per_pixel + 7) / 8).cast("int")


def scale_to_8(value: Column, depth: Column) -> Column:
    """16 bits keep their high byte; fewer than 8 stretch to the whole range."""
    stretched = F.floor(value * 255 / (F.shiftleft(F.lit(1), 0) * F.pow(F.lit(2), depth) - 1)).cast("int")
    return F.when(depth == 16, F.shiftright(value, 8)).when(depth == 8, value).otherwise(stretched).cast("int")


def sample_at(row: Column, index: Column, depth: Column) -> Column:
    """A sample of a packed row: most significant bits first, 16 bits big-endian."""
    bit = index * depth
    byte = F.conv(F.hex(F.substring(row, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    wide = F.conv(F.hex(F.substring(row, (index * 2 + 1).cast("int"), F.lit(2))), 16, 10).cast("int")
    shifted = F.floor(byte / F.pow(F.lit(2), 8 - depth - F.pmod(bit, F.lit(8)))).cast("int")
    return F.when(depth == 16, wide).otherwise(F.pmod(shifted, F.pow(F.lit(2), depth).cast("int"))).cast("int")


def paeth(a: Column, b: Column, c: Column) -> Column:
    pa, pb, pc = F.abs(b - c), F.abs(a - c), F.abs(a + b - 2 * c)
    return F.when((pa <= pb) & (pa <= pc), a).when(pb <= pc, b).otherwise(c)


def prediction(kind: Column, a: Column, b: Column, c: Column) -> Column:
    """What a filter expects at a byte from its left, upper and corner neighbours."""
    return F.when(kind == 1, a).when(kind == 2, b).when(kind == 3, F.shiftright(a + b, 1)).when(kind == 4, paeth(a, b, c)).otherwise(0)


def letter_is_upper(chunk_type: Column, place: int) -> Column:
    return F.ascii(F.substring(chunk_type, place, 1)).between(65, 90)


def is_chunk_type(chunk_type: Column) -> Column:
    return chunk_type.rlike("^[A-Za-z]{4}$")


def is_critical(chunk_type: Column) -> Column:
    return letter_is_upper(chunk_type, 1)


def is_public(chunk_type: Column) -> Column:
    return letter_is_upper(chunk_type, 2)


def is_reserved_bit_valid(chunk_type: Column) -> Column:
    return letter_is_upper(chunk_type, 3)


def is_safe_to_copy(chunk_type: Column) -> Column:
    return ~letter_is_upper(chunk_type, 4)


def chunk_crc(chunk_type: Column, data: Column) -> Column:
    return F.crc32(F.concat(F.encode(chunk_type, "US-ASCII"), data))


def chunk_bytes(chunk_type: Column, data: Column) -> Column:
    """A whole chunk: length, type, data, checksum."""
    return F.concat(to_bytes(F.octet_length(data), 4), F.encode(chunk_type, "US-ASCII"), data, to_bytes(chunk_crc(chunk_type, data), 4))


def delay_seconds(numerator: Column, denominator: Column) -> Column:
    return numerator / F.when(denominator == 0, 100).otherwise(denominator)


def printable(text: Column) -> Column:
    return ~text.rlike("[^ -~\\u00a1-\\u00ff]")


def keyword_is_valid(keyword: Column) -> Column:
    return F.length(keyword).between(1, 79) & printable(keyword) & ~keyword.rlike("^ | $|  ")


def zlib_head(level: Column, dynamic: Column) -> Column:
    """The two bytes that begin a zlib stream, as a number."""
    speed = F.when(~dynamic | (level < 2), 0).when(level < 6, 1).when(level == 6, 2).otherwise(3)
    head = F.lit(0x7800) + speed * 64
    return (head + F.pmod(31 - F.pmod(head, F.lit(31)), F.lit(31))).cast("int")


def blend_over(below: Column, above: Column) -> Column:
    """Straight-alpha compositing of two struct<r,g,b,a> of ints, rounded to nearest."""
    weight = above["a"] * 255
    rest = below["a"] * (255 - above["a"])
    total = weight + rest
    mixed = [F.floor((above[c] * weight + below[c] * rest + F.floor(total / 2)) / total).cast("int").alias(c) for c in "rgb"]
    over = F.struct(*mixed, F.floor((total + 127) / 255).cast("int").alias("a"))
    return F.when(above["a"] == 0, below).when(above["a"] == 255, above).otherwise(over)
