"""File-grain kernels: one PNG byte string or raster at a time, with NumPy and zlib and without Spark.

They run inside Arrow batches where the format is sequential (chunk framing, DEFLATE, reconstruction of rows).
Everything that isn't is written a second time as column expressions in pixelloom.operators.
"""

from __future__ import annotations

import os
import re
import zlib
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np

# Fixed values of the format.
SIGNATURE = bytes.fromhex("89504E470D0A1A0A")
GRAY, RGB, INDEXED, GRAY_ALPHA, RGBA = 0, 2, 3, 4, 6
CHANNELS = {GRAY: 1, RGB: 3, INDEXED: 1, GRAY_ALPHA: 2, RGBA: 4}
DEPTHS = {GRAY: (1, 2, 4, 8, 16), RGB: (8, 16), INDEXED: (1, 2, 4, 8), GRAY_ALPHA: (8, 16), RGBA: (8, 16)}
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))  # x0, y0, dx, dy
KNOWN_CHUNKS = ("IHDR PLTE IDAT IEND tRNS gAMA cHRM sRGB iCCP cICP pHYs tIME tEXt zTXt iTXt eXIf acTL fcTL fdAT").split()
MAX_LENGTH = 2**31 - 1
TEXT_MAX, PROFILE_MAX = 8_000_000, 16_000_000
SEGMENT = 1 << 20
SMALL_IMAGE = 16 * 1024
BEFORE_PALETTE, BEFORE_IMAGE, AFTER_IMAGE = "BeforePalette", "BeforeImageData", "AfterImageData"


class PngError(Exception):
    """One of the format's errors: a code and its payload."""

    def __init__(self, code: str, **detail):
        super().__init__(code, detail)
        self.code, self.detail = code, {k: str(v) for k, v in detail.items()}


# Headers and sizes


@dataclass(frozen=True)
class Header:
    width: int
    height: int
    bit_depth: int
    color_type: int
    interlace: int = 0

    @property
    def channels(self) -> int:
        return CHANNELS[self.color_type]

    @property
    def bits_per_pixel(self) -> int:
        return self.channels * self.bit_depth

    @property
    def filter_bpp(self) -> int:
        return -(-self.bits_per_pixel // 8)

    def row_bytes(self, width: int) -> int:
        return -(-width * self.bits_per_pixel // 8)

    @property
    def stride(self) -> int:
        return self.row_bytes(self.width)

    @property
    def image_size(self) -> int:
        size = self.stride * self.height
        if size >= 1 << 63:
            raise PngError("ImageTooLarge")
        return size

    def passes(self) -> list[tuple[int, int, int, int, int, int]]:
        """(x0, y0, dx, dy, width, height) of the passes that have pixels; without interlacing, of the whole."""
        if not self.interlace:
            return [(0, 0, 1, 1, self.width, self.height)]
        sized = [(*p, max(0, -(-(self.width - p[0]) // p[2])), max(0, -(-(self.height - p[1]) // p[3]))) for p in ADAM7]
        return [p for p in sized if p[4] and p[5]]

    @property
    def scanline_size(self) -> int:
        size = sum((self.row_bytes(w) + 1) * h for *_, w, h in self.passes())
        if size >= (1 << 63) - 1:  # what a buffer can be asked for
            raise PngError("ImageTooLarge")
        return size

    def data(self) -> bytes:
        return self.width.to_bytes(4, "big") + self.height.to_bytes(4, "big") + bytes([self.bit_depth, self.color_type, 0, 0, self.interlace])


def check_dimensions(width: int, height: int) -> None:
    if not (0 < width <= MAX_LENGTH and 0 < height <= MAX_LENGTH):
        raise PngError("InvalidDimensions", width=width, height=height)


def check_depth(depth: int, color_type: int) -> None:
    if depth not in DEPTHS[color_type]:
        raise PngError("InvalidBitDepth", color_type=color_type, bit_depth=depth)


def parse_header(data: bytes) -> Header:
    if len(data) != 13:
        raise PngError("InvalidImageHeaderLength", length=len(data))
    width, height = int.from_bytes(data[:4], "big"), int.from_bytes(data[4:8], "big")
    check_dimensions(width, height)
    depth, color, compression, filtering, interlace = data[8:]
    if color not in CHANNELS:
        raise PngError("InvalidColorType", value=color)
    check_depth(depth, color)
    for value, code, allowed in ((compression, "InvalidCompressionMethod", 0), (filtering, "InvalidFilterMethod", 0), (interlace, "InvalidInterlaceMethod", 1)):
        if value > allowed:
            raise PngError(code, value=value)
    return Header(width, height, depth, color, interlace)


# Chunks


@dataclass(frozen=True)
class Chunk:
    type: str
    data: bytes
    crc: int
    position: str | None = None


def is_critical(chunk_type: str) -> bool:
    return chunk_type[0].isupper()


def is_safe_to_copy(chunk_type: str) -> bool:
    return not chunk_type[3].isupper()


def scan(content: bytes, validate_crc: bool = True):
    """The chunks of a file, whatever they are and to its very end."""
    if content[:8] != SIGNATURE:
        raise PngError("UnexpectedEndOfInput" if SIGNATURE.startswith(content[:8]) else "InvalidSignature")
    at = 8

    def take(n: int) -> bytes:
        nonlocal at
        part = content[at : at + n]
        if len(part) < n:
            raise PngError("UnexpectedEndOfInput")
        at += n
        return part

    while at < len(content):
        length = int.from_bytes(take(4), "big")
        if length > MAX_LENGTH:
            raise PngError("ChunkTooLong", length=length)
        name = take(4)
        if not re.fullmatch(rb"[A-Za-z]{4}", name):
            raise PngError("InvalidChunkType", bytes=name.hex())
        data = take(length)
        stored = int.from_bytes(take(4), "big")
        if validate_crc and (actual := zlib.crc32(name + data)) != stored:
            raise PngError("CrcMismatch", expected=stored, actual=actual)
        yield Chunk(name.decode(), data, stored)


def read_header(content: bytes, validate_crc: bool = True) -> Header:
    first = next(iter(scan(content, validate_crc)), None)
    if first is None or first.type != "IHDR":
        raise PngError("MissingImageHeader")
    return parse_header(first.data)


def parse_palette(data: bytes, header: Header) -> bytes:
    if header.color_type in (GRAY, GRAY_ALPHA):
        raise PngError("UnexpectedPalette", color_type=header.color_type)
    if not data or len(data) % 3 or len(data) > 768:
        raise PngError("InvalidPaletteLength", length=len(data))
    if header.color_type == INDEXED and len(data) // 3 > 1 << header.bit_depth:
        raise PngError("TooManyPaletteEntries", entries=len(data) // 3, bit_depth=header.bit_depth)
    return data


@dataclass(frozen=True)
class Transparency:
    """kind: gray or rgb with key samples, or palette with alpha bytes."""

    kind: str
    values: tuple[int, ...]

    def data(self) -> bytes:
        return bytes(self.values) if self.kind == "palette" else b"".join(v.to_bytes(2, "big") for v in self.values)


def parse_transparency(data: bytes, header: Header, palette: bytes | None) -> Transparency:
    if header.color_type in (GRAY_ALPHA, RGBA):
        raise PngError("UnexpectedTransparency", color_type=header.color_type)
    if header.color_type == INDEXED:
        if not palette:
            raise PngError("TransparencyBeforePalette")
        if not data:
            raise PngError("InvalidTransparencyLength", color_type=header.color_type, length=0)
        if len(data) > len(palette) // 3:
            raise PngError("TooManyTransparencyEntries", entries=len(data), palette_entries=len(palette) // 3)
        return Transparency("palette", tuple(data))
    if len(data) != 2 * header.channels:
        raise PngError("InvalidTransparencyLength", color_type=header.color_type, length=len(data))
    mask = (1 << header.bit_depth) - 1
    return Transparency("gray" if header.color_type == GRAY else "rgb", tuple(int.from_bytes(data[i : i + 2], "big") & mask for i in range(0, len(data), 2)))


# Metadata


def _exact(kind: str, data: bytes, length: int) -> None:
    if len(data) != length:
        raise PngError("InvalidChunkLength", chunk_type=kind, length=len(data))


def _require(kind: str, holds: bool) -> None:
    if not holds:
        raise PngError("InvalidChunkData", chunk_type=kind)


def _u32s(data: bytes) -> list[int]:
    return np.frombuffer(data, ">u4").tolist()


def printable(keyword: str) -> bool:
    return all(32 <= ord(c) <= 126 or 161 <= ord(c) <= 255 for c in keyword)


def check_keyword(kind: str, keyword: str) -> None:
    _require(kind, 1 <= len(keyword) <= 79 and printable(keyword) and keyword == keyword.strip(" ") and "  " not in keyword)


def _split(kind: str, data: bytes) -> tuple[bytes, bytes]:
    head, mark, rest = data.partition(b"\0")
    _require(kind, bool(mark))
    return head, rest


def _keyword(kind: str, data: bytes) -> tuple[str, bytes]:
    head, rest = _split(kind, data)
    check_keyword(kind, keyword := head.decode("latin-1"))
    return keyword, rest


def bounded_inflate(kind: str, data: bytes, most: int) -> bytes:
    stream = zlib.decompressobj()
    try:
        out = stream.decompress(data, most + 1)
    except zlib.error:
        raise PngError("InvalidChunkData", chunk_type=kind) from None
    if len(out) > most:
        raise PngError("TextTooLong", chunk_type=kind, max_size=most)
    _require(kind, stream.eof)
    return out


def _utf8(kind: str, data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        raise PngError("InvalidChunkData", chunk_type=kind) from None


def parse_known(kind: str, data: bytes) -> dict:
    """The typed value of a known ancillary chunk."""
    if kind == "gAMA":
        _exact(kind, data, 4)
        (value,) = _u32s(data)
        _require(kind, value != 0)
        return {"gamma": value}
    if kind == "cHRM":
        _exact(kind, data, 32)
        return {"chromaticities": _u32s(data)}
    if kind == "sRGB":
        _exact(kind, data, 1)
        _require(kind, data[0] <= 3)
        return {"srgb": data[0]}
    if kind == "pHYs":
        _exact(kind, data, 9)
        _require(kind, data[8] <= 1)
        return {"phys": [*_u32s(data[:8]), data[8]]}
    if kind == "tIME":
        _exact(kind, data, 7)
        year, (month, day, hour, minute, second) = int.from_bytes(data[:2], "big"), data[2:]
        _require(kind, 1 <= month <= 12 and 1 <= day <= 31 and hour <= 23 and minute <= 59 and second <= 60)
        return {"time": [year, month, day, hour, minute, second]}
    if kind == "cICP":
        _exact(kind, data, 4)
        _require(kind, data[2] == 0 and data[3] <= 1)
        return {"cicp": list(data)}
    if kind == "eXIf":
        if len(data) < 8:
            _exact(kind, data, 8)
        _require(kind, data[:4] in (b"II*\0", b"MM\0*"))
        return {"exif": data}
    if kind == "iCCP":
        name, rest = _keyword(kind, data)
        _require(kind, rest[:1] == b"\0")
        return {"icc": (name, bounded_inflate(kind, rest[1:], PROFILE_MAX))}
    keyword, rest = _keyword(kind, data)
    text = {"kind": kind, "keyword": keyword, "language": "", "translated": "", "compressed": kind == "zTXt"}
    if kind == "tEXt":
        return {"text": text | {"text": rest.decode("latin-1")}}
    if kind == "zTXt":
        _require(kind, rest[:1] == b"\0")
        return {"text": text | {"text": bounded_inflate(kind, rest[1:], TEXT_MAX).decode("latin-1")}}
    _require(kind, len(rest) >= 2 and rest[0] <= 1 and rest[1] == 0)
    language, tail = _split(kind, rest[2:])
    translated, body = _split(kind, tail)
    text |= {"language": language.decode("latin-1"), "translated": _utf8(kind, translated), "compressed": rest[0] == 1}
    return {"text": text | {"text": _utf8(kind, bounded_inflate(kind, body, TEXT_MAX) if rest[0] else body)}}


PARSED = {"gAMA": "gamma", "cHRM": "chromaticities", "sRGB": "srgb", "pHYs": "phys", "tIME": "time", "cICP": "cicp", "eXIf": "exif", "iCCP": "icc", "tEXt": "text", "zTXt": "text", "iTXt": "text"}
COLOR_CHUNKS, PLACED_CHUNKS = ("gAMA", "cHRM", "sRGB", "iCCP", "cICP"), ("pHYs", "eXIf")


def add_metadata(metadata: dict, chunk: Chunk, position: str) -> None:
    kind = chunk.type
    if kind in COLOR_CHUNKS and position != BEFORE_PALETTE or kind in PLACED_CHUNKS and position == AFTER_IMAGE:
        raise PngError("MisplacedChunk", chunk_type=kind)
    slot = PARSED.get(kind)
    if slot is None:
        return
    if slot != "text" and slot in metadata:
        raise PngError("DuplicateChunk", chunk_type=kind)
    value = parse_known(kind, chunk.data)[slot]
    if slot == "text":
        metadata.setdefault("text", []).append(value)
    else:
        metadata[slot] = value


def metadata_chunks(metadata: dict, level: int = 6) -> list[tuple[str, bytes, bool]]:
    """(type, data, whether it goes before the palette) of typed metadata, in writing order."""
    u32 = lambda *v: b"".join(x.to_bytes(4, "big") for x in v)
    out = []
    if "cicp" in metadata:
        out.append(("cICP", bytes(metadata["cicp"]), True))
    if "icc" in metadata:
        name, profile = metadata["icc"]
        out.append(("iCCP", name.encode("latin-1") + b"\0\0" + zlib.compress(profile, level), True))
    if "srgb" in metadata:
        out.append(("sRGB", bytes([metadata["srgb"]]), True))
    if "gamma" in metadata:
        out.append(("gAMA", u32(metadata["gamma"]), True))
    if "chromaticities" in metadata:
        out.append(("cHRM", u32(*metadata["chromaticities"]), True))
    if "phys" in metadata:
        out.append(("pHYs", u32(*metadata["phys"][:2]) + bytes([metadata["phys"][2]]), False))
    if "exif" in metadata:
        out.append(("eXIf", bytes(metadata["exif"]), False))
    if "time" in metadata:
        out.append(("tIME", metadata["time"][0].to_bytes(2, "big") + bytes(metadata["time"][1:]), False))
    for text in metadata.get("text", []):
        head = text["keyword"].encode("latin-1") + b"\0"
        if text["kind"] == "tEXt":
            out.append(("tEXt", head + text["text"].encode("latin-1"), False))
        elif text["kind"] == "zTXt":
            out.append(("zTXt", head + b"\0" + zlib.compress(text["text"].encode("latin-1"), level), False))
        else:
            body = text["text"].encode()
            flag = bytes([int(text["compressed"]), 0])
            out.append(("iTXt", head + flag + text["language"].encode("latin-1") + b"\0" + text["translated"].encode() + b"\0" + (zlib.compress(body, level) if text["compressed"] else body), False))
    return out


def check_metadata(metadata: dict) -> None:
    if "icc" in metadata:
        check_keyword("iCCP", metadata["icc"][0])
    if "time" in metadata:
        _, month, day, hour, minute, second = metadata["time"]
        _require("tIME", 1 <= month <= 12 and 1 <= day <= 31 and 0 <= hour <= 23 and 0 <= minute <= 59 and 0 <= second <= 60)
    for text in metadata.get("text", []):
        kind = text["kind"]
        check_keyword(kind, text["keyword"])
        _require(kind, "\0" not in text["text"])
        if kind == "iTXt":
            _require(kind, re.fullmatch(r"[A-Za-z0-9-]*", text["language"]) is not None and "\0" not in text["translated"])
        else:
            _require(kind, all(ord(c) < 256 for c in text["text"]))


# Reading a file


@dataclass
class Options:
    """Of decoding. Metadata and raw chunks are kept unless turned off, as in a DataFrame a column that nobody selects
    costs little; errors in ancillary chunks skip the chunk unless strict."""

    validate_crc: bool = True
    preserve_metadata: bool = True
    preserve_chunks: bool = True
    strict_ancillary: bool = False


@dataclass
class File:
    header: Header
    palette: bytes | None = None
    transparency: Transparency | None = None
    metadata: dict = field(default_factory=dict)
    ancillary: list[Chunk] = field(default_factory=list)
    chunks: list[Chunk] = field(default_factory=list)  # all after IHDR, up to IEND
    animation: tuple[int, int, list] | None = None  # frames, plays and the frames' controls

    @property
    def image_data(self) -> bytes:
        return b"".join(c.data for c in self.chunks if c.type == "IDAT")


def read_file(content: bytes, options: Options = Options()) -> File:
    """Header, checked chunk sequence, palette, transparency and metadata; image data stays as it is."""
    chunks = scan(content, options.validate_crc)
    first = next(chunks, None)
    if first is None or first.type != "IHDR":
        raise PngError("MissingImageHeader")
    file = File(parse_header(first.data))
    runs = 0  # of image data begun
    inside = False
    for chunk in chunks:
        if chunk.type != "IDAT":
            inside = False
        position = AFTER_IMAGE if runs else BEFORE_IMAGE if file.palette else BEFORE_PALETTE
        chunk = replace(chunk, position=position)
        file.chunks.append(chunk)
        if options.preserve_chunks and not is_critical(chunk.type):
            file.ancillary.append(chunk)
        if chunk.type == "PLTE":
            if file.transparency and not runs:
                raise PngError("TransparencyBeforePalette")
            if runs or file.palette:
                raise PngError("PaletteAfterImageData" if runs else "DuplicatePalette")
            file.palette = parse_palette(chunk.data, file.header)
        elif chunk.type == "tRNS":
            if runs or file.transparency:
                raise PngError("TransparencyAfterImageData" if runs else "DuplicateTransparency")
            file.transparency = parse_transparency(chunk.data, file.header, file.palette)
        elif chunk.type == "IDAT":
            if runs and not inside:
                raise PngError("NonConsecutiveImageData")
            if not runs and file.header.color_type == INDEXED and not file.palette:
                raise PngError("MissingPalette")
            runs, inside = 1, True
        elif chunk.type == "IEND":
            if not runs:
                raise PngError("MissingImageData")
            return file
        elif options.preserve_metadata:
            try:
                add_metadata(file.metadata, chunk, position)
            except PngError:
                if options.strict_ancillary:
                    raise
    raise PngError("MissingImageEnd")


def read_chunks(content: bytes, options: Options = Options()) -> File:
    """read_file() with all chunks from IHDR on, metadata whatever the options say, and the animation's controls. An
    animation that is laid out wrong is none, or with strict_ancillary an error; its data is not inflated."""
    file = read_file(content, replace(options, preserve_metadata=True))
    try:
        plays, _, frames = animation_layout(file)
        file.animation = len(frames), plays, [control for control, _ in frames]
    except PngError as e:
        if options.strict_ancillary and e.code != "NotAnimated":
            raise
    first = next(scan(content, options.validate_crc))
    file.chunks.insert(0, replace(first, position=BEFORE_PALETTE))
    return file


def inflate(data: bytes, expected: int) -> bytes:
    """Exactly the expected bytes, and the stream's end."""
    stream = zlib.decompressobj()
    try:
        out = stream.decompress(data, expected + 1)
    except zlib.error as e:
        raise PngError("Decompression", reason=e) from None
    if len(out) > expected:
        raise PngError("ImageDataTooLong", expected=expected)
    if not stream.eof:
        if len(out) == expected:
            try:
                more = stream.decompress(stream.unconsumed_tail, 1)
            except zlib.error as e:
                raise PngError("Decompression", reason=e) from None
            if more:
                raise PngError("ImageDataTooLong", expected=expected)
        if not stream.eof:
            raise PngError("Decompression", reason="the stream has no end")
    if len(out) < expected:
        raise PngError("ImageDataTooShort", expected=expected, actual=len(out))
    return out


# Row filters


def paeth(a, b, c):
    """The neighbour nearest a + b - c: left, then above, then corner where they tie."""
    pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))


def rows_of(rows: list[list[int]]) -> np.ndarray:
    return np.array(rows, np.uint8)


def unfilter(raw: np.ndarray, bpp: int) -> np.ndarray:
    """Rows with a filter byte each to rows of plain bytes."""
    return np.ascontiguousarray(reconstruct(raw, bpp))


def reconstruct(raw: np.ndarray, bpp: int) -> np.ndarray:
    """unfilter() as a view of a larger array.

    None, Sub and Up rows follow from prefix sums. Between the first and the last row that predicts from reconstructed
    neighbours on both sides, anti-diagonals are independent, so they go one at a time for all those rows."""
    kinds, rows = raw[:, 0], raw[:, 1:]
    if kinds.max(initial=0) > 4:
        raise PngError("InvalidFilterType", value=int(kinds[kinds > 4][0]))
    height, size = rows.shape
    pixels = -(-size // bpp)
    if not kinds.any():
        return rows
    out = np.zeros((height + 1, pixels + 1, bpp), np.uint8)  # a row above and a pixel before of zeros; odd bytes filled up
    plain = out.reshape(height + 1, -1)[1:, bpp : bpp + size]  # whole rows move faster than pixels
    plain[...] = rows
    hard = np.flatnonzero(kinds >= 3)
    first, last = (int(hard[0]), int(hard[-1]) + 1) if len(hard) else (height, height)

    def easy(start: int, end: int) -> None:
        """Runs of one filter at a time; bytes wrap by themselves."""
        cuts = [start, *(np.flatnonzero(np.diff(kinds[start:end])) + start + 1).tolist(), end]
        for y, stop in zip(cuts, cuts[1:]):
            if kinds[y] == 1:
                np.cumsum(out[y + 1 : stop + 1, 1:], axis=1, dtype=np.uint8, out=out[y + 1 : stop + 1, 1:])
            elif kinds[y] == 2:
                np.cumsum(out[y : stop + 1, 1:], axis=0, dtype=np.uint8, out=out[y : stop + 1, 1:])

    if first:
        easy(0, first)
    band = max(1, LANE_BYTES // bpp)
    while band > 1 and band * (pixels + band) * bpp > BAND_BYTES:
        band //= 2
    for start in range(first, last, band):
        wavefront(out[start : min(start + band, last) + 1, 1:], kinds[start : min(start + band, last)])
    if last < height:
        easy(last, height)
    return plain


#: Bytes that wavefront() handles in one step at most, and of its buffer.
LANE_BYTES, BAND_BYTES = 16_384, 128 << 20
#: What a pixel of so many bytes is moved as.
PIXEL = {1: "u1", 2: "u2", 3: "V3", 4: "u4", 6: "V6", 8: "u8"}


def wavefront(rows: np.ndarray, kinds: np.ndarray) -> None:
    """Reconstructs rows (the first one plain, the others of the given filters) in place: (row, pixel, byte).

    The rows are moved into a skewed buffer, each one place on from the row above, so that pixels which depend on
    nothing but earlier ones (an anti-diagonal) lie side by side; they go at once, in plain byte operations."""
    count, width, bpp = rows.shape
    lane, steps = count * bpp, width + count
    skew = np.zeros((steps + 1, lane), np.uint8)  # a row of zeros before the first anti-diagonal
    places = np.lib.stride_tricks.as_strided(skew[1:].reshape(-1).view(PIXEL[bpp]), (count, width), (lane + bpp, lane))
    packed = rows.view(PIXEL[bpp])[..., 0]
    places[...] = packed
    every = np.repeat(np.append(0, kinds).astype(np.uint8), bpp)
    masks = [np.where(every == k, 255, 0).astype(np.uint8) for k in range(5)]
    used = [k for k in range(1, 5) if masks[k].any()]
    for t in range(1, steps):
        lo, hi = max(1, t - width + 1) * bpp, min(count, t + 1) * bpp
        if lo >= hi:
            continue
        a, b, c = skew[t, lo:hi], skew[t, lo - bpp : hi - bpp], skew[t - 1, lo - bpp : hi - bpp]
        here = skew[t + 1, lo:hi]
        for k in used:
            guess = a if k == 1 else b if k == 2 else (a & b) + ((a ^ b) >> 1) if k == 3 else nearest_byte(a, b, c)
            here += guess & masks[k][lo:hi] if len(used) > 1 or not masks[k][lo:hi].all() else guess
    packed[...] = places


def nearest_byte(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """paeth() within bytes: the distances of a and b from the estimate are |b - c| and |a - c|, and that of c is their
    sum where a and b lie on the same side of c (so that c is never nearest), else their difference."""
    to_a, to_b = np.maximum(b, c), np.maximum(a, c)
    to_a -= np.minimum(b, c)
    to_b -= np.minimum(a, c)
    to_c = np.maximum(to_a, to_b)
    to_c -= np.minimum(to_a, to_b)
    side = a >= c
    side ^= b < c  # the same side
    to_c |= np.negative(side.view(np.uint8))
    second = to_b <= to_c
    first = to_a <= to_b
    to_a = to_a <= to_c
    first &= to_a
    # c, then b instead of c, then a instead of either, by exclusive or
    out = b ^ c
    out &= np.negative(second.view(np.uint8))
    out ^= c
    swap = out ^ a
    swap &= np.negative(first.view(np.uint8))
    out ^= swap
    return out


def filtered(rows: np.ndarray, bpp: int) -> np.ndarray:
    """(filter, row, byte): every row under each of the five filters, from plain neighbours."""
    v = rows.astype(np.int32)
    a, b, c = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    a[:, bpp:] = v[:, :-bpp] if bpp < v.shape[1] else v[:, :0]
    b[1:] = v[:-1]
    c[1:] = a[:-1]
    return np.stack([v, v - a, v - b, v - ((a + b) >> 1), v - paeth(a, b, c)]).astype(np.uint8)


def filter_pass(rows: np.ndarray, bpp: int, strategy: str | int) -> bytes:
    """Rows with their filter bytes. strategy: a filter's number, or adaptive: the least sum of signed magnitudes."""
    options = filtered(rows, bpp)
    if strategy == "adaptive":
        kinds = np.abs(options.astype(np.int8).astype(np.int64)).sum(2).argmin(0)
    else:
        kinds = np.full(len(rows), strategy)
    out = np.empty((rows.shape[0], rows.shape[1] + 1), np.uint8)
    out[:, 0] = kinds
    out[:, 1:] = options[kinds, np.arange(len(rows))]
    return out.tobytes()


# Samples


def unpack(data: bytes | np.ndarray, width: int, height: int, depth: int, channels: int) -> np.ndarray:
    """Packed rows to (height, width, channels); bits that pad a row are dropped."""
    rows = np.frombuffer(data, np.uint8).reshape(height, -1) if isinstance(data, bytes) else data
    n = width * channels
    if depth == 16:
        return rows.reshape(height, n, 2).astype(np.uint16)[:, :, 0].reshape(height, width, channels) * np.uint16(256) + rows.reshape(height, n, 2)[:, :, 1].reshape(height, width, channels)
    if depth == 8:
        return rows.reshape(height, width, channels)
    bits = np.unpackbits(rows, axis=1)[:, : n * depth].reshape(height, n, depth)
    return (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8).reshape(height, width, channels)


def pack(samples: np.ndarray, depth: int) -> np.ndarray:
    """(height, width, channels) to packed rows, padded with zero bits."""
    height = samples.shape[0]
    flat = samples.reshape(height, -1)
    if depth == 16:
        return flat.astype(">u2").view(np.uint8).reshape(height, -1)
    if depth == 8:
        return flat.astype(np.uint8)
    bits = (flat[:, :, None] >> np.arange(depth - 1, -1, -1)) & 1
    return np.packbits(bits.astype(np.uint8).reshape(height, -1), axis=1)


def decode_samples(raw: bytes, header: Header) -> np.ndarray:
    """Inflated scanlines to (height, width, channels)."""
    data, at = np.frombuffer(raw, np.uint8), 0
    out = np.zeros((header.height, header.width, header.channels), np.uint16 if header.bit_depth == 16 else np.uint8)
    for x0, y0, dx, dy, width, height in header.passes():
        size = (header.row_bytes(width) + 1) * height
        rows = unfilter(data[at : at + size].reshape(height, -1), header.filter_bpp)
        out[y0::dy, x0::dx] = unpack(rows, width, height, header.bit_depth, header.channels)
        at += size
    return out


def decode(content: bytes, options: Options = Options()) -> tuple[File, bytes]:
    """A file and its pixels in their own format, rows packed."""
    file = read_file(content, options)
    return file, native_pixels(inflate(file.image_data, file.header.scanline_size), file.header)


def native_pixels(raw: bytes, header: Header) -> bytes:
    """Inflated scanlines to packed rows; without interlacing they need no unpacking."""
    if not header.interlace:
        return unfilter(np.frombuffer(raw, np.uint8).reshape(header.height, -1), header.filter_bpp).tobytes()  # contiguous first: that copies by rows
    return pack(decode_samples(raw, header), header.bit_depth).tobytes()


def to_bitmap(header: Header, data: bytes, palette: bytes | None, transparency: Transparency | None, alpha: bool = True) -> bytes:
    """RGBA8 or RGB8 pixels; what is that already stays as it is."""
    if header.bit_depth == 8 and header.color_type == (RGBA if alpha else RGB):
        return data
    depth, keyed = header.bit_depth, alpha and transparency is not None and header.color_type != INDEXED
    if depth == 16:  # the high bytes
        scaled = np.frombuffer(data, np.uint8).reshape(header.height, header.width, header.channels, 2)[..., 0]
    if depth < 16 or keyed:
        v = unpack(data, header.width, header.height, depth, header.channels)
    if header.color_type == INDEXED:
        entries = len(palette) // 3
        if (beyond := v[v >= entries]).size:
            raise PngError("PaletteIndexOutOfRange", index=int(beyond[0]), entries=entries)
        table = np.full((entries, 4), 255, np.uint8)
        table[:, :3] = np.frombuffer(palette, np.uint8).reshape(-1, 3)
        if transparency:
            table[: len(transparency.values), 3] = transparency.values
        return np.ascontiguousarray(table[:, : 4 if alpha else 3])[v[:, :, 0]].tobytes()
    if depth < 16:
        scaled = v if depth == 8 else (v.astype(np.uint16) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    out = np.empty((header.height, header.width, 4 if alpha else 3), np.uint8)
    has_alpha = header.color_type in (GRAY_ALPHA, RGBA)
    for place in range(3):
        out[..., place] = scaled[..., place if header.color_type in (RGB, RGBA) else 0]
    if alpha:
        out[..., 3] = scaled[..., -1] if has_alpha else 255
        if keyed:  # at the file's own depth
            out[..., 3][(v == np.array(transparency.values)).all(2)] = 0
    return out.tobytes()


# Animation


@dataclass(frozen=True)
class Control:
    sequence: int
    width: int
    height: int
    x: int
    y: int
    delay_num: int
    delay_den: int
    dispose: int
    blend: int

    def data(self, sequence: int | None = None) -> bytes:
        words = (self.sequence if sequence is None else sequence, self.width, self.height, self.x, self.y)
        return b"".join(v.to_bytes(4, "big") for v in words) + self.delay_num.to_bytes(2, "big") + self.delay_den.to_bytes(2, "big") + bytes([self.dispose, self.blend])

    def fits(self, header: Header) -> bool:
        return self.x + self.width <= header.width and self.y + self.height <= header.height

    def covers(self, header: Header) -> bool:
        return (self.x, self.y, self.width, self.height) == (0, 0, header.width, header.height)


def parse_animation_control(data: bytes) -> tuple[int, int]:
    _exact("acTL", data, 8)
    frames, plays = _u32s(data)
    _require("acTL", frames != 0)
    return frames, plays


def parse_frame_control(data: bytes) -> Control:
    _exact("fcTL", data, 26)
    _require("fcTL", data[24] <= 2 and data[25] <= 1)
    sequence, width, height, x, y = _u32s(data[:20])
    check_dimensions(width, height)
    return Control(sequence, width, height, x, y, int.from_bytes(data[20:22], "big"), int.from_bytes(data[22:24], "big"), data[24], data[25])


def animation_layout(file: File) -> tuple[int, bool, list[tuple[Control, bytes]]]:
    """(plays, whether the still image is the first frame, frames with their compressed data)."""
    control, seen, expected = None, False, 0
    frames: list[list] = []  # control, pieces, whether its data is the still image's

    def in_order(actual: int) -> None:
        nonlocal expected
        if actual != expected:
            raise PngError("FrameSequenceMismatch", expected=expected, actual=actual)
        expected = (expected + 1) & 0xFFFFFFFF

    def complete() -> None:
        if frames and not frames[-1][1]:
            raise PngError("MissingFrameData")

    for chunk in file.chunks:
        if chunk.type == "acTL":
            if seen or control:
                raise PngError("MisplacedChunk" if seen else "DuplicateChunk", chunk_type="acTL")
            control = parse_animation_control(chunk.data)
        elif chunk.type == "fcTL":
            frame = parse_frame_control(chunk.data)
            in_order(frame.sequence)
            if not seen and frames:
                raise PngError("MisplacedChunk", chunk_type="fcTL")
            if not seen and not frame.covers(file.header):
                raise PngError("InvalidChunkData", chunk_type="fcTL")
            if not frame.fits(file.header):
                raise PngError("FrameOutOfBounds")
            complete()
            frames.append([frame, [], not seen])
        elif chunk.type == "IDAT":
            seen = True
            if frames and frames[-1][2]:
                frames[-1][1].append(chunk.data)
        elif chunk.type == "fdAT":
            if not frames or frames[-1][2]:
                raise PngError("MisplacedChunk", chunk_type="fdAT")
            if len(chunk.data) < 4:
                raise PngError("InvalidChunkLength", chunk_type="fdAT", length=len(chunk.data))
            in_order(int.from_bytes(chunk.data[:4], "big"))
            frames[-1][1].append(chunk.data[4:])
    if control is None:
        raise PngError("NotAnimated")
    complete()
    if len(frames) != control[0]:
        raise PngError("FrameCountMismatch", expected=control[0], actual=len(frames))
    return control[1], bool(frames and frames[0][2]), [(c, b"".join(pieces)) for c, pieces, _ in frames]


def decode_animation(content: bytes, options: Options = Options()) -> tuple[File, int, bool, list[tuple[Control, Header, bytes]]]:
    file = read_file(content, options)
    plays, still, frames = animation_layout(file)
    out = []
    for control, data in frames:
        header = replace(file.header, width=control.width, height=control.height)
        out.append((control, header, native_pixels(inflate(data, header.scanline_size), header)))
    return file, plays, still, out


def blend_over(below: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Straight-alpha compositing in integers, rounded to nearest."""
    b, s = below.astype(np.int64), above.astype(np.int64)
    weight = s[..., 3:] * 255
    rest = b[..., 3:] * (255 - s[..., 3:])
    total = weight + rest
    color = (s[..., :3] * weight + b[..., :3] * rest + total // 2) // np.maximum(total, 1)
    mixed = np.concatenate([color, (total + 127) // 255], -1)
    return np.where(s[..., 3:] == 0, b, np.where(s[..., 3:] == 255, s, mixed)).astype(np.uint8)


class Canvas:
    """Renders frames in order; what a frame leaves behind is settled before the next one."""

    def __init__(self, width: int, height: int):
        self.pixels = np.zeros((height, width, 4), np.uint8)
        self.header = Header(width, height, 8, RGBA)
        self.pending = None

    @classmethod
    def restored(cls, width: int, height: int, pixels: bytes, area: tuple[int, int, int, int], left: bytes | None) -> Canvas:
        """A canvas after a frame of an area (x, y, width, height), with what that leaves to settle."""
        canvas, (x, y, w, h) = cls(width, height), area
        canvas.pixels = np.frombuffer(pixels, np.uint8).reshape(height, width, 4).copy()
        canvas.pending = np.s_[y : y + h, x : x + w], None if left is None else np.frombuffer(left, np.uint8).reshape(h, w, 4)
        return canvas

    def render(self, control: Control, rgba: bytes) -> bytes:
        if not control.fits(self.header):
            raise PngError("FrameOutOfBounds")
        first = self.pending is None
        if not first:
            area, left = self.pending
            if left is not None:
                self.pixels[area] = left
        area = np.s_[control.y : control.y + control.height, control.x : control.x + control.width]
        before = self.pixels[area].copy()
        left = None if control.dispose == 0 else np.zeros_like(before) if control.dispose == 1 or first else before
        above = np.frombuffer(rgba, np.uint8).reshape(before.shape)
        self.pixels[area] = above if control.blend == 0 else blend_over(before, above)
        self.pending = area, left
        return self.pixels.tobytes()


# Writing


@dataclass
class EncodeOptions:
    level: int = 6
    filter: str | int = "adaptive"
    compression: str = "dynamic"  # dynamic, fixed or stored
    interlace: bool | None = None
    palette: str = "keep"  # keep or auto
    strip: str = "keep"  # keep, safe or all
    keep_unsafe: bool = False
    crop: bool = False
    threads: str | int = "single"  # single: one stream; auto or a number: segments, on so many threads


def chunk_bytes(kind: str, data: bytes) -> bytes:
    name = kind.encode()
    return len(data).to_bytes(4, "big") + name + data + zlib.crc32(name + data).to_bytes(4, "big")


def scanlines(header: Header, data: bytes, strategy: str | int) -> bytes:
    """Filtered rows of all passes; adaptive filters only where samples are whole bytes of colors."""
    if strategy == "adaptive" and (header.color_type == INDEXED or header.bit_depth < 8):
        strategy = 0
    samples = unpack(data, header.width, header.height, header.bit_depth, header.channels)
    return b"".join(filter_pass(pack(samples[y0::dy, x0::dx], header.bit_depth), header.filter_bpp, strategy) for x0, y0, dx, dy, _, _ in header.passes())


def zlib_head(level: int, compression: str = "dynamic") -> bytes:
    fast = 0 if compression != "dynamic" or level < 2 else 1 if level < 6 else 2 if level == 6 else 3
    flags = fast << 6
    return bytes([0x78, flags + (31 - (0x7800 + flags) % 31) % 31])


def _compressor(level: int, compression: str, raw: bool):
    strategy = zlib.Z_FIXED if compression == "fixed" else zlib.Z_DEFAULT_STRATEGY
    return zlib.compressobj(0 if compression == "stored" else level, zlib.DEFLATED, -15 if raw else 15, 9, strategy)


def compress_segment(data: bytes, level: int, compression: str = "dynamic") -> bytes:
    stream = _compressor(level, compression, True)
    return stream.compress(data) + stream.flush(zlib.Z_SYNC_FLUSH)


def join_segments(segments: list[bytes], checksum: int, level: int, compression: str = "dynamic") -> bytes:
    return zlib_head(level, compression) + b"".join(segments) + b"\x03\x00" + checksum.to_bytes(4, "big")


def compress(data: bytes, options: EncodeOptions) -> bytes:
    if options.threads != "single" and len(data) > SEGMENT:
        one = lambda i: compress_segment(data[i : i + SEGMENT], options.level, options.compression)
        count = os.process_cpu_count() or 1 if options.threads == "auto" else max(1, int(options.threads))
        with ThreadPoolExecutor(count) as pool:  # zlib works without the interpreter's lock
            parts = list(pool.map(one, range(0, len(data), SEGMENT)))
        return join_segments(parts, zlib.adler32(data), options.level, options.compression)
    stream = _compressor(options.level, options.compression, False)
    return stream.compress(data) + stream.flush()


def strip(file: File, mode: str) -> File:
    if mode == "keep":
        return file
    kept = ("gamma", "chromaticities", "srgb", "phys", "icc", "cicp") if mode == "safe" else ()
    suggested = file.header.color_type != INDEXED
    return replace(file, metadata={k: v for k, v in file.metadata.items() if k in kept}, ancillary=[], palette=None if suggested else file.palette)


def check_image(file: File, data: bytes) -> None:
    header = file.header
    check_dimensions(header.width, header.height)
    check_depth(header.bit_depth, header.color_type)
    if header.color_type == INDEXED and not file.palette:
        raise PngError("MissingPalette")
    if len(data) != header.image_size:
        raise PngError("InvalidImageDataLength", expected=header.image_size, actual=len(data))
    check_colors(file)
    check_metadata(file.metadata)
    for chunk in file.ancillary:
        if is_critical(chunk.type):
            raise PngError("UnexpectedCriticalChunk", chunk_type=chunk.type)
        if len(chunk.data) > MAX_LENGTH:
            raise PngError("InvalidChunkLength", chunk_type=chunk.type, length=len(chunk.data))


def check_colors(file: File) -> None:
    header, palette, key = file.header, file.palette, file.transparency
    if palette is not None:
        if header.color_type in (GRAY, GRAY_ALPHA):
            raise PngError("UnexpectedPalette", color_type=header.color_type)
        if header.color_type == INDEXED and len(palette) // 3 > 1 << header.bit_depth:
            raise PngError("TooManyPaletteEntries", entries=len(palette) // 3, bit_depth=header.bit_depth)
    if key is None:
        return
    if header.color_type in (GRAY_ALPHA, RGBA):
        raise PngError("UnexpectedTransparency", color_type=header.color_type)
    if key.kind != {GRAY: "gray", RGB: "rgb", INDEXED: "palette"}[header.color_type]:
        raise PngError("InvalidTransparencyLength", color_type=header.color_type, length=len(key.data()))
    if key.kind == "palette":
        if not palette:
            raise PngError("MissingPalette")
        if len(key.values) > len(palette) // 3:
            raise PngError("TooManyTransparencyEntries", entries=len(key.values), palette_entries=len(palette) // 3)
    elif max(key.values) >= 1 << header.bit_depth:
        raise PngError("InvalidChunkData", chunk_type="tRNS")


def palettize(file: File, images: list[tuple[Header, bytes]]) -> tuple[File, list[tuple[Header, bytes]]] | None:
    """The same images with one palette of at most 256 colors, or None: translucent entries come first, then colors
    by first appearance. A keyed color becomes an entry without opacity."""
    header = file.header
    if header.bit_depth != 8 or header.color_type not in (RGB, RGBA):
        return None
    pixels = []
    for h, data in images:
        v = np.frombuffer(data, np.uint8).reshape(-1, header.channels)
        if header.color_type == RGB:
            alpha = np.full((len(v), 1), 255, np.uint8)
            if file.transparency:
                alpha[(v == np.array(file.transparency.values)).all(1)] = 0
            v = np.concatenate([v, alpha], 1)
        pixels.append(v)
    joined = np.concatenate(pixels)
    codes = np.ascontiguousarray(joined).view("<u4").reshape(-1)
    colors, first, at = np.unique(codes, return_index=True, return_inverse=True)
    if len(colors) > 256:
        return None
    rgba = joined[first]
    order = np.lexsort((first, rgba[:, 3] == 255))
    place = np.empty(len(order), np.uint8)
    place[order] = np.arange(len(order))
    indices, table = place[at], rgba[order]
    depth = next(d for d in (1, 2, 4, 8) if len(table) <= 1 << d)
    opaque = int((table[:, 3] < 255).sum())
    new = replace(header, color_type=INDEXED, bit_depth=depth)
    out, start = [], 0
    for h, _ in images:
        n = h.width * h.height
        out.append((replace(h, color_type=INDEXED, bit_depth=depth), pack(indices[start : start + n].reshape(h.height, h.width, 1), depth).tobytes()))
        start += n
    key = Transparency("palette", tuple(table[:opaque, 3].tolist())) if opaque else None
    return replace(file, header=new, palette=table[:, :3].tobytes(), transparency=key), out


def written_by_encoder(file: File) -> set[str]:
    """Chunk types that are written from typed values."""
    typed = {"gamma": "gAMA", "chromaticities": "cHRM", "srgb": "sRGB", "phys": "pHYs", "time": "tIME", "icc": "iCCP", "cicp": "cICP", "exif": "eXIf"}
    out = {"acTL", "fcTL", "fdAT"} | {typed[k] for k in file.metadata if k in typed}
    if file.transparency:
        out.add("tRNS")
    if file.metadata.get("text"):
        out |= {"tEXt", "zTXt", "iTXt"}
    return out


def around(file: File, options: EncodeOptions, keep_unsafe: bool, control: bytes | None = None) -> tuple[bytes, bytes]:
    """What stands before and after a file's image data chunks, in the format's order."""
    typed = metadata_chunks(file.metadata, options.level)
    blocked = written_by_encoder(file)
    extra = lambda position: [(c.type, c.data) for c in file.ancillary if c.position == position and c.type not in blocked and (keep_unsafe or is_safe_to_copy(c.type))]
    parts = [("IHDR", file.header.data())]
    parts += [("acTL", control)] if control else []
    parts += [(k, d) for k, d, early in typed if early] + extra(BEFORE_PALETTE)
    parts += [("PLTE", file.palette)] if file.palette else []
    parts += [("tRNS", file.transparency.data())] if file.transparency else []
    parts += [(k, d) for k, d, early in typed if not early] + extra(BEFORE_IMAGE)
    return SIGNATURE + b"".join(chunk_bytes(k, d) for k, d in parts), b"".join(chunk_bytes(k, d) for k, d in [*extra(AFTER_IMAGE), ("IEND", b"")])


def assemble(file: File, body: list[tuple[str, bytes]], options: EncodeOptions, keep_unsafe: bool, control: bytes | None = None) -> bytes:
    """A whole file around its image data chunks."""
    head, tail = around(file, options, keep_unsafe, control)
    return b"".join([head, *(chunk_bytes(k, d) for k, d in body), tail])


def pieces(kind: str, data: bytes, most: int = MAX_LENGTH) -> list[tuple[str, bytes]]:
    return [(kind, data[i : i + most]) for i in range(0, max(1, len(data)), most)]


@dataclass(frozen=True)
class Prepared:
    """A file but for its image data: what comes before and after it, and the filtered rows to compress."""

    head: bytes
    tail: bytes
    raw: bytes

    @property
    def segment_count(self) -> int:
        return max(1, -(-len(self.raw) // SEGMENT))

    def segment(self, i: int) -> bytes:
        return self.raw[i * SEGMENT : (i + 1) * SEGMENT]

    def finish(self, compressed: list[bytes], options: EncodeOptions) -> bytes:
        if len(compressed) != self.segment_count:
            raise PngError("InvalidSegmentCount", expected=self.segment_count, actual=len(compressed))
        stream = join_segments(compressed, zlib.adler32(self.raw), options.level, options.compression)
        return self.head + b"".join(chunk_bytes(k, d) for k, d in pieces("IDAT", stream)) + self.tail


def prepare(file: File, data: bytes, options: EncodeOptions = EncodeOptions()) -> Prepared:
    """The first half of encoding; segments may be compressed anywhere, and finish() is the second half."""
    if options.interlace is not None:
        file = replace(file, header=replace(file.header, interlace=int(options.interlace)))
    file = strip(file, options.strip)
    check_image(file, data)
    keep_unsafe = options.keep_unsafe
    if options.palette == "auto" and (found := palettize(file, [(file.header, data)])):
        file, data, keep_unsafe = found[0], found[1][0][1], False
    return Prepared(*around(file, options, keep_unsafe), scanlines(file.header, data, options.filter))


def encode(file: File, data: bytes, options: EncodeOptions = EncodeOptions()) -> bytes:
    """One image. Stripping comes before checking, so what is stripped can't be wrong."""
    if options.interlace is not None:
        file = replace(file, header=replace(file.header, interlace=int(options.interlace)))
    file = strip(file, options.strip)
    check_image(file, data)

    def write(f: File, d: bytes, keep_unsafe: bool) -> bytes:
        return assemble(f, pieces("IDAT", compress(scanlines(f.header, d, options.filter), options)), options, keep_unsafe)

    if options.palette == "auto" and (found := palettize(file, [(file.header, data)])):
        smaller = write(found[0], found[1][0][1], False)
        if len(data) > SMALL_IMAGE:
            return smaller
        plain = write(file, data, options.keep_unsafe)
        return smaller if len(smaller) < len(plain) else plain
    return write(file, data, options.keep_unsafe)


def changed_area(previous: np.ndarray, current: np.ndarray) -> tuple[int, int, int, int] | None:
    """(x, y, width, height) of the box around the pixels that differ."""
    ys, xs = np.nonzero((previous != current).any(2))
    if not len(ys):
        return None
    return int(xs.min()), int(ys.min()), int(xs.max() - xs.min() + 1), int(ys.max() - ys.min() + 1)


def crop_frames(header: Header, frames: list[tuple[Control, bytes]]) -> list[tuple[Control, bytes]]:
    """Frames over an unchanged canvas, reduced to what differs from the frame before."""
    whole = [unpack(d, c.width, c.height, header.bit_depth, header.channels) for c, d in frames]
    out = frames[:1]
    for (before, _), (control, data), a, b in zip(frames, frames[1:], whole, whole[1:]):
        plain = before.covers(header) and control.covers(header) and (before.blend, before.dispose, control.blend) == (0, 0, 0) and control.dispose != 1
        x, y, w, h = (changed_area(a, b) or (0, 0, 1, 1)) if plain else (0, 0, header.width, header.height)
        if plain and (w, h) != (header.width, header.height):
            control, data = replace(control, x=x, y=y, width=w, height=h), pack(b[y : y + h, x : x + w], header.bit_depth).tobytes()
        out.append((control, data))
    return out


def check_frames(header: Header, frames: list[tuple[Control, bytes]], still: bool) -> None:
    if not frames:
        raise PngError("FrameCountMismatch", expected=1, actual=0)
    if not still and not frames[0][0].covers(header):
        raise PngError("InvalidChunkData", chunk_type="fcTL")
    for control, data in frames:
        check_dimensions(control.width, control.height)
        if not control.fits(header):
            raise PngError("FrameOutOfBounds")
        size = replace(header, width=control.width, height=control.height).image_size
        if len(data) != size:
            raise PngError("InvalidImageDataLength", expected=size, actual=len(data))


def encode_animation(file: File, frames: list[tuple[Control, bytes]], plays: int = 0, still: bytes | None = None, options: EncodeOptions = EncodeOptions()) -> bytes:
    """Frames, with a still image apart from them or the first frame as one."""
    file = strip(file, options.strip)
    header = file.header
    check_frames(header, frames, still is not None)
    check_image(file, still if still is not None else frames[0][1])
    if options.crop:
        frames = crop_frames(header, frames)
    sized = lambda f, c: replace(f.header, width=c.width, height=c.height)

    def write(f: File, parts: list[tuple[Control, bytes]], default: bytes | None, keep_unsafe: bool) -> bytes:
        body = pieces("IDAT", compress(scanlines(f.header, default, options.filter), options)) if default is not None else []
        sequence = 0
        for i, (control, data) in enumerate(parts):
            body.append(("fcTL", control.data(sequence)))
            sequence += 1
            packed = compress(scanlines(sized(f, control), data, options.filter), options)
            if i == 0 and default is None:
                body += pieces("IDAT", packed)
                continue
            for _, piece in pieces("fdAT", packed, MAX_LENGTH - 4):
                body.append(("fdAT", sequence.to_bytes(4, "big") + piece))
                sequence += 1
        return assemble(f, body, options, keep_unsafe, len(parts).to_bytes(4, "big") + plays.to_bytes(4, "big"))

    images = ([(header, still)] if still is not None else []) + [(sized(file, c), d) for c, d in frames]
    if options.palette == "auto" and (found := palettize(file, images)):
        converted = [d for _, d in found[1]]
        default = converted.pop(0) if still is not None else None
        smaller = write(found[0], [(c, d) for (c, _), d in zip(frames, converted)], default, False)
        if sum(len(d) for _, d in images) > SMALL_IMAGE:
            return smaller
        plain = write(file, frames, still, options.keep_unsafe)
        return smaller if len(smaller) < len(plain) else plain
    return write(file, frames, still, options.keep_unsafe)


def is_empty(metadata: dict) -> bool:
    """Whether there is no typed metadata at all."""
    return not any(value is not None and value != [] for value in metadata.values())
