"""File kernels: formula rasters, round trips, specification forms, one defect for each error."""

import dataclasses
import zlib

import numpy as np
import pytest

from pixelloom.functions import codec as C

FORMATS = [(color, depth) for color, depths in C.DEPTHS.items() for depth in depths]


def raster(header: C.Header) -> bytes:
    """Samples by formula: (29x + 83y + 47c) mod 2^depth, indices (x + 3y) mod 2^depth."""
    y, x, c = np.mgrid[: header.height, : header.width, : header.channels]
    value = x + 3 * y if header.color_type == C.INDEXED else 29 * x + 83 * y + 47 * c
    return C.pack((value % (1 << header.bit_depth)).astype(np.uint16), header.bit_depth).tobytes()


def palette(header: C.Header) -> bytes | None:
    entries = 1 << header.bit_depth
    return bytes(m * i % 256 for i in range(entries) for m in (71, 113, 157)) if header.color_type == C.INDEXED else None


@pytest.mark.parametrize("color,depth", FORMATS)
@pytest.mark.parametrize("interlace", [0, 1])
def test_round_trips(color, depth, interlace):
    for width, height in ((13, 7), (1, 1), (16, 16)):
        header = C.Header(width, height, depth, color, interlace)
        data = raster(header)
        for options in (C.EncodeOptions(), *(C.EncodeOptions(filter=f) for f in range(5)), C.EncodeOptions(compression="fixed"), C.EncodeOptions(compression="stored"), C.EncodeOptions(level=9)):
            file, found = C.decode(C.encode(C.File(header, palette=palette(header)), data, options))
            assert (file.header, found) == (header, data)


def slow_unfilter(raw: np.ndarray, bpp: int) -> list[list[int]]:
    out, above = [], [0] * (raw.shape[1] - 1)
    for kind, *row in raw.tolist():
        line = []
        for i, v in enumerate(row):
            a, b, c = (line[i - bpp], above[i], above[i - bpp]) if i >= bpp else (0, above[i], 0)
            estimate = a + b - c
            nearest = min((abs(estimate - n), order, n) for order, n in enumerate((a, b, c)))[2]
            line.append((v + (0, a, b, (a + b) // 2, nearest)[kind]) % 256)
        out.append(line)
        above = line
    return out


def test_unfilter_against_the_specification():
    rng = np.random.default_rng(3)
    for bpp in (1, 2, 3, 4, 6, 8):
        for kinds in ((0, 1, 2), (3, 4), (0, 1, 2, 3, 4)):
            for _ in range(6):
                raw = rng.integers(0, 256, (rng.integers(1, 12), 1 + rng.integers(1, 30)), dtype=np.uint8)
                raw[:, 0] = rng.choice(kinds, len(raw))
                assert C.unfilter(raw, bpp).tolist() == slow_unfilter(raw, bpp)


def test_adaptive_choice_is_the_least_sum():
    rng = np.random.default_rng(4)
    rows = rng.integers(0, 256, (20, 24), dtype=np.uint8)
    chosen = np.frombuffer(C.filter_pass(rows, 3, "adaptive"), np.uint8).reshape(20, -1)
    every = [np.frombuffer(C.filter_pass(rows, 3, f), np.uint8).reshape(20, -1)[:, 1:] for f in range(5)]
    cost = lambda row: sum(min(int(v), 256 - int(v)) for v in row)
    for i, line in enumerate(chosen):
        costs = [cost(e[i]) for e in every]
        assert line[0] == costs.index(min(costs))


def test_bitmaps():
    header = C.Header(2, 1, 16, C.GRAY)
    assert C.to_bitmap(header, b"\x12\x34\xff\x00", None, C.Transparency("gray", (0x1234,))) == bytes([0x12, 0x12, 0x12, 0, 255, 255, 255, 255])
    assert C.to_bitmap(C.Header(4, 1, 2, C.GRAY), b"\x1b", None, None, False) == bytes(v for v in (0, 85, 170, 255) for _ in range(3))
    indexed = C.Header(2, 1, 8, C.INDEXED)
    assert C.to_bitmap(indexed, b"\0\1", b"abcdef", C.Transparency("palette", (7,))) == b"abc\x07def\xff"
    with pytest.raises(C.PngError, match="PaletteIndexOutOfRange"):
        C.to_bitmap(indexed, b"\0\2", b"abcdef", None)


def test_metadata_and_raw_chunks_survive():
    text = {"keyword": "Title", "language": "", "translated": "", "compressed": False, "text": "café"}
    metadata = {
        "gamma": 45455, "chromaticities": list(range(8)), "srgb": 1, "phys": [2835, 2835, 1], "time": [2026, 2, 31, 23, 59, 60], "cicp": [1, 13, 0, 1], "exif": b"II*\0abcd", "icc": ("profile", b"x" * 500),
        "text": [text | {"kind": "tEXt"}, text | {"kind": "zTXt", "compressed": True}, text | {"kind": "iTXt", "language": "de-DE", "translated": "Überschrift", "text": "日本", "compressed": True}],
    }
    header = C.Header(3, 2, 8, C.RGB)
    extra = [C.Chunk("prVt", b"1", 0, C.BEFORE_PALETTE), C.Chunk("prVt", b"2", 0, C.AFTER_IMAGE), C.Chunk("prVT", b"3", 0, C.BEFORE_IMAGE)]
    file, _ = C.decode(C.encode(C.File(header, metadata=metadata, ancillary=extra), raster(header)))
    assert file.metadata == metadata
    assert [(c.data, c.position) for c in file.ancillary if c.type == "prVt"] == [(b"1", C.BEFORE_PALETTE), (b"2", C.AFTER_IMAGE)]
    assert not [c for c in file.ancillary if c.type == "prVT"]
    unsafe = C.read_file(C.encode(C.File(header, ancillary=extra), raster(header), C.EncodeOptions(keep_unsafe=True)))
    assert [c.data for c in unsafe.ancillary if c.type == "prVT"] == [b"3"]
    safe = C.read_file(C.encode(C.File(header, metadata=metadata, ancillary=extra), raster(header), C.EncodeOptions(strip="safe")))
    assert set(safe.metadata) == {"gamma", "chromaticities", "srgb", "phys", "icc", "cicp"}
    assert C.read_file(C.encode(C.File(header, metadata=metadata), raster(header), C.EncodeOptions(strip="all"))).metadata == {}


def parts(header: C.Header, data: bytes) -> dict[str, bytes]:
    return {"IHDR": header.data(), "IDAT": zlib.compress(C.scanlines(header, data, 0)), "IEND": b"", "PLTE": palette(header) or b"abc"}


def build(*chunks: tuple[str, bytes]) -> bytes:
    return C.SIGNATURE + b"".join(C.chunk_bytes(k, d) for k, d in chunks)


RGBA, INDEXED, GRAY, RGB = (C.Header(13, 7, 8, c) for c in (C.RGBA, C.INDEXED, C.GRAY, C.RGB))


def ihdr(**changes) -> bytes:
    data = bytearray(RGBA.data())
    for place, value in changes.items():
        data[int(place[1:])] = value
    return bytes(data)


def whole(header: C.Header, *names: str | tuple[str, bytes]) -> bytes:
    known = parts(header, raster(header))
    return build(*((n, known[n]) if isinstance(n, str) else n for n in ("IHDR", *names)))


good = whole(RGBA, "IDAT", "IEND")
DEFECTS = {
    "empty": (b"", "UnexpectedEndOfInput"),
    "signature_truncated": (C.SIGNATURE[:5], "UnexpectedEndOfInput"),
    "not_png": (b"GIF89a......", "InvalidSignature"),
    "signature_only": (C.SIGNATURE, "MissingImageHeader"),
    "first_chunk_not_ihdr": (build(("IDAT", b"")), "MissingImageHeader"),
    "chunk_length_too_long": (C.SIGNATURE + b"\x80\0\0\0IHDR", "ChunkTooLong"),
    "chunk_type_invalid": (C.SIGNATURE + bytes(4) + b"IH1R" + bytes(4), "InvalidChunkType"),
    "crc_wrong": (good[:32] + bytes([good[32] ^ 255]) + good[33:], "CrcMismatch"),
    "truncated": (good[:-14], "UnexpectedEndOfInput"),
    "ihdr_length": (build(("IHDR", RGBA.data()[:12])), "InvalidImageHeaderLength"),
    "width_zero": (build(("IHDR", bytes(4) + RGBA.data()[4:])), "InvalidDimensions"),
    "width_too_large": (build(("IHDR", b"\x80" + RGBA.data()[1:])), "InvalidDimensions"),
    "color_type": (build(("IHDR", ihdr(p9=5))), "InvalidColorType"),
    "bit_depth": (build(("IHDR", ihdr(p8=4))), "InvalidBitDepth"),
    "compression": (build(("IHDR", ihdr(p10=1))), "InvalidCompressionMethod"),
    "filter_method": (build(("IHDR", ihdr(p11=1))), "InvalidFilterMethod"),
    "interlace": (build(("IHDR", ihdr(p12=2))), "InvalidInterlaceMethod"),
    "idat_missing": (whole(RGBA, "IEND"), "MissingImageData"),
    "iend_missing": (whole(RGBA, "IDAT"), "MissingImageEnd"),
    "idat_twice": (whole(RGBA, "IDAT", ("loOm", b""), "IDAT", "IEND"), "NonConsecutiveImageData"),
    "plte_missing": (whole(INDEXED, "IDAT", "IEND"), "MissingPalette"),
    "plte_after_idat": (whole(RGB, "IDAT", "PLTE", "IEND"), "PaletteAfterImageData"),
    "plte_twice": (whole(INDEXED, "PLTE", "PLTE", "IDAT", "IEND"), "DuplicatePalette"),
    "plte_empty": (whole(INDEXED, ("PLTE", b""), "IDAT", "IEND"), "InvalidPaletteLength"),
    "plte_length": (whole(INDEXED, ("PLTE", b"abcd"), "IDAT", "IEND"), "InvalidPaletteLength"),
    "plte_too_many": (whole(C.Header(13, 7, 2, C.INDEXED), ("PLTE", bytes(15)), "IDAT", "IEND"), "TooManyPaletteEntries"),
    "plte_in_gray": (whole(GRAY, ("PLTE", bytes(3)), "IDAT", "IEND"), "UnexpectedPalette"),
    "plte_after_trns": (whole(RGB, ("tRNS", bytes(6)), ("PLTE", bytes(3)), "IDAT", "IEND"), "TransparencyBeforePalette"),
    "trns_before_plte": (whole(INDEXED, ("tRNS", b"a"), "PLTE", "IDAT", "IEND"), "TransparencyBeforePalette"),
    "trns_after_idat": (whole(RGB, "IDAT", ("tRNS", bytes(6)), "IEND"), "TransparencyAfterImageData"),
    "trns_twice": (whole(RGB, ("tRNS", bytes(6)), ("tRNS", bytes(6)), "IDAT", "IEND"), "DuplicateTransparency"),
    "trns_in_rgba": (whole(RGBA, ("tRNS", bytes(6)), "IDAT", "IEND"), "UnexpectedTransparency"),
    "trns_length": (whole(GRAY, ("tRNS", bytes(3)), "IDAT", "IEND"), "InvalidTransparencyLength"),
    "trns_too_many": (whole(INDEXED, ("PLTE", bytes(6)), ("tRNS", bytes(3)), "IDAT", "IEND"), "TooManyTransparencyEntries"),
    "zlib_corrupt": (whole(RGBA, ("IDAT", b"\0\1\2\3"), "IEND"), "Decompression"),
    "adler_wrong": (whole(RGBA, ("IDAT", parts(RGBA, raster(RGBA))["IDAT"][:-1] + b"?"), "IEND"), "Decompression"),
    "filter_type_5": (whole(RGBA, ("IDAT", zlib.compress(b"\5" + bytes(370))), "IEND"), "InvalidFilterType"),
    "data_too_short": (whole(RGBA, ("IDAT", zlib.compress(bytes(351))), "IEND"), "ImageDataTooShort"),
    "data_too_long": (whole(RGBA, ("IDAT", zlib.compress(bytes(372))), "IEND"), "ImageDataTooLong"),
}


@pytest.mark.parametrize("name", DEFECTS)
def test_each_defect_has_its_error(name):
    content, code = DEFECTS[name]
    with pytest.raises(C.PngError) as found:
        C.decode(content)
    assert found.value.code == code
    if name == "data_too_short":
        assert found.value.detail == {"expected": "371", "actual": "351"}


def test_ancillary_errors_count_only_when_strict():
    misplaced = whole(INDEXED, "PLTE", ("gAMA", bytes(3) + b"\1"), "IDAT", "IEND")
    assert C.decode(misplaced)[0].metadata == {}
    with pytest.raises(C.PngError, match="MisplacedChunk"):
        C.decode(misplaced, C.Options(strict_ancillary=True))
    twice = whole(RGB, ("gAMA", bytes(4)), ("gAMA", bytes(3) + b"\1"), ("gAMA", bytes(3) + b"\2"), "IDAT", "IEND")
    assert C.decode(twice)[0].metadata == {"gamma": 1}
    assert C.decode(good + b"anything")[1] == raster(RGBA)
    broken = bytearray(good)
    broken[32] ^= 255
    assert C.decode(bytes(broken), C.Options(validate_crc=False))[1] == raster(RGBA)


@pytest.mark.parametrize(
    "kind,data,code",
    [
        ("gAMA", bytes(4), "InvalidChunkData"), ("gAMA", b"1", "InvalidChunkLength"), ("cHRM", bytes(31), "InvalidChunkLength"), ("sRGB", b"\4", "InvalidChunkData"), ("pHYs", bytes(8) + b"\2", "InvalidChunkData"),
        ("tIME", b"\7\xea\x0d\1\0\0\0", "InvalidChunkData"), ("cICP", b"\1\1\1\0", "InvalidChunkData"), ("eXIf", b"II*\0", "InvalidChunkLength"), ("eXIf", b"XX*\0abcd", "InvalidChunkData"),
        ("tEXt", b"no mark", "InvalidChunkData"), ("tEXt", b" x\0t", "InvalidChunkData"), ("tEXt", b"a  b\0t", "InvalidChunkData"), ("tEXt", b"k" * 80 + b"\0", "InvalidChunkData"), ("zTXt", b"k\0\1x", "InvalidChunkData"),
        ("zTXt", b"k\0\0" + zlib.compress(bytes(C.TEXT_MAX + 1)), "TextTooLong"), ("zTXt", b"k\0\0??", "InvalidChunkData"), ("iTXt", b"k\0\2\0\0\0t", "InvalidChunkData"), ("iTXt", b"k\0\0\0de\0\0\xff", "InvalidChunkData"), ("iCCP", b"p\0\1", "InvalidChunkData"),
    ],
)
def test_bad_metadata(kind, data, code):
    with pytest.raises(C.PngError) as found:
        C.parse_known(kind, data)
    assert found.value.code == code


@pytest.mark.parametrize(
    "changes,data,code",
    [
        ({"header": C.Header(0, 1, 8, C.GRAY)}, b"", "InvalidDimensions"), ({"header": C.Header(1, 1, 4, C.RGB)}, b"", "InvalidBitDepth"), ({"header": C.Header(1, 1, 8, C.INDEXED)}, b"\0", "MissingPalette"),
        ({}, b"12", "InvalidImageDataLength"), ({"header": C.Header(1, 1, 8, C.GRAY), "palette": b"abc"}, b"\0", "UnexpectedPalette"), ({"transparency": C.Transparency("gray", (1,))}, b"123", "InvalidTransparencyLength"),
        ({"transparency": C.Transparency("rgb", (1, 2, 256))}, b"123", "InvalidChunkData"), ({"ancillary": [C.Chunk("ABcd", b"", 0, C.BEFORE_IMAGE)]}, b"123", "UnexpectedCriticalChunk"),
        ({"metadata": {"time": [2020, 13, 1, 0, 0, 0]}}, b"123", "InvalidChunkData"), ({"metadata": {"text": [{"kind": "tEXt", "keyword": "k", "text": "日", "language": "", "translated": "", "compressed": False}]}}, b"123", "InvalidChunkData"),
    ],
)
def test_images_are_checked_before_writing(changes, data, code):
    file = dataclasses.replace(C.File(C.Header(1, 1, 8, C.RGB)), **changes)
    with pytest.raises(C.PngError) as found:
        C.encode(file, data)
    assert found.value.code == code
    if code == "UnexpectedCriticalChunk":
        assert C.encode(file, data, C.EncodeOptions(strip="all"))  # what is stripped can't be wrong


def test_palette_reduction_looks_the_same():
    rng = np.random.default_rng(5)
    for channels, color in ((3, C.RGB), (4, C.RGBA)):
        table = rng.integers(0, 256, (20, channels), dtype=np.uint8)
        header = C.Header(40, 30, 8, color)
        data = table[rng.integers(0, 20, 1200)].tobytes()
        key = C.Transparency("rgb", tuple(table[3].tolist())) if color == C.RGB else None
        before = C.to_bitmap(header, data, None, key)
        file, packed = C.decode(C.encode(C.File(header, transparency=key), data, C.EncodeOptions(palette="auto")))
        assert file.header.color_type == C.INDEXED and file.header.bit_depth == 8
        assert C.to_bitmap(file.header, packed, file.palette, file.transparency) == before
        if file.transparency:
            assert max(file.transparency.values) < 255
    noise = C.Header(40, 30, 8, C.RGB)
    assert C.read_file(C.encode(C.File(noise), rng.integers(0, 256, 3600, dtype=np.uint8).tobytes(), C.EncodeOptions(palette="auto"))).header.color_type == C.RGB


def test_segments_are_one_stream():
    rng = np.random.default_rng(6)
    data = rng.integers(0, 9, 3 * C.SEGMENT + 5, dtype=np.uint8).tobytes()
    for level, compression in ((6, "dynamic"), (1, "fixed"), (0, "stored")):
        stream = C.compress(data, C.EncodeOptions(level=level, compression=compression, threads="auto"))
        assert zlib.decompress(stream) == data
        assert int.from_bytes(stream[:2], "big") % 31 == 0


def test_two_phases_are_one_encoding(monkeypatch):
    monkeypatch.setattr(C, "SEGMENT", 100)
    data = raster(RGBA)
    whole = C.prepare(C.File(RGBA), data)
    compressed = [C.compress_segment(whole.segment(i), 6) for i in range(whole.segment_count)]
    assert len(compressed) == 4
    content = whole.finish(compressed, C.EncodeOptions())
    assert content == C.encode(C.File(RGBA), data, C.EncodeOptions(threads=2))
    assert C.decode(content)[1] == data
    with pytest.raises(C.PngError, match="InvalidSegmentCount"):
        whole.finish(compressed[:-1], C.EncodeOptions())


def frames(header: C.Header, count: int, step: int = 2) -> list[tuple[C.Control, bytes]]:
    out = []
    for k in range(count):
        pixels = np.zeros((header.height, header.width, 4), np.uint8)
        pixels[step * k : step * k + 4, step * k : step * k + 4] = (255, 9 * k, 0, 255)
        out.append((C.Control(0, header.width, header.height, 0, 0, 3, 0, 0, 0), pixels.tobytes()))
    return out


def test_animations_cropped_and_rendered():
    header = C.Header(16, 16, 8, C.RGBA)
    whole_frames = frames(header, 4)
    for options in (C.EncodeOptions(), C.EncodeOptions(crop=True), C.EncodeOptions(palette="auto")):
        content = C.encode_animation(C.File(header), whole_frames, 7, options=options)
        file, plays, still, found = C.decode_animation(content)
        assert (plays, still, len(found)) == (7, True, 4)
        canvas = C.Canvas(16, 16)
        assert [canvas.render(c, C.to_bitmap(h, d, file.palette, file.transparency)) for c, h, d in found] == [d for _, d in whole_frames]
    areas = [(c.x, c.y, c.width, c.height) for c, _ in C.crop_frames(header, whole_frames)]
    assert areas == [(0, 0, 16, 16), (0, 0, 6, 6), (2, 2, 6, 6), (4, 4, 6, 6)]
    same = C.crop_frames(header, [whole_frames[0], whole_frames[0]])
    assert (same[1][0].width, same[1][0].height) == (1, 1)
    apart = C.decode_animation(C.encode_animation(C.File(header), whole_frames, still=bytes(1024)))
    assert apart[2] is False and len(apart[3]) == 4


def test_disposal():
    header = C.Header(2, 1, 8, C.RGBA)
    red, green = bytes([255, 0, 0, 255]), bytes([0, 255, 0, 128])
    canvas = C.Canvas(2, 1)
    show = lambda dispose, blend, x, data: canvas.render(C.Control(0, len(data) // 4, 1, x, 0, 1, 1, dispose, blend), data)
    assert show(2, 0, 0, red + red) == red + red  # nothing to go back to: cleared
    assert show(2, 0, 1, green) == bytes(4) + green
    assert show(0, 1, 0, green) == green + bytes(4)
    assert show(1, 1, 0, red) == red + bytes(4)
    assert show(0, 1, 0, green) == green + bytes(4)
    assert header.image_size == 8
    with pytest.raises(C.PngError, match="FrameOutOfBounds"):
        show(0, 0, 2, red)


def test_animation_layout_errors():
    header = C.Header(4, 4, 8, C.GRAY)
    image = zlib.compress(C.scanlines(header, bytes(16), 0))
    control = lambda n: ("acTL", n.to_bytes(4, "big") + bytes(4))
    frame = lambda seq, w=4, h=4, x=0: ("fcTL", C.Control(seq, w, h, x, 0, 1, 1, 0, 0).data())
    data = lambda seq: ("fdAT", seq.to_bytes(4, "big") + image)
    idat, end = ("IDAT", image), ("IEND", b"")
    cases = {
        "NotAnimated": [idat, end],
        "DuplicateChunk": [control(1), control(1), frame(0), idat, end],
        "FrameSequenceMismatch": [control(2), frame(0), idat, frame(2), data(2), end],
        "MissingFrameData": [control(2), frame(0), idat, frame(1), end],
        "FrameCountMismatch": [control(3), frame(0), idat, frame(1), data(2), end],
        "FrameOutOfBounds": [control(2), frame(0), idat, frame(1, x=1), data(2), end],
        "InvalidChunkData": [control(1), frame(0, w=2), idat, end],
        "InvalidChunkLength": [control(2), frame(0), idat, frame(1), ("fdAT", b"abc"), end],
        "MisplacedChunk": [control(1), idat, ("fdAT", bytes(8)), end],
    }
    for code, chunks in cases.items():
        with pytest.raises(C.PngError) as found:
            C.decode_animation(build(("IHDR", header.data()), *chunks))
        assert found.value.code == code
    assert len(C.decode_animation(build(("IHDR", header.data()), control(2), frame(0), idat, frame(1), data(2), end))[3]) == 2


def test_sizes_that_no_buffer_can_have():
    for interlace in (0, 1):
        header = C.Header(2**31 - 1, 2**31 - 1, 16, C.RGBA, interlace)
        for size in ("image_size", "scanline_size"):
            with pytest.raises(C.PngError, match="ImageTooLarge"):
                getattr(header, size)
        whole = C.SIGNATURE + C.chunk_bytes("IHDR", header.data()) + C.chunk_bytes("IDAT", zlib.compress(b"")) + C.chunk_bytes("IEND", b"")
        with pytest.raises(C.PngError, match="ImageTooLarge"):
            C.decode(whole)


def test_preparing_a_file_with_image_data_inside_a_chunk():
    """An ancillary chunk may hold the bytes of an empty image data chunk."""
    header = C.Header(2, 2, 8, C.GRAY)
    file = C.File(header, ancillary=[C.Chunk("loOm", b"x" + C.chunk_bytes("IDAT", b"") + b"y", 0, C.BEFORE_PALETTE)])
    whole = C.prepare(file, bytes(4))
    parts = [C.compress_segment(whole.segment(i), 6) for i in range(whole.segment_count)]
    found, data = C.decode(whole.finish(parts, C.EncodeOptions()))
    assert data == bytes(4) and found.ancillary[0].data == file.ancillary[0].data


def animated(colors: int, options=C.EncodeOptions()) -> bytes:
    rng = np.random.default_rng(0)
    frames = [(C.Control(0, 2, 2, 0, 0, 1, 10, 0, 0), rng.integers(0, colors, 16, dtype=np.uint8).tobytes()) for _ in range(3)]
    return C.encode_animation(C.File(C.Header(2, 2, 8, C.RGBA)), frames, 4, None, options)


def test_animations_keep_the_smaller_form():
    for colors in (2, 200):
        plain, auto = animated(colors), animated(colors, C.EncodeOptions(palette="auto"))
        assert len(auto) <= len(plain)
        shown = [[C.to_bitmap(h, d, f.palette, f.transparency) for _, h, d in frames] for f, _, _, frames in (C.decode_animation(plain), C.decode_animation(auto))]
        assert shown[0] == shown[1]


def test_animations_of_chunks():
    """Chunks begin with IHDR; an animation's controls come with them, or an error where it is laid out wrong and strict."""
    content = animated(200)
    file = C.read_chunks(content)
    assert [c.type for c in file.chunks] == [c.type for c in C.scan(content)] and file.chunks[0].position == C.BEFORE_PALETTE
    assert file.animation[:2] == (3, 4) and [c.sequence for c in file.animation[2]] == [0, 1, 3]
    chunks = [(c.type, c.data) for c in C.scan(content)]
    whole = lambda parts: C.SIGNATURE + b"".join(C.chunk_bytes(k, d) for k, d in parts)
    for damage in ([(k, bytes(8) if k == "acTL" else d) for k, d in chunks], [c for c in chunks if c[0] != "fdAT"]):
        assert C.read_chunks(whole(damage)).animation is None
        with pytest.raises(C.PngError):
            C.read_chunks(whole(damage), C.Options(strict_ancillary=True))
    still = whole([c for c in chunks if c[0] not in ("acTL", "fcTL", "fdAT")])
    assert C.read_chunks(still, C.Options(strict_ancillary=True)).animation is None


def test_threads_give_the_same_segments():
    data = np.random.default_rng(1).integers(0, 9, 5 * C.SEGMENT // 2, dtype=np.uint8).tobytes()
    streams = {t: C.compress(data, C.EncodeOptions(level=1, threads=t)) for t in ("single", "auto", 1, 3)}
    assert streams["auto"] == streams[1] == streams[3] != streams["single"]
    assert all(zlib.decompress(s) == data for s in streams.values())


def test_wavefront_over_bands(monkeypatch):
    """Images of several bands, as wide and as high as they come."""
    rng = np.random.default_rng(8)
    monkeypatch.setattr(C, "LANE_BYTES", 12)
    for bpp in (1, 2, 3, 4, 6, 8):
        for height, width in ((40, 3), (3, 40), (25, 25), (1, 9), (9, 1)):
            raw = rng.integers(0, 256, (height, 1 + width * bpp), dtype=np.uint8)
            raw[:, 0] = rng.integers(0, 5, height)
            assert C.unfilter(raw, bpp).tolist() == slow_unfilter(raw, bpp)


def test_files_by_an_independent_route():
    """Written files are read by their definition alone: chunks, one zlib stream, filters byte by byte."""
    rng = np.random.default_rng(9)
    for color, depth in FORMATS:
        header = C.Header(7, 5, depth, color)
        data = C.pack(rng.integers(0, 1 << depth, (5, 7, header.channels)).astype(np.uint16), depth).tobytes()
        content, at, stream = C.encode(C.File(header, palette=palette(header)), data), 8, b""
        assert content[:8] == b"\x89PNG\r\n\x1a\n"
        while at < len(content):
            size, kind = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
            assert zlib.crc32(content[at + 4 : at + 8 + size]) == int.from_bytes(content[at + 8 + size : at + 12 + size], "big")
            stream += content[at + 8 : at + 8 + size] if kind == b"IDAT" else b""
            at += 12 + size
        lines = np.frombuffer(zlib.decompress(stream), np.uint8).reshape(5, -1)
        assert bytes(v for line in slow_unfilter(lines, header.filter_bpp) for v in line) == data


def test_metadata_that_is_empty():
    assert C.is_empty({}) and C.is_empty({"gamma": None, "text": []}) and not C.is_empty({"gamma": 45455}) and not C.is_empty({"text": [{"kind": "tEXt"}]})
