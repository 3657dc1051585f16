"""Whole files in DataFrames: reading and writing PNG bytes in Arrow batches, one file to a row.

A stream within a file is sequential, so files are the unit of parallelism; batches are kept small, as images are
large. Errors are values: PERMISSIVE gives a row with error, DROPMALFORMED none, FAILFAST raises.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions import codec
from ..functions.expressions import chunk_bytes

HEADER = "width long, height long, bit_depth int, color_type int, interlace int"
ERROR = "error struct<code: string, detail: map<string, string>>"
TEXT = "struct<kind: string, keyword: string, language: string, translated: string, compressed: boolean, text: string>"
METADATA = f"struct<gamma: long, chromaticities: array<long>, srgb: int, phys: array<long>, time: array<int>, cicp: array<int>, exif: binary, icc: struct<name: string, profile: binary>, text: array<{TEXT}>>"
CHUNK = "struct<type: string, data: binary, crc: long, position: string>"
CONTROL = "struct<sequence: long, width: long, height: long, x: long, y: long, delay_num: int, delay_den: int, dispose: int, blend: int>"
COLORS = "palette binary, transparency struct<kind: string, values: array<int>>"
MODES = {
    "header": HEADER,
    "chunks": f"{HEADER}, {COLORS}, metadata {METADATA}, chunks array<{CHUNK}>, animation struct<frames: long, plays: long>, frame_controls array<{CONTROL}>",
    "image": f"{HEADER}, {COLORS}, metadata {METADATA}, chunks array<{CHUNK}>, data binary",
    "bitmap": "width long, height long, alpha boolean, data binary",
    "frames": f"{HEADER}, {COLORS}, plays long, still boolean, k int, seq long, frame_width long, frame_height long, x long, y long, delay_num int, delay_den int, dispose int, blend int, data binary",
    "composited": "width long, height long, plays long, k int, delay_num int, delay_den int, data binary",
    "raw": "ord long, type string, data binary, crc long",
}
ERROR_MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")


#: Bytes after which a batch of output rows is passed on.
OUTPUT_BYTES = 32 << 20


def map_rows(df: DataFrame, schema: str, function: Callable[[dict], list[dict]], batch: int = 64) -> DataFrame:
    """Every row to any number of rows, in Arrow batches that end after about `batch` rows or OUTPUT_BYTES."""
    from ..plans.shipping import ship

    ship(df.sparkSession)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            rows: list[dict] = []
            size = 0
            step = max(1, min(batch, OUTPUT_BYTES * len(whole) // max(1, whole.nbytes)))  # input rows turned into objects at once
            for at in range(0, len(whole), step):
                for row in whole.slice(at, step).to_pylist():
                    for out in function(row):
                        rows.append(out)
                        size += sum(len(v) for v in out.values() if isinstance(v, bytes))
                        if size >= OUTPUT_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, arrow)
                            rows, size = [], 0
                if len(rows) >= batch:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return df.mapInArrow(run, schema)


def _header(header: codec.Header) -> dict:
    return asdict(header)


def _colors(file: codec.File) -> dict:
    key = file.transparency
    return {"palette": file.palette, "transparency": key and {"kind": key.kind, "values": list(key.values)}}


def _metadata(metadata: dict) -> dict:
    icc = metadata.get("icc")
    return metadata | {"icc": icc and {"name": icc[0], "profile": icc[1]}}


def _chunks(chunks: list[codec.Chunk]) -> list[dict]:
    return [asdict(c) for c in chunks]


def read_one(content: bytes, mode: str, options: codec.Options, alpha: bool) -> list[dict]:
    if mode == "header":
        return [_header(codec.read_header(content, options.validate_crc))]
    if mode == "raw":
        return [{"ord": i, "type": c.type, "data": c.data, "crc": c.crc} for i, c in enumerate(codec.scan(content, options.validate_crc))]
    if mode == "chunks":
        file = codec.read_chunks(content, options)
        frames, plays, controls = file.animation or (None, None, [])
        found = {"animation": frames and {"frames": frames, "plays": plays}, "frame_controls": [asdict(c) for c in controls]}
        return [_header(file.header) | _colors(file) | {"metadata": _metadata(file.metadata), "chunks": _chunks(file.chunks)} | found]
    if mode == "frames":
        file, plays, still, frames = codec.decode_animation(content, options)
        common = _header(file.header) | _colors(file) | {"plays": plays, "still": still}
        return [
            common
            | {"k": k, "seq": c.sequence, "frame_width": c.width, "frame_height": c.height, "x": c.x, "y": c.y, "delay_num": c.delay_num, "delay_den": c.delay_den, "dispose": c.dispose, "blend": c.blend, "data": data}
            for k, (c, _, data) in enumerate(frames)
        ]
    if mode == "composited":
        file, plays, _, frames = codec.decode_animation(content, options)
        canvas, size = codec.Canvas(file.header.width, file.header.height), {"width": file.header.width, "height": file.header.height, "plays": plays}
        shown = ((k, c, canvas.render(c, codec.to_bitmap(header, data, file.palette, file.transparency))) for k, (c, header, data) in enumerate(frames))
        return [size | {"k": k, "delay_num": c.delay_num, "delay_den": c.delay_den, "data": data} for k, c, data in shown]
    file, data = codec.decode(content, options)
    if mode == "bitmap":
        bitmap = codec.to_bitmap(file.header, data, file.palette, file.transparency, alpha)
        return [{"width": file.header.width, "height": file.header.height, "alpha": alpha, "data": bitmap}]
    return [_header(file.header) | _colors(file) | {"metadata": _metadata(file.metadata), "chunks": _chunks(file.ancillary), "data": data}]


def guarded(row: dict, key: str, on_error: str, function: Callable[[], list[dict]]) -> list[dict]:
    """A row's results, or its error as a value. What no rule of the format foresees has the code Unforeseen, so that one
    odd file can't end a job that was told to go on."""
    try:
        return [{key: row[key]} | out for out in function()]
    except Exception as e:
        if on_error == "FAILFAST":
            raise
        code, detail = (e.code, e.detail) if isinstance(e, codec.PngError) else ("Unforeseen", {"reason": f"{type(e).__name__}: {e}"})
        return [] if on_error == "DROPMALFORMED" else [{key: row[key], "error": {"code": code, "detail": list(detail.items())}}]


def read(df: DataFrame, mode: str = "image", key: str = "file_id", on_error: str = "PERMISSIVE", alpha: bool = True, validate_crc: bool = True, strict: bool = False) -> DataFrame:
    """df has key and content: MODES[mode] of each file, and error. The modes parse no more than they need: header only
    the first chunk, chunks no image data, and so on. An absent content is an empty file. chunks has all chunks from IHDR
    on and the animation's controls, null where there is none; composited has each frame's full canvas as RGBA8. Metadata
    and raw chunks come with image mode without asking, unlike in a decoder that returns one object; don't select them."""
    if on_error not in ERROR_MODES:
        raise ValueError(f"on_error must be one of {ERROR_MODES}")
    options = codec.Options(validate_crc=validate_crc, strict_ancillary=strict)
    kind = df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, {MODES[mode]}, {ERROR}"
    return map_rows(df.select(key, "content"), schema, lambda row: guarded(row, key, on_error, lambda: read_one(row["content"] or b"", mode, options, alpha)))


def _file(row: dict) -> codec.File:
    """A file from the columns of a row; those that are absent have defaults."""
    header = codec.Header(row["width"], row["height"], row["bit_depth"], row["color_type"], row.get("interlace") or 0)
    key = row.get("transparency")
    metadata = {k: v for k, v in (row.get("metadata") or {}).items() if v is not None}
    if "icc" in metadata:
        metadata["icc"] = (metadata["icc"]["name"], metadata["icc"]["profile"])
    extra = [codec.Chunk(c["type"], c["data"], c.get("crc") or 0, c["position"]) for c in row.get("chunks") or [] if c["type"] not in ("PLTE", "IDAT", "IEND")]
    return codec.File(header, row.get("palette"), key and codec.Transparency(key["kind"], tuple(key["values"])), metadata, extra)


def write(df: DataFrame, options: codec.EncodeOptions = codec.EncodeOptions(), key: str = "file_id", on_error: str = "PERMISSIVE") -> DataFrame:
    """df has key, HEADER's columns and data, and any of palette, transparency, metadata, chunks: (key, content, error)."""
    kind = df.schema[key].dataType.simpleString()
    one = lambda row: guarded(row, key, on_error, lambda: [{"content": codec.encode(_file(row), row["data"] or b"", options)}])
    return map_rows(df, f"{key} {kind}, content binary, {ERROR}", one)


def write_animations(df: DataFrame, options: codec.EncodeOptions = codec.EncodeOptions(), key: str = "file_id", on_error: str = "PERMISSIVE") -> DataFrame:
    """df has key, HEADER's columns and frames, an array of structs (k, width, height, x, y, delay_num, delay_den,
    dispose, blend, data) in any order, and any of plays, still, palette, transparency, metadata, chunks."""
    kind = df.schema[key].dataType.simpleString()

    def one(row: dict) -> list[dict]:
        frames = sorted(row["frames"] or [], key=lambda f: f["k"])
        controls = [(codec.Control(0, *(f[c] for c in ("width", "height", "x", "y", "delay_num", "delay_den", "dispose", "blend"))), f["data"]) for f in frames]
        return [{"content": codec.encode_animation(_file(row), controls, row.get("plays") or 0, row.get("still"), options)}]

    return map_rows(df, f"{key} {kind}, content binary, {ERROR}", lambda row: guarded(row, key, on_error, lambda: one(row)))


def segments(df: DataFrame, key: str = "file_id", size: int = codec.SEGMENT) -> DataFrame:
    """df has key and raw: raw bytes in segments of fixed size: key, seg_no, part. One task compresses one segment at a
    time, whatever the file's size; the segments of one file may go to many tasks."""
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("raw") / size)).cast("int")
    cut = df.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("raw"), i * size + 1, F.lit(size)))).alias("seg_no", "part"))
    return cut.repartition(key, "seg_no")


def compressed_segments(parts: DataFrame, key: str = "file_id", level: int = 6, compression: str = "dynamic") -> DataFrame:
    """Segments as raw DEFLATE, each ended by a flush, so that they join into one stream."""
    kind = parts.schema[key].dataType.simpleString()
    one = lambda row: [{key: row[key], "seg_no": row["seg_no"], "part": codec.compress_segment(row["part"], level, compression), "adler": zlib.adler32(row["part"]), "size": len(row["part"])}]
    return map_rows(parts, f"{key} {kind}, seg_no int, part binary, adler long, size long", one)


def joined_segments(parts: DataFrame, key: str = "file_id", level: int = 6, compression: str = "dynamic") -> DataFrame:
    """zlib streams from compressed segments: key, n_segments, adler, stream. The checksum of the whole combines those
    of the segments, as it is two sums modulo 65521."""
    m = 65521
    kind = parts.schema[key].dataType.simpleString()
    ordered = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seg_no", "part", "adler", "size"))).alias("s"))

    def one(row: dict) -> list[dict]:
        checksum = 1
        for part in row["s"]:
            checksum = combined_adler(checksum, part["adler"], part["size"])
        stream = codec.join_segments([part["part"] for part in row["s"]], checksum, level, compression)
        return [{key: row[key], "n_segments": len(row["s"]), "adler": checksum, "stream": stream}]

    return map_rows(ordered, f"{key} {kind}, n_segments int, adler long, stream binary", one)


def combined_adler(first: int, second: int, size: int) -> int:
    """The checksum of two byte strings in a row, from those of each and the size of the second."""
    m = 65521  # fixed value of the format
    low = ((first & 0xFFFF) + (second & 0xFFFF) - 1) % m
    return ((first >> 16) + (second >> 16) + ((first & 0xFFFF) - 1) * size) % m << 16 | low


def prepared(df: DataFrame, options: codec.EncodeOptions = codec.EncodeOptions(), key: str = "file_id") -> DataFrame:
    """Encoding in two phases, the first: a row for each segment of each image's filtered rows (key, seg_no, n_segments,
    part), with the file's head and tail beside segment 0. df is as write() takes it."""
    kind = df.schema[key].dataType.simpleString()

    def one(row: dict) -> list[dict]:
        whole = codec.prepare(_file(row), row["data"] or b"", options)
        n = whole.segment_count
        return [{"seg_no": i, "n_segments": n, "part": whole.segment(i), "head": whole.head if not i else None, "tail": whole.tail if not i else None} for i in range(n)]

    schema = f"{key} {kind}, seg_no int, n_segments int, part binary, head binary, tail binary, {ERROR}"
    return map_rows(df, schema, lambda row: guarded(row, key, "PERMISSIVE", lambda: one(row)))


def finished(whole: DataFrame, compressed: DataFrame, key: str = "file_id", level: int = 6, compression: str = "dynamic") -> DataFrame:
    """The second phase: (key, content, error) from prepared() and the compressed_segments() of its parts. A file that
    lacks segments has the error InvalidSegmentCount."""
    ends = whole.where("seg_no = 0").select(key, "n_segments", "head", "tail")
    both = ends.join(joined_segments(compressed, key, level, compression).withColumnRenamed("n_segments", "found"), key, "left")
    bad = F.coalesce(F.col("found"), F.lit(0)) != F.col("n_segments")
    detail = F.create_map(F.lit("expected"), F.col("n_segments").cast("string"), F.lit("actual"), F.coalesce(F.col("found"), F.lit(0)).cast("string"))
    content = F.concat("head", chunk_bytes(F.lit("IDAT"), F.col("stream")), "tail")
    done = both.select(key, F.when(~bad, content).alias("content"), F.when(bad, F.struct(F.lit("InvalidSegmentCount").alias("code"), detail.alias("detail"))).alias("error"))
    return done.unionByName(whole.where("error is not null").select(key, F.lit(None).cast("binary").alias("content"), "error"))
