"""Data source, error modes and the streaming compositor."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.types import StructType

from pixelloom.functions import codec as C
from pixelloom.operators import files
from pixelloom.sources import png
from pixelloom.streaming import compositor


@pytest.fixture(scope="module")
def images(spark):
    rng = np.random.default_rng(1)
    rows = [(f"d{i % 2}/{i}.png", 4 + i, 3, 8, C.RGB, rng.integers(0, 256, (4 + i) * 9, dtype=np.uint8).tobytes()) for i in range(5)]
    return spark.createDataFrame(rows, "path string, width long, height long, bit_depth int, color_type int, data binary")


def test_source_round_trip(spark, images, tmp_path):
    png.register(spark)
    images.write.format(png.NAME).mode("append").save(str(tmp_path))
    wanted = {f"{tmp_path}/{r['path']}": bytes(r["data"]) for r in images.collect()}
    found = spark.read.format(png.NAME).load(str(tmp_path))
    assert {r["path"]: bytes(r["data"]) for r in found.collect()} == wanted
    headers = spark.read.format(png.NAME).option("mode", "header").load(str(tmp_path)).where("width > 6")
    assert sorted(r["width"] for r in headers.collect()) == [7, 8]
    general = png.read_png(spark, str(tmp_path), "bitmap", alpha=False)
    assert {r["path"].removeprefix("file:"): bytes(r["data"]) for r in general.collect()} == wanted
    assert png.needed_mode({"width", "height"}) == "header" and png.needed_mode({"metadata"}) == "chunks" and png.needed_mode({"data"}) == "image"
    with pytest.raises(Exception, match="FileExistsError"):
        images.write.format(png.NAME).mode("append").save(str(tmp_path))
    assert {r["path"]: bytes(r["data"]) for r in found.collect()} == wanted and not (tmp_path / png.STAGING).exists()
    images.where("width > 6").write.format(png.NAME).mode("overwrite").save(str(tmp_path))
    assert sorted(r["width"] for r in spark.read.format(png.NAME).option("mode", "header").load(str(tmp_path)).collect()) == [7, 8]


def test_a_writer_task_that_is_tried_again(images, tmp_path):
    """An attempt that dies midway leaves nothing that the next one, or the table's readers, would meet."""
    batches = images.toArrow().to_batches()
    writer = png.PngWriter({"path": str(tmp_path)}, False)

    def dies():
        yield batches[0]
        raise RuntimeError("lost executor")

    with pytest.raises(RuntimeError):
        writer.write(dies())
    assert png.PngReader(None, {"path": str(tmp_path)}).paths() == []
    writer.commit([writer.write(iter(batches)), None])
    assert len(png.PngReader(None, {"path": str(tmp_path)}).paths()) == 5 and not (tmp_path / png.STAGING).exists()
    bad = batches[0].slice(0, 1).to_pylist()[0]
    for path in ("../out.png", "a/../../out.png"):
        with pytest.raises(ValueError, match="below the target"):
            writer.write(iter([pa.RecordBatch.from_pylist([bad | {"path": path}])]))


def test_header_mode_reads_no_more_than_headers(images, tmp_path):
    writer = png.PngWriter({"path": str(tmp_path)}, False)
    writer.commit([writer.write(iter(images.toArrow().to_batches()))])
    for path in png.PngReader(None, {"path": str(tmp_path)}).paths():
        with open(path, "r+b") as file:
            file.truncate(png.HEADER_BYTES)  # what comes after is gone, and header mode doesn't notice
    source = png.PngSource({"path": str(tmp_path), "mode": "header"})
    reader = source.reader(StructType.fromDDL(source.schema()))
    found = [row for part in reader.partitions() for batch in reader.read(part) for row in batch.to_pylist()]
    assert sorted(r["width"] for r in found) == [4, 5, 6, 7, 8] and not any(r["error"] for r in found)


def test_hostile_files_are_values(spark):
    """A size that no buffer can have, and an exception that no rule foresees, are errors of their rows."""
    huge = C.SIGNATURE + C.chunk_bytes("IHDR", (2**31 - 1).to_bytes(4, "big") * 2 + bytes([16, 6, 0, 0, 0])) + C.chunk_bytes("IDAT", zlib.compress(b"x")) + C.chunk_bytes("IEND", b"")
    found = files.read(spark.createDataFrame([(1, huge)], "file_id long, content binary"), "image").collect()
    assert found[0]["error"]["code"] == "ImageTooLarge"
    broken = lambda: [][0]
    assert files.guarded({"k": 1}, "k", "PERMISSIVE", broken)[0]["error"]["code"] == "Unforeseen" and files.guarded({"k": 1}, "k", "DROPMALFORMED", broken) == []


def test_batches_end_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(files, "OUTPUT_BYTES", 1000)  # in this process
    df = spark.range(3).repartition(1)
    out = files.map_rows(df, "id long, data binary", lambda r: [{"id": r["id"], "data": bytes(400)}] * 7)
    assert out.count() == 21


def test_error_modes(spark):
    good = C.encode(C.File(C.Header(1, 1, 8, C.GRAY)), b"\7")
    df = spark.createDataFrame([(1, good), (2, b"nonsense"), (3, None)], "file_id long, content binary")
    found = {r["file_id"]: r for r in files.read(df, "image").collect()}
    assert bytes(found[1]["data"]) == b"\7" and found[1]["error"] is None
    assert found[2]["error"]["code"] == "InvalidSignature" and found[3]["error"]["code"] == "UnexpectedEndOfInput"
    assert [r["file_id"] for r in files.read(df, "image", on_error="DROPMALFORMED").collect()] == [1]
    with pytest.raises(Exception, match="InvalidSignature"):
        files.read(df, "image", on_error="FAILFAST").collect()


def test_canvases_in_rows():
    """Frames over a canvas that is taken apart into a row and put together again after each."""
    rng = np.random.default_rng(2)
    for _ in range(30):
        plain, row = C.Canvas(5, 4), None
        for k in range(6):
            x, y = int(rng.integers(0, 4)), int(rng.integers(0, 3))
            w, h = int(rng.integers(1, 6 - x)), int(rng.integers(1, 5 - y))
            dispose, blend, data = int(rng.integers(0, 3)), int(rng.integers(0, 2)), rng.integers(0, 256, w * h * 4, dtype=np.uint8).tobytes()
            row, pixels = compositor.shown(row, (5, 4, w, h, x, y, dispose, blend, data, 6), k)
            assert pixels == plain.render(C.Control(0, w, h, x, y, 0, 0, dispose, blend), data)
        assert row[:2] == (6, True) and row[4] is None


def test_stream(spark, tmp_path):
    rows = [(f"f{f}", k, 2, 1, 1, 1, k % 2, 0, k % 3, k % 2, bytes([10 * k + f, 0, 0, 100 + k]), 6 if f else None) for f in range(2) for k in range(6)]
    schema = "file_id string, k long, canvas_width long, canvas_height long, width long, height long, x long, y long, dispose int, blend int, data binary, num_frames long"
    for i, part in enumerate((rows[3:8], rows[:3] + rows[8:], rows[:2])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = compositor.composite_stream(stream).writeStream.format("memory").queryName("shown").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    found = {(r["file_id"], r["k"]): bytes(r["data"]) for r in spark.table("shown").collect()}
    wanted = {}
    for f in range(2):
        canvas = C.Canvas(2, 1)
        for r in (r for r in rows if r[0] == f"f{f}"):
            wanted[r[0], r[1]] = canvas.render(C.Control(0, *r[4:8], 0, 0, *r[8:10]), r[10])
    assert found == wanted


def test_empty_metadata_columns(spark):
    from pyspark.sql import functions as F

    from pixelloom.operators import metadata

    header = C.Header(1, 1, 8, C.GRAY)
    text = {"kind": "tEXt", "keyword": "Title", "language": "", "translated": "", "compressed": False, "text": "x"}
    made = [C.encode(C.File(header, metadata=m), b"\1") for m in ({}, {"gamma": 45455}, {"text": [text]})]
    found = files.read(spark.createDataFrame(list(enumerate(made)), "file_id long, content binary"), "chunks")
    names = found.schema["metadata"].dataType.names
    rows = found.select("file_id", metadata.is_empty(F.col("metadata"), names).alias("empty")).collect()
    assert {r["file_id"]: r["empty"] for r in rows} == {0: True, 1: False, 2: False}


def test_blending_as_columns(spark):
    from pyspark.sql import functions as F

    from pixelloom.functions import expressions as X

    rng = np.random.default_rng(6)
    v = rng.integers(0, 256, (300, 8), dtype=np.uint8)
    v[::3, 7], v[1::5, 7], v[::4, 3] = 0, 255, 0
    df = spark.createDataFrame([(i, *map(int, row)) for i, row in enumerate(v)], "i int, r int, g int, b int, a int, r2 int, g2 int, b2 int, a2 int")
    two = [F.struct(*[F.col(c + n).alias(c) for c in "rgba"]) for n in ("", "2")]
    found = df.select("i", X.blend_over(*two).alias("o")).select("i", "o.r", "o.g", "o.b", "o.a").orderBy("i").collect()
    assert [list(r[1:]) for r in found] == C.blend_over(v[:, :4], v[:, 4:]).tolist()
