"""PNG files as a Spark data source: spark.read.format("pixelloom_png") and df.write.format("pixelloom_png").

The source opens files itself, so its paths must be mounted on all executors. read_png() works with any store that
Spark reads, since Spark's binaryFile source fetches the bytes, and is the general way. Options of both: mode (header,
chunks, image, bitmap, frames, composited, raw), on_error, alpha, validate_crc, strict.
"""

from __future__ import annotations

import glob
import operator
import os
import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import codec
from ..operators import files

NAME = "pixelloom_png"
FILES_IN_PARTITION = 64
COMPARISONS = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, In: lambda value, among: value in among}
HEADER_COLUMNS = ("width", "height", "bit_depth", "color_type", "interlace")
#: Bytes that hold a file's signature and header chunk (fixed value of the format).
HEADER_BYTES = 33
STAGING = f"_{NAME}"


def read_png(spark: SparkSession, path: str, mode: str = "image", **options) -> DataFrame:
    """Files under a path of any store, one file to a row (or one row for each frame or raw chunk), by path. Spark
    fetches whole files; where only headers are wanted and paths are mounted, the source reads 33 bytes of each."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", options.pop("glob", "*.png")).option("recursiveFileLookup", "true").load(path)
    return files.read(found.select(F.col("path"), F.col("content")), mode, "path", **options)


def needed_mode(columns: set[str]) -> str:
    """The cheapest mode that has all the columns."""
    for mode in ("header", "chunks", "image"):
        if columns <= {part.split(":")[0].split(" ")[0] for part in StructType.fromDDL(files.MODES[mode]).names} | {"path", "error"}:
            return mode
    raise ValueError(f"no mode has {sorted(columns)}")


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class PngReader(DataSourceReader):
    """Reads many files to a partition. Comparisons with path and header fields are decided before anything is inflated."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path = schema, options["path"]
        self.mode, self.on_error = options.get("mode", "image"), options.get("on_error", "PERMISSIVE").upper()
        flag = lambda name, default: options.get(name, default).lower() == "true"
        self.alpha = flag("alpha", "true")
        self.options = codec.Options(validate_crc=flag("validate_crc", "true"), strict_ancillary=flag("strict", "false"))
        self.filters: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in COMPARISONS and name in ("path", *HEADER_COLUMNS):
                self.filters.append((name, type(f), f.value))
            else:
                yield f

    def paths(self) -> list[str]:
        """All files, but for those in folders with hidden names."""
        found = sorted(glob.glob(os.path.join(self.path, "**", "*.png"), recursive=True)) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        found = [p for p in found if not any(part.startswith((".", "_")) for part in os.path.relpath(p, self.path).split(os.sep)[:-1])]
        return found

    def partitions(self) -> list[InputPartition]:
        found = [p for p in self.paths() if all(COMPARISONS[kind](p, value) for name, kind, value in self.filters if name == "path")]
        return [Files(found[i : i + FILES_IN_PARTITION]) for i in range(0, len(found), FILES_IN_PARTITION)] or [Files([])]

    def wanted(self, content: bytes) -> bool:
        about = [(n, k, v) for n, k, v in self.filters if n != "path"]
        if not about:
            return True
        try:
            header = codec.read_header(content, self.options.validate_crc)
        except codec.PngError:
            return False  # its fields are null, so no comparison holds
        return all(COMPARISONS[kind](getattr(header, name), value) for name, kind, value in about)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(self.schema)
        for path in partition.paths:
            with open(path, "rb") as file:
                content = file.read(HEADER_BYTES)  # enough for the filters, and for all that header mode parses
                wanted = self.wanted(content)
                if wanted and self.mode != "header":
                    content += file.read()
            if wanted:
                rows = files.guarded({"path": path}, "path", self.on_error, lambda content=content: files.read_one(content, self.mode, self.options, self.alpha))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)


class Written(WriterCommitMessage):
    """A finished attempt: its staging folder, and the files in it, by their paths below the target."""

    def __init__(self, folder: str, paths: list[str]):
        self.folder, self.paths = folder, paths


class PngWriter(DataSourceArrowWriter):
    """Rows with path (a name relative to the target), header fields and data, or with content, become files.

    Every attempt of a task writes to a staging folder of its own, so one that is retried after a lost executor meets
    nothing of the first. The driver moves the files of the attempts that Spark committed to their places, and removes
    the staging folder, whether the job ends well or not. overwrite removes the files that were there before."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.target, self.overwrite = options["path"], overwrite
        self.staging = os.path.join(self.target, STAGING, uuid.uuid4().hex)
        threads = options.get("threads", "single").lower()
        self.encode = codec.EncodeOptions(
            level=int(options.get("level", 6)), palette=options.get("palette", "keep"), strip=options.get("strip", "keep"), compression=options.get("compression", "dynamic"),
            interlace=None if "interlace" not in options else options["interlace"].lower() == "true", threads=int(threads) if threads.isdigit() else threads,
        )

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder, paths = os.path.join(self.staging, uuid.uuid4().hex), []
        for batch in iterator:
            for row in batch.to_pylist():
                path = os.path.normpath(row["path"].lstrip("/"))
                if path.split(os.sep)[0] in ("..", ".", STAGING):
                    raise ValueError(f"{row['path']} is not below the target")
                content = row.get("content") or codec.encode(files._file(row), row["data"], self.encode)
                place = os.path.join(folder, path)
                os.makedirs(os.path.dirname(place), exist_ok=True)
                with open(place, "wb") as file:
                    file.write(content)
                paths.append(path)
        return Written(folder, paths)

    def commit(self, messages: list) -> None:
        found = [(m.folder, path) for m in messages if m for path in m.paths]
        names = [path for _, path in found]
        taken = [p for p in names if os.path.exists(os.path.join(self.target, p))] if not self.overwrite else []
        if taken or len(set(names)) < len(names):
            self.clean()
            raise FileExistsError(taken[0] if taken else "two rows have the same path")
        if self.overwrite:
            for path in PngReader(StructType(), {"path": self.target}).paths():
                os.remove(path)
        for folder, path in found:
            place = os.path.join(self.target, path)
            os.makedirs(os.path.dirname(place), exist_ok=True)
            os.replace(os.path.join(folder, path), place)
        self.clean()

    def abort(self, messages: list) -> None:
        self.clean()

    def clean(self) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)
        try:
            os.rmdir(os.path.dirname(self.staging))  # unless another job writes
        except OSError:
            pass


class PngSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return f"path string, {files.MODES[self.options.get('mode', 'image')]}, {files.ERROR}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PngReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return PngWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets comparisons be pushed into it."""
    from ..plans.shipping import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PngSource)
