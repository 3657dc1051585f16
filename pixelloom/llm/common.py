"""What the text operators share: input columns, shared tables, hashing of UTF-8 words."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers once per Spark application, so that they need no installation."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, str(path.relative_to(root.parent)))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


#: What empties the caches that operators keep in a Python worker between tasks.
CACHES: list = []


def tidy() -> None:
    """For tasks that need much memory: drops other operators' caches in this worker, and has the allocator map large
    arrays by themselves and give free memory back."""
    import ctypes

    import pyarrow as pa

    for clear in CACHES:
        clear()
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the id (long) and the text (string): columns that clash or don't matter go no further."""
    ship(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def keep_rows(docs: DataFrame, make_judge, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose text make_judge()'s result approves: it takes a list of
    texts, null as empty, and returns a list of booleans. Nothing is shuffled or joined."""
    import pyarrow as pa

    ship(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(batches):
        judge = make_judge()
        for batch in batches:
            if len(batch):
                yield batch.filter(pa.array(judge([t or "" for t in batch.column(place).to_pylist()]), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def remainder(column: str, divisor: int):
    """crc32 of an id's decimal text, modulo divisor; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where that is unset."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.gettempdir()}/pixelloom-{os.getpid()}"
    return folder


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session's setting for what runs meanwhile."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut(df: DataFrame, **options) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends there, and lost executors
    cost no recomputation of what came before. The shuffle files that led to it go at once, the table with free() or
    when the driver exits. options: of the writer."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/pixelloom-{uuid.uuid4().hex}"
    with setting(spark, SHUFFLE_CLEANUP, "true"):
        df.write.options(**options).parquet(path)
    atexit.register(remove, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table.pixelloom_path = path
    return table


def free(*tables: DataFrame) -> None:
    """Removes tables made by cut() that nothing will read any more."""
    for table in tables:
        remove(table.sparkSession, table.pixelloom_path)


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(target, True)
    except Exception:  # the JVM may have gone first
        if path.startswith("file://"):
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x + _MIX
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordIds(dict):
    """Numbers words as they come; hashes() has the 64-bit hash of each number. Cleared by its user when it has grown."""

    def __init__(self):
        super().__init__()
        self._hashes: list[int] = []
        self._known = np.zeros(0, np.uint64)

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self._hashes.append(xxhash.xxh3_64_intdigest(word))
        self[word] = n = len(self)
        return n

    def hashes(self) -> np.ndarray:
        if len(self._known) < len(self._hashes):
            self._known = np.concatenate([self._known, np.array(self._hashes[len(self._known) :], np.uint64)])
        return self._known

    def forget(self) -> None:
        self.clear()
        self._hashes.clear()
        self._known = np.zeros(0, np.uint64)


def lower_ascii(text: str) -> bytes:
    """UTF-8 with A-Z lower-cased and nothing else."""
    return text.encode("utf-8", "surrogatepass").lower()


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers as the byte planes that the greatest needs, lowest first; a plane that compresses is compressed.
    In front: the number of planes, and the bytes of each."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1, write_content_size=True).compress
    wide = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = []
    for i in range(wide):
        plane = np.ascontiguousarray(values.astype("<u8", copy=False).view(np.uint8)[i::8]).tobytes()
        small = press(plane)
        planes.append(small if len(small) < len(plane) else plane)
    sizes = np.array([wide, len(values), *map(len, planes)], "<u4").tobytes()
    return sizes + b"".join(planes)


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    wide, n = np.frombuffer(data, "<u4", 2).tolist()
    expand = zstandard.ZstdDecompressor().decompress
    out = np.zeros((n, 8), np.uint8)
    at = 8 + 4 * wide
    for i, size in enumerate(np.frombuffer(data, "<u4", wide, 8).tolist()):
        plane = data[at : at + size]
        at += size
        out[:, i] = np.frombuffer(plane if size == n else expand(plane), np.uint8)
    return out.view("<u8").reshape(-1)
