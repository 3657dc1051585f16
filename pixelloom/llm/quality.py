"""Quality rules by compression bands: zstandard ratios of whole documents and of fixed chunks.

Repetitive text compresses far better than prose of its length, noise far worse. The limits depend on the
length, because a short text has little to refer back to. All work is per document, in one narrow pass.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keep_rows, texts

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: (from so many bytes, lowest ratio, highest ratio). Each lies a little outside the range that prose of its length
#: has, measured on all texts of sf0.1, check_s and check_l that the other rules keep, on their chunks, and for the
#: shortest on passages of them. Noise of under 128 bytes compresses no worse than prose, so it is told by no ratio.
BANDS = (
    (0, 0.95, float("inf")), (50, 0.90, 1.30), (60, 0.80, 1.25), (70, 0.75, 1.20), (80, 0.71, 1.17), (90, 0.68, 1.16),
    (100, 0.64, 1.15), (128, 0.60, 1.05), (160, 0.56, 0.98), (200, 0.53, 0.93),
    (256, 0.52, 0.88), (320, 0.50, 0.84), (400, 0.48, 0.79), (512, 0.46, 0.75), (700, 0.42, 0.71), (1024, 0.39, 0.67),
    (1500, 0.37, 0.62), (2048, 0.36, 0.60), (3072, 0.35, 0.57), (4096, 0.34, 0.55), (8192, 0.33, 0.50), (16384, 0.32, 0.50),
)
CHUNK_BYTES = 4096
#: A last chunk shorter than this belongs to the one before.
TAIL_BYTES = 256
#: A document goes if more than this share of its chunk bytes is out of band; no chunk of those tables' prose is.
CHUNK_SHARE = 0.25
LEVEL = 1
MIN_WORDS, WINDOW, REPEAT_PERCENT = 10, 5, 20

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_bytes long, zstd_ratio double, bad_chunk_share double"
)


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a window of WINDOW words that occurs at least twice."""
    grams = list(zip(*(words[i:] for i in range(WINDOW))))
    if len(set(grams)) == len(grams):
        return 0
    counts, covered, end = Counter(grams), 0, 0
    for start, gram in enumerate(grams):
        if counts[gram] > 1:
            covered += start + WINDOW - max(start, end)
            end = start + WINDOW
    return covered


def out_of_band(size: int, ratio: float, bands=BANDS) -> bool:
    limits = None
    for least, low, high in bands:
        if size >= least:
            limits = (low, high)
    return limits is not None and not limits[0] <= ratio <= limits[1]


def verdict(data: bytes, compress, bands=BANDS, chunk=CHUNK_BYTES, share=CHUNK_SHARE) -> tuple[float, float, bool]:
    """The whole text's ratio, the share of its bytes in chunks out of band, and whether both are acceptable."""
    if not data:
        return 0.0, 0.0, True
    ratio, bad = len(compress(data)) / len(data), 0
    if len(data) > chunk:
        starts = list(range(0, len(data), chunk))
        if len(data) - starts[-1] < min(TAIL_BYTES, chunk):
            starts.pop()
        for at, end in zip(starts, [*starts[1:], len(data)]):
            part = data[at:end]
            if out_of_band(len(part), len(compress(part)) / len(part), bands):
                bad += len(part)
    bad_share = bad / len(data)
    return ratio, bad_share, not out_of_band(len(data), ratio, bands) and bad_share <= share


def measure(text: str | None, compress, **limits) -> tuple:
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    repeat = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeat > REPEAT_PERCENT * len(words)
    ratio, bad, good = verdict(data, compress, **limits)
    return (
        len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
        repeat, failed, good and not failed, len(data), ratio, bad,
    )


def compression_bands(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """Measures and judges every document; one row per input row, in SCHEMA.

    limits: bands, chunk, share, as verdict() has them. A null text counts as empty: no words, so base_failed.
    A null id passes through. Equal rows give equal rows. An empty table gives an empty one; other columns of
    docs are ignored. Texts of any length are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            rows = [measure(text.as_py(), compress, **limits) for text in column]
            columns = list(zip(*rows)) or [()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    names = [part.split()[0] for part in SCHEMA.split(", ")]
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64(), pa.float64(), pa.float64()]
    return texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def kept(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """The rows of docs whose text compression_bands() keeps, with all their columns."""

    def judge():
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        return lambda found: [measure(text, compress, **limits)[6] for text in found]

    return keep_rows(docs, judge, text_col)
