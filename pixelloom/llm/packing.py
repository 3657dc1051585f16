"""Packing by shortest-pack-first over the length histogram.

Documents become token ids and an end id, cut into pieces of at most the sequence length. Only the histogram of
piece lengths (as many rows as a sequence has places) comes to the driver; there, lengths are placed longest
first, each onto the shortest packs that take it, as counts of packing patterns. Pieces get a rank among their
length without any task seeing all of a length, and the rank selects the pattern, the sequence and the offset.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vocabulary
from .common import CACHES, cut, texts

LENGTH, END_ID = 2048, 1
#: Pieces of one length that a rank task holds at most, on average, and parts of one length whose sizes it adds up.
RANK_ROWS, PART_ROWS = 500, 1000
#: Runs of white space that the fast encoder's pattern matching takes too much stack for.
LONG_SPACE = re.compile(r"\s{1000}")
#: Distinct words whose ids a worker keeps, and the longest word kept.
CACHE_WORDS, CACHE_CHARS = 200_000, 48

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class PieceIds(dict):
    """Little-endian ids of " " + word, or None where a word's white space would reach into its neighbours."""

    def __init__(self, plain):
        super().__init__()
        self.plain = plain

    def __missing__(self, word: str) -> bytes | None:
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        ids = self.plain(" " + word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


def le(ids: list[int]) -> bytes:
    import array
    import sys

    out = array.array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


_ENCODERS: dict = {}
CACHES.append(_ENCODERS.clear)


def encoder(path: str):
    """A function from a text to its ids as little-endian unsigned 32-bit bytes, as the file's library gives them."""
    if path not in _ENCODERS:
        import tiktoken

        ranks, special = vocabulary.byte_bpe(path)
        encoding = tiktoken.Encoding("file", pat_str=vocabulary.BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)

        def plain(text: str) -> bytes:
            """Of a text without special strings."""
            return slow(path, text) if len(text) >= 1000 and LONG_SPACE.search(text) else le(encoding.encode_ordinary(text))

        _ENCODERS[path] = list(special), plain, PieceIds(plain)
        vocabulary.byte_bpe.cache_clear()
        vocabulary.load.cache_clear()
    special, plain, words = _ENCODERS[path]

    def encode(text: str) -> bytes:
        if any(s in text for s in special):
            return slow(path, text)
        first, *rest = text.split(" ")  # a space between two other characters begins a pre-token
        if first[-1:].isspace():
            return plain(text)
        try:
            return plain(first) + b"".join(map(words.__getitem__, rest))
        except TypeError:
            return plain(text)

    return encode


def slow(path: str, text: str) -> bytes:
    """By the file's own library, for the few texts that the fast encoder is not sure to take."""
    if (path, "library") not in _ENCODERS:
        from tokenizers import Tokenizer

        _ENCODERS[path, "library"] = Tokenizer.from_file(path)
        _ENCODERS[path, "library"].no_truncation()
        _ENCODERS[path, "library"].no_padding()
    return le(_ENCODERS[path, "library"].encode(text, add_special_tokens=False).ids)


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids with end_id, cut every `length` ids: PIECES, one row per piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, step = encoder(tokenizer), le([end_id]), 4 * length
        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                out += [(key, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4) for at in range(0, len(ids), step) if (part := ids[at : at + step])]
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return texts(docs, id_col, text_col).mapInArrow(run, PIECES)


def shortest_pack_first(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, list[int]]]:
    """(how many packs, their lengths) for a histogram of lengths, placed longest first onto the shortest packs.

    Where no open pack takes a length, just as many packs are opened as its pieces need by themselves."""
    open_packs: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)  # by the space left
    for size in sorted(histogram, reverse=True):
        left, space = histogram[size], length
        while left:
            while space >= size and not open_packs.get(space):
                space -= 1
            if space < size:
                fresh = -(-left // (length // size))
                open_packs[length - size].append((fresh, [size]))
                left, space = left - fresh, length - size
                continue
            count, lengths = open_packs[space].pop()
            used = min(count, left)
            if count > used:
                open_packs[space].append((count - used, lengths))
            open_packs[space - size].append((used, [*lengths, size]))
            left -= used
    return [pack for space in sorted(open_packs) for pack in open_packs[space]]


def assignments(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first rank, offset) of every place in every pattern."""
    ranks: dict[int, int] = defaultdict(int)
    out, base = [], 0
    for count, lengths in patterns:
        offset = 0
        for size in lengths:
            out.append((size, ranks[size], ranks[size] + count, base, offset))
            ranks[size] += count
            offset += size
        base += count
    return out


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents: PIECES and sequence_id long, offset long; one row per piece.

    A null text counts as empty and still has its end id; ids may be null or repeated, every row is a document of
    its own. An empty table gives no rows. Equal pieces are interchangeable, so ties need no rule. Other columns
    of docs are ignored. Texts are tokenized whole; special strings in them become their special ids.
    """
    spark = docs.sparkSession
    table = cut(pieces(docs, tokenizer, length, end_id, id_col, text_col))
    histogram = {r["length"]: r["count"] for r in table.groupBy("length").count().collect()}  # at most `length` rows
    salts = spark.createDataFrame([(n, 1 + count // RANK_ROWS) for n, count in histogram.items()], "size long, salts long")
    places = spark.createDataFrame(
        assignments(shortest_pack_first(histogram, length)), "length long, first long, last long, sequence long, offset long"
    )
    salted = (  # each length in parts of its own number; as many rows to broadcast as a sequence has places
        table.join(F.broadcast(salts), F.col("length") == F.col("size"))
        .withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("salts")))
        .drop("size", "salts")
    )
    # how many pieces of a length stand before each of its parts: sums within stretches of parts, then over stretches
    ahead = Window.partitionBy("length").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("length", "stretch").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy("length", "salt").count().withColumn("stretch", F.floor(F.col("salt") / PART_ROWS))
    stretches = sizes.groupBy("length", "stretch").agg(F.sum("count").alias("count")).select("length", "stretch", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("ahead"))
    offsets = (
        sizes.withColumn("inside", F.coalesce(F.sum("count").over(within), F.lit(0))).join(stretches, ["length", "stretch"])
        .select("length", "salt", (F.col("ahead") + F.col("inside")).alias("before"))
    )
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = (
        salted.withColumn("own", F.row_number().over(own) - 1)
        .join(offsets, ["length", "salt"])
        .withColumn("rank", F.col("before") + F.col("own"))
    )
    # A place belongs to one length and a range of ranks: ranges are cut at multiples of RANK_ROWS, so that the
    # join has an equality on (length, block) and each piece meets only the ranges of its block.
    block = F.floor(F.col("rank") / RANK_ROWS)
    blocks = places.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / RANK_ROWS), F.floor((F.col("last") - 1) / RANK_ROWS))))
    joined = ranked.withColumn("block", block).join(
        blocks.withColumnRenamed("length", "of"),
        (F.col("length") == F.col("of")) & (ranked["rank"] >= F.col("first")) & (ranked["rank"] < F.col("last")) & (block == blocks["block"]),
    )
    return joined.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset"
    )
