"""BPE encoding and decoding with a contiguous rank array.

A word is a row of parts; next to the parts stands a contiguous array with the rank of merging each part with its
right neighbour. The smallest rank is found by scanning (leftmost first), the boundary behind it is deleted, and
the ranks left and right of the merged part are refreshed. For words of ordinary length a scan of so short an
array beats any queue; words longer than SHORT use a queue, with the same result.
"""

from __future__ import annotations

import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import vocabulary
from .common import texts

SHORT = 200
#: White-space delimited chunks, and words, whose results a worker keeps; the longest chunk kept.
CACHE_CHUNKS, CACHE_WORDS, CACHE_CHARS = 250_000, 250_000, 48
NO_MERGE = 1 << 62
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Separators that str.split() takes for white space and Unicode does not.
ODD_SPACE = "\x1c\x1d\x1e\x1f"

_LOADED: dict[str, Codec] = {}


class Codec:
    """A BPE file with word ends, lower case and no white space: encode() and decode() as its library does."""

    def __init__(self, path: str):
        import regex

        data = vocabulary.load(path)
        model = data["model"]
        kinds = [n["type"] for n in data["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or data["decoder"] or model["unk_token"] or not model["end_of_word_suffix"]:
            raise ValueError(f"{path}: not a BPE file with word ends, lower case and white space dropped")
        self.suffix = model["end_of_word_suffix"]
        self.pattern = regex.compile(data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.token = {i: t for t, i in (self.ids | self.special).items()}
        self.chars = {b: c for c, b in vocabulary.byte_chars().items()}
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        # (left id, right id) -> rank and merged id in one number, ordered by rank
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(self.ids[left] << 32 | self.ids[right], rank << 32 | self.ids[left + right])
        self._words: dict[str, tuple[int, ...]] = {}
        self._chunks: dict[str, tuple[int, str, str]] = {}

    def parts(self, word: str) -> list[int]:
        chars = [self.chars[b] for b in word.encode("utf-8", "surrogatepass")]
        chars[-1] += self.suffix
        return [self.ids[c] for c in chars]

    def merge(self, parts: list[int]) -> list[int]:
        """Merges a word's parts in place, by scanning the contiguous rank array."""
        rank = self.merges.get
        ranks = [rank(a << 32 | b, NO_MERGE) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_MERGE:
                break
            at = ranks.index(least)
            parts[at] = merged = least & 0xFFFFFFFF
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] << 32 | merged, NO_MERGE)
            if at < len(ranks):
                ranks[at] = rank(merged << 32 | parts[at + 1], NO_MERGE)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same by a queue of (rank, place) over a linked list, for words too long to scan again and again."""
        rank, n = self.merges.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i] << 32 | parts[i + 1], NO_MERGE)) != NO_MERGE]
        heapq.heapify(queue)
        while queue:
            found, at, left, right = heapq.heappop(queue)
            behind = after[at] if after[at] < n else -1
            if parts[at] != left or behind < 0 or parts[behind] != right:
                continue  # one of the two has been merged since
            parts[at], parts[behind] = found & 0xFFFFFFFF, -1
            after[at] = after[behind]
            if after[at] < n:
                before[after[at]] = at
            for i, j in ((before[at], at), (at, after[at])):
                if i >= 0 and j < n and (r := rank(parts[i] << 32 | parts[j], NO_MERGE)) != NO_MERGE:
                    heapq.heappush(queue, (r, i, parts[i], parts[j]))
        return [p for p in parts if p >= 0]

    def word(self, word: str) -> tuple[int, ...]:
        if (found := self._words.get(word)) is None:
            parts = self.parts(word)
            found = tuple(self.merge(parts) if len(parts) <= SHORT else self.merge_long(parts))
            if len(word) <= CACHE_CHARS:
                if len(self._words) >= CACHE_WORDS:
                    self._words.clear()
                self._words[word] = found
        return found

    def plain(self, text: str) -> list[int]:
        """Ids of a text without special strings."""
        if not text.isascii():
            # case is lowered character by character, so a final sigma gets no form of its own
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return [i for word in self.pattern.findall(text.lower()) for i in self.word(word)]

    def chunk(self, chunk: str) -> tuple[int, str, str]:
        ids = self.plain(chunk)
        found = len(ids), " ".join(map(str, ids)), self.decode(ids)
        if len(chunk) <= CACHE_CHARS:
            if len(self._chunks) >= CACHE_CHUNKS:
                self._chunks.clear()
            self._chunks[chunk] = found
        return found

    def encode(self, text: str) -> list[int]:
        """Ids of a text; special strings in it become their ids."""
        out, at = [], 0
        for found in self.split_special.finditer(text):
            out += [*self.plain(text[at : found.start()]), self.special[found[0]]]
            at = found.end()
        return out + self.plain(text[at:])

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: its tokens, special ones too, joined by spaces."""
        return " ".join([self.token[i] for i in ids])

    def digest(self, text: str) -> tuple[int, str, str]:
        """How many ids a text has, its ids in decimal and its decoded text, each joined by spaces."""
        if any(s in text for s in self.special) or any(c in text for c in ODD_SPACE):
            ids = self.encode(text)
            return len(ids), " ".join(map(str, ids)), self.decode(ids)
        # no word crosses white space, so chunks between white space stand for themselves
        known = self._chunks.get
        rows = [known(c) or self.chunk(c) for c in text.split()]
        if not rows:
            return 0, "", ""
        counts, ids, decoded = zip(*rows)
        return sum(counts), " ".join(ids), " ".join(decoded)


def codec(path: str) -> Codec:
    if path not in _LOADED:
        _LOADED[path] = Codec(path)
    return _LOADED[path]


def encoded(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every text: the operator's real output.

    A null text counts as empty: no ids, an empty text. Null and repeated ids pass through; an empty table gives
    an empty one; other columns are ignored; texts of any length are encoded whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(tokenizer)
        for batch in batches:
            ids = [coder.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(coder.decode, ids), pa.string())], names=["doc_id", "ids", "decoded"]
            )

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA of every text: encoded()'s ids and decoded texts as SHA-256 digests, so that neither is moved.

    Same cases as encoded()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(tokenizer)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            counts, ids, decoded = [], [], []
            for text in batch.column(1):
                n, i, d = coder.digest(text.as_py() or "")
                counts.append(n)
                ids.append(sha(i))
                decoded.append(sha(d))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)
