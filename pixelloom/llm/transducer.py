"""Token counts by a byte-level BPE file compiled to a deterministic transducer.

The transducer reads UTF-8 bytes. A state holds where the pre-tokenizer's pattern stands and, for the pre-token
begun, what its tokens so far can still become: the longest suffix that begins some token, with the last token and
the relative count at each place in it. That is enough to continue, so there are finitely many states; they and
their transitions are compiled when first met. A transition is annotated with the change in the number of tokens.

Texts are cut into chunks of fixed size. All chunks advance in lockstep, one table lookup for a whole row of them.
Each chunk has a map from the entry states that can occur to its exit state and count: first the one at which a text
begins, then, round by round, whatever its predecessor's map leads to, until the maps are closed. An evaluation at a
further entry runs up to where it meets the chunk's first path, mostly within a word. So the rounds follow from how
many states can stand at one boundary (two on ordinary text, the length of a token on periodic text), not from the
number of chunks. The closed maps then compose in a parallel prefix scan, in as many steps as the number of chunks has
binary digits. Maps still open after MAX_ROUNDS are followed chunk by chunk from where they end, so counts are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import vocabulary
from .common import texts

CHUNK = 256
#: Bytes that run in lockstep at once, and states after which a worker's table is begun anew.
BLOCK_BYTES, MAX_STATES = 4 << 20, 250_000
#: Rounds in which the maps of chunks grow, and pairs of tokens whose fit a worker remembers.
MAX_ROUNDS, MAX_FITS = 40, 500_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Contractions of the pre-tokenizer's pattern (fixed values): their endings by first letter.
CONTRACTIONS = {"s": "", "t": "", "m": "", "d": "", "r": "e", "v": "e", "l": "l"}
BIAS = 128

_LOADED: dict[str, Transducer] = {}


class Table:
    """An open-addressing map from 64-bit keys to 32-bit values, read and written by whole arrays."""

    def __init__(self, bits: int = 16):
        self.bits, self.size = bits, 0
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 for keys that it lacks."""
        at = self.slots(keys)
        there = self.keys.take(at)
        out = self.values.take(at)
        left = np.flatnonzero(there != keys)
        while len(left):
            out[left] = -1
            left = left[self.keys.take(at[left]) >= 0]  # an empty slot ends the search
            at[left] = at[left] + 1 & len(self.keys) - 1
            out[left] = self.values.take(at[left])
            left = left[self.keys.take(at[left]) != keys[left]]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that it lacks, each once."""
        self.size += len(keys)
        if 3 * self.size > len(self.keys):
            old, kept = self.values[self.keys >= 0], self.keys[self.keys >= 0]
            size = self.size
            self.__init__(self.bits + max(1, (3 * size // len(self.keys)).bit_length()))
            self.add(kept, old)
            self.size = size
        at, left = self.slots(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]
            mine = free[self.keys[at[free]] == keys[free]]
            self.values[at[mine]] = values[mine]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = at[left] + 1 & len(self.keys) - 1


class Transducer:
    START, NOTHING = 0, (b"", ((None, 0),))

    def __init__(self, path: str):
        import regex

        self.vocab, self.special = vocabulary.byte_bpe(path)
        self.begins = {t[:n] for t in self.vocab for n in range(len(t))}  # what a token can still grow from
        self._class = regex.compile(r"(\p{L})|(\p{N})|(\p{White_Space})")
        self._classes: dict[str, str] = {}
        self._fits: dict[tuple, bool] = {}
        self.rounds = self.steps = 0  # of the last count: rounds in which maps grew, steps of the scan
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.ends = np.zeros(1024, np.int32)
        self.table = Table()
        self.number(("begin",))

    # the pieces of a transition

    def kind(self, char: str) -> str:
        if (found := self._classes.get(char)) is None:
            match = self._class.match(char)
            found = self._classes[char] = "other" if not match else ("letter", "number", "space")[match.lastindex - 1]
        return found

    def encode(self, data: bytes) -> list[bytes]:
        """Plain BPE, to learn whether two tokens stay apart."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.vocab.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
            least = min(ranks)
            if least == 1 << 30:
                break
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: bytes | None, right: bytes) -> bool:
        if left is None:
            return True
        if (found := self._fits.get((left, right))) is None:
            if len(self._fits) >= MAX_FITS:
                self._fits.clear()
            found = self._fits[left, right] = self.encode(left + right) == [left, right]
        return found

    def feed(self, bpe: tuple, data: bytes) -> tuple[tuple, int]:
        """Extends a pre-token by bytes: its new state and the change in its number of tokens."""
        change = 0
        for byte in data:
            suffix, places = bpe
            longer = suffix + bytes([byte])
            for n in range(len(longer), 0, -1):
                token = longer[-n:]
                if token in self.vocab:
                    last, count = places[len(suffix) - n + 1]
                    if self.fits(last, token):
                        break
            else:
                raise AssertionError("every byte is a token")
            change += count + 1
            kept = longer
            while kept not in self.begins:
                kept = kept[1:]
            start = len(places) - len(kept)
            bpe = kept, (*(self.place(kept[i:], places[start + i], count + 1) for i in range(len(kept))), (token, 0))
        return bpe, change

    def place(self, grown: bytes, place: tuple | None, base: int) -> tuple | None:
        """A place in a state, forgotten if no token grows from there."""
        return (place[0], place[1] - base) if place and grown in self.begins else None

    def begin(self, char: str, data: bytes) -> tuple[tuple, int]:
        """A character at the beginning of a pre-token."""
        kind = self.kind(char)
        if kind == "space":
            return ("space", self.NOTHING, data), 0  # the last character of white space waits, uncounted
        bpe, change = self.feed(self.NOTHING, data)
        return ("quote" if char == "'" else kind, bpe), change

    def read(self, state: tuple, char: str, data: bytes) -> tuple[tuple, int]:
        mode, kind = state[0], self.kind(char)
        if mode == "begin":
            return self.begin(char, data)
        if mode == "space":
            _, before, last = state
            if kind == "space":
                bpe, change = self.feed(before, last)
                return ("space", bpe, data), change
            if last == b" ":
                bpe, change = self.feed(self.NOTHING, b" " + data)
                return (kind, bpe), change
            alone = self.feed(self.NOTHING, last)[1]
            after, change = self.begin(char, data)
            return after, alone + change
        if mode == "quote":
            rest = CONTRACTIONS.get(char)
            if rest == "":
                return ("begin",), self.feed(self.NOTHING, b"'" + data)[1] - 1
            if rest:
                return ("maybe", rest, *self.feed(self.NOTHING, data)[:1], data), self.feed(self.NOTHING, data)[1]
            mode = "other"
        if mode == "maybe":
            _, rest, bpe, first = state
            if char == rest:
                return ("begin",), self.feed(self.NOTHING, b"'" + first + data)[1] - 2
            state, mode = ("letter", bpe), "letter"
        if kind == mode:
            bpe, change = self.feed(state[1], data)
            return (kind, bpe), change
        return self.begin(char, data)

    def step(self, state: tuple, byte: int) -> tuple[tuple, int]:
        base, data = (state[1], state[2]) if state[0] == "inside" else (state, b"")
        data += bytes([byte])
        need = 1 if data[0] < 0xC0 else 2 if data[0] < 0xE0 else 3 if data[0] < 0xF0 else 4
        if len(data) < need:
            return ("inside", base, data), 0
        return self.read(base, data.decode("utf-8", "replace")[0], data)

    def end(self, state: tuple) -> int:
        """Tokens still to count at the end of a text: white space that waits."""
        return self.feed(state[1], state[2])[1] if state[0] == "space" else 0

    # the compiled table

    def tidy(self) -> None:
        """Begins the table anew when it has grown; state numbers hold until then."""
        if len(self.states) > MAX_STATES:
            self.clear()

    def number(self, state: tuple) -> int:
        if (n := self.numbers.get(state)) is None:
            n = self.numbers[state] = len(self.states)
            self.states.append(state)
            if n >= len(self.ends):
                self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
            self.ends[n] = self.end(state)
        return n

    def compile(self, keys: np.ndarray) -> None:
        """The transitions of new (state, byte) pairs."""
        keys = np.unique(keys)
        values = np.empty(len(keys), np.int32)
        for i, key in enumerate(keys.tolist()):
            after, change = self.step(self.states[key >> 8], key & 255)
            if not -BIAS <= change < BIAS:
                raise AssertionError("a change that does not fit")
            values[i] = self.number(after) << 8 | change + BIAS
        self.table.add(keys, values)

    def advance(self, states: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One byte for each of many states: the next states and the count changes."""
        keys = states.astype(np.int64) << 8
        keys |= data
        found = self.table.get(keys)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            self.compile(keys[missing])
            found[missing] = self.table.get(keys[missing])
        return found >> 8, (found & 255) - BIAS

    def count(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens counted, exit state) of each text, given as (start, size) in data and its entry state."""
        chunks = np.maximum(1, -(-sizes // CHUNK))
        first = np.cumsum(chunks) - chunks
        text = np.repeat(np.arange(len(sizes)), chunks)
        place = np.arange(len(text)) - first[text]
        at = starts[text] + place * CHUNK
        size = np.minimum(CHUNK, sizes[text] - place * CHUNK)
        order = np.argsort(-size, kind="stable")  # so that those still running come first
        running = np.searchsorted(-size[order], -np.arange(CHUNK), side="left")  # lanes with more than i bytes
        lane = np.empty(len(order), np.int64)
        lane[order] = np.arange(len(order))
        path = np.zeros((CHUNK + 1, len(order)), np.int32)
        total = np.zeros((CHUNK + 1, len(order)), np.int32)
        path[0, lane[first]] = heads
        ends = at[order]
        for i in range(CHUNK):
            n = running[i]
            path[i + 1, n:], total[i + 1, n:] = path[i, n:], total[i, n:]
            if n:
                path[i + 1, :n], change = self.advance(path[i, :n], data.take(ends[:n] + i))
                np.add(total[i, :n], change, out=total[i + 1, :n])

        def evaluate(chunk: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Exit states and counts of chunks at other entries: where one meets its chunk's path, that path's end
            holds, its counts moved along."""
            leave, counted = np.empty(len(chunk), np.int32), np.empty(len(chunk), np.int32)
            left, sums, lanes = np.arange(len(chunk)), np.zeros(len(chunk), np.int32), lane[chunk]
            for i in range(CHUNK + 1):
                met = path[i, lanes] == state
                stop = met | (i >= size[chunk])
                if stop.any():
                    done, met, mine = left[stop], met[stop], lanes[stop]
                    leave[done] = np.where(met, path[CHUNK, mine], state[stop])
                    counted[done] = sums[stop] + np.where(met, total[CHUNK, mine] - total[i, mine], 0)
                    left, chunk, lanes, state, sums = left[~stop], chunk[~stop], lanes[~stop], state[~stop], sums[~stop]
                if not len(left):
                    break
                state, change = self.advance(state, data.take(at[chunk] + i))
                sums = sums + change
            return leave, counted

        # the maps, a layer for each round: entry state, exit state and count of each chunk, -1 and -2 where there is none
        entry, leave, counted = [path[0][lane]], [path[CHUNK][lane]], [total[CHUNK][lane]]
        last = first + chunks - 1
        inner = np.ones(len(text), bool)
        inner[last] = False
        fresh, self.rounds = np.flatnonzero(inner), 0
        while len(fresh) and self.rounds < MAX_ROUNDS:
            after, state = fresh + 1, leave[-1][fresh]
            new = ~np.any([layer[after] == state for layer in entry], axis=0)
            after, state = after[new], state[new]
            if not len(after):
                break
            self.rounds += 1
            for layers, values, none in zip((entry, leave, counted), (state, *evaluate(after, state)), (-1, -2, 0)):
                layers.append(np.full(len(text), none, np.int32))
                layers[-1][after] = values
            fresh = after[inner[after]]
        entries, leaves, sums = np.stack(entry), np.stack(leave), np.stack(counted).astype(np.int64)
        # where in the next chunk's map each exit is; the scan composes that over 1, 2, 4 ... chunks
        to = np.full(entries.shape, -1, np.int16)
        for j in range(len(entries)):
            to[:, :-1][leaves[:, :-1] == entries[j, 1:]] = j
        reach, self.steps = 1, 0
        while reach < chunks.max(initial=1):
            join = np.flatnonzero(place >= reach)
            middle = to[:, join - reach]
            known, middle = middle >= 0, np.maximum(middle, 0)
            sums[:, join], to[:, join] = (
                sums[:, join - reach] + np.take_along_axis(sums[:, join], middle, 0),
                np.where(known, np.take_along_axis(to[:, join], middle, 0), -1),
            )
            reach, self.steps = 2 * reach, self.steps + 1
        into = np.where(chunks > 1, to[0, np.maximum(last - 1, 0)], 0)
        counts, out = sums[0, last], leaves[into, last]
        for i in np.flatnonzero(into < 0).tolist():  # maps that are still open
            at_chunk = first[i] + int(np.argmin(to[0, first[i] : last[i]] >= 0))
            before = int(to[0, at_chunk - 1]) if at_chunk > first[i] else 0
            counts[i], state = sums[0, at_chunk], leaves[before, at_chunk : at_chunk + 1]
            for chunk in range(at_chunk + 1, int(last[i]) + 1):
                state, more = evaluate(np.array([chunk]), state)
                counts[i] += int(more[0])
            out[i] = state[0]
        return counts, out


def transducer(path: str) -> Transducer:
    if path not in _LOADED:
        _LOADED[path] = Transducer(path)
    return _LOADED[path]


def count_texts(machine: Transducer, data: list[bytes]) -> np.ndarray:
    """The number of tokens of each UTF-8 text; special strings count as one token and end what stands before.

    Texts run together in blocks of BLOCK_BYTES; of a longer one each block begins in the state the last one left."""
    counts = np.zeros(len(data), np.int64)
    special = [s.encode() for s in machine.special]
    held: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        if held:
            owner, parts = zip(*held)
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            found, state = machine.count(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, sizes, np.zeros(len(parts), np.int32))
            np.add.at(counts, np.array(owner), found + machine.ends[state])
            held, size = [], 0
            machine.tidy()

    for i, text in enumerate(data):
        parts = [text]
        for s in special:
            parts = [p for part in parts for p in part.split(s)]
        counts[i] += len(parts) - 1
        for part in parts:
            if size + len(part) > BLOCK_BYTES:
                flush()
            if len(part) <= BLOCK_BYTES:
                held.append((i, part))
                size += len(part)
                continue
            state = machine.states[Transducer.START]
            for at in range(0, len(part), BLOCK_BYTES):
                block = np.frombuffer(part, np.uint8, min(BLOCK_BYTES, len(part) - at), at)
                found, left = machine.count(block, np.zeros(1, np.int64), np.array([len(block)]), np.array([machine.number(state)], np.int32))
                counts[i] += int(found[0])
                state = machine.states[left[0]]
                machine.tidy()
            counts[i] += machine.end(state)
    flush()
    return counts


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA: bytes and tokens of every whole text, and whether it has more than `limit` tokens.

    A null text counts as empty: no bytes, no tokens. Null and repeated ids pass through; an empty table gives an
    empty one; other columns are ignored. One narrow pass: nothing is shuffled, and memory
    follows from the block, not from the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer)
        for batch in batches:
            data = [(t.as_py() or b"") for t in batch.column(1).cast(pa.binary())]
            counts = count_texts(machine, data) if data else np.zeros(0, np.int64)
            sizes = np.fromiter(map(len, data), np.int64, len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(counts), pa.array(counts > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)
