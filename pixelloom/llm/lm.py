"""Language-model scores by a weighted backoff automaton over a corpus-wide model of n-grams.

Counts cover all training documents and are exact but for equal 64-bit hashes. A state is a history shorter than
the longest n-grams that occurs in training; the root is the empty one. From a state an arc leads on for every word that
followed its history, with that word's smoothed log probability, to the state of the longest known suffix. Any other
word takes the failure arc, whose weight pays for backing off, to the history without its first word, and so on down
to the root, which has an arc for every word. A history h of n words is smoothed by a prior of `priors[n - 1]` tokens
spread as the shorter history h' has it: p(w|h) = (c(hw) + prior p(w|h')) / (c(h) + prior). So the probabilities of a
state add up to one, its failure weight is prior / (c(h) + prior), and no arc needs pruning.

The model of a large corpus fits nowhere, and no text needs all of it. Texts are cut into blocks, whole but for those
longer than a block. A block asks for the totals of its distinct n-grams: their sorted 64-bit hashes go, packed with
the block's own counts, to a fixed number of ranges of hashes, however large the corpus is. While a range would hold too much, the
questions of about as many blocks are merged for each range, which asks finer ranges in turn; at the last level totals
are added up, and they go back the same way. A block then has all states and arcs its own texts can meet, and its
texts run through them side by side from left to right, each carrying its state.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordIds, cut, mix, pack, remainder, texts, tidy, unpack

@dataclass(frozen=True)
class Settings:
    """order: longest n-grams. priors: weight of the shorter history's distribution, in tokens, by the length of the
    history. add: what the root adds to each count. block_bytes: of text in a block. range_grams: n-grams that a range
    of hashes has at most, about. fan_bits: ranges at each level, as a power of two. stride: tokens after which a long
    text goes on in another lane; a state depends on the order - 1 tokens before alone, so the lane begins in the state
    that the one before ends in, the root carried over those tokens."""

    order: int = 3
    priors: tuple[float, ...] = (200.0, 20.0, 10.0, 5.0)
    add: float = 0.1
    block_bytes: int = 6_000_000
    range_grams: int = 1_500_000
    fan_bits: int = 8
    stride: int = 512


DEFAULT = Settings()
#: n-grams of one order that a byte of text has at most, about.
GRAMS_A_BYTE = 0.1
BEGIN, END = b" begin", b" end"  # no words, as they hold a blank
SPACE = re.compile(rb"[ \t-\r]")
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_backoffs long"
BLOCKS = "block long, data binary"
ASKED = "asker long, range long, gram_order int, keys binary, counts binary"
ANSWER = "asker long, range long, gram_order int, totals binary, tokens long, words long"
PIECE = ["row", "doc_id", "held", "text", "head", "skip", "last"]


# Blocks


def pieces_of(data: bytes, order: int, most: int) -> Iterator[tuple[bytes, bool, int, bool]]:
    """(text, whether the beginning comes before it, how many words of it are context only, whether the end follows):
    a text, in pieces where it is longer than `most`, each after the words that its first history needs."""
    context: list[bytes] = []
    at = 0
    while True:
        found = SPACE.search(data, at + most) if len(data) - at > most else None
        end = found.start() if found else len(data)
        piece = data[at:end]
        yield b" ".join([*context, piece]), len(context) < order - 1, len(context), end == len(data)
        if end == len(data):
            return
        if order > 1:
            context = (context + piece.rsplit(None, order - 1)[-(order - 1) :])[-(order - 1) :]
        at = end


def deal(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[pa.RecordBatch]:
    """BLOCKS: the pieces of a partition's texts in blocks of bounded size, each as one compressed row."""
    import zstandard
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() << 32
    press = zstandard.ZstdCompressor(level=3).compress
    held: list[tuple] = []
    size = rows = blocks = 0

    def flush() -> pa.RecordBatch:
        nonlocal blocks
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.bool_(), pa.int32(), pa.bool_()]
        table, sink = pa.table([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=PIECE), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        blocks += 1
        return pa.RecordBatch.from_arrays([pa.array([first + blocks]), pa.array([press(sink.getvalue())], pa.binary())], names=["block", "data"])

    for batch in batches:
        for doc_id, text, out in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist()):
            rows += 1
            for piece in pieces_of(text.as_py() or b"", settings.order, settings.block_bytes):
                if held and size + len(piece[0]) > settings.block_bytes:
                    yield flush()
                    held, size = [], 0
                held.append((first + rows, doc_id, out, *piece))
                size += len(piece[0]) + 16
    if held:
        yield flush()


class Block:
    """The tokens of a block's pieces as numbers, one after the other, and its distinct n-grams."""

    def __init__(self, data: bytes, settings: Settings):
        import zstandard

        self.settings = settings
        self.table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all()
        column = lambda name: self.table[name].to_pylist()
        ids, rows = WordIds(), []
        begin, end = ids[BEGIN], ids[END]
        for text, head, last in zip(column("text"), column("head"), column("last")):
            numbers = list(map(ids.__getitem__, text.lower().split()))
            rows.append(np.array([begin] * head + numbers + [end] * last, np.int32))
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.skip = np.array(column("skip"), np.int64) + np.array(column("head"), np.int64)  # tokens that are history only
        self.tokens = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        self.words, self.hashes = len(ids), ids.hashes()
        place = np.arange(len(self.tokens)) - np.repeat(self.starts, self.sizes)
        self.inner = place >= np.repeat(self.skip, self.sizes)
        weight = self.inner & np.repeat(~np.array(column("held"), bool), self.sizes)
        # n-grams of each order by number: of the n-gram before its last word and of that word; one place of each
        self.codes: list[np.ndarray] = []
        self.at: list[np.ndarray] = []  # the n-gram that ends at each token
        self.where: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        for order in range(1, self.settings.order + 1):
            whole = np.flatnonzero(place >= order - 1) if order > 1 else np.arange(len(self.tokens))
            word = self.tokens[whole].astype(np.int64)
            codes, where, number = np.unique(self.at[-1][whole - 1].astype(np.int64) << 32 | word if order > 1 else word, return_index=True, return_inverse=True)
            at = np.full(len(self.tokens), -1, np.int32)
            at[whole] = number
            hashes = self.hashes[codes & 0xFFFFFFFF]
            if order > 1:
                hashes = mix(mix(self.keys[-1][codes >> 32]) ^ hashes)
            self.codes.append(codes)
            self.at.append(at)
            self.where.append(whole[where])
            self.counts.append(np.bincount(number, weight[whole], len(codes)).astype(np.int64))
            self.keys.append(hashes)

    def questions(self) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(range, order, packed keys, packed training counts)."""
        for order, (keys, counts) in enumerate(zip(self.keys, self.counts), 1):
            rank = np.argsort(keys)
            for where, part in ranges(keys[rank], self.settings.fan_bits):
                mine = rank[part]
                yield where, order, pack_keys(keys[mine], where, self.settings.fan_bits), pack(counts[mine])

    def totals(self, answers: pa.Table) -> list[np.ndarray]:
        """The totals of the n-grams of each order, from the answers to questions()."""
        given = {(r["gram_order"], r["range"]): r["totals"] for r in answers.to_pylist()}
        out = []
        for order, keys in enumerate(self.keys, 1):
            rank = np.argsort(keys)
            found = np.zeros(len(keys), np.int64)
            for where, part in ranges(keys[rank], self.settings.fan_bits):
                found[rank[part]] = unpack(given[order, where])  # of all the others
            found += self.counts[order - 1]
            out.append(found)
        return out

    def automaton(self, totals: list[np.ndarray], tokens: int, words: int, begins: int) -> list[State]:
        """The states of each length of history, from the root up, with their arcs.

        An n-gram that occurs in training is an arc, from its words but the last; its parts occur too."""
        chance = (totals[0] + self.settings.add) / (tokens + self.settings.add * (words + 1))
        out = [State(self.codes[0], np.log10(chance), np.zeros(1), None)]
        for order in range(2, self.settings.order + 1):
            history = totals[order - 2]
            if order == 2:
                history = np.where(self.codes[0] == 0, begins, history)
            prior, codes, found = self.settings.priors[order - 2], self.codes[order - 1], totals[order - 1]
            shorter = self.at[order - 2][self.where[order - 1]]  # the n-gram without its first word
            with np.errstate(divide="ignore", invalid="ignore"):
                chance = np.where(found > 0, (found + prior * chance[shorter]) / (history[codes >> 32] + prior), np.nan)
                out.append(State(codes, np.log10(chance), np.log10(prior / (history + prior)), shorter))
        return out

    def walk(self, totals: list[np.ndarray], tokens: int, words: int, begins: int) -> tuple[np.ndarray, ...]:
        """(n_tokens, n_known, base_score, score, n_backoffs) of each piece, by the automaton that totals give."""
        machine = self.automaton(totals, tokens, words, begins)
        pieces = len(self.sizes)
        owner, inner = np.repeat(np.arange(pieces), self.sizes)[self.inner], self.at[0][self.inner]
        n = np.bincount(owner, minlength=pieces).astype(np.int64)
        known = np.bincount(owner, totals[0][inner] > 0, pieces).astype(np.int64)
        base = np.bincount(owner, machine[0].weight[inner], pieces).astype(np.float64)
        # lanes of `stride` tokens, in lockstep, the longest first, so that those still going come first
        lanes = np.maximum(1, -(-n // self.settings.stride))
        piece = np.repeat(np.arange(pieces), lanes)
        skip = (np.arange(len(piece)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * self.settings.stride
        size = np.minimum(self.settings.stride, n[piece] - skip)
        order = np.argsort(-size, kind="stable")
        piece, size, first = piece[order], size[order], (self.starts[piece] + self.skip[piece] + skip)[order]
        run = Run(self, machine, totals[0], len(piece))
        for back in range(self.settings.order - 1, 0, -1):  # up to the state that the lane begins in
            there = np.flatnonzero(first - back >= self.starts[piece])
            run.step(there, first[there] - back)
        run.score[:], run.backoffs[:] = 0, 0
        everyone = np.arange(len(piece))
        going = np.searchsorted(-size, -np.arange(1, size.max(initial=0) + 1), side="right")
        for step, live in enumerate(going.tolist()):
            run.step(everyone[:live], first[:live] + step)
        return n, known, base, np.bincount(piece, run.score, pieces).astype(np.float64), np.bincount(piece, run.backoffs, pieces).astype(np.int64)


@dataclass
class State:
    """All states with histories of one length: ascending codes (number of the history, word) of what may be their
    arcs, the weight of each (NaN: no arc), the weight of each history's failure arc, and the number of each code's
    n-gram without its first word, among those one shorter."""

    codes: np.ndarray
    weight: np.ndarray
    fail: np.ndarray
    shorter: np.ndarray | None


class Run:
    """Lanes of text that run through an automaton side by side: each one's state (the length of its history, and its
    number), log probability so far, and number of failure arcs taken."""

    def __init__(self, block: Block, machine: list[State], seen: np.ndarray, lanes: int):
        self.block, self.machine, self.seen = block, machine, seen
        self.length, self.state = np.zeros(lanes, np.int8), np.zeros(lanes, np.int64)
        self.score, self.backoffs = np.zeros(lanes), np.zeros(lanes, np.int64)

    def step(self, lanes: np.ndarray, places: np.ndarray) -> None:
        """Each lane reads the token at its place: along an arc of its state, or a failure arc and so on.

        The arc that a state may have for a token is looked up by the number that the block gave to the n-gram ending
        there, and is taken if it leaves the state that the lane is in."""
        block, machine = self.block, self.machine
        word, length, state = block.tokens.take(places).astype(np.int64), self.length[lanes], self.state[lanes]
        gain, backs = np.zeros(len(lanes)), np.zeros(len(lanes), np.int64)
        to_length, to_state = np.zeros(len(lanes), np.int8), np.zeros(len(lanes), np.int64)
        for n in range(block.settings.order - 1, 0, -1):
            mine, level = np.flatnonzero(length == n), machine[n]
            if not len(mine):
                continue
            arc = block.at[n].take(places[mine])
            weight = level.weight.take(arc)
            taken = (arc >= 0) & (level.codes.take(arc) == state[mine] << 32 | word[mine]) & (weight == weight)
            yes, arc, no = mine[taken], arc[taken], mine[~taken]
            gain[yes] += weight[taken]
            to_length[yes], to_state[yes] = (n + 1, arc) if n + 1 < block.settings.order else (n, level.shorter[arc])
            length[yes] = -1
            gain[no] += level.fail.take(state[no])
            backs[no] += 1
            length[no] = n - 1
            if n > 1:
                state[no] = machine[n - 1].shorter[state[no]]
        mine = np.flatnonzero(length == 0)
        number = block.at[0].take(places[mine])
        gain[mine] += machine[0].weight.take(number)
        if block.settings.order > 1:  # a word that training lacks, but for the beginning, is no history
            to_state[mine], to_length[mine] = number, (self.seen.take(number) > 0) | (word[mine] == 0)
        self.length[lanes], self.state[lanes] = to_length, to_state
        self.score[lanes] += gain
        self.backoffs[lanes] += backs


# Questions and answers


def least_of(where: int, bits: int) -> np.uint64:
    """The lowest key of a range, of which there are 2 ** bits."""
    return np.uint64(where << 64 - bits)


def ranges(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Which of 2 ** bits ranges ascending keys are in, and where."""
    top = keys >> np.uint64(64 - bits)
    cuts = np.flatnonzero(np.append(True, top[1:] != top[:-1])) if len(top) else []
    for a, b in zip(cuts, [*cuts[1:], len(top)]):
        yield int(top[a]), slice(int(a), int(b))


def pack_keys(keys: np.ndarray, where: int, bits: int) -> bytes:
    """A range's ascending keys as differences."""
    return pack(np.diff(keys, prepend=least_of(where, bits)))


def unpack_keys(data: bytes, where: int, bits: int) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64) + least_of(where, bits)


def merged(rows: list[dict], order: int, where: int, bits: int) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Of one range's questions of an order: (which it is, where its keys are among the distinct ones, its counts) of
    each, the distinct keys, and the sums of the counts."""
    mine = [i for i, r in enumerate(rows) if r["gram_order"] == order]
    if not mine:
        return [], np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = [unpack(rows[i]["counts"]) for i in mine]
    keys, at = np.unique(np.concatenate([unpack_keys(rows[i]["keys"], where, bits) for i in mine]), return_inverse=True)
    sums = np.bincount(at, np.concatenate(counts), len(keys)).astype(np.int64)  # exact up to 2 ** 53
    return list(zip(mine, np.split(at, np.cumsum([len(c) for c in counts])[:-1]), counts)), keys, sums


def reply(rows: list[dict], totals: list[bytes], tokens: int, words: int) -> pa.Table:
    first = [True] + [False] * (len(rows) - 1)
    column = lambda name: [r[name] for r in rows]
    return pa.table(
        {
            "asker": pa.array(column("asker"), pa.int64()), "range": pa.array(column("range"), pa.int64()), "gram_order": pa.array(column("gram_order"), pa.int32()),
            "totals": pa.array(totals, pa.binary()), "tokens": pa.array([tokens * f for f in first], pa.int64()), "words": pa.array([words * f for f in first], pa.int64()),
        }
    )


def total_counts(asked: DataFrame, settings: Settings, levels: int, level: int = 1) -> DataFrame:
    """ANSWER to each row of ASKED, whose ranges are of this level: the counts of all other askers, as those are small
    numbers where an n-gram is rare. The last level adds up, others ask finer ranges."""
    bits, fan_bits, orders = settings.fan_bits * level, settings.fan_bits, range(1, settings.order + 1)
    if level == levels:

        def answer(table: pa.Table) -> pa.Table:
            rows = table.to_pylist()
            totals: list[bytes] = [b""] * len(rows)
            tokens = words = 0
            for order in orders:
                asked_here, _, sums = merged(rows, order, rows[0]["range"], bits)
                for i, at, own in asked_here:
                    totals[i] = pack(sums[at].astype(np.uint64) - own)
                if order == 1:
                    tokens, words = int(sums.sum()), int((sums > 0).sum())
            return reply(rows, totals, tokens, words)

        return asked.groupBy("range").applyInArrow(answer, ANSWER)

    asked = cut(asked)
    groups = max(1, -(-asked.select("asker").distinct().count() >> fan_bits))
    asked = asked.withColumn("group", F.pmod(F.xxhash64("asker"), F.lit(groups)))

    def ask(table: pa.Table) -> pa.Table:
        """One question for all of a group's in a range: the asker is the group and the range."""
        rows, out = table.to_pylist(), []
        where = rows[0]["range"]
        for order in orders:
            _, keys, sums = merged(rows, order, where, bits)
            for finer, part in ranges(keys, bits + fan_bits):
                out.append((rows[0]["group"] << bits | where, finer, order, pack_keys(keys[part], finer, bits + fan_bits), pack(sums[part])))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["asker", "range", "gram_order", "keys", "counts"])

    def spread(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows, given = table.to_pylist(), sorted(answers.to_pylist(), key=lambda r: (r["gram_order"], r["finer"]))
        totals: list[bytes] = [b""] * len(rows)
        for order in orders:
            asked_here, _, sums = merged(rows, order, rows[0]["range"], bits)
            others = np.concatenate([np.zeros(0, np.uint64), *(unpack(r["totals"]) for r in given if r["gram_order"] == order)])
            for i, at, own in asked_here:
                totals[i] = pack((others + sums.astype(np.uint64))[at] - own)
        return reply(rows, totals, sum(r["tokens"] for r in given), sum(r["words"] for r in given))

    finer = total_counts(asked.groupBy("group", "range").applyInArrow(ask, ASKED), settings, levels, level + 1)
    finer = cut(finer).select(
        F.shiftright("asker", bits).alias("group"), F.col("asker").bitwiseAND((1 << bits) - 1).alias("range"), F.col("range").alias("finer"), "gram_order", "totals", "tokens", "words"
    )
    return asked.groupBy("group", "range").cogroup(finer.groupBy("group", "range")).applyInArrow(spread, ANSWER)


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = DEFAULT) -> DataFrame:
    """SCHEMA: trains on the documents whose id's crc32 has a remainder by 10 other than 0, and scores all of them.

    score is the automaton's log10 probability of the whole text, base_score that of the root alone, n_backoffs the
    number of failure arcs taken. A null text counts as empty: its end is its one token. A null id trains and is not
    held out. Every row of equal rows trains and is scored. With no training documents every word is unknown. An
    empty table gives an empty one; other columns are ignored. A text longer than a block is scored in pieces that
    begin in the state the one before ends in."""
    docs = texts(docs, id_col, text_col).withColumn("held_out", F.coalesce(remainder("doc_id", 10) == 0, F.lit(False)))
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 6).alias("bytes"), F.count_if(~F.col("held_out")).alias("begins")).first()
    begins, levels = size["begins"], 1
    while (size["bytes"] or 0) * GRAMS_A_BYTE * settings.order > settings.range_grams << settings.fan_bits * levels:
        levels += 1
    blocks = cut(docs.mapInArrow(lambda batches: deal(batches, settings), BLOCKS), **{"parquet.block.row.count.limit": 8, "compression": "uncompressed"})

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                columns = list(zip(*Block(data.as_py(), settings).questions()))
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(columns[0])), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["asker", "range", "gram_order", "keys", "counts"]
                )

    answers = cut(total_counts(blocks.mapInArrow(ask, ASKED), settings, levels))
    total = answers.agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).first()
    tokens, words = total["tokens"] or 0, total["words"] or 0

    def walk(mine: pa.Table, replies: pa.Table) -> pa.Table:
        tidy()
        block = Block(mine["data"][0].as_py(), settings)
        n, known, base, score, backoffs = block.walk(block.totals(replies), tokens, words, begins)
        return pa.table(
            {
                "row": block.table["row"], "doc_id": block.table["doc_id"], "held_out": block.table["held"], "n_tokens": pa.array(n), "n_known": pa.array(known),
                "base_score": pa.array(base), "score": pa.array(score), "n_backoffs": pa.array(backoffs),
            }
        )

    sums = ["n_tokens", "n_known", "base_score", "score", "n_backoffs"]
    found = (
        blocks.groupBy("block").cogroup(answers.select(F.col("asker").alias("block"), "range", "gram_order", "totals").groupBy("block"))
        .applyInArrow(walk, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_backoffs long")
        .groupBy("row", "doc_id", "held_out").agg(*(F.sum(c).alias(c) for c in sums))  # a row's pieces
    )
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", "n_backoffs")
