"""Jaccard join of word shingles by universe partition, and the components of its links.

Sets that reach the threshold differ in few shingles, a number H that follows from their sizes. A scheme for each
band of sizes hashes the universe of shingles into more than H segments; of two linked sets, some segments agree
exactly. Every set indexes its segments, as signatures, in its own band's scheme; it probes the bands of all sets
not larger than itself, with segments worth H + 1 units: a segment that must agree is one unit, and one whose
one-deletion neighbourhoods are indexed too is worth two. Units are allocated by cost, the commonness of a
segment's rarest shingle, so that widely shared passages are not probed where anything rarer will do.

Signatures meet in buckets by hash. Equal sets are one class from the start. In a bucket the members of a group
(one signature) are not paired with each other but with one of them, their centre; texts go to their centres, the
sets are compared exactly, and members that don't link to their centre are compared with the other members. So no
link between different texts is lost but those inside a component that stands already. Centres of large groups are
split into parts, with a second round across the parts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, WordIds, cut, free, lower_ascii, mix, pack, setting, texts, tidy, unpack

WORDS, PERCENT = 5, 80
#: Bands grow by this factor, more than 100 / PERCENT, so that a set mostly probes two. Up to SINGLE shingles each
#: is a segment of its own; beyond, SEGMENTS segments for each shingle of the band's largest set, of which all
#: (bands up to ALL_DELETIONS) or one in DELETIONS index their one-deletion neighbourhoods.
GROWTH, SINGLE, SEGMENTS, ALL_DELETIONS, DELETIONS = 1.3, 32, 0.3, 400, 8
#: Shingles handled at once, of a bucket, of the members in a part of a centre's group, and of parts checked at once:
#: memory follows from shingles, as texts may be long.
FLUSH, BUCKET_ROWS, PART, BIN = 600_000, 1_500_000, 500_000, 1_000_000
#: Bytes of a batch of rows on their way to Python, which take several times as many in the JVM: the text of two flushes.
BATCH = 7_000_000
#: Shingles, and signature rows, that are worked on at once within these: what arithmetic needs in between is many times as large.
STEP = 100_000
#: Ranges of buckets that rows are dealt to at once; the bucket number, and the mark, of sets to be joined by shingles.
FAN, HARD = 256, -1
#: Bytes of a class that signature rows carry; classes that share them are candidates together, and then told apart.
REF_BYTES = 5
#: Commonest shingles that a task reports, from so many documents on, and that the allocation knows.
HEAVY_TASK, HEAVY_LEAST, HEAVY = 2000, 4, 50_000
CACHE_WORDS = 120_000
SCHEMA = "doc_id long, n_shingles long, component_id long"
_TAG, _DELETED, _SIDE = np.uint64(0x51ED270B3A1F9C47), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)

HIGHS = [1]
while HIGHS[-1] < 1 << 40:
    HIGHS.append(max(HIGHS[-1] + 1, int((HIGHS[-1] + 1) * GROWTH)))
HIGHS = np.array(HIGHS, np.int64)


@dataclass
class Sets:
    """The distinct shingles of some texts, one set after the other, ascending within each."""

    shingles: np.ndarray
    sizes: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def one(self, i: int) -> np.ndarray:
        start = int(self.starts[i])
        return self.shingles[start : start + int(self.sizes[i])]

    def classes(self) -> list[bytes | None]:
        """128 bits that stand for each set; None for the empty one."""
        if not len(self.shingles):
            return [None] * len(self.sizes)
        full = np.flatnonzero(self.sizes)
        at = self.starts[full]
        sums = np.stack([np.add.reduceat(mix(self.shingles ^ tag), at) for tag in (_TAG, _DELETED)], 1)
        out: list[bytes | None] = [None] * len(self.sizes)
        for i, row in zip(full.tolist(), sums.astype(">u8")):
            out[i] = row.tobytes()
        return out


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, ascending."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def shingle_sets(batch: list[str | None], ids: WordIds) -> Sets:
    numbered = [np.zeros(0, np.int64)]
    for text in batch:  # the words of one text at a time, as objects take many times the text's bytes
        words = lower_ascii(text).split() if text else []
        numbered.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
    counts = np.array([len(n) for n in numbered[1:]], np.int64)
    numbers = np.concatenate(numbered)
    tokens = ids.hashes()[numbers] if len(numbers) else np.zeros(0, np.uint64)
    del numbered, numbers
    if len(ids) > CACHE_WORDS:
        ids.forget()
    rolled = mix(tokens)
    for step in range(1, WORDS):
        rolled = mix(rolled[: max(0, len(tokens) - step)] ^ tokens[step:])
    out, at = [], 0
    for n in counts.tolist():
        if n >= WORDS:
            found = distinct(rolled[at : at + n - WORDS + 1])
        elif n:  # a short text is one shingle, of its own kind
            whole = mix(tokens[at : at + 1])
            for word in tokens[at + 1 : at + n]:
                whole = mix(whole ^ word)
            found = mix(whole ^ _TAG)
        else:
            found = np.zeros(0, np.uint64)
        out.append(found)
        at += n
    return Sets(np.concatenate(out) if out else np.zeros(0, np.uint64), np.array([len(s) for s in out], np.int64))


def batches_of(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[pa.RecordBatch]:
    """Batches of at most about FLUSH shingles' text."""
    for batch in batches:
        at = 0
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        while at < len(batch):
            n = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + 65000]), 6 * FLUSH)))
            yield batch.slice(at, n)
            at += n


# Signatures


def scheme(band: np.ndarray, density: float) -> tuple[np.ndarray, np.ndarray]:
    """(segments, segments with deletion neighbourhoods) of bands."""
    high = HIGHS[band]
    segments = np.where(high <= SINGLE, 1 << 31, np.ceil(density * high).astype(np.int64) + 2)
    deletions = np.where(high <= SINGLE, 0, np.where(high <= ALL_DELETIONS, segments, segments // DELETIONS))
    return segments, deletions


def differences(larger: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """By how many shingles linked sets of these sizes differ at most."""
    return (larger + smaller) * (100 - PERCENT) // (100 + PERCENT)


def signatures(sets: Sets, heavy: np.ndarray, counts: np.ndarray, density: float = SEGMENTS) -> tuple[np.ndarray, ...]:
    """(index signatures, their sets, probe signatures, their sets, which sets have not units enough).

    A set lacks units if its shingles fall into few segments, about once in 10^15 sets; it is told, not lost."""
    index_sig, index_set, probe_sig, probe_set = [], [], [], []
    n = sets.sizes
    own = np.searchsorted(HIGHS, n)
    lowest = np.searchsorted(HIGHS, -(-n * PERCENT // 100))
    owner = np.repeat(np.arange(len(n)), n)
    spread, content = mix(sets.shingles ^ _SIDE) >> np.uint64(33), mix(sets.shingles ^ _TAG)
    common = np.ones(len(sets.shingles), np.int64)
    if len(heavy) and len(common):
        at = np.minimum(np.searchsorted(heavy, sets.shingles), len(heavy) - 1)
        common = np.where(heavy[at] == sets.shingles, counts[at], 1)
    hard = np.zeros(len(n), bool)
    for below in range(int((own - lowest).max(initial=0)) + 1):
        live = (n > 0) & (own - below >= lowest)
        band = np.where(live, own - below, 0)
        segments, deletions = scheme(band, density)
        mine = np.flatnonzero(live[owner])
        if not len(mine):
            continue
        who = owner[mine]
        segment = (spread[mine] % segments[who].astype(np.uint64)).astype(np.int64)
        order = np.argsort(who << 32 | segment)
        mine, who, segment = mine[order], who[order], segment[order]
        starts = np.flatnonzero(np.append(True, (np.diff(who) != 0) | (np.diff(segment) != 0)))
        size = np.diff(np.append(starts, len(mine)))
        seg_of, seg_who, seg = np.repeat(np.arange(len(starts)), size), who[starts], segment[starts]
        total = np.add.reduceat(content[mine], starts)
        place = mix((band[seg_who] << 32 | seg).astype(np.uint64))
        exact = mix(total ^ place)
        has_deletions = seg < deletions[seg_who]
        # every shingle's one-deletion content, where segments have more than one
        inside = np.flatnonzero((has_deletions & (size > 1))[seg_of])
        less = total[seg_of[inside]] - content[mine[inside]]
        if below == 0:
            index_sig += [exact, mix(less ^ place[seg_of[inside]] ^ _DELETED)]
            index_set += [seg_who, who[inside]]
        # allocation: the cheapest units worth one more than the sets may differ
        need = differences(n, np.minimum(n, HIGHS[band])) + 1
        cost = np.minimum.reduceat(common[mine], starts)
        dear = np.add.reduceat(common[mine], starts) + size
        double = np.flatnonzero(has_deletions & (size > 1))
        offer_seg = np.append(np.arange(len(starts)), double)
        offer_who = seg_who[offer_seg]
        offer_cost = np.minimum(np.append(cost, dear[double]), (1 << 24) - 1)
        rank = np.argsort(offer_who << 32 | offer_cost << 8 | 255 - np.minimum(size[offer_seg], 255))
        first = np.searchsorted(offer_who[rank], np.arange(len(n)))
        taken = np.arange(len(rank)) - first[offer_who[rank]] < need[offer_who[rank]]
        units = np.bincount(offer_who, minlength=len(n))
        hard |= live & (units < need)
        chosen = rank[taken]
        single, doubled = chosen[chosen < len(starts)], offer_seg[chosen[chosen >= len(starts)]]
        probe_sig.append(exact[single])
        probe_set.append(seg_who[single])
        if len(doubled):
            probe_sig.append(mix(total[doubled] ^ place[doubled] ^ _DELETED))
            probe_set.append(seg_who[doubled])
            upgraded = np.zeros(len(starts), bool)
            upgraded[doubled] = True
            pick = upgraded[seg_of[inside]]
            probe_sig.append(mix(less[pick] ^ place[seg_of[inside[pick]]]))
            probe_set.append(who[inside[pick]])
    join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
    return join(index_sig, np.uint64), join(index_set, np.int64), join(probe_sig, np.uint64), join(probe_set, np.int64), hard


def stepwise(sets: Sets, heavy: np.ndarray, counts: np.ndarray, density: float = SEGMENTS) -> tuple[np.ndarray, ...]:
    """signatures(), of about STEP shingles' sets at a time."""
    starts, found, at = np.append(sets.starts, len(sets.shingles)), [], 0
    while at < len(sets.sizes):
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + STEP, side="right")) - 1)
        some = Sets(sets.shingles[starts[at] : starts[end]], sets.sizes[at:end])
        index_sig, index_set, probe_sig, probe_set, hard = signatures(some, heavy, counts, density)
        found.append((index_sig, index_set + at, probe_sig, probe_set + at, hard))
        at = end
    return tuple(map(np.concatenate, zip(*found)))


def pack_rows(sig: np.ndarray, owner: np.ndarray) -> tuple[bytes, bytes]:
    """Signature rows, ascending: the signatures as differences, and their owners."""
    order = np.argsort(sig)
    return pack(np.diff(sig[order], prepend=np.uint64(0))), pack(owner[order])


def unpack_rows(sig: bytes, owner: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(unpack(sig), dtype=np.uint64), unpack(owner).astype(np.int64)


def pack_names(names: np.ndarray) -> bytes:
    """Names of classes, ascending, as differences: one that a row names costs less than its bytes, the more the row has."""
    return pack(np.diff(names, prepend=np.uint64(0)))


def unpack_names(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def ref_of(name: bytes, length: int) -> bytes:
    return name[:length] + bytes(8 - length)


PACKED = "bucket long, classes binary, index_sig binary, index_set binary, probe_sig binary, probe_set binary"
LOW = np.uint64(32)


def packed_rows(names: np.ndarray, rows: tuple[np.ndarray, ...], buckets: tuple[np.ndarray, np.ndarray], width: int, out: list[tuple]) -> None:
    """Adds PACKED rows to out: index and probe signatures by the range of `width` buckets they fall into. A signature is
    its bucket's place in the range, then its low half; owners are numbers among the classes that the row names. names:
    ascending."""
    ranges = [b // width for b in buckets]
    order = [np.argsort(r.astype(np.uint16) if r.max(initial=0) < 1 << 16 else r, kind="stable") for r in ranges]
    used_ranges = np.unique(np.concatenate(ranges))  # as many as there are signatures at most
    low = [np.searchsorted(r[o], used_ranges) for r, o in zip(ranges, order)]
    high = [np.searchsorted(r[o], used_ranges, side="right") for r, o in zip(ranges, order)]
    value = [(b % width).astype(np.uint64) << LOW | s & np.uint64(0xFFFFFFFF) for b, s in zip(buckets, (rows[0], rows[2]))]
    for i, k in enumerate(used_ranges.tolist()):
        index, probe = (o[a[i] : b[i]] for o, a, b in zip(order, low, high))
        used, at = np.unique(np.concatenate([rows[1][index], rows[3][probe]]), return_inverse=True)
        n = len(index)
        out.append((k, pack_names(names[used]), *pack_rows(value[0][index], at[:n]), *pack_rows(value[1][probe], at[n:])))


def packed_batch(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out)) or [()] * 6
    kinds = [pa.int64(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in PACKED.split(", ")])


def emit(docs: DataFrame, heavy: np.ndarray, counts: np.ndarray, buckets: int, width: int) -> DataFrame:
    """PACKED: the signatures of all non-empty sets, equal sets of a flush once; under HARD, the sets whose signatures
    are not enough."""
    length, density = REF_BYTES, SEGMENTS

    def flush(batch: pa.RecordBatch, ids: WordIds) -> list[tuple]:
        sets = shingle_sets(batch.column(1).to_pylist(), ids)
        classes = sets.classes()
        kept = [i for _, i in sorted({c: i for i, c in reversed(list(enumerate(classes))) if c is not None}.items())]
        out: list[tuple] = []
        if kept:
            sets = Sets(np.concatenate([sets.one(i) for i in kept]), sets.sizes[kept])
            names = np.frombuffer(b"".join(ref_of(classes[i], length) for i in kept), ">u8").astype(np.uint64)
            rows = stepwise(sets, heavy, counts, density)
            del sets
            packed_rows(names, rows, tuple(((s >> LOW) % np.uint64(buckets)).astype(np.int64) for s in (rows[0], rows[2])), width, out)
            if rows[4].any():
                out.append((HARD, pack_names(names[rows[4]]), *[pack(np.zeros(0, np.uint64))] * 4))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        ids = WordIds()
        for batch in batches_of(batches):
            if out := flush(batch, ids):
                yield packed_batch(out)

    return docs.mapInArrow(run, PACKED)


def finer(packed: DataFrame, width: int, narrower: int, groups: int) -> DataFrame:
    """PACKED by ranges of fewer buckets: rows of a range are merged, in `groups` groups, and dealt to its parts. Groups are
    dealt by place, as copies of whole flushes have equal classes."""

    def split(table: pa.Table) -> pa.Table:
        tidy()
        rows = table.to_pylist()
        first = rows[0]["bucket"]
        if first == HARD:
            return table.select([c.split()[0] for c in PACKED.split(", ")])
        named = [unpack_names(r["classes"]) for r in rows]
        names, classes = np.unique(np.concatenate(named), return_inverse=True)
        starts = np.cumsum([0, *map(len, named)])
        found: list[list[np.ndarray]] = [[], [], [], []]
        for r, start in zip(rows, starts.tolist()):
            for i, kind in enumerate(("index", "probe")):
                sig, owner = unpack_rows(r[f"{kind}_sig"], r[f"{kind}_set"])
                found[2 * i].append(sig)
                found[2 * i + 1].append(classes[start + owner])
        merged = tuple(map(np.concatenate, found))
        del rows, classes, found
        buckets = tuple(first * width + (s >> LOW).astype(np.int64) for s in (merged[0], merged[2]))
        out: list[tuple] = []
        packed_rows(names, merged, buckets, narrower, out)
        return pa.Table.from_batches([packed_batch(out)])

    return packed.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))).groupBy("bucket", "part").applyInArrow(split, PACKED)


def by_bucket(docs: DataFrame, heavy: np.ndarray, counts: np.ndarray, buckets: int, shingles: int) -> DataFrame:
    """PACKED by bucket. A flush sends to FAN ranges at most, however many buckets there are; ranges are cut again until
    each is one bucket. All levels have about the same number of ranges, so that rows stay as long as they were, and what
    is merged at a time has the shingles of a flush, however much there is. Levels are shuffles of one query: a table
    between them would take more disk."""
    levels = 1
    while (fan := math.ceil(buckets ** (1 / levels))) > FAN:
        levels += 1
    width = fan ** (levels - 1)
    packed = emit(docs, heavy, counts, buckets, width)
    while width > 1:
        ranges = -(-buckets // width)
        packed, width = finer(packed, width, width // fan, 1 + shingles // (ranges * FLUSH)), width // fan
    return packed


CANDIDATES = "centre binary, member binary, mutual int"


def candidates(table: pa.Table) -> pa.Table:
    """A bucket's groups as (centre, member) pairs; mutual: members of a group may also link to each other, HARD: a set
    whose signatures are not enough."""
    tidy()
    if table["bucket"][0].as_py() == HARD:
        data = np.concatenate([unpack_names(c) for c in table["classes"].to_pylist()]).astype(">u8").tobytes()
        names = [data[i : i + 8] for i in range(0, len(data), 8)]
        return pa.table({"centre": pa.array(names, pa.binary()), "member": pa.array(names, pa.binary()), "mutual": pa.array([HARD] * len(names), pa.int32())})
    named = [unpack_names(c) for c in table["classes"].to_pylist()]
    known = distinct(np.concatenate(named))
    named = [known.searchsorted(n).astype(np.uint32) for n in named]
    packed = []
    for row, mine in zip(table.select(["index_sig", "index_set", "probe_sig", "probe_set"]).to_batches(max_chunksize=1), named):
        of = row.to_pylist()[0]
        for kind, name in enumerate(("index", "probe")):
            sig, owner = unpack_rows(of[f"{name}_sig"], of[f"{name}_set"])
            packed.append(sig << np.uint64(32) | mine[owner].astype(np.uint64) << np.uint64(1) | np.uint64(kind))
    keys = np.concatenate(packed)  # signature, class, kind
    del named, packed
    keys.sort()
    pairs, at = [np.zeros(0, np.uint64)], 0
    while at < len(keys):  # whole groups, some after others
        last = keys[min(at + STEP, len(keys)) - 1] | np.uint64(0xFFFFFFFF)
        end = int(keys.searchsorted(last, side="right"))
        pairs.append(pairs_of(keys[at:end]))
        at = end
    found = distinct(np.concatenate(pairs))
    last = np.append(found[1:] >> np.uint64(1) != found[:-1] >> np.uint64(1), True) if len(found) else found.astype(bool)
    found = found[last]  # mutual if any group says so
    names = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8), len(known), [None, pa.py_buffer(known.astype(">u8"))])
    left, right = (names.take(pa.array(found >> np.uint64(shift) & np.uint64(0x7FFFFFFF))).cast(pa.binary()) for shift in (33, 1))
    return pa.table({"centre": left, "member": right, "mutual": pa.array((found & np.uint64(1)).astype(np.int32))})


def pairs_of(keys: np.ndarray) -> np.ndarray:
    """The pairs of some signatures' groups: the centre's number, the member's, and whether they are mutual. keys:
    ascending."""
    keys = keys[np.append(True, keys[1:] != keys[:-1])]
    # only signatures of more than one class matter
    near = np.flatnonzero((keys[1:] >> np.uint64(32) == keys[:-1] >> np.uint64(32)) & (keys[1:] >> np.uint64(1) != keys[:-1] >> np.uint64(1)))
    shared = distinct(keys[near] >> np.uint64(32))
    if not len(shared):
        return np.zeros(0, np.uint64)
    at = np.minimum(np.searchsorted(shared, keys >> np.uint64(32)), len(shared) - 1)
    keys = keys[shared[at] == keys >> np.uint64(32)]
    both = keys >> np.uint64(1)  # signature and class
    group = keys >> np.uint64(32)
    probes = (keys & np.uint64(1)).astype(bool)
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    ends = np.append(starts[1:], len(keys))
    several = np.add.reduceat(np.append(True, both[1:] != both[:-1]).astype(np.int64), starts)
    asked, there = np.add.reduceat(probes.astype(np.int64), starts), np.add.reduceat((~probes).astype(np.int64), starts)
    member = (keys & np.uint64(0xFFFFFFFF)) >> np.uint64(1)
    live = (several > 1) & (asked > 0) & (there > 0)
    two = np.flatnonzero(live & (several == 2))
    pairs = [distinct(member[starts[two]] << np.uint64(32) | member[ends[two] - 1]) << np.uint64(1)]
    more = np.flatnonzero(live & (several > 2))
    if len(more):  # equal groups under many signatures are looked at once
        low = keys & np.uint64(0xFFFFFFFF)
        sums = np.stack([np.add.reduceat(mix(low ^ tag), starts)[more] for tag in (_TAG, _SIDE)], 1)
        for g in more[np.unique(sums, axis=0, return_index=True)[1]].tolist():
            part, probe = member[starts[g] : ends[g]], probes[starts[g] : ends[g]]
            asking = part[probe]
            if len(asking) <= 2:  # few ask: each is a centre, and the others have nothing to do with each other
                pairs += [(q << np.uint64(32) | others[others != q]) << np.uint64(1) for q in asking for others in [part[~probe]]]
            else:
                members = distinct(part)
                pairs.append((members[0] << np.uint64(32) | members[1:]) << np.uint64(1) | np.uint64(1))
    return distinct(np.concatenate(pairs))


# Exact comparison


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) < len(b) else (b, a)
    same = int(np.count_nonzero(large.take(np.minimum(large.searchsorted(small), len(large) - 1)) == small))
    return 100 * same >= PERCENT * (len(a) + len(b) - same)


def may_link(left: list[np.ndarray], right: list[np.ndarray]) -> list[np.ndarray]:
    """For each left set, the places of the right sets that may link to it. Linked sets share one of the rarest
    shingles of both, as many as may be missing and one more; rare is what few of all these sets have."""
    sizes = np.array([len(s) for s in chain(right, left)], np.int64)
    shingles, number, times = np.unique(np.concatenate([*right, *left]), return_inverse=True, return_counts=True)
    rank = np.empty(len(shingles), np.int64)
    rank[np.lexsort((shingles, times))] = np.arange(len(shingles))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((rank[number], owner))
    place = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first = place < np.repeat(sizes - -(-sizes * PERCENT // 100) + 1, sizes)
    token, owner = rank[number][order][first], owner[first]
    there = owner < len(right)
    order = np.argsort(token[there], kind="stable")
    held, whose = token[there][order], owner[there][order]
    asked, asker = token[~there], owner[~there] - len(right)
    low, high = held.searchsorted(asked), held.searchsorted(asked, side="right")
    cuts = np.searchsorted(asker, np.arange(len(left) + 1))
    none = np.zeros(0, np.int64)
    return [np.unique(np.concatenate([none, *(whose[a:b] for a, b in zip(low[x:y].tolist(), high[x:y].tolist()) if a < b)])) for x, y in zip(cuts, cuts[1:])]


VERIFIED = "left_class binary, right_class binary, link boolean"


def known_sets(table: pa.Table, keys: tuple[str, ...]) -> list[tuple[bytes, np.ndarray, dict]]:
    """(class, set, row) of rows whose text has the class it was sent for, each class once under the same keys."""
    rows = table.drop_columns(["text"]).to_pylist()
    out, seen = [], set()
    ids, column = WordIds(), table["text"].combine_chunks()
    for at in range(0, len(rows), 256):
        sets = shingle_sets(column[at : at + 256].to_pylist(), ids)
        for i, c in enumerate(sets.classes()):
            row = rows[at + i]
            mark = (c, row["role"], *(row[k] for k in keys))
            if c == row["class"] and mark not in seen:
                seen.add(mark)
                out.append((c, sets.one(i).copy(), row))
    return out


def links_table(out: list[tuple]) -> pa.Table:
    columns = list(zip(*out)) or [()] * 3
    return pa.table({"left_class": pa.array(columns[0], pa.binary()), "right_class": pa.array(columns[1], pa.binary()), "link": pa.array(columns[2], pa.bool_())})


def parts_of(table: pa.Table, *keys: str) -> Iterator[list[tuple[bytes, np.ndarray, dict]]]:
    groups: dict[tuple, list] = {}
    for row in known_sets(table, keys):
        groups.setdefault(tuple(row[2][k] for k in keys), []).append(row)
    yield from groups.values()


def verify(table: pa.Table) -> pa.Table:
    """Parts of centres' groups: links to the centre, then between mutual members that have none and the others, but
    not inside a component that stands. A row without link reports a member that its part alone can't settle."""
    out: list[tuple[bytes, bytes, bool]] = []
    for found in parts_of(table, "centre", "part"):
        ref = found[0][2]["centre"]
        centres = sorted((m for m in found if m[2]["role"] == 0), key=lambda m: m[0])  # the same first in all parts
        name, centre = centres[0][:2] if centres else (ref, None)
        # other classes that share the centre's few bytes are members here, and any member may be theirs
        members = [m for m in found if m[2]["role"] == 1] + centres[1:]
        shared = len(centres) > 1
        root = list(range(len(members) + 1))  # the last is the centre

        def find(i: int, root=root) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        near = [centre is not None and linked(centre, s) for _, s, _ in members]
        for i, yes in enumerate(near):
            if yes:
                out.append((name, members[i][0], True))
                root[i] = len(members)
        mutual = [i for i, (_, _, r) in enumerate(members) if r["mutual"] or shared]
        loose = [i for i in mutual if not near[i]]
        for i, some in zip(loose, may_link([members[i][1] for i in loose], [members[j][1] for j in mutual]) if loose else ()):
            for j in (mutual[place] for place in some.tolist()):
                if find(i) != find(j) and linked(members[i][1], members[j][1]):
                    out.append((members[i][0], members[j][0], True))
                    root[find(i)] = find(j)
        out += [(ref, members[i][0], False) for i in mutual if members[i][2]["parts"] > 1 and find(i) != find(len(members))]
    return links_table(out)


def verify_across(table: pa.Table) -> pa.Table:
    """Parts' members (role 1) against unsettled members of other parts (role 2). Settled members are one component
    with their centre, so one link to any of them does."""
    out = []
    for found in parts_of(table, "centre", "part", "deal"):
        there = sorted((m for m in found if m[2]["role"] == 1), key=lambda m: not m[2]["settled"])
        asking = [m for m in found if m[2]["role"] == 2]
        for (a, s, r), some in zip(asking, may_link([m[1] for m in asking], [m[1] for m in there]) if asking and there else ()):
            joined = False
            for b, t, q in (there[place] for place in some.tolist()):
                if q["part"] != r["home"] and not (joined and q["settled"]) and linked(s, t):
                    out.append((a, b, True))
                    joined = joined or q["settled"]
    return links_table(out)


def met(docs: DataFrame, classes: DataFrame, hard: DataFrame) -> DataFrame:
    """CANDIDATES of sets whose signatures are not enough: all classes that share enough shingles with one, by a join on
    shingles."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches_of(batches):
            sets = shingle_sets(batch.column(1).to_pylist(), ids)
            ref, n = batch.column(0).to_numpy(zero_copy_only=False), np.repeat(sets.sizes, sets.sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ref, sets.sizes), pa.binary()), pa.array(n), pa.array(sets.shingles.view(np.int64))], names=["ref", "n", "shingle"])

    def shingles(some: DataFrame) -> DataFrame:
        of = referred(some).select("ref", "first").hint("merge")
        return docs.join(of, docs["doc_id"] == of["first"]).select("ref", "text").mapInArrow(explode, "ref binary, n long, shingle long")

    asked = shingles(hard.drop("ref")).select(F.col("ref").alias("centre"), F.col("n").alias("m"), "shingle")
    found = asked.join(shingles(classes), "shingle").where("centre <> ref").groupBy("centre", F.col("ref").alias("member"), "n", "m").agg(F.count("*").alias("same"))
    return found.where(F.col("same") * 100 >= PERCENT * (F.col("n") + F.col("m") - F.col("same"))).select("centre", "member", F.lit(0).alias("mutual"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of edges (a, b): alternating large and small stars until nothing changes.

    Each round is a table of its own, so its lineage is short; a node with many links is a partial minimum and a join
    that Spark can split."""

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.join(least, "u")
        if large:
            moved = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            moved = moved.where(F.col("v") < F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return moved.where(F.col("a") != F.col("b")).distinct()

    pairs = cut(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    # short numbers for the nodes; a written table, so that they stay
    nodes = cut(pairs.select("a").union(pairs.select("b")).distinct().withColumn("id", F.monotonically_increasing_id()))
    left, right = nodes.select(F.col("a"), F.col("id").alias("i")), nodes.select(F.col("a").alias("b"), F.col("id").alias("j"))
    now, before = cut(pairs.join(left, "a").join(right, "b").select(F.col("i").alias("a"), F.col("j").alias("b"))), None
    while True:
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == before:
            break
        last, now, before = now, cut(star(star(now, True), False)), sign
        free(last)
    return now.join(left, now["a"] == left["i"]).select(left["a"].alias("node"), "b").join(right.withColumnRenamed("b", "root"), F.col("b") == F.col("j")).select("node", "root")


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA: each document's number of distinct shingles and the smallest id that links lead to, itself included.

    Null and empty texts, and texts without words, have no shingles and link to nothing. A row without an id links
    to nothing and has no component. Rows that repeat have equal sets, so they link. Rows that share an id but not
    a text are documents of their own. An empty table gives an empty one; other columns are ignored. Sets are
    compared by the 64-bit hashes of their shingles."""
    with setting(docs.sparkSession, BATCH_BYTES, f"{BATCH}b"):  # what is returned runs no Python
        return linked_documents(texts(docs, id_col, text_col))


def linked_documents(docs: DataFrame) -> DataFrame:

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        ids, common = WordIds(), {}
        for batch in batches_of(batches):
            sets = shingle_sets(batch.column(1).to_pylist(), ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets.sizes), pa.array(sets.classes(), pa.binary()), pa.nulls(len(batch), pa.int64())], names=["doc_id", "n", "class", "shingle"]
            )
            seen, times = np.unique(sets.shingles, return_counts=True)
            for s, n in zip(seen[times > 1].view(np.int64).tolist(), times[times > 1].tolist()):
                common[s] = common.get(s, 0) + n
            if len(common) > 200_000:
                common = dict(sorted(common.items(), key=lambda x: -x[1])[:50_000])
        top = sorted(((s, n) for s, n in common.items() if n >= HEAVY_LEAST), key=lambda x: (-x[1], x[0]))[:HEAVY_TASK]
        if top:
            shingles, times = zip(*top)
            empty = pa.nulls(len(top), pa.int64())
            yield pa.RecordBatch.from_arrays([empty, pa.array(times, pa.int64()), pa.nulls(len(top), pa.binary()), pa.array(shingles, pa.int64())], names=["doc_id", "n", "class", "shingle"])

    measured = cut(docs.mapInArrow(measure, "doc_id long, n long, class binary, shingle long"))
    documents = measured.where("shingle is null").drop("shingle")
    classes = documents.where("class is not null and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"))
    known = measured.where("shingle is not null").groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(HEAVY).collect()
    order = np.argsort(np.array([r["shingle"] for r in known], np.int64).view(np.uint64))
    heavy = np.array([r["shingle"] for r in known], np.int64).view(np.uint64)[order]
    counts = np.array([r["n"] for r in known], np.int64)[order]
    shingles = documents.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-shingles // BUCKET_ROWS))

    pairs = by_bucket(docs.where("doc_id is not null"), heavy, counts, buckets, shingles).groupBy("bucket").applyInArrow(candidates, CANDIDATES)
    twins = referred(classes).groupBy("ref").count().where("count > 1")
    pairs = pairs.union(twins.select("ref", "ref", F.lit(1)))  # different classes under one reference
    # of a pair that both a group and a set's lack of units give, the group's is a row of its own
    pairs = cut(pairs.groupBy("centre", "member", (F.col("mutual") == HARD).alias("hard")).agg(F.max("mutual").alias("mutual")))
    hard, pairs = pairs.where("hard").select(F.col("centre").alias("ref")), pairs.where("not hard").drop("hard")
    if not hard.isEmpty():
        pairs = cut(pairs.union(met(docs, classes, referred(classes).join(hard, "ref", "left_semi"))).groupBy("centre", "member").agg(F.max("mutual").alias("mutual")))
    routes = route(pairs, classes)
    needed = routes.select("class", "first").distinct().hint("merge")
    needed_texts = cut(docs.join(needed, docs["doc_id"] == needed["first"]).select("class", "text"), compression="zstd")

    def sent_to(routes: DataFrame, *keys: str) -> DataFrame:
        bins = 1 + (routes.agg(F.sum("n")).first()[0] or 0) // BIN  # parts of many centres at once
        sent = needed_texts.join(routes.drop("first", "n").hint("merge"), "class")
        return sent.withColumn("bin", F.pmod(F.xxhash64(*keys), F.lit(bins))).groupBy("bin")

    verified = cut(sent_to(routes, "centre", "part").applyInArrow(verify, VERIFIED))
    edges = verified.where("link").select(F.col("left_class").alias("a"), F.col("right_class").alias("b"))
    unsettled = verified.where("not link").select(F.col("left_class").alias("centre"), F.col("right_class").alias("class"))
    if not unsettled.isEmpty():
        across = sent_to(route_across(routes, unsettled), "centre", "part", "deal").applyInArrow(verify_across, VERIFIED)
        edges = edges.union(across.select("left_class", "right_class"))
    roots = cut(components(edges))
    free(needed_texts, verified)
    of_root = (
        roots.join(classes, roots["node"] == classes["class"]).select("root", "first")
        .union(roots.select("root").distinct().join(classes, F.col("root") == classes["class"]).select("root", "first"))
        .groupBy("root").agg(F.min("first").alias("component_id"))
    )
    members = roots.union(roots.select("root", "root").distinct()).join(of_root, "root").select(F.col("node").alias("class"), "component_id")
    # a table, so that the join with the documents of a frequent class stands by itself and Spark can split it
    labels = cut(classes.join(members, "class", "left").select("class", F.coalesce("component_id", "first").alias("component_id")))
    out = documents.join(labels, "class", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def referred(classes: DataFrame) -> DataFrame:
    rest = bytearray(8 - REF_BYTES)
    return classes.withColumn("ref", F.concat(F.substring("class", 1, REF_BYTES), F.lit(rest)) if rest else F.substring("class", 1, 8))


def route(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Where texts go: each member to a part of its centre's group, the centre to all parts of it."""
    named = referred(classes)
    members = cut(pairs.join(named, pairs["member"] == named["ref"]).select("centre", "mutual", "class", "first", "n"))
    # a table, so that the join with the members of a large group stands by itself and Spark can split it
    parts = cut(members.groupBy(F.col("centre").alias("of")).agg(F.ceil(F.sum("n") / PART).cast("long").alias("parts")))
    members = members.join(parts, members["centre"] == parts["of"]).select(
        "centre", F.pmod(F.xxhash64("class"), "parts").alias("part"), "class", "first", "n", F.lit(1).alias("role"), "mutual", "parts"
    )
    centres = parts.join(named, parts["of"] == named["ref"]).select(
        F.col("of").alias("centre"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "class", "first", "n", F.lit(0).alias("role"), F.lit(0).alias("mutual"), "parts"
    )
    return members.union(centres)


def route_across(routes: DataFrame, unsettled: DataFrame) -> DataFrame:
    """Unsettled members go to all parts of their centre, dealt into groups of PART; the parts' members meet each."""
    sizes = routes.where("role = 1").select("centre", "class", "n")
    deals = unsettled.join(sizes, ["centre", "class"]).groupBy("centre").agg(F.ceil(F.sum("n") / PART).cast("long").alias("deals"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    home = routes.where("role = 1 and mutual = 1").join(deals, "centre")
    asked = (
        home.join(unsettled, ["centre", "class"]).withColumn("home", F.col("part")).withColumn("part", every("parts"))
        .withColumn("deal", F.pmod(F.xxhash64("class", F.lit(7)), "deals")).withColumn("role", F.lit(2)).withColumn("settled", F.lit(False))
    )
    there = (
        home.join(unsettled.withColumn("loose", F.lit(True)), ["centre", "class"], "left").withColumn("settled", F.col("loose").isNull())
        .withColumn("home", F.col("part")).withColumn("deal", every("deals"))
    )
    columns = ["centre", "part", "deal", "class", "role", "home", "settled", "first", "n"]
    return asked.select(columns).union(there.select(columns))
