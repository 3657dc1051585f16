"""Jaccard join, top-k join and pipeline against brute force."""

import collections
import random
import tracemalloc

import corpus_pipeline
import numpy as np
import pyarrow as pa

from pixelloom.llm import jaccard, knn
from pixelloom.llm.common import BATCH_BYTES


def near_copies(rng: random.Random) -> list:
    words = [f"w{i}" for i in range(2000)]
    texts = []
    for size in (3, 4, 5, 6, 8, 9, 12, 20, 33, 40, 80, 150, 400) * 2:
        base = rng.choices(words, k=size)
        for _ in range(rng.choice([1, 2, 3, 8, 25])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, max(1, size // 50), max(1, size // 25)])):
                k, way = rng.randrange(len(copy)), rng.random()
                if way < 0.4:
                    copy[k] = rng.choice(words)
                elif way < 0.7 and len(copy) > 2:
                    del copy[k]
                else:
                    copy.insert(k, rng.choice(words))
            texts.append(" ".join(copy))
    passage = rng.choices(words, k=60)
    texts += [" ".join(passage + rng.choices(words, k=rng.choice([5, 10, 14, 20]))) for _ in range(60)]
    return [*texts, "", None, "a", "A", "a b"]


def plain_components(texts: list) -> tuple[list[int], list[int]]:
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(sets)))

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


def test_jaccard_components(spark, monkeypatch):
    texts = near_copies(random.Random(11))
    sizes, roots = plain_components(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for small in (False, True):
        if small:
            monkeypatch.setattr(jaccard, "BUCKET_ROWS", 700)
            monkeypatch.setattr(jaccard, "FAN", 3)  # several levels of ranges
            monkeypatch.setattr(jaccard, "PART", 150)
            monkeypatch.setattr(jaccard, "FLUSH", 1500)
            monkeypatch.setattr(jaccard, "REF_BYTES", 1)  # many classes share their short form
        found = {r["doc_id"]: r for r in jaccard.link_components(docs).collect()}
        assert [found[i]["n_shingles"] for i in range(len(texts))] == sizes
        assert [found[i]["component_id"] for i in range(len(texts))] == roots


def test_sets_without_units_enough_lose_no_link(spark, monkeypatch):
    """With so few segments that most sets lack units, and none has them by chance."""
    texts = near_copies(random.Random(3))
    sizes, roots = plain_components(texts)
    monkeypatch.setattr(jaccard, "SEGMENTS", 0.02)
    found = {r["doc_id"]: r for r in jaccard.link_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [found[i]["component_id"] for i in range(len(texts))] == roots


def test_merged_groups_do_not_grow(monkeypatch):
    """What a task merges of a range of buckets stays about a flush, however many buckets there are."""
    merged = []
    monkeypatch.setattr(jaccard, "emit", lambda docs, heavy, counts, buckets, width: merged.append((width, 1)))
    monkeypatch.setattr(jaccard, "finer", lambda packed, width, narrower, groups: merged.append((narrower, groups * -(-buckets // width))))
    monkeypatch.setattr(jaccard, "cut", lambda df: df)
    for buckets in (1, 256, 257, 1040, 5000, 65_537, 10**6):
        merged.clear()
        jaccard.by_bucket(None, None, None, buckets, buckets * jaccard.BUCKET_ROWS)
        widths, groups = zip(*merged)
        assert widths[-1] == 1 and all(-(-a // b) <= jaccard.FAN for a, b in zip((buckets, *widths), widths))
        assert all(buckets * jaccard.BUCKET_ROWS <= n * jaccard.FLUSH for n in groups[1:])


def test_equal_rows_are_not_merged_at_once(spark):
    """Copies of whole flushes name the same classes."""
    out: list[tuple] = []
    rows = np.arange(8, dtype=np.uint64) << jaccard.LOW, np.zeros(8, np.int64)
    jaccard.packed_rows(np.array([7], np.uint64), (*rows, *rows), (np.arange(8),) * 2, 8, out)
    packed = spark.createDataFrame([tuple(out[0])] * 60, jaccard.PACKED).repartition(4)
    found = jaccard.finer(packed, 8, 1, 10).groupBy("bucket").count().collect()
    assert sorted(r["bucket"] for r in found) == list(range(8)) and all(5 <= r["count"] <= 10 for r in found)


def traced(run) -> int:
    tracemalloc.start()
    run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def wide_bucket(classes: int, rows: int, per_row: int) -> pa.Table:
    """A bucket whose rows name many classes, with few signatures of each."""
    rng, out = np.random.default_rng(6), []
    for _ in range(rows):
        names = np.unique(rng.integers(0, 1 << 62, size=classes // rows).astype(np.uint64))
        sig = [rng.integers(0, 1 << 32, size=per_row).astype(np.uint64) for _ in range(2)]
        for s in sig:
            s[: per_row // 5] = rng.integers(0, 2000, size=per_row // 5)
        owner = [rng.integers(0, len(names), size=per_row) for _ in range(2)]
        jaccard.packed_rows(names, (sig[0], owner[0], sig[1], owner[1]), (np.zeros(per_row, np.int64),) * 2, 1, out)
    return pa.Table.from_batches([jaccard.packed_batch(out)])


def test_memory_of_a_bucket():
    """At 6 GB a bucket names 800,000 classes under 2 million signatures; two tasks share what the heap leaves."""
    table = wide_bucket(200_000, 20, 12_000)
    assert traced(lambda: jaccard.candidates(table)) < 50 * 2 * 20 * 12_000


def test_memory_of_a_flush():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(20_000)]
    lines = [" ".join(rng.choices(words, k=600)) for _ in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lines))), pa.array(lines)], names=["doc_id", "text"])

    class Here:
        def mapInArrow(self, run, schema):
            return list(run([batch]))

    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    assert traced(lambda: jaccard.emit(Here(), *none, 1000, 32)) < 100 * 600 * 600


def test_steps_change_no_result(monkeypatch):
    texts = [t for t in near_copies(random.Random(5)) if t and t.split()]
    sets = jaccard.shingle_sets(texts, jaccard.WordIds())
    none, table = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), wide_bucket(900, 9, 400)
    whole = jaccard.signatures(sets, *none)
    linked = [(i, j) for i in range(len(texts)) for j in range(len(texts)) if i != j and jaccard.linked(sets.one(i), sets.one(j))]
    assert linked
    pairs = {tuple(p.values()) for p in jaccard.candidates(table).to_pylist()}
    for step in (1, 40, 10**6):
        monkeypatch.setattr(jaccard, "STEP", step)
        index_sig, index_set, probe_sig, probe_set, hard = jaccard.stepwise(sets, *none)
        assert sorted(zip(index_sig.tolist(), index_set.tolist())) == sorted(zip(whole[0].tolist(), whole[1].tolist()))
        assert len(probe_sig) and (hard == whole[4]).all()
        holders = collections.defaultdict(set)  # which of equally cheap units are probed is free, but linked sets meet
        for sig, i in zip(index_sig.tolist(), index_set.tolist()):
            holders[sig].add(i)
        meet = {(i, j) for sig, j in zip(probe_sig.tolist(), probe_set.tolist()) for i in holders[sig]}
        each = [sets.one(i) for i in range(len(texts))]
        for i, j in linked:
            assert (i, j) in meet or hard[j] or len(each[j]) < len(each[i])
        found = jaccard.candidates(table).to_pylist()
        assert {tuple(p.values()) for p in found} == pairs and len(found) == len(pairs) > 100


def test_settings_are_given_back(spark):
    before = spark.conf.get(BATCH_BYTES)
    jaccard.link_components(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).collect()
    assert spark.conf.get(BATCH_BYTES) == before


def test_may_link_misses_no_pair():
    rng = np.random.default_rng(4)
    for _ in range(60):
        base = rng.integers(0, 80, size=int(rng.integers(1, 40))).astype(np.uint64)
        sets = [jaccard.distinct(np.where(rng.random(len(base)) < rng.choice([0.0, 0.05, 0.3]), rng.integers(0, 200, size=len(base)).astype(np.uint64), base)) for _ in range(25)]
        found = jaccard.may_link(sets[:10], sets)
        for i, some in enumerate(found):
            assert {j for j in range(25) if jaccard.linked(sets[i], sets[j])} <= set(some.tolist())


def test_top_products(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(5, 8))
    vectors = [(centres[i % 5] + 0.2 * rng.normal(size=8)).tolist() for i in range(900)] + [[0.5] * 8] * 300
    monkeypatch.setattr(knn, "BLOCK_BYTES", 50 * 64)
    monkeypatch.setattr(knn, "QUERY_BYTES", 4 * 64)
    found = collections.defaultdict(list)
    table = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    for r in knn.top_products(table).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    whole = np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(int)
    for q in range(0, 1200, 100):
        scores = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(1200), -scores)) if i != q][:10]
        assert found[q] == [(i, scores[i]) for i in order]


def test_top_products_of_a_repeated_id(spark):
    rng = np.random.default_rng(5)
    vectors = [[1.0] + [0.0] * 7] * 12 + [[0.5, *rng.normal(scale=0.3, size=7)] for _ in range(40)]  # all are pivots
    ids = [0] * 12 + list(range(1, 41))
    table = spark.createDataFrame(list(zip(ids, [list(map(float, v)) for v in vectors])), "vec_id long, embedding array<float>")
    found = collections.Counter(map(tuple, knn.top_products(table).collect()))
    whole = np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(int)
    wanted = collections.Counter()
    for q in range(12):
        scores = whole @ whole[q]
        order = [i for i in np.lexsort((ids, -scores)) if i != q][:10]
        wanted.update((0, n, ids[i], scores[i]) for n, i in enumerate(order, 1))
    assert found == wanted


def test_groups_that_cannot_reach_the_floor_are_not_asked():
    rng = np.random.default_rng(3)
    pivots = np.eye(6) * 100
    rows = [{"cell": 6 * knn.STEP + i + 1, "n": 50, "radius": 5.0, "norm": 105.0, "nearest": [1.0] * 11} for i in range(6)]
    floor, needed = knn.Groups(rows, 6, pivots, 10).wanted(np.eye(6)[:1] * 80 + rng.normal(size=(1, 6)))
    assert needed.tolist() == [[True] + [False] * 5] and 7000 < floor[0] < 8500


def test_pipeline_keeps_one_of_each(spark, prose_of):
    rng = random.Random(12)
    texts = [prose_of(rng, 150, 3000) for _ in range(20)]
    texts += [texts[0], texts[1] + " mail me at x.y@z.org", "no", "12 34", None, "again " * 200]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
    kept = {r["doc_id"]: r for r in docs.collect()}
    assert set(kept) == set(range(20))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r["doc_id"] for r in pieces} == set(kept)


def test_one_of_each_component(spark, prose_of):
    rng = random.Random(13)
    a, b, c = (prose_of(rng, 150, 3000) for _ in range(3))
    rows = [(1, a), (5, a + " more"), (5, b), (7, b + " more"), (None, a), (None, c), (None, c + " more"), (2, ""), (2, ""), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.one_of_each(spark, docs, "").collect()
    found = sorted((r["doc_id"] or 0, r["text"]) for r in kept)
    assert [f for f in found if f[0]] == [(1, a), (2, ""), (3, ""), (5, b)]
    assert len(found) == 5 and found[0][1] in (c, c + " more")


def test_personal_data_stage(spark):
    docs = spark.createDataFrame([(1, "write to a@b.org now", 20)], "doc_id long, text string, n_chars long")
    (row,) = corpus_pipeline.without_personal_data(spark, docs, "").collect()
    assert row["text"] == "write to <EMAIL> now" and row["n_chars"] == len(row["text"])
