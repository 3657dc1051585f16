"""Exact top-k inner products by a Voronoi join.

A sample of vectors, about the root of their number, are pivots, and each vector belongs to its nearest pivot. From
summaries of the groups (size, radius, greatest norm, the distances nearest the pivot) each query derives a score that
k others reach at least, its floor, and for each group a score that none of its vectors exceeds. Only groups that can
reach the floor need the query; it is sent there with its floor, and solved against the group's blocks, which return
only what reaches the floor. Groups of any size are split into blocks, and a group's queries too, each by its own
number, so no task holds a group or all queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ship

#: Pivots: the root of the number of vectors, but for these many at least, and bytes of them at most (sent to tasks).
LEAST_PIVOTS, PIVOT_BYTES = 16, 16 << 20
#: Bytes of the vectors in a block, and of the queries that meet it at once; numbers in a matrix of bounds.
BLOCK_BYTES, QUERY_BYTES, CELLS = 2 << 20, 2 << 20, 2 << 20
SCALE, SLACK = 1024.0, 1e-9
ASSIGNED = "row long, vec_id long, vector binary, cell long, distance double, norm double"
SUMMARY = "cell long, n long, radius double, norm double, nearest array<double>"
FOUND = "row long, query_id long, vec_id long, score long"
SCHEMA = "query_id long, rank int, vec_id long, score long"
#: A group's number is its vectors' length times this, and its pivot's number among those of that length from 1; 0: none.
STEP = 1 << 24


def quantised(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, which rows, their vectors floor(SCALE * x) as exact doubles) for each length; rows that are null or hold
    null or non-finite components are in none."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    starts = np.cumsum(sizes) - sizes
    bad = np.append(0, np.cumsum(~np.isfinite(values)))
    good = (bad[starts + sizes] == bad[starts]) & pc.is_valid(column).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[good]).tolist():
        mine = np.flatnonzero(good & (sizes == size))
        yield size, mine, values[starts[mine][:, None] + np.arange(size)]


def norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", vectors, vectors))


def nearest(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each vector's nearest pivot, and its distance."""
    lengths, near = np.einsum("ij,ij->i", pivots, pivots), np.empty(len(vectors), np.int64)
    step = max(1, CELLS // len(pivots))
    for at in range(0, len(vectors), step):
        near[at : at + step] = (lengths - 2 * (vectors[at : at + step] @ pivots.T)).argmin(1)
    return near, norms(vectors - pivots[near])


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products; beyond 64 bits, the nearest 64-bit integer."""
    if not queries.shape[1]:
        return np.zeros((len(queries), len(vectors)), np.int64)
    if np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * queries.shape[1] < 2.0**53:
        return (queries @ vectors.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object)
    return np.clip(whole(queries) @ whole(vectors).T, -(2**63), 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, open_: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each query its k best open columns: highest score, then smallest id."""
    for i in np.flatnonzero(open_.any(1)).tolist():
        columns, row = np.flatnonzero(open_[i]), scores[i]
        if len(columns) > k:
            columns = columns[row[columns] >= np.partition(row[columns], -k)[-k]]
        yield i, columns[np.lexsort((ids[columns], -row[columns]))][:k]


class Groups:
    """The groups of one length, from their summaries: what bounds a query's scores in each."""

    def __init__(self, rows: list, length: int, pivots: np.ndarray | None, k: int):
        self.cells, self.k = np.array([r["cell"] for r in rows], np.int64), k
        near = self.cells % STEP - 1
        self.centred = near >= 0
        self.centres = np.zeros((len(rows), length))
        if pivots is not None:
            self.centres[self.centred] = pivots[near[self.centred]]
        self.radius, self.norm = np.array([r["radius"] for r in rows]), np.array([r["norm"] for r in rows])
        self.distances = np.full((len(rows), k + 1), np.inf)  # from the pivot, of those nearest it
        for i, r in enumerate(rows):
            self.distances[i, : len(r["nearest"])] = r["nearest"] if self.centred[i] else self.norm[i]
        self.radius[~self.centred] = self.norm[~self.centred]

    def wanted(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(each query's floor, which groups each needs): the floor is the k-th best of what rows reach at least, after
        one that may be the query's own."""
        long, middle = norms(queries)[:, None], queries @ self.centres.T
        reached = (middle[:, :, None] - long[:, :, None] * self.distances).reshape(len(queries), -1)
        reached[np.isnan(reached)] = -np.inf  # 0 * inf
        floor = np.partition(reached, -self.k - 1, 1)[:, -self.k - 1] if reached.shape[1] > self.k else np.full(len(queries), -np.inf)
        most = np.minimum(middle + long * self.radius, long * self.norm)
        floor = floor - SLACK * (np.abs(floor) + long[:, 0] * self.norm.max(initial=0))
        floor = np.minimum(floor, 2.0**63)  # scores end there
        return floor, most >= floor[:, None]


def top_products(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """SCHEMA: for every row whose id is divisible by `every`, the k highest inner products of its vector with others.

    Each row is a vector of its own, whatever its id: a query's own row is no candidate, other rows of its id are, and
    rows that repeat an id with a divisible one are queries each, so that they give their ranks each. Ties go to the
    smaller id; fewer than k candidates give fewer rows. Vectors that are null or hold null or non-finite components,
    and rows without an id, take no part; vectors meet only vectors of their length. An empty table gives an empty one;
    other columns are ignored. The driver sees the pivots and a summary for each group."""
    spark = vectors.sparkSession
    ship(spark)
    kind = vectors.schema[vector_col].dataType.simpleString()
    vector = vectors[vector_col].cast(kind if kind in ("array<float>", "array<double>") else "array<double>")
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vector.alias("vector")).where("vec_id is not null")
    size = rows.where("vector is not null").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("length")).first()
    count = min(max(LEAST_PIVOTS, isqrt(size["n"])), max(1, PIVOT_BYTES // (8 * max(1, size["length"] or 1))), STEP - 1)
    chosen = rows.where("vector is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(count).collect()
    pivots = {length: np.unique(found, axis=0) for length, _, found in quantised(pa.array([r["vector"] for r in chosen], pa.list_(pa.float64()))) if length}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for length, mine, found in quantised(batch.column(2)):
                near, distance = nearest(found, pivots[length]) if length in pivots else (np.full(len(mine), -1), np.zeros(len(mine)))
                width = pa.binary(8 * length) if length else pa.binary()
                data = pa.array([v.tobytes() for v in found.astype("<f8")], width).cast(pa.binary())
                columns = [pa.array(keys[mine]), pa.array(ids[mine]), data, pa.array(length * STEP + near + 1), pa.array(distance), pa.array(norms(found))]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ASSIGNED.split(", ")])

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[int, list] = {}
        for batch in batches:
            cell, distance, norm = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            order = np.lexsort((distance, cell))
            cell, distance, norm = cell[order], distance[order], norm[order]
            cuts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else []
            for a, b in zip(cuts, [*cuts[1:], len(cell)]):
                old = cells.get(int(cell[a]), [0, 0.0, 0.0, np.zeros(0)])
                cells[int(cell[a])] = [old[0] + int(b - a), max(old[1], distance[b - 1]), max(old[2], norm[a:b].max()), np.sort(np.append(old[3], distance[a : min(b, a + k + 1)]))[: k + 1]]
        columns = list(zip(*((c, n, float(r), float(m), d.tolist()) for c, (n, r, m, d) in cells.items()))) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns, kinds)), names=["cell", "n", "radius", "norm", "nearest"])

    # a written table, so that the rows' numbers stay
    assigned = cut(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector").mapInArrow(assign, ASSIGNED))
    partial = assigned.select("cell", "distance", "norm").mapInArrow(summarise, SUMMARY)
    summary = (  # a row for each pivot, and for each length of vectors without one
        partial.groupBy("cell")
        .agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.max("norm").alias("norm"), F.slice(F.sort_array(F.flatten(F.collect_list("nearest"))), 1, k + 1).alias("nearest"))
        .collect()
    )
    by_length: dict[int, list] = {}
    for r in summary:
        by_length.setdefault(r["cell"] // STEP, []).append(r)
    groups = {length: Groups(found, length, pivots.get(length), k) for length, found in by_length.items()}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes = batch.column(0).to_numpy(), pc.binary_length(batch.column(1)).to_numpy() // 8
            for length in np.unique(sizes).tolist():
                mine, group = np.flatnonzero(sizes == length), groups[length]
                step = max(1, CELLS // (len(group.cells) * (k + 1)))
                for at in range(0, len(mine), step):
                    part = mine[at : at + step]
                    queries = np.frombuffer(b"".join(batch.column(1).take(pa.array(part)).to_pylist()), "<f8").reshape(len(part), length)
                    floor, needed = group.wanted(queries)
                    i, j = np.nonzero(needed)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[part[i]]), pa.array(group.cells[j]), pa.array(floor[i])], names=["row", "cell", "floor"])

    def solve(wanted: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if len(wanted) and len(block):
            rows, ids = block["row"].to_numpy(), block["vec_id"].to_numpy()
            matrix = lambda column: np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)
            q, v, own, query, floor = matrix(wanted["query"]), matrix(block["vector"]), wanted["row"].to_numpy(), wanted["query_id"].to_numpy(), wanted["floor"].to_numpy()
            step = max(1, CELLS // len(rows))
            for at in range(0, len(own), step):
                part = slice(at, at + step)
                scores = products(q[part], v)
                for i, columns in best(scores, ids, (scores >= floor[part, None]) & (rows != own[part, None]), k):
                    out.append((np.repeat(own[at + i], len(columns)), np.repeat(query[at + i], len(columns)), ids[columns], scores[i, columns]))
        columns = map(np.concatenate, zip(*out)) if out else [np.zeros(0, np.int64)] * 4
        return pa.table(dict(zip(["row", "query_id", "vec_id", "score"], map(pa.array, columns))))

    asking = assigned.where(F.col("vec_id") % every == 0).select("row", "vec_id", "vector")
    routed = cut(asking.select("row", "vector").mapInArrow(route, "row long, cell long, floor double"))
    asked = {r["cell"]: r["count"] for r in routed.groupBy("cell").count().collect()}  # a row for each group
    pieces = lambda n, cell, most: -(-n * 8 * max(1, cell // STEP) // most)
    sizes = spark.createDataFrame(
        [(r["cell"], pieces(r["n"], r["cell"], BLOCK_BYTES), pieces(asked[r["cell"]], r["cell"], QUERY_BYTES)) for r in summary if r["cell"] in asked], "cell long, parts long, deals long"
    )
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    keys = ["cell", "part", "deal"]
    sent = (
        routed.join(F.broadcast(sizes), "cell").withColumn("deal", F.pmod(F.xxhash64("row"), "deals")).withColumn("part", upto("parts"))
        .join(asking, "row").select(*keys, "row", F.col("vec_id").alias("query_id"), F.col("vector").alias("query"), "floor")
    )
    blocks = (
        assigned.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("row"), "parts")).withColumn("deal", upto("deals"))
        .select(*keys, "row", "vec_id", "vector")
    )
    found = sent.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(solve, FOUND)
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
