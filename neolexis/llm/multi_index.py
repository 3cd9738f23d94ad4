"""Embedding near-duplicates by an inverted multi-index.

Independent codebooks on the two halves of a vector form a product grid of cells. A vector is indexed in its
own cell and looked up in the cells that a multi-sequence traversal visits first; how many are visited is
calibrated on pairs at exactly the threshold until the target recall. Candidates are verified in double
precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import components
from .simhash import _forest
from .vectors import matrix, unit, usable

#: Vectors that the codebooks are fitted on, those with the smallest hashes of their ids.
SAMPLE = 20_000
#: Rows of one side of a comparison in one task.
BLOCK = 1024
#: Codes of each half, at most: the sample has about ten vectors for each then. Up to cell_rows times the square of
#: this (800 million classes by default) the grid grows with the table and cells keep their size.
CODES = 2048


def codebook(x: np.ndarray, codes: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means centres."""
    centres = x[rng.choice(len(x), min(codes, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)
        for k in range(len(centres)):
            if (mine := near == k).any():
                centres[k] = x[mine].mean(0)
    return centres


def multi_sequence(d1: np.ndarray, d2: np.ndarray, count: int) -> list[int]:
    """The first `count` cells i * len(d2) + j by d1[i] + d2[j], without looking at the whole grid."""
    o1, o2, width = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist(), len(d2)
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    heap, out = [(s1[0] + s2[0], 0, 0)], []
    while heap and len(out) < count:
        _, i, j = heapq.heappop(heap)
        out.append(o1[i] * width + o2[j])
        if j == 0 and i + 1 < len(o1):
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
        if j + 1 < width:
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
    return out


class Grid:
    def __init__(self, sample: np.ndarray, codes: int, threshold: float, recall: float, seed: int = 3):
        rng, x = np.random.default_rng(seed), unit(sample)
        self.half = max(1, x.shape[1] // 2)
        self.books = [codebook(x[:, : self.half], codes, rng), codebook(x[:, self.half :], codes, rng)] if x.shape[1] > 1 else [codebook(x, codes, rng), np.zeros((1, 0))]
        self.cells = len(self.books[0]) * len(self.books[1])
        self.visits = self._calibrate(x, threshold, recall, rng)

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        parts = x[:, : self.half], x[:, self.half :]
        return [(p * p).sum(1)[:, None] + (b * b).sum(1) - 2 * p @ b.T for p, b in zip(parts, self.books)]

    def places(self, x: np.ndarray, count: int) -> np.ndarray:
        """Visited cells of each row, nearest first; the first is its own."""
        d1, d2 = self.distances(x)
        return np.array([multi_sequence(a, b, count) for a, b in zip(d1, d2)], np.int64).reshape(len(x), min(count, self.cells))

    def _calibrate(self, x: np.ndarray, threshold: float, recall: float, rng: np.random.Generator, pairs: int = 2000) -> int:
        """Visits that find a pair at exactly the threshold, from either side, with probability `recall`."""
        a = x[rng.choice(len(x), pairs)]
        u = rng.normal(size=a.shape)
        u -= (u * a).sum(1, keepdims=True) * a
        b = threshold * a + np.sqrt(1 - threshold**2) * u / np.maximum(np.sqrt((u * u).sum(1, keepdims=True)), 1e-12)

        def ranks(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            (p1, p2), (q1, q2) = self.distances(x), self.distances(y)
            k1, k2, row = q1.argmin(1), q2.argmin(1), np.arange(len(x))
            own = p1[row, k1] + p2[row, k2]
            return np.array([(np.add.outer(m, n) < o).sum() for m, n, o in zip(p1, p2, own)])

        return min(self.cells, int(np.quantile(np.minimum(ranks(a, b), ranks(b, a)), recall)) + 1)


def _compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """From rows sorted by unit: partial link counts (a, null, n) and links as a forest (a, b, 0)."""

    def run(rows: pa.Table) -> pa.RecordBatch:
        side = rows["side"].to_numpy()
        node, copies, cell = (rows[c].to_numpy() for c in ("node", "copies", "cell"))
        vecs = unit(matrix(rows["vector"].combine_chunks()))
        x, y = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # side 2: both
        if not len(x) or not len(y):
            return empty
        cosine = vecs[x] @ vecs[y].T
        i, j = np.nonzero(cosine >= threshold - 1e-9)
        close = cosine[i, j] < threshold + 1e-9
        i, j = x[i], y[j]
        # a product's last bits depend on the rows' places in it: decide what is that close by sums in one fixed order
        close[close] = (vecs[i[close]] * vecs[j[close]]).sum(1) < threshold
        i, j = i[~close], j[~close]
        if (side == 2).all():
            keep = i < j
        else:
            # the pair may be found in either's cell: it counts in the smaller one
            twice = np.zeros(len(i), bool)
            if len(i):
                # only rows of the index carry what they visit
                lists = rows["visited"].combine_chunks().take(pa.array(x))
                table, row = np.asarray(lists.flatten()).reshape(len(x), -1), np.zeros(len(rows), np.int64)
                row[x] = np.arange(len(x))
                for at in range(0, len(i), 1 << 16):
                    s = slice(at, at + (1 << 16))
                    twice[s] = (table[row[i[s]]] == cell[j[s]][:, None]).any(1)
            keep = ~twice | (cell[i] <= cell[j])  # within a cell, once anyway
        i, j = i[keep], j[keep]
        if not len(i):
            return empty
        n = np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
        at = np.flatnonzero(n)
        a, b = _forest(len(rows), i, j)
        cols = [np.concatenate([node[at], node[a]]), np.concatenate([np.zeros(len(at), np.int64), node[b]]), np.concatenate([n[at].astype(np.int64), np.zeros(len(a), np.int64)])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "b", "n"])

    empty = pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, names=["a", "b", "n"])
    held: list[pa.RecordBatch] = []
    for batch in batches:
        unit_ids = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(unit_ids[1:] != unit_ids[:-1]) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi == lo:
                continue
            if held and held[0].column(0)[0].as_py() != unit_ids[lo]:
                yield run(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield run(pa.Table.from_batches(held))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, recall: float = 0.995, cell_rows: int = 200) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept (vec_id = component_id).

    Equal vectors are one class with a number of copies; rows of a class link with each other. Unusable vectors
    (null, zero, null or non-finite components) have no link and are their own component. A null id takes part
    in links and is a component's id only if it has no other; its kept is null then. The grid has about a cell
    for `cell_rows` classes. Rows of a cell are cut into blocks of bounded size, and every pair of blocks of
    index and lookups is a unit, so one very full cell is dealt over many tasks. All vectors have the same
    length. Links are counted where they are verified; only a forest of them goes on to the components.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = usable(vectors, id_col, vector_col)
    good = rows.where("valid")
    classes = good.groupBy("vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = scratch.save(classes.withColumn("node", F.xxhash64("least", "vector")), "classes")
    total = classes.count()
    if not total:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    sample = np.array([r.vector for r in classes.orderBy(F.xxhash64(F.lit(1), "node")).limit(SAMPLE).select("vector").collect()], np.float64)
    grid = Grid(sample, int(np.clip(round((total / cell_rows) ** 0.5), 1, CODES)), threshold, recall)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            visited = grid.places(unit(matrix(batch.column(2))), grid.visits) if batch.num_rows else np.zeros((0, 1), np.int64)
            own = visited[:, 0]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * visited.shape[1]), pa.array(visited.reshape(-1).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), lists], names=["node", "copies", "vector", "cell", "visited"])

    kind = classes.schema["vector"].dataType.simpleString()
    placed = scratch.save(classes.select("node", "copies", "vector").mapInArrow(place, f"node bigint, copies bigint, vector {kind}, cell bigint, visited array<int>"), "placed")

    def blocks_of(counts: DataFrame) -> np.ndarray:
        """Blocks of each cell: a number for each cell of the grid, at most CODES * CODES."""
        found, out = counts.select(F.col("c").cast("int"), F.ceil(F.col("count") / BLOCK).cast("int").alias("n")).toArrow(), np.zeros(grid.cells, np.int32)
        out[found["c"].to_numpy()] = found["n"].to_numpy()
        return out

    blocks = blocks_of(placed.groupBy(F.col("cell").alias("c")).count())
    queues = blocks_of(placed.select(F.explode("visited").alias("c"), "cell").where("c <> cell").groupBy("c").count())
    schema = f"unit bigint, side int, node bigint, copies bigint, cell bigint, visited array<int>, vector {kind}"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = (1 << 63) - 1
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                take, units, sides = [], [], []
                few, waiting = blocks.__getitem__, queues.__getitem__
                for k, (node, cell, visited) in enumerate(zip(part.column(0).to_pylist(), part.column(3).to_pylist(), part.column(4).to_pylist())):
                    mix = (node * 0x9E3779B97F4A7C15) >> 13 & mask
                    n = int(few(cell))
                    mine = mix % n
                    for other in range(n):
                        lo, hi = min(mine, other), max(mine, other)
                        take.append(k)
                        units.append(_unit(cell, lo, hi, 0))
                        sides.append(2 if lo == hi else 0 if mine == lo else 1)
                    for q in range(int(waiting(cell))):
                        take.append(k)
                        units.append(_unit(cell, mine, q, 1))
                        sides.append(0)
                    for v in visited[1:]:
                        if n := int(few(v)):
                            q = (mix >> 20) % int(waiting(v))
                            for b in range(n):
                                take.append(k)
                                units.append(_unit(v, b, q, 1))
                                sides.append(1)
                t, side = part.take(pa.array(take, pa.int64())), pa.array(sides, pa.int32())
                # those that look into a cell need not carry what they visit, which is most copies
                lists = pc.if_else(pc.equal(side, 1), pa.scalar(None, part.schema.field(4).type), t.column(4))
                yield pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), side, t.column(0), t.column(1), t.column(3), lists, t.column(2)], names=["unit", "side", "node", "copies", "cell", "visited", "vector"])

    dealt = placed.mapInArrow(deal, schema).repartition("unit").sortWithinPartitions("unit")
    found = scratch.save(dealt.mapInArrow(lambda batches: _compare(batches, threshold), "a bigint, b bigint, n bigint"), "found")
    counts = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    label = components(spark, found.where("n = 0").select("a", "b"), scratch)
    nodes = classes.select("node", "least").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    nodes = scratch.save(nodes.join(counts, "node", "left"), "labelled")
    # a component or a vector may have a third of the rows: what joins them is written first, so that Spark can split them
    smallest = scratch.save(nodes.groupBy("component").agg(F.min("least").alias("component_id")), "smallest")
    labelled = nodes.join(smallest, "component").select("node", "links", "component_id")
    by_vector = classes.join(labelled, "node").select("vector", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    by_vector = scratch.save(by_vector, "by_vector")
    linked = good.join(by_vector, "vector").select("vec_id", "n_links", "component_id")
    alone = rows.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _unit(cell: int, a: int, b: int, kind: int) -> int:
    """A number for a pair of blocks of a cell; below 2**63."""
    return (((cell * 2 + kind) << 22 | a) << 22 | b) & ((1 << 63) - 1)
