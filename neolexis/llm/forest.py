"""Approximate nearest neighbours by a forest of hash prefixes.

Each tree is a sorted array of long hash strings. A character of a string is the axis, with its sign, that lies
nearest to the vector after a random rotation (cross-polytope hashing): near vectors share it far more often than
they share bits of hyperplanes of the same selectivity (README has both). A query descends every tree to its
longest matching prefix; then all trees ascend together, one character at a time, until enough candidates share
the prefix in some tree. All rows of the last level are candidates, and all candidates are verified in double
precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .vectors import matrix, unit, usable

#: Characters of a string, and axes that a character chooses from.
LENGTH, AXES = 4, 32
#: Rows of an index shard, at least and at most: between them a shard grows with the root of the table.
SHARD, LARGEST = 4096, 32_768
#: Queries looked up at once, and (query, row) pairs held at once.
QUERIES, PAIRS = 512, 1 << 22


class Forest:
    def __init__(self, rows: np.ndarray, trees: int, seed: int = 5):
        """rows: unit vectors, in the order of their ids."""
        rng, d = np.random.default_rng(seed), rows.shape[1]
        self.axes = min(AXES, max(1, d // 2))
        wide = min(d, 2 * self.axes)
        self.turns = np.stack([np.linalg.qr(rng.normal(size=(d, wide)))[0] for _ in range(trees)]).astype(np.float32)
        self.rows, self.base = rows, 2 * self.axes
        codes = self.codes(rows)
        self.order = [np.argsort(c, kind="stable").astype(np.int32) for c in codes]
        self.arrays = [c[o] for c, o in zip(codes, self.order)]

    def characters(self, x: np.ndarray, turn: np.ndarray) -> list[np.ndarray]:
        y = x @ turn
        out = []
        for part in (y[:, : self.axes], y[:, -self.axes :]):
            at = np.abs(part).argmax(1)
            out.append((2 * at + (part[np.arange(len(part)), at] > 0)).astype(np.int64))
        return out

    def codes(self, x: np.ndarray) -> list[np.ndarray]:
        """Each tree's strings as numbers: two characters of its own rotation, then those of the next tree's."""
        x = x.astype(np.float32)
        pairs = [a * self.base + b for a, b in (self.characters(x, t) for t in self.turns)]
        return [own * self.base**2 + after for own, after in zip(pairs, [*pairs[1:], pairs[0]])]

    def candidates(self, queries: np.ndarray, enough: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query number, row number), each once: for each query at least `enough` rows, or all."""
        n, total = len(queries), len(self.rows)
        if enough >= total:
            for at in range(0, n, max(1, PAIRS // total)):
                some = np.arange(at, min(n, at + max(1, PAIRS // total)))
                yield np.repeat(some, total), np.tile(np.arange(total), len(some))
            return
        codes, live = self.codes(queries), np.arange(n)
        for level in range(LENGTH, 0, -1):
            cut = self.base ** (LENGTH - level)
            low = np.stack([np.searchsorted(a, q[live] // cut * cut) for a, q in zip(self.arrays, codes)])
            size = np.stack([np.searchsorted(a, (q[live] // cut + 1) * cut) for a, q in zip(self.arrays, codes)]) - low
            reach = size.sum(0)  # no fewer than distinct rows
            ready, done = np.flatnonzero(reach >= enough), np.zeros(len(live), bool)
            at = 0
            while at < len(ready):
                end = at + max(1, int(np.searchsorted(np.cumsum(reach[ready[at:]]), PAIRS, side="right")))
                part, at = ready[at:end], end
                keys = []
                for t in range(len(self.arrays)):
                    s = size[t, part]
                    place = np.repeat(low[t, part] - np.cumsum(s) + s, s) + np.arange(int(s.sum()))
                    keys.append(np.repeat(part, s) * total + self.order[t][place])
                found = np.unique(np.concatenate(keys))
                who, row = found // total, found % total
                full = np.bincount(who, minlength=len(live)) >= enough
                done |= full
                yield live[who[full[who]]], row[full[who]]
            live = live[~done]
            if not len(live):
                return
        for q in live:
            yield np.full(total, q), np.arange(total)


def _nearest(forest: Forest, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, enough: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query number, vec_id, score of each query's k best candidates."""
    out: list[tuple[np.ndarray, ...]] = []
    for who, row in forest.candidates(queries, enough):
        other = ids[row] != own[who]
        who, row = who[other], row[other]
        # products summed along each row alike, so that equal vectors have equal scores wherever they lie
        score = np.concatenate([(queries[who[a : a + 65_536]] * forest.rows[row[a : a + 65_536]]).sum(1) for a in range(0, len(who), 65_536)]) if len(who) else np.zeros(0)
        order = np.lexsort((ids[row], -score, who))
        who, row, score = who[order], row[order], score[order]
        best = np.arange(len(who)) - np.searchsorted(who, who) < k
        out.append((who[best], ids[row[best]], score[best]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, trees: int = 400, share: float = 0.04, least: int = 160) -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score: each query's k nearest rows found, by cosine, ties to smaller ids.

    Every row is indexed once, in shards dealt by a hash of the row; every query goes to every shard, whose task
    reads the shard's rows, builds its forest and then takes the queries batch by batch. In a shard the trees
    ascend until a `share` of its rows, or `least` rows, are candidates; both were chosen by recall against brute
    force (README). A candidate with the query's own id is left out. Unusable vectors (null, zero, null or
    non-finite components) and rows with null ids take no part. Rows repeated with the same id are candidates
    each; a repeated query gives one result for its id and vector. All vectors have the same length.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = usable(vectors, id_col, vector_col).where("valid and vec_id is not null").select("vec_id", "vector")
    asked = usable(queries, id_col, vector_col).where("valid and vec_id is not null").select("vec_id", "vector").distinct()
    total = rows.count()
    shards = max(1, -(-total // int(min(LARGEST, max(SHARD, 16 * total**0.5)))))
    index = rows.select("vec_id", "vector", F.pmod(F.xxhash64(F.lit(1), "vec_id", "vector"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("ask"))
    wanted = asked.select("vec_id", "vector", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("ask"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, forest, ids = None, [], None, None

        def answer(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            own, wants = part.column(0).to_numpy(), unit(matrix(part.column(1)))
            for a in range(0, len(own), QUERIES):
                who, vec, score = _nearest(forest, ids, wants[a : a + QUERIES], own[a : a + QUERIES], k, max(least, int(share * len(ids))))
                yield pa.RecordBatch.from_arrays([pa.array(own[a : a + QUERIES][who]), pa.array(vec), pa.array(score)], names=["query_id", "vec_id", "score"])

        for batch in batches:  # sorted: a shard's rows, then its queries, then the next shard's
            marks = batch.column(2).to_numpy().astype(np.int64) * 2 + batch.column(3).to_numpy()
            cuts = [0, *(np.flatnonzero(marks[1:] != marks[:-1]) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                shard, ask = divmod(int(marks[lo]), 2)
                if shard != at:
                    at, held, forest = shard, [], None
                part = batch.slice(lo, hi - lo)
                if not ask:
                    held.append((part.column(0).to_numpy(), unit(matrix(part.column(1)))))
                    continue
                if held:
                    ids, x = np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])
                    by_id = np.argsort(ids, kind="stable")
                    ids, forest, held = ids[by_id], Forest(x[by_id], trees), []
                if forest is not None:
                    yield from answer(part)

    dealt = index.unionByName(wanted).repartition(shards, "shard").sortWithinPartitions("shard", "ask")
    found = scratch.save(dealt.mapInArrow(run, "query_id long, vec_id long, score double"), "found")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
