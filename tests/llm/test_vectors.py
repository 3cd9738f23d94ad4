import math
import random

import numpy as np
import pytest

from neolexis.llm import forest, multi_index


def make(seed=0, n=300, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[50:90] = x[7] + 0.05 * rng.normal(size=(40, dim))
    x[100:160] = x[9]
    rows = [(i, [float(np.float32(v)) for v in r], "l") for i, r in enumerate(x.tolist())]
    rows += [(1000, None, "l"), (1001, [0.0] * dim, "l"), (1002, [float("nan")] + [1.0] * (dim - 1), "l"), (1003, [None] + [1.0] * (dim - 1), "l"), (1004, [float("inf")] * dim, "l"), (5, rows[5][1], "again")]
    random.Random(1).shuffle(rows)
    return rows


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))


def test_links_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 32)
    rows = make()
    df = spark.createDataFrame([(i, v, t, 0) for i, v, t in rows], "vec_id long, embedding array<float>, label string, copies int")
    out = multi_index.near_duplicates(df, cell_rows=20).collect()
    assert len(out) == len(rows)
    good = [(i, v) for i, v, _ in rows if i < 1000]
    links = {}
    up = {i: i for i, _, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, v) in enumerate(good):
        for m, (j, w) in enumerate(good):
            if n != m and cosine(v, w) >= 0.9:
                links[i] = links.get(i, 0) + (1 if i != 5 else 0.5)  # id 5 has two rows
                a, b = sorted((find(i), find(j)))
                up[b] = a
    for r in out:
        assert r.component_id == find(r.vec_id) and r.kept == (r.vec_id == r.component_id)
        assert r.n_links == links.get(r.vec_id, 0)
    assert multi_index.near_duplicates(df.limit(0)).count() == 0
    assert {r.n_links for r in multi_index.near_duplicates(df.where("vec_id > 1000")).collect()} == {0}


def test_null_ids_and_pairs_at_the_threshold(spark):
    v = [0.9, math.sqrt(1 - 0.9**2)] + [0.0] * 6
    e = [1.0] + [0.0] * 7
    rows = [(None, e), (None, e), (3, v), (4, v), (5, [-1.0] + [0.0] * 7), (None, [0.0, 0.0, 1.0] + [0.0] * 5)]
    out = multi_index.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    near = int((multi_index.unit(np.array([e])) * multi_index.unit(np.array([v]))).sum() >= 0.9)
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), str(r.kept)) for r in out)
    first = "3" if near else "None"
    assert got == sorted([("None", 1 + 2 * near, first, "None")] * 2 + [("3", 1 + 2 * near, "3", "True"), ("4", 1 + 2 * near, "3", "False"), ("5", 0, "5", "True"), ("None", 0, "None", "None")])


def test_recall_of_pairs_near_the_threshold(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = rng.normal(size=x.shape)
    u -= (u * x).sum(1, keepdims=True) * x
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    y = 0.905 * x + math.sqrt(1 - 0.905**2) * u
    rows = [(i, v) for i, v in enumerate(np.concatenate([x, y]).tolist())]
    out = multi_index.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cell_rows=40).collect()
    assert sum(r.n_links > 0 for r in out) / len(rows) > 0.95


def test_multi_sequence_visits_the_nearest_cells():
    rng = np.random.default_rng(1)
    a, b = rng.random(9), rng.random(7)
    order = np.argsort(np.add.outer(a, b).reshape(-1), kind="stable").tolist()
    for n in (1, 5, 63, 100):
        assert multi_index.multi_sequence(a, b, n) == order[:n]


def test_search_matches_brute_force_on_small_tables(spark):
    rows = make(3)
    df = spark.createDataFrame([(i, v, t, 0.0) for i, v, t in rows], "vec_id long, embedding array<float>, label string, score double")
    out = forest.search(df, df.where("vec_id % 50 = 0")).collect()
    good = [(i, v) for i, v, _ in rows if i < 1000]
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r)
    for q in (i for i in range(0, 300, 50)):
        v = dict(good)[q]
        want = sorted(((-cosine(v, w), j) for j, w in good if j != q))[:5]
        assert [r.rank for r in got[q]] == [1, 2, 3, 4, 5]
        assert [r.score for r in got[q]] == pytest.approx([-s for s, _ in want])
        assert all(cosine(v, dict(good)[r.vec_id]) == pytest.approx(r.score) for r in got[q])
    assert set(got) == set(range(0, 300, 50))
    assert forest.search(df.limit(0), df).count() == 0
    two = df.where("vec_id in (0, 1)")
    assert forest.search(two, two).count() == 2


def test_search_recall_over_shards(spark, monkeypatch):
    monkeypatch.setattr(forest, "SHARD", 1000)
    monkeypatch.setattr(forest, "QUERIES", 20)
    monkeypatch.setattr(forest, "PAIRS", 10_000)
    x = np.random.default_rng(4).normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    out = forest.search(df, df.where("vec_id % 50 = 0"), least=50).collect()
    sims = x @ x.T
    np.fill_diagonal(sims, -9)
    hit = sum(r.vec_id in np.argsort(-sims[r.query_id])[:5] for r in out)
    assert len(out) == 300 and hit / 300 >= 0.9


def test_ties_go_to_smaller_ids_and_repeated_ids_are_candidates_each(spark, monkeypatch):
    monkeypatch.setattr(forest, "SHARD", 40)
    rng = np.random.default_rng(6)
    v, others = rng.normal(size=16).tolist(), rng.normal(size=(150, 16)).tolist()
    rows = [(0, v)] + [(i, v) for i in random.Random(2).sample(range(1, 400), 90)] + [(1000 + i, o) for i, o in enumerate(others)] + [(7000, v), (7000, v)]
    low = sorted(i for i, w in rows if w is v and i)[:5]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    for least in (5, 400):
        out = forest.search(df, df.where("vec_id in (0, 7000)"), least=least).orderBy("query_id", "rank").collect()
        assert [r.vec_id for r in out if r.query_id == 0] == low and [r.vec_id for r in out if r.query_id == 7000] == sorted([0, *low])[:5]
        assert len({r.score for r in out}) == 1
    twice = spark.createDataFrame([(0, v), (5, v), (5, v), (6, others[0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in forest.search(twice, twice.where("vec_id = 0")).orderBy("rank").collect()] == [5, 5, 6]


def test_forest_descends_and_ascends():
    x = np.random.default_rng(0).normal(size=(200, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    f = forest.Forest(x, 4)
    for enough in (1, 10, 150, 500):
        found = {}
        for who, row in f.candidates(x[:5], enough):
            for a, b in zip(who.tolist(), row.tolist()):
                found.setdefault(a, []).append(b)
        for k in range(5):
            assert k in found[k] and len(set(found[k])) == len(found[k]) >= min(enough, 200)
    # a query has all rows with its prefix of the level where it stopped, in any tree
    codes = f.codes(x)
    for who, row in f.candidates(x[:5], 3):
        for q in set(who.tolist()):
            mine = set(row[who == q].tolist())
            levels = [{i for c in codes for i in np.flatnonzero(c // f.base ** (4 - n) == c[q] // f.base ** (4 - n)).tolist()} for n in range(5)]
            assert mine in levels
