import random
import re

import xxhash
from pyspark.sql import functions as F

from neolexis.llm import simhash


def plain(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute(prints, most):
    ids = sorted(prints)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= most:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: find(i) for i in ids}


def texts():
    rng = random.Random(3)
    base = [" ".join(rng.choice(["Ab", "cd", "éf", "gh", "ij", "kl"]) + str(rng.randrange(40)) for _ in range(rng.choice([1, 2, 3, 5, 30, 80]))) for _ in range(60)]
    out = base + base[:20] + [None, "", " \t ", None]
    for b in base[:40]:
        w = b.split()
        w[rng.randrange(len(w))] = "new"
        out.append("\n".join(w))
    return out


def test_matches_brute_force_with_nulls_ties_and_extra_columns(spark):
    rows = [(i, t, i, i) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, f0 long, component long")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = {i: plain(t) for i, t, *_ in rows}
    assert {i: r.f0 & (2**64 - 1) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == brute(prints, 4)


def test_pivot_differences_never_exceed_the_distance():
    import numpy as np

    rng = np.random.default_rng(1)
    for words in (1, 4):
        x = rng.integers(0, 1 << 63, (60, words)).astype(np.uint64)
        x[30:] = x[:30] ^ np.uint64(0b10110)
        x[0], x[1] = 0, ~np.uint64(0)
        table = simhash.pivot_distances(x)
        assert (simhash._unpacked(simhash._packed(table)) == table).all() and (simhash._unpacked(simhash._packed(table).slice(7)) == table[7:]).all()
        for a in range(60):
            apart = simhash._distance(x, x[a])
            assert (np.abs(table.astype(int) - table[a].astype(int)).max(1) <= apart).all()


def test_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (4, "A b c d e"), (4, "A b c d e"), (None, "zz yy"), (None, None), (7, "")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted([("None", "4"), ("None", "4"), ("4", "4"), ("4", "4"), ("None", "None"), ("None", "7"), ("7", "7")])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0


def test_hot_bucket_is_cut_and_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 64)
    rng = random.Random(5)
    center = rng.getrandbits(64)
    prints = {i: center ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 6]))) for i in range(300)}
    prints |= {1000 + i: rng.getrandbits(64) for i in range(100)}
    prints = {i: p for n, (i, p) in enumerate(prints.items()) if p not in list(prints.values())[:n]}
    df = spark.createDataFrame([(i, simhash._signed(p)) for i, p in prints.items()], "id long, f0 long")
    scratch = simhash.Scratch(spark)
    links = simhash.link_fingerprints(scratch.save(simhash.pivot_table(df, 1), "p"), simhash.group_masks(), 4, 1, scratch)
    label = {r.node: r.component for r in simhash.components(spark, links, scratch).collect()}
    want = brute(prints, 4)
    assert {i: label.get(i, i) for i in prints} == want


def test_long_text_is_read_whole(spark):
    text = "word " * 200_000 + "end of it all"
    docs = spark.createDataFrame([(1, text), (2, text[:-1])], "doc_id long, text string")
    a, b = (r.f0 for r in simhash.near_duplicates(docs).orderBy("doc_id").collect())
    assert a & (2**64 - 1) == plain(text)
    assert b & (2**64 - 1) == plain(text[:-1])
    assert F is not None
