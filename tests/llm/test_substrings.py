import hashlib
import random
from collections import Counter

import numpy as np

from neolexis.llm import substrings


def brute(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed, n=90):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + str(r.randrange(60))
    prose = lambda k: [word() for _ in range(k)]
    passages = [prose(k) for k in (33, 34, 35, 36, 40, 62, 63, 90, 200)]
    out = []
    for _ in range(n):
        w = prose(r.choice([0, 5, 20, 60]))
        for _ in range(r.choice([0, 1, 1, 2])):
            p = r.choice(passages)
            a, b = sorted(r.sample(range(len(p) + 1), 2)) if r.random() < 0.4 else (0, len(p))
            w += p[a:b] + prose(r.choice([0, 1, 3, 30]))
        out.append(" ".join(w))
    for t in out[:20]:
        w = t.split()
        if w:
            w[r.randrange(len(w))] = "edit"
        out.append("\n".join(w))
    out += [None, "", " \t", out[3], out[3], " ".join(["same"] * 300), " ".join(["x", "y"] * 40), "  ".join(passages[4])]
    return out


def test_matches_brute_force(spark):
    for seed in (1, 2, 3):
        ts = texts(seed)
        rows = [(i, t, 0, "p") for i, t in enumerate(ts)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, place int, print string").repartition(5)
        out = sorted(substrings.remove_repeats(docs).collect(), key=lambda r: r.doc_id)
        assert [(r.n_words, r.n_removed, r.kept_sha256) for r in out] == brute(ts, 35)
        assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in out)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    t = " ".join(map(str, range(50)))
    docs = spark.createDataFrame([(None, t), (None, t), (1, None), (1, "a b")], "doc_id long, text string")
    out = substrings.remove_repeats(docs).collect()
    assert sorted((r.n_words, r.n_removed) for r in out) == [(0, 0), (2, 0), (50, 50), (50, 50)]
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_rolling_hashes_depend_on_the_words_only():
    h = np.random.default_rng(0).integers(0, 2**63, 200).astype(np.uint64)
    h[100:150] = h[20:70]
    for n in (1, 8, 35, 62):
        r = substrings.rolling(h, n, substrings._R1)
        assert len(r) == 201 - n and len(set(r.tolist())) == len(r) - max(0, 51 - n)
        if n <= 50:
            assert (r[100 : 151 - n] == r[20 : 71 - n]).all()
