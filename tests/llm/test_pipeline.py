import random
import re

from pyspark.sql import functions as F

import corpus_pipeline as cp
from neolexis.llm import bilstm_crf, pii
from neolexis.llm.simhash import text_fingerprint


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def documents(seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "er", "th", "in", "on", "re", "st"]) for _ in range(r.randint(1, 4)))
    base = [" ".join(word() for _ in range(r.choice([60, 150, 400]))) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(base)]
    for k in range(20):  # near copies: one edit in 60 words or more leaves a similarity above 0.84
        w = base[k].split()
        w[r.randrange(len(w))] = "edited"
        rows.append((100 + k, " ".join(w), "en", "s1", 1))
    rows += [(200, base[0], "en", "s0", 1), (0, base[0], "en", "s0", len(base[0])), (201, None, None, None, None), (202, "", "en", "s2", 0), (203, "Mail a.b@c.de or +1 (209) 555-1594 " + base[41], "en", "s3", 1)]
    return rows, base


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_near_dedup_against_brute_force(spark):
    rows, _ = documents()
    out = cp.near_dedup(spark, frame(spark, rows), "").collect()
    prints = {(i, t): text_fingerprint(t, 5, 4) for i, t, *_ in rows}
    keys = sorted(prints, key=lambda k: k[0])
    up = {k: k for k in keys}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for n, a in enumerate(keys):
        for b in keys[:n]:
            apart = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(prints[a], prints[b]))
            if apart <= cp.BITS_APART:
                x, y = sorted((find(a), find(b)), key=lambda k: k[0])
                up[y] = x
            elif a[1] and b[1]:
                s, t = shingles(a[1]), shingles(b[1])
                assert len(s & t) / len(s | t) < 0.85
    want = sorted(k[0] for k in keys if find(k) == k)
    assert sorted(r.doc_id for r in out) == want
    assert set(range(60)) <= set(want) | {0} and not set(want) & set(range(100, 120))


def test_near_dedup_is_decided_by_exact_jaccard(spark):
    # pairs on both sides of 0.8, far within what fingerprints of 256 bits can tell apart; texts of few shingles too
    r = random.Random(3)
    rows, n = [], 0
    for size in [4, 5, 9, 10, 19, 30, 60, 200] * 12:
        shared = [f"w{r.randrange(10**9)}" for _ in range(size + 4)]
        for cut in (r.choice([0, 0.1, 0.2, 0.25, 0.3]), r.choice([0, 0.1, 0.2])):
            rows.append((n, " ".join(shared[: size + 4 - int(cut * size)] + ["x", f"y{n}"][: r.randrange(3)]), "en", "s", 1))
            n += 1
    rows += [(n + k, " ".join(f"v{i}" for i in range(k * 4, k * 4 + 60)), "en", "s", 1) for k in range(12)]  # a chain
    rows += [(900, "same line here again now " * 9 + "end", "en", "s", 1), (901, "same line here again now " * 40 + "end", "en", "s", 1)]
    sets = {i: shingles(t) for i, t, *_ in rows}
    up = {i: i for i in sets}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    want = sorted(i for i in sets if find(i) == i)
    assert 20 < len(want) < len(rows) - 20
    assert sorted(r.doc_id for r in cp.near_dedup(spark, frame(spark, rows), "").collect()) == want


def test_near_copies_of_one_id_or_none_leave_one_row(spark):
    text = lambda name, end: " ".join(f"{name}{i}" for i in range(60)) + end
    rows = [(None, text("a", " x"), "en", "s", 1), (None, text("a", " y"), "en", "s", 1), (7, text("b", " x"), "en", "s", 1), (7, text("b", " y"), "en", "s", 1), (9, text("c", ""), "en", "s", 1), (None, text("c", " y"), "en", "s", 1)]
    out = cp.near_dedup(spark, frame(spark, rows), "").collect()
    assert sorted(r.text[:2] for r in out) == ["a0", "b0", "c0"] and {r.doc_id for r in out} == {None, 7, 9}


def test_units_of_many_sets_lose_no_pair(spark, monkeypatch):
    from neolexis.llm import simhash

    monkeypatch.setattr(simhash, "SETS", 4)
    monkeypatch.setattr(simhash, "BLOCK", 4)
    rows = [(k, " ".join(f"v{i}" for i in range(k * 4, k * 4 + 60)), "en", "s", 1) for k in range(30)]
    assert [r.doc_id for r in cp.near_dedup(spark, frame(spark, rows), "").collect()] == [0]


def saved_tables(monkeypatch, spark):
    """What each scratch table held, by name: rows, and the most rows of a key."""
    from neolexis.llm import simhash

    seen, save = {}, simhash.Scratch.save

    def record(self, df, name):
        out = save(self, df, name)
        most = out.groupBy("key").count().agg(F.max("count")).first()[0] if "key" in out.columns else None
        seen.setdefault(name, (out.count(), most))
        return out

    monkeypatch.setattr(simhash.Scratch, "save", record)
    return seen


def test_a_common_line_proposes_few_pairs(spark, monkeypatch):
    from neolexis.llm import simhash

    monkeypatch.setattr(simhash, "SAMPLED", 4, raising=False)
    seen = saved_tables(monkeypatch, spark)
    line = " ".join(f"line{i}" for i in range(24))
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(50)) + " " + line, "en", "s", 1) for k in range(300)]
    rows += [(1000 + k, rows[k][1] + " end", "en", "s", 1) for k in range(5)]
    assert sorted(r.doc_id for r in cp.near_dedup(spark, frame(spark, rows), "").collect()) == list(range(300))
    # by the value of hashes, all 305 texts met at one hash of the line
    assert seen["shared"][1] <= 4


def family(r):
    """Near copies of one text, from lightly to heavily edited, a common line in most texts, and a chain."""
    base = [f"b{i}" for i in range(140)]
    rows = [(0, " ".join(base), "en", "s", 1)]
    for k in range(1, 90):
        w = list(base)
        for at in r.sample(range(5, 135), r.choice([1, 1, 1, 2, 2, 3, 4, 6])):
            w[at] = r.choice([f"e{k}x{at}", "edited", f"e{at}"])
        rows.append((k, " ".join(w[r.randrange(3) :]), "en", "s", 1))
    line = " ".join(f"line{i}" for i in range(20))
    rows += [(100 + k, " ".join(f"w{k // 2}x{i}" for i in range(60)) + " " + line + (" x" * r.randrange(12)), "en", "s", 1) for k in range(60)]
    return rows + [(200 + k, " ".join(f"v{i}" for i in range(k * 4, k * 4 + 60)), "en", "s", 1) for k in range(30)]


def test_near_copies_of_one_text_by_any_order_of_hashes(spark, monkeypatch):
    from neolexis.llm import simhash

    rows = family(random.Random(8))
    sets = {i: shingles(t) for i, t, *_ in rows}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((label[a], label[b]))
                label = {k: x if v == y else v for k, v in label.items()}
    want = sorted(set(label.values()))
    assert 10 < sum(i < 100 for i in want) < 80
    monkeypatch.setattr(simhash, "SETS", 8)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    for sampled, common in ((1, 1 << 18), (3, 1 << 18), (1, 40)):
        monkeypatch.setattr(simhash, "SAMPLED", sampled, raising=False)
        monkeypatch.setattr(simhash, "COMMON", common, raising=False)
        assert sorted(r.doc_id for r in cp.near_dedup(spark, frame(spark, rows), "").collect()) == want


def test_a_group_of_near_copies_is_not_compared_pair_by_pair(spark, monkeypatch):
    from neolexis.llm import simhash
    from neolexis.llm.common import Scratch

    monkeypatch.setattr(simhash, "SETS", 8)
    seen = saved_tables(monkeypatch, spark)
    # near copies of one set, sets apart from all, and two classes that only sets outside the largest class connect
    members = [list(range(100)) + [1000 + k, 2000 + k] for k in range(120)] + [list(range(30)) + list(range(10_000 * k, 10_000 * k + 70)) for k in range(1, 4)]
    members += [list(range(500 + 5 * k, 600 + 5 * k)) for k in range(12)]
    sets = spark.createDataFrame([(k, 7, sorted(m)) for k, m in enumerate(members)], "id long, key long, hashes array<long>")
    loose = spark.createDataFrame([(k, 7, 2) for k in range(len(members))], "id long, key long, own long")
    sizes = spark.createDataFrame([(7, len(members))], "key long, n long")
    label = {r.node: r.component for r in simhash._exact_components(sets, sizes, loose, Scratch(spark)).collect()}
    assert {label[k] for k in range(120)} == {0} and {label[k] for k in range(123, 135)} == {123}
    assert not {120, 121, 122} & {k for k, v in label.items() if k != v}
    n = len(members)
    assert seen["placed"][0] <= 2 * 15 * (n // 4 + 2) < n * n // 4


def test_personal_data_is_masked(spark):
    rows, _ = documents()
    out = {r.doc_id: r for r in cp.personal_data(spark, frame(spark, rows), "").collect()}
    assert out[203].text.startswith("Mail [EMAIL] or [PHONE] ") and out[203].n_chars == len(out[203].text)
    detector = pii.Detector(bilstm_crf.default_model())
    for i, t, *_ in rows:
        if i != 203 and t:
            assert out[i].text == t and detector.spans([t])[0][1] == []
    assert out[201].text is None


def test_mixing_repeats_whole_documents(spark):
    rows, _ = documents()
    extra = frame(spark, rows).select(F.col("doc_id"), "text", "lang", "source", "n_chars", F.lit("x").alias("words"), F.lit(1).alias("uses"))
    out = cp.mixing(spark, extra, "").collect()
    assert sorted(map(str, out)) == sorted(map(str, cp.mixing(spark, extra.repartition(3), "").collect()))
    whole = {}
    for i, t, *_ in rows:
        whole.setdefault(i, set()).add(t)
    total = sum(len((t or "").split()) for _, t, *_ in rows)
    # each of the five sources is off by half a document at most
    assert abs(sum(len(r.text.split()) for r in out) - total) <= 5 * 200 + 4
    for r in out:
        assert r.text in whole[r.doc_id] and r.n_chars == len(r.text)
    uses = {}
    for r in out:
        uses[r.doc_id, r.text, r.source] = uses.get((r.doc_id, r.text, r.source), 0) + 1
    copies = {}
    for i, t, _, s, _ in rows:
        copies[i, t, s] = copies.get((i, t, s), 0) + 1
    assert all(n <= 3 * copies[k] for k, n in uses.items())


def test_the_whole_pipeline(spark, tmp_path):
    rows, _ = documents()
    r = random.Random(1)
    more = [(1000 + i, " ".join(("moron" if k == 3 and i % 4 == 0 else f"w{r.randrange(500)}") for k in range(30)), "en", "s2", 1) for i in range(200)]
    frame(spark, rows + more).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1000 + i, 1, int(i % 4 == 0)) for i in range(150)] + [(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = cp.run(spark, str(tmp_path)).collect()
    assert {"doc_id", "source", "n_tokens", "bucket", "bucket_tokens", "batch", "slot"} == set(out[0].asDict())
    toxic = {1000 + i for i in range(0, 200, 4)}
    assert not toxic & {x.doc_id for x in out}
    batches = {}
    for x in out:
        batches.setdefault((x.bucket, x.batch), []).append(x)
    assert all(len(b) == 1 or len(b) * b[0].bucket_tokens <= 65_536 for b in batches.values())


def test_stages_take_empty_tables(spark, tmp_path):
    rows, _ = documents()
    empty = frame(spark, rows).limit(0)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in cp.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0, name
        if name != "packing":
            assert out.columns == cp.COLUMNS
    assert re.match("quality", cp.STAGES[0][0])
