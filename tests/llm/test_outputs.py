import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from neolexis.llm import mixing, packing, token_output, warc
from neolexis.llm.common import Scratch, scratch_path, word_count

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_word_encoder_equals_whole_texts(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_output, "CACHE_WORDS", 20)
    plain, enc = Tokenizer.from_file(PATH), token_output.WordEncoder(PATH)
    texts = ["Hello WORLD it's 7 7 77 a7b", "é e ́x İ ß y　z", "a\x0bb\x1cc\x85d", "x <|endoftext|> y<|startoftext|>", "", "don't re-do 's 'S \U0001f600!!", "ﬁ ſ Å Ω", "End. end, \"end.\" l'eau. a.' a-b ÉTÉ!! ĲĮ. ǅ. a%%% ×÷ a_b İ."] * 3
    for batch in (texts[:4], texts[4:], texts):
        ids, sizes = enc.encode(pa.array(batch))
        want = [plain.encode(t, add_special_tokens=False).ids for t in batch]
        assert ids.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))


def test_token_output_round_trip(spark):
    from tokenizers import Tokenizer

    rows = [(5, "b c"), (1, "Hello there " * 5000), (3, None), (2, ""), (5, "b c"), (9, "ends")]
    docs = spark.createDataFrame([(a, b, 0, "s") for a, b in rows], "doc_id long, text string, part int, ids string").repartition(3)
    path = scratch_path(spark, "t")
    token_output.write_tokens(docs, path, PATH)
    got = sorted(token_output.checksums(spark, path).collect(), key=lambda r: (r.doc_id, r.start))
    plain, at = Tokenizer.from_file(PATH), 0
    for r, (i, t) in zip(got, sorted(rows, key=lambda x: x[0])):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        assert tuple(r) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_output.lookup(spark, path, 9).count() == 1 and token_output.lookup(spark, path, 4).count() == 0
    empty = scratch_path(spark, "e")
    token_output.write_tokens(docs.limit(0), empty, PATH)
    assert token_output.read_tokens(spark, empty).count() == 0


def test_word_encoder_on_random_texts(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_output, "CACHE_WORDS", 300)
    plain, enc, rng = Tokenizer.from_file(PATH), token_output.WordEncoder(PATH), random.Random(8)
    marks = "aabcdEFzéÉĲßİ-'’.,!?\"()[]{}@#1279   \t\n\x0b\u00a0\u0301\u2009漢\U0001f600"
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(40))) for _ in range(3000)]
    for at in range(0, len(texts), 250):
        ids, sizes = enc.encode(pa.array(texts[at : at + 250]))
        want = [plain.encode(t, add_special_tokens=False).ids for t in texts[at : at + 250]]
        assert sizes.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_token_files_prune_and_take_null_ids(spark):
    import pyarrow.orc

    rows = [(i, f"w{i} " * 40) for i in range(6000)] + [(None, "no id"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = scratch_path(spark, "p")
    token_output.write_tokens(docs, path, PATH, stripe_bytes=1 << 16, row_stride=1000)
    files = [f for f in spark.read.orc(path).inputFiles()]
    ranges = [(s["low"], s["high"]) for s in (spark.read.orc(f).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first() for f in files) if s["low"] is not None]
    ranges.sort()
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))  # files hold disjoint ascending ranges
    assert max(pyarrow.orc.ORCFile(f.removeprefix("file://")).nstripes for f in files) >= 1
    out = token_output.read_tokens(spark, path)
    assert sorted(r.start for r in out.where("doc_id is null").collect())[0] == 0
    # the filter reaches the scan, and the totals come from their own small table
    plan = token_output.lookup(spark, path, 77)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,77)" in plan.replace("77L", "77") and "struct<part:int,total:bigint>" in plan and plan.count("FileScan orc") == 1
    (row,) = token_output.lookup(spark, path, 77).collect()
    assert row.start == sum(r.n_tokens for r in out.where("doc_id is null or doc_id < 77").collect())


def targets(sizes, most=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def test_mixing_meets_targets(spark):
    rng = random.Random(2)
    names = ["a", "b", "c", "d", "e", None, "É"]
    rows = [(i, rng.choice(names[:1] * 6 + names), rng.choice([None, "", "w " * rng.choice([1, 3, 50])])) for i in range(400)] + [(400, "tiny", "one"), (0, "a", "twice  \tx")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, source string, text string, size int")
    out = mixing.mix(docs, Scratch(spark), ["doc_id", "source"]).collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes)
    for s in sizes:
        mine = [r for r in out if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and r.taken <= 3 * r.size for r in mine)
        assert sum(r.taken for r in mine) == round(want[s])
        uses = sorted((u["position"], u["words"]) for r in mine for u in r.uses)
        assert all(0 <= p < 1 for p, _ in uses)
    again = mixing.mix(docs.repartition(5), Scratch(spark), ["doc_id", "source"]).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    order = [r.position for r in mixing.training_order(mixing.mix(docs, Scratch(spark), ["doc_id"])).collect()]
    assert order == sorted(order)
    assert mixing.mix(docs.limit(0), Scratch(spark), ["doc_id"]).count() == 0


def test_mixing_is_what_its_sql_gives(spark, tmp_path):
    import duckdb

    from neolexis.llm import queries

    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "a", "b", "É", None]), rng.choice([None, "", "one", "w " * 40, "x\ty\u00a0z " * 7])) for i in range(150)]
    rows += [(None, "a", "no id"), (7, "b", "long " * 9000), *[(500, "c", "twice the same")] * 3]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, source string, text string, size int")
    docs.repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = queries.op7_mixing(spark, f"file://{tmp_path}")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()["op7_mixing"]).fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_training_reads_the_whole_mix_at_an_even_rate(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, rng.choice("aaaabbc"), "w " * rng.choice([1, 3, 9])) for i in range(3000)], "doc_id long, source string, text string")
    uses = mixing.training_order(mixing.mix(docs, Scratch(spark), ["doc_id", "source"])).collect()
    total, before = sum(r.words for r in uses), 0
    for r in uses:  # words read before a use are its progress, up to a document of each source
        assert 0 <= r.progress < 1 and abs(r.progress * total - before) <= 30
        before += r.words
    assert [r.progress for r in uses] == sorted(r.progress for r in uses)
    # around the middle of the schedule all rates are 1: shares are those of the targets
    share = lambda low, high, s: sum(r.words for r in uses if low <= r.position < high and r.source == s) / sum(r.words for r in uses if low <= r.position < high)
    whole = {s: sum(r.words for r in uses if r.source == s) / total for s in "abc"}
    assert all(share(0.4, 0.6, s) == pytest.approx(whole[s], abs=0.02) for s in "abc")
    assert share(0, 0.2, "a") < whole["a"] < share(0.8, 1, "a") and share(0, 0.2, "c") > whole["c"] > share(0.8, 1, "c")


def test_curriculum_inverts_the_integral(spark):
    for first, last in ((0.5, 1.5), (1.0, 1.0), (1.5, 0.5), (0.0, 2.0)):
        for t in (0.0, 0.1, 0.5, 0.9, 1.0):
            demand = (first * t + (last - first) * t * t / 2) / ((first + last) / 2)
            got = spark.range(1).select(mixing._when(F.lit(demand), F.lit(first), F.lit(last)).alias("t")).first().t
            assert (got or 0.0) == pytest.approx(t, abs=1e-9)


def test_buckets_are_optimal():
    from itertools import combinations

    rng = random.Random(4)
    for _ in range(40):
        lengths = sorted(rng.sample(range(1, 60), 9))
        count = [rng.randrange(1, 30) for _ in lengths]
        waste = lambda tops: sum(n * min(t for t in tops if t >= x) for x, n in zip(lengths, count))  # noqa: E731, B023
        for k in (1, 2, 3, 5, 20):
            got = packing.choose_buckets(np.array(lengths, float), np.array(count), k)
            best = min(waste((*c, lengths[-1])) for c in combinations(lengths[:-1], min(k, 9) - 1))
            assert len(got) <= k and got[-1] == lengths[-1] and waste(got) == best


def test_packing_forms_full_batches_within_the_budget(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.choice([0, 1, 5, 6, 7, 40, 41, 300]), "x") for i in range(500)] + [(None, None, None), (7, "w " * 5000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket string")
    out = packing.pack(docs, Scratch(spark), ["doc_id"], word_count(F.col("text")), F.xxhash64("doc_id", "text"), buckets=4, budget=600).collect()
    assert len(out) == len(rows) and sorted(r.n_tokens for r in out) == sorted(len((t or "").split()) for _, t, _ in rows)
    groups = {}
    for r in out:
        assert r.n_tokens <= r.bucket_tokens
        groups.setdefault((r.bucket, r.batch), []).append(r)
    for rs in groups.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
        assert len(rs) == 1 or len(rs) * rs[0].bucket_tokens <= 600
    for b in {b for b, _ in groups}:
        sizes = [len(groups[b, k]) for k in range(len([1 for x, _ in groups if x == b]))]
        assert len(set(sizes[:-1])) <= 1 and sizes[-1] <= sizes[0]
    assert packing.pack(docs.limit(0), Scratch(spark), ["doc_id"], word_count(F.col("text")), F.xxhash64("doc_id")).count() == 0


def test_length_bins_are_monotone(spark):
    rows = spark.range(0, 20_000).select("id", packing.length_bin(F.col("id")).alias("b")).orderBy("id").collect()
    assert all(x.b <= y.b <= x.b + 1 for x, y in zip(rows, rows[1:])) and all(r.b == r.id for r in rows[:1024])


def test_word_count(spark):
    texts = [None, "", " ", "a", " a ", "a b", "\ta\x0b\x0cb\r\nc ", "é  è", "a\x1cb"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in docs.select(word_count(F.col("text"))).collect()] == [len((t or "").encode().split()) for t in texts]


def test_archives_round_trip(spark, monkeypatch):
    html = ["<p>é</p>" * 40_000, "same", "same", "", None, "x\r\n\r\nWARC/1.1\r\ny", "0\r\n\r\n" * 20_000]
    rows = [(10 - i, f"http://h/{i} x", h, 1) for i, h in enumerate(html)] + [(None, None, "same", 2), (9, "again", "same", 3), (9, "again", "same", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to int").repartition(3)
    path = scratch_path(spark, "w")
    warc.write_warc(pages, path)
    got = warc.read_warc(spark, path).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    for page, _, h, _ in rows:
        payload = (h or "").encode()
        for r in by[page]:
            assert (r.payload_bytes, r.payload_digest) == (len(payload), warc.sha1_base32(payload))
            group = [p for p, _, x, _ in rows if (x or "") == (h or "") and p is not None]
            first = min(group)
            assert (r.record_type, r.refers_to) == (("response", None) if page == first else ("revisit", first))
            if r.record_type == "response":
                assert r.payload == payload
    assert warc.archive(pages.limit(0)).count() == 0
    path = scratch_path(spark, "big")
    warc.write_warc(pages, path, least_revisit=5)
    assert {r.record_type for r in warc.read_warc(spark, path, False).collect()} == {"response"}


def test_archives_are_bundled_and_parsed_member_by_member(spark, monkeypatch):
    monkeypatch.setattr(warc, "BUNDLE", 2000)
    monkeypatch.setattr(warc, "BUNDLES_A_FILE", 3)
    rng = random.Random(5)
    rows = [(i, "u", "".join(chr(rng.randrange(32, 0x2FF)) for _ in range(700))) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = scratch_path(spark, "bundles")
    warc.write_warc(pages, path)
    files = spark.read.format("binaryFile").load(path).collect()
    assert len(files) > 3 and max(r.length for r in files) < 3 * 5000
    assert {r.page_id: r.payload.decode() for r in warc.read_warc(spark, path).collect()} == {i: t for i, _, t in rows}
    every = bytes(range(256)) * 300
    data = warc._record([("WARC-Type", "x")], every) + warc._EMPTY_MEMBER + warc._record([("WARC-Type", "y")], b"")
    assert [(f["warc-type"], b) for f, b in warc.parse_warc(data)] == [("x", every), ("y", b"")]
    for cut in (5, len(data) - 3):
        with pytest.raises(ValueError):
            list(warc.parse_warc(data[:cut]))


def test_broken_archives_are_refused():
    assert warc.unchunked(warc.chunked(b"abc" * 9000)) == b"abc" * 9000
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")
    with pytest.raises(ValueError):
        warc.reassemble([(1, b"a", None), (3, b"b", 2)])
    with pytest.raises(ValueError):
        warc.reassemble([(1, b"a", None), (2, b"b", 3)])
    assert warc.reassemble([(2, b"b", 2), (1, b"a", None)]) == b"ab"
