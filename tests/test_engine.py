import json
import math
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from neolexis.config import Params, Scope, fraction_label, load_params
from neolexis.functions import text as X
from neolexis.operators import candidates as C
from neolexis.operators import exports as E
from neolexis.operators import posts as P
from neolexis.operators import records as R
from neolexis.operators import stats as S
from neolexis.sources import readers


def spans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    rows = X.tokenize_with_offsets(df, "body", ["id"]).orderBy("id", "token_start").collect()
    out = {}
    for r in rows:
        out.setdefault(r.id, []).append((r.surface, r.token_start, r.token_end))
    return [out.get(i, []) for i in range(len(texts))]


def test_tokens_and_offsets(spark):
    texts = ["lmaooo!!", "foo_bar", "don't", "y'all", "hi!hello", "rock-and-roll", "low-key", None, "", "--", "-a-", "a--b", "é \U0001f600 Ünï-x 漢字", " ".join(f"w{i}-é" for i in range(1000))]
    pattern = re.compile(r"[\w]+(?:[-'][\w]+)*")
    want = [[(m[0], *m.span()) for m in pattern.finditer(t or "")] for t in texts]
    assert spans(spark, texts) == want


def test_clean_posts(spark):
    rows = [("1", "a", "1577836800", "x", 1), (None, "a", "1", "x", 1), ("2", "a", "1", None, 1), ("3", "a", "1", "[deleted]", 1), ("4", "a", "1", "[removed]", 1), ("5", "a", "1578268800", "[deleted] x", None), ("6", "a", "abc", "x", 1), ("7", None, "1", "x", 1)]
    out = P.clean_posts(spark.createDataFrame(rows, "id string, subreddit string, created_utc string, body string, score int")).orderBy("post_id").collect()
    assert [(r.post_id, str(r.week_start_date), r.year, r.month) for r in out] == [("1", "2019-12-30", 2020, 1), ("5", "2020-01-06", 2020, 1)]


@pytest.mark.parametrize("flags, want", [
    ({"allow_numbers": False}, {"abc", "it's", "a-b"}), ({}, {"abc", "it's", "a-b", "a1b"}), ({"allow_underscore": True}, {"abc", "it's", "a-b", "a1b", "a_b"}),
    ({"allow_hyphen": False, "allow_apostrophe": False, "allow_numbers": False}, {"abc"}), ({"min_len": 4, "allow_numbers": False}, {"it's"}), ({"allow_hyphen": False}, {"abc", "it's", "a1b"}),
])
def test_candidate_form(spark, flags, want):
    df = spark.createDataFrame([(t,) for t in ["ab", "abc", "a1b", "a_b", "it's", "a-b", "x--y", "café", None]], "token string")
    assert {r.token for r in df.where(X.is_candidate(F.col("token"), **flags)).collect()} == want


def test_gibberish(spark):
    df = spark.createDataFrame([(t,) for t in ["oooooooo", "noooo", "lolololo", "nananana", "hahaha", "haha", "umum", "lololo", "aaaa", "mama"]], "token string")
    kept = lambda **k: {r.token for r in df.where(~X.is_gibberish(F.col("token"), **k)).collect()}
    assert kept() == {"noooo", "lolololo", "nananana", "hahaha", "haha", "umum", "lololo", "aaaa", "mama"}
    assert kept(strict=True) == kept() - {"lolololo", "nananana", "aaaa"}
    assert kept(laughter=True) == {"noooo", "haha", "mama"}


def test_counts_add_up_and_spikes_by_hand(spark):
    params = Params(min_token_count=1, min_period_count=1, min_baseline_total_tokens=1, min_baseline_periods=2, monthly_window=2)
    plan = {(2020, 1): ["foo", "bar", "bar"], (2020, 2): ["bar"] * 4, (2020, 4): ["foo", "foo", "bar"], (2020, 5): ["foo"] * 3 + ["x1"]}
    rows = [("s", y, m, t) for (y, m), ts in plan.items() for t in ts] + [("other", 2020, 4, "foo")]
    tokens = spark.createDataFrame(rows, "subreddit string, year int, month int, token string")
    base, scope = S.monthly_base(tokens, params), Scope("subreddit")
    stats = S.token_stats(base, "monthly", scope)
    assert {(r.month, r.token): (r.count_reddit, r.total_tokens) for r in stats.where("subreddit = 's'").collect()}[5, "foo"] == (3, 4)
    year, whole = S.token_stats(base, "yearly", scope), S.token_stats(base, "all_time", scope)
    for df in (year, whole):
        assert {r.token: (r.count_reddit, r.total_tokens) for r in df.where("subreddit = 's'").collect()} == {"foo": (6, 14), "bar": (7, 14)}
    assert S.token_stats(base, "all_time", Scope("global")).where("token = 'foo'").first().count_reddit == 7
    ratio = S.clean_ratio(whole, S.clean_stats(spark.createDataFrame([("bar bar",)], "text string")), scope)
    got = {r.token: r for r in ratio.where("subreddit = 's'").collect()}
    assert got["foo"].clean_ratio_score == pytest.approx(math.log(6 / 14 / 1e-12)) and got["foo"].count_clean is None
    spikes = S.spike_scores(stats, S.broad_candidates(ratio.where("token = 'foo'"), params, scope), params, scope, "monthly").collect()
    by = {(r.subreddit, r.month): r for r in spikes}
    # April: the months before are January and February (March was never seen); February has no foo
    assert set(by) == {("s", 4), ("s", 5)}
    assert (by["s", 4].baseline_count_reddit, by["s", 4].baseline_total_tokens, by["s", 4].baseline_periods) == (1, 7, 2)
    assert (by["s", 5].baseline_count_reddit, by["s", 5].baseline_total_tokens) == (2, 7)
    assert by["s", 4].spike_score == pytest.approx(math.log((3 / 4) / (2 / 8)))


def test_rank_rescale(spark):
    params = Params(rank_top_k=3, tail_decay=0.1)
    ratio = spark.createDataFrame([("t" + "abcd"[i], "s", 10 * (4 - i), float(4 - i)) for i in range(4)], "token string, subreddit string, count_reddit long, clean_ratio_score double")
    none = spark.createDataFrame([], "subreddit string, token string, spike_score double, period_id string")
    out = {r.token: r.slang_score for r in C.token_scores(ratio, none, none, params, Scope("subreddit")).collect()}
    assert [out[t] for t in ("ta", "tb", "tc", "td")] == pytest.approx([1.0, 0.9, 0.8, 0.8 * math.exp(-0.1)])
    plain = C.token_scores(ratio, none, none, replace(params, rank_top_k=0), Scope("subreddit")).collect()
    assert all(0 <= r.slang_score <= 1 for r in plain)


def test_parameters(tmp_path):
    for bad in ({"clean_ratio_s": 0}, {"spike_boost_weight": 1.5}, {"rank_top_k": -1}, {"reliability_log": 1.0}):
        with pytest.raises(ValueError):
            Params(**bad)
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"params": {"min_token_count": 7}, "score_params": {"tail_decay": 0.5}}))
    p = load_params(str(path), tail_decay=0.25, min_len=None)
    assert (p.min_token_count, p.tail_decay, p.min_len) == (7, 0.25, 3)
    assert [fraction_label(f) for f in (0.1, 0.025, 0.07)] == ["10pct", "2_5pct", "7pct"]
    assert readers.token_list('["b", "a", "b", ""]') == ["b", "a"]
    with pytest.raises(ValueError):
        readers.token_list("[1]")


def test_samples_depend_on_posts_only(spark):
    tokens = spark.range(5000).select((F.col("id") % 500).cast("string").alias("post_id"), F.lit(2020).alias("year"), F.lit(1).alias("month"), F.col("id").alias("n"))
    a = P.sample_tokens(tokens, 0.2)
    assert sorted(r.n for r in a.collect()) == sorted(r.n for r in P.sample_tokens(tokens.repartition(7), 0.2).collect())
    assert a.count() == 10 * a.select("post_id").distinct().count() and 50 < a.select("post_id").distinct().count() < 150
    with pytest.raises(ValueError):
        P.sample_tokens(tokens, 0.0)


def test_links_and_names(spark):
    value = {"Page_URL": "u1", "x": [{"url": " "}, {"urls": {"deep_url": "u2"}}], "Hashtags": [{"text": "t", "url": "no"}, {"text": ""}, 3], "hashtags_url": [{"text": "z"}]}
    assert R.links_and_tags(value) == (["u1", "u2"], ["t"])
    df = spark.createDataFrame([(1, json.dumps(value)), (2, "{broken"), (3, None)], "id int, j string")
    out = {r.id: (r.extracted_urls, r.extracted_hashtags) for r in R.extract_links(df, "j", ["id"]).collect()}
    assert out == {1: (["u1", "u2"], ["t"]), 2: ([], []), 3: ([], [])}
    lines = spark.createDataFrame([(0, "reddit/subreddits25/ABC_comments.zst"), (1, "x_submissions.zst"), (2, "reddit/subreddits25/abc_submissions.zst")], "line int, path string")
    assert sorted(map(tuple, R.first_names(lines).collect())) == [("abc", 0), ("x", 1)]


def test_histogram_and_previews(spark):
    scores = spark.createDataFrame([(0.0,), (1.0,), (0.999,), (0.5,), (1.5,), (None,), (float("nan"),)], "slang_score double")
    assert {r.bin: r.n for r in E.score_histogram(scores).collect()} == {0: 1, 49: 2, 25: 1}
    assert [r[0] for r in E.preview(spark.range(5), [("nope", True), ("id", True)], 2).collect()] == [4, 3]
    assert len(E.PREVIEWS) == 11


def test_ranks_of_tied_scores_have_no_hot_part(spark):
    from neolexis.operators import ranks

    n = 20_000
    rows = spark.range(n).select(F.format_string("t%06d", F.col("id")).alias("token"), F.when(F.col("id") % 10 == 0, F.rand(1)).otherwise(0.25).alias("power")).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ranks.global_rank(rows, [F.desc("power"), "token"], "rank")
        got = out.collect()
        parts = [r["count"] for r in ranks.in_parts(rows, [F.desc("power"), "token"]).groupBy("_part").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = sorted(((-r.power, r.token) for r in got))
    assert [(-r.power, r.token) for r in sorted(got, key=lambda r: r.rank)] == want and sorted(r.rank for r in got) == list(range(1, n + 1))
    assert len(parts) == 4 and max(parts) < 2 * n / 4
    assert ranks.global_rank(rows.limit(0), ["token"], "rank").count() == 0


def test_weekly_sample_has_its_cap(spark):
    posts = spark.range(900).select(F.col("id").cast("string").alias("post_id"), F.expr("date'2020-01-06' + cast(7 * (id % 9) as int)").alias("week_start_date"))
    out = P.sample_posts_by_week(posts, 90)
    assert 60 < out.count() <= 90 and P.weeks(out).count() == 9
    assert P.sample_posts_by_week(posts, 5000).count() == 900
    assert sorted(map(str, out.collect())) == sorted(map(str, P.sample_posts_by_week(posts.repartition(5), 90).collect()))
    with pytest.raises(ValueError):
        P.sample_posts_by_week(posts, 0)


def test_top_tables(spark):
    rows = spark.createDataFrame([("s", "a", 3.0, None, 1.0), ("s", "b", 5.0, 2.0, None), ("t", "b", 4.0, 9.0, None), ("t", "c", 5.0, None, float("nan"))], "subreddit string, token string, clean_ratio_score double, max_spike_score_monthly double, max_spike_score_yearly double")
    assert [tuple(r) for r in E.top_tokens(rows, "max_spike_score_monthly", 5).collect()] == [("b", 9.0), ("b", 2.0)]
    assert [tuple(r) for r in E.top_tokens(rows, "max_spike_score_yearly", 5).collect()] == [("a", 1.0)]
    assert [r.token for r in E.auto_tokens(rows, 2).collect()] == ["b", "c"]
    assert [(r.subreddit, r.token) for r in E.candidate_summary(rows, 1).collect()] == [("s", "b"), ("t", "c"), ("t", "b"), ("s", "a")]
    dates = spark.createDataFrame([("monthly", 2020, 5), ("monthly", 2020, None), ("yearly", 2021, 7)], "time_grain string, year int, month int")
    assert sorted(str(r.plot_date) for r in E.plot_dates(dates).collect()) == ["2020-01-01", "2020-05-01", "2021-01-01"]


def test_readers_of_files(spark, tmp_path):
    import zstandard

    lines = [json.dumps({"id": str(i), "subreddit": "s", "created_utc": "1577836800", "body": f"é {i}", "score": i}) for i in range(25)]
    (tmp_path / "raw.zst").write_bytes(zstandard.compress("\n".join(lines[:20]).encode()) + zstandard.compress(("\n" + "\n\n".join(lines[20:])).encode()))
    got = readers.zstd_posts(spark, f"{tmp_path}/raw.zst").collect()
    assert sorted(int(r.id) for r in got) == list(range(25)) and got[3].body.startswith("é ")
    assert readers.json_lines(spark, f"{tmp_path}/none.json").count() == 0
    (tmp_path / "lines.json").write_text('{"a": 1}\n\n  \n{"b": 2}\n')
    assert readers.json_lines(spark, f"{tmp_path}/lines.json").count() == 2
    (tmp_path / "words.txt").write_text("foo\n\nbar\nfoo\n two words\n")
    assert sorted(r.token for r in readers.lexicon(spark, f"{tmp_path}/words.txt").collect()) == [" two words", "bar", "foo"]
    (tmp_path / "names.txt").write_text("10\treddit/subreddits25/Abc_comments.zst\n\n7\tx_submissions.zst\n")
    assert [(r.size, r.path) for r in readers.size_path_lines(spark, f"{tmp_path}/names.txt").orderBy("line").collect()] == [("10", "reddit/subreddits25/Abc_comments.zst"), ("7", "x_submissions.zst")]
    a = readers.shuffled_corpus(spark.range(500), 50).collect()
    assert a == readers.shuffled_corpus(spark.range(500).repartition(7), 50).collect() and len({r.id for r in a}) == 50


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from neolexis.sources import scratch

    none = SimpleNamespace(get=lambda *a: None)
    session = SimpleNamespace(conf=none, sparkContext=SimpleNamespace(master="spark://h:7077", getConf=lambda: none))
    with pytest.raises(RuntimeError):
        scratch.shared_dir(session)


def test_command_line(spark, tmp_path):
    from neolexis import cli

    raw = [{"id": str(i), "subreddit": "s", "created_utc": str(1577836800 + 86400 * 31 * (i % 20)), "body": "brandnew word " * (1 + 5 * (i % 20 == 19)), "score": 1} for i in range(80)]
    (tmp_path / "raw.json").write_text("\n".join(map(json.dumps, raw)))
    (tmp_path / "records.json").write_text(json.dumps({"url": "u", "hashtags": [{"text": "t"}]}) + "\n")
    (tmp_path / "names.txt").write_text("1\tB_comments.zst\n2\ta_comments.zst\n3\tb_submissions.zst\n")
    spark.createDataFrame([("word word the",)], "text string").write.parquet(f"{tmp_path}/clean")
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"paths": {"out_dir": f"{tmp_path}/out", "raw_posts": f"{tmp_path}/raw.json", "clean_corpus": f"{tmp_path}/clean", "records": f"{tmp_path}/records.json", "names": f"{tmp_path}/names.txt"}, "params": {"min_token_count": 1, "min_period_count": 1, "min_baseline_total_tokens": 1, "min_spike_score": -1.0, "min_clean_ratio_score": 1.0, "min_baseline_periods": 1}}))
    run = lambda stage, *more: cli.main(["--config", str(config), "--stage", stage, *more], spark)
    for stage in ("clean_posts", "sample_posts", "tokens", "stats", "clean_stats", "clean_ratio", "spikes", "candidates", "combined", "occurrences", "bert_inputs", "bert_inputs_all", "scores", "bert_inputs_scored", "occurrence_scores", "plotting", "export_tokens", "export_scores", "label_counts", "distinct_tokens", "inspect_raw", "json_extract", "corpus_parts"):
        assert run(stage, "--sample-csv", "5").count() > 0, stage
    for kind in ("clean_ratio", "spiking"):
        for stage in ("occurrences", "bert_inputs", "export_tokens"):
            assert run(stage, "--candidate-type", kind, "--include-full-text").count() > 0, (kind, stage)
    assert [r.name for r in run("dedupe_names").orderBy("line").collect()] == ["b", "a"]
    assert run("tokens_subset", "--fraction", "0.5").count() > 0 and run("posts_subset", "--fraction", "0.5").count() < 80
    assert run("lookup", "--tokens-json", '["brandnew"]').count() == 1
    assert run("preview", "--table", "tokens", "--viewer", "tokens").count() == 20
    assert run("plot_scores", "--plot-dir", f"{tmp_path}/plots").count() > 0
    run("plot_candidates", "--plot-dir", f"{tmp_path}/plots")
    drawn = {p.name for p in (tmp_path / "plots").iterdir()}
    assert {"scores_subreddit.svg", "spike_profile_counts.svg", "top_clean_ratio_score.svg", "000_monthly.svg"} <= drawn
    csv = next((tmp_path / "out" / "clean_stats_csv").glob("*.csv")).read_text().splitlines()
    assert csv[0].startswith("token,count_clean") and csv[1].startswith("word,2")


def test_streaming_counts_match_batch(spark, tmp_path):
    from neolexis.streaming.monthly import rolling_counts

    posts = spark.createDataFrame([("2020-01-01 01:00:00", "s", "a b a"), ("2020-01-01 02:00:00", "s", "b"), ("2020-01-09 00:00:00", "s", "c")], "t string, subreddit string, body string").select(F.to_timestamp("t").alias("timestamp"), "subreddit", "body")
    posts.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(posts.schema).parquet(f"{tmp_path}/in")
    q = rolling_counts(stream).writeStream.outputMode("append").format("memory").queryName("rolling").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.token, r.n) for r in spark.table("rolling").collect()) == [("a", 2), ("b", 2)]
