"""What keeps the vocabulary queries from growing faster than their input, and that results stay those of the plain joins."""

import pytest
from pyspark.sql import functions as F

from neolexis.config import Params, Scope
from neolexis.operators import candidates as C
from neolexis.operators import exports as E
from neolexis.operators import posts as P
from neolexis.operators import stats as S
from neolexis.plans.engine import Engine

PARAMS = Params(min_token_count=2, min_clean_ratio_score=-50.0, spike_min_clean_ratio_score=-50.0, min_period_count=1, min_baseline_total_tokens=1, min_baseline_periods=1, min_spike_score=-50.0)


@pytest.fixture(scope="module")
def posts(spark):
    words = ["foo", "Bar", "b1z", "don't", "é-x", "İstanbul", "ΣΑΣ", "x²y", "rare{}"]
    rows = [(str(i), "st"[i % 2], f"2020-{1 + i % 5:02d}-03 00:00:00", " ".join(w.format(i) for w in words[i % 4 :]) + " foo" * (i % 3)) for i in range(40)]
    rows += [("7", "t", "2020-03-03 00:00:00", "foo again"), ("8", "s", "2020-01-03 00:00:00", ""), ("x", "s", "2020-01-03 00:00:00", "--")]
    df = spark.createDataFrame(rows, "post_id string, subreddit string, t string, body string").withColumn("timestamp", F.to_timestamp("t"))
    return df.select("post_id", "subreddit", "timestamp", F.year("timestamp").alias("year"), F.month("timestamp").alias("month"), F.date_trunc("week", "timestamp").cast("date").alias("week_start_date"), "body", F.lit(1).alias("score"))


@pytest.fixture(scope="module")
def engine(spark, posts):
    return Engine(posts, spark.createDataFrame([("bar bar foo",)], "text string"), PARAMS, pieces=5)


def exchanged(df):
    """How many shuffles a plan has before it runs."""
    return df.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


@pytest.mark.parametrize("mode", ["subreddit", "global"])
def test_statistics_are_rows_of_one_table(engine, mode):
    tokens = engine.tokens.select("subreddit", "year", "month", "token")
    base = S.monthly_base(tokens, PARAMS)
    for grain in ("monthly", "yearly", "all_time"):
        got = engine.stats(grain, mode)
        same(got, S.token_stats(base, grain, Scope(mode)))
        same(engine.stats(grain, mode, 3), got.join(engine.stats("all_time", mode).where("count_reddit >= 3").select(*Scope(mode).keys), Scope(mode).keys, "left_semi").select(*got.columns))
        assert exchanged(got) <= 1, grain  # the periods' totals, a row a community and month
        if grain != "all_time":
            ratio = S.clean_ratio(engine.stats("all_time", mode), engine.clean, Scope(mode))
            same(engine.spikes(grain, mode), S.spike_scores(got, S.broad_candidates(ratio, PARAMS, Scope(mode)), PARAMS, Scope(mode), grain))


@pytest.mark.parametrize("mode", ["subreddit", "global"])
def test_tokens_meet_a_lexicon_by_surface_forms(spark, engine, mode):
    scope, tokens = Scope(mode), engine.tokens
    every = tokens.select(*scope.join).distinct()
    for lexicon in (every.where("token > 'c'").withColumns({"n": F.length("token"), "d": F.when(F.col("token") != "foo", F.rand(1))}).localCheckpoint(), every.limit(0).withColumns({"n": F.lit(1), "d": F.lit(1.0)})):
        for how, columns in (("left", ["n", "d"]), ("inner", ["n", "d"]), ("inner", []), ("anti", [])):
            got = P.tokens_with(engine.dealt_posts, lexicon, scope, columns, how, 5)
            same(got, tokens.join(lexicon.select(*scope.join, *columns), scope.join, f"left_{how}" if how == "anti" else how))


@pytest.mark.parametrize("mode", ["subreddit", "global"])
def test_texts_and_labels_are_those_of_the_joins(spark, engine, posts, mode):
    scope = Scope(mode)
    same(engine.bert_inputs(mode), C.bert_inputs(engine.tokens, engine.combined(mode), posts, scope))
    found = C.occurrences(engine.tokens, engine.combined(mode), scope, "spiking_combined")
    same(engine.occurrences(mode), found)
    scores = engine.token_scores(mode)
    want = C.scored_bert_inputs(engine.tokens, scores, posts, scope)
    same(engine.scored_bert_inputs(mode, PARAMS), want)
    same(engine.scored_bert_inputs(mode, PARAMS, digest=True), want.withColumn("full_text_md5", F.md5("full_text")).drop("full_text"))
    same(engine.occurrence_scores(mode), C.occurrence_scores(engine.tokens, engine.ratio(mode), engine.spikes("monthly", mode), engine.spikes("yearly", mode), PARAMS, scope))
    same(scores, C.token_scores(engine.ratio(mode), engine.spikes("monthly", mode), engine.spikes("yearly", mode), PARAMS, scope))
    same(engine.scored_tokens(mode).select(*scope.join), scores.select(*scope.join))
    if mode == "global":
        same(engine.all_bert_inputs(mode), C.all_bert_inputs(engine.tokens, found, posts))
        same(engine.non_candidates(mode), C.non_candidates(engine.tokens, found))
        same(C.counted_labels(engine.labelled(mode)), C.label_counts(engine.tokens, found))


def test_a_short_list_meets_scores_without_shuffling_them(spark, tmp_path):
    spark.range(1000).select(F.format_string("t%d", "id").alias("token"), F.rand(1).alias("slang_score")).write.parquet(f"{tmp_path}/scores")
    scores, wanted = spark.read.parquet(f"{tmp_path}/scores"), spark.createDataFrame([("t7",), ("none",)], "token string")
    found = E.missing_tokens(scores, wanted)
    assert [r.token for r in found.collect()] == ["none"]
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()


def test_large_documents_are_dealt_by_size(spark, tmp_path):
    from neolexis.plans import catalog

    df = spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text"))
    df.coalesce(1).write.parquet(f"{tmp_path}/d")
    read = spark.read.parquet(f"{tmp_path}/d")
    old, catalog.PIECE = catalog.PIECE, 1 << 14
    try:
        n = catalog.pieces(read)
        assert n > 20 and catalog.spread(read, "id").rdd.getNumPartitions() == n
    finally:
        catalog.PIECE = old
