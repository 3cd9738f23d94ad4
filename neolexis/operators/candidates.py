"""Candidate sets, their occurrences and scores."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Params, Scope
from ..functions.text import is_gibberish, sigmoid
from .ranks import global_rank

FLAGS = ["is_profane", "is_typo", "is_reddit_jargon", "is_subreddit"]
METADATA = ["count_reddit_all_time", "total_tokens_all_time", "p_reddit_all_time", "count_clean", "total_clean_tokens", "p_clean", "clean_ratio_score", "has_monthly_spike", "max_spike_score_monthly", "num_spike_periods_monthly", "has_yearly_spike", "max_spike_score_yearly", "num_spike_periods_yearly", "spike_profile"]
OCCURRENCE = ["post_id", "subreddit", "timestamp", "year", "month", "week_start_date", "token", "surface", "token_start", "token_end"]


def without_lexicons(rows: DataFrame, lexicons: list[DataFrame]) -> DataFrame:
    """One anti join on the union of the word lists (column token, exact match)."""
    if not lexicons:
        return rows
    return rows.join(reduce(DataFrame.union, [x.select("token") for x in lexicons]), "token", "left_anti")


def clean_ratio_candidates(ratio: DataFrame, params: Params, scope: Scope, lexicons: list[DataFrame] = ()) -> DataFrame:
    rows = ratio.where((F.col("count_reddit") >= params.min_token_count) & (F.col("clean_ratio_score") >= params.min_clean_ratio_score))
    rows = without_lexicons(rows, list(lexicons)).where(~is_gibberish(F.col("token"), params.strict_gibberish))
    return rows.select(
        *scope.keys, F.col("count_reddit").alias("count_reddit_all_time"), F.col("total_tokens").alias("total_tokens_all_time"), F.col("p_reddit").alias("p_reddit_all_time"),
        "count_clean", "total_clean_tokens", "p_clean", "clean_ratio_score", F.lit(True).alias("is_slang_candidate_clean_ratio"), *[F.lit(False).alias(f) for f in FLAGS],
    )


def spike_evidence(spikes: DataFrame, scope: Scope, at_least: float | None = None) -> DataFrame:
    """Strongest spike of each token, and its number of spike periods."""
    rows = spikes if at_least is None else spikes.where(F.col("spike_score") >= at_least)
    return rows.groupBy(*scope.keys).agg(F.max("spike_score").alias("max_spike_score"), F.count_distinct("period_id").alias("num_spike_periods"))


def spiking_candidates(candidates: DataFrame, spikes: DataFrame, params: Params, scope: Scope) -> DataFrame:
    evidence = spike_evidence(spikes, scope, params.min_spike_score).where(F.col("num_spike_periods") >= params.min_spike_periods)
    return candidates.join(evidence, scope.keys).withColumn("is_slang_candidate_clean_ratio_spiking", F.lit(True))


def combined_candidates(monthly: DataFrame, yearly: DataFrame, scope: Scope) -> DataFrame:
    """Both grains side by side, with a spike profile: one full outer join."""
    shared = METADATA[:7]

    def side(df: DataFrame, grain: str) -> DataFrame:
        return df.select(*scope.keys, *[F.col(c).alias(f"{c}_{grain}") for c in [*shared, "max_spike_score", "num_spike_periods"]])

    both = side(monthly, "monthly").join(side(yearly, "yearly"), scope.keys, "full_outer")
    has_m, has_y = F.col("max_spike_score_monthly").isNotNull(), F.col("max_spike_score_yearly").isNotNull()
    profile = F.when(has_m & has_y, "both").when(has_m, "monthly_only").when(has_y, "yearly_only").otherwise("none")
    return both.select(
        *scope.keys, *[F.coalesce(f"{c}_monthly", f"{c}_yearly").alias(c) for c in shared], has_m.alias("has_monthly_spike"), "max_spike_score_monthly", "num_spike_periods_monthly",
        has_y.alias("has_yearly_spike"), "max_spike_score_yearly", "num_spike_periods_yearly", profile.alias("spike_profile"), F.lit(True).alias("is_slang_candidate_clean_ratio_spiking_combined"),
    )


def known_of(candidates: DataFrame) -> list[str]:
    return [c for c in [*METADATA[:7], "max_spike_score", "num_spike_periods", *METADATA[7:]] if c in candidates.columns]


def occurrences(tokens: DataFrame, candidates: DataFrame, scope: Scope, kind: str, grain: str | None = None, posts: DataFrame | None = None) -> DataFrame:
    """Occurrences of candidates with what is known of them; with posts also their full text.

    The candidate side is a lexicon; whether it is broadcast is left to its size. Of repeated candidates one
    row counts; repeated posts repeat their occurrences.
    """
    meta = known_of(candidates)
    rows = tagged(tokens.join(candidates.select(*scope.join, *meta).distinct(), scope.join), meta, scope, kind, grain)
    return rows if posts is None else with_text(rows, posts)


def tagged(rows: DataFrame, meta: list[str], scope: Scope, kind: str, grain: str | None) -> DataFrame:
    tags = [F.lit(True).alias("is_slang_candidate"), F.lit(kind).alias("candidate_type"), F.lit(scope.mode).alias("candidate_mode")]
    if kind != "spiking_combined":
        tags.append(F.lit(grain).cast("string").alias("spike_time_grain"))
    return rows.select(*OCCURRENCE, *tags, *meta)


def with_text(rows: DataFrame, posts: DataFrame) -> DataFrame:
    return rows.join(posts.select("post_id", F.col("body").alias("full_text")), "post_id", "left")


BERT = ["post_id", "subreddit", "timestamp", "token", "token_start", "token_end", "full_text", "is_slang_candidate"]


def bert_inputs(tokens: DataFrame, candidates: DataFrame, posts: DataFrame, scope: Scope) -> DataFrame:
    """Occurrences of candidates with the text around them: a semi join, then the posts."""
    return with_text(tokens.join(candidates.select(*scope.join), scope.join, "left_semi"), posts).withColumn("is_slang_candidate", F.lit(True)).select(*BERT)


PLACE = ["post_id", "token", "token_start", "token_end"]


def labelled_tokens(tokens: DataFrame, found: DataFrame) -> DataFrame:
    """All occurrences with whether they are among the found ones (by post, token and offsets)."""
    known = found.select(*PLACE, F.lit(True).alias("_is")).distinct()
    return tokens.join(known, PLACE, "left").withColumn("is_slang_candidate", F.coalesce("_is", F.lit(False))).drop("_is")


def all_bert_inputs(tokens: DataFrame, found: DataFrame, posts: DataFrame) -> DataFrame:
    return with_text(labelled_tokens(tokens, found), posts).select(*BERT)


def scored_bert_inputs(tokens: DataFrame, scores: DataFrame, posts: DataFrame, scope: Scope) -> DataFrame:
    rows = with_text(tokens.join(scores.select(*scope.join, "slang_score"), scope.join, "left"), posts)
    return rows.select(*BERT[:-1], F.coalesce("slang_score", F.lit(0.0)).alias("slang_score"))


def non_candidates(tokens: DataFrame, found: DataFrame) -> DataFrame:
    return tokens.join(found.select(*PLACE), PLACE, "left_anti")


def label_counts(tokens: DataFrame, found: DataFrame) -> DataFrame:
    """Number of candidate and other occurrences; both labels are always there."""
    return counted_labels(labelled_tokens(tokens, found))


def counted_labels(labelled: DataFrame) -> DataFrame:
    counts = labelled.groupBy("is_slang_candidate").agg(F.count("*").alias("n"))
    both = labelled.sparkSession.range(2).select((F.col("id") == 1).alias("is_slang_candidate"))
    return both.join(counts, "is_slang_candidate", "left").select("is_slang_candidate", F.coalesce("n", F.lit(0)).alias("occurrences"))


def _components(params: Params, monthly: str, yearly: str) -> dict:
    at = lambda c: F.coalesce(c, F.lit(0.0))
    return {
        "clean_component": sigmoid((F.col("clean_ratio_score") - params.clean_ratio_c) / params.clean_ratio_s),
        "monthly_component": sigmoid((at(monthly) - params.spike_monthly_c) / params.spike_monthly_s),
        "yearly_component": sigmoid((at(yearly) - params.spike_yearly_c) / params.spike_yearly_s),
    }


def _with_spikes(rows: DataFrame, monthly: DataFrame, yearly: DataFrame, scope: Scope) -> DataFrame:
    for grain, spikes in (("monthly", monthly), ("yearly", yearly)):
        found = spike_evidence(spikes, scope)
        rows = rows.join(found.select(*scope.keys, F.col("max_spike_score").alias(f"max_spike_score_{grain}"), F.col("num_spike_periods").alias(f"num_spike_periods_{grain}")), scope.keys, "left")
    return rows


def token_features(ratio: DataFrame, monthly: DataFrame, yearly: DataFrame, params: Params, scope: Scope, rare: DataFrame | None = None) -> DataFrame:
    """The features and score of every token. Rows of `rare` are further ratios, of tokens without spikes."""
    def needed(rows: DataFrame) -> DataFrame:
        return rows.select(*scope.keys, F.col("count_reddit").alias("count_reddit_all_time"), F.col("total_tokens").alias("total_tokens_all_time"), F.col("p_reddit").alias("p_reddit_all_time"), "count_clean", "total_clean_tokens", "p_clean", "clean_ratio_score")

    rows = _with_spikes(needed(ratio), monthly, yearly, scope)
    if rare is not None:
        rows = rows.unionByName(needed(rare), allowMissingColumns=True)
    rows = rows.withColumns({"has_monthly_spike": F.col("max_spike_score_monthly").isNotNull(), "has_yearly_spike": F.col("max_spike_score_yearly").isNotNull()} | _components(params, "max_spike_score_monthly", "max_spike_score_yearly"))
    rows = rows.withColumn("spike_boost", F.greatest("monthly_component", "yearly_component")).withColumn("reliability", F.least(F.lit(1.0), F.log1p("count_reddit_all_time") / math.log1p(100)))
    return rows.withColumn("slang_score", F.col("reliability") * F.col("clean_component") * (0.4 + 0.6 * F.col("spike_boost")))


#: Features by their order in a result: these are null where a token has none, the others false or 0.
PLAIN = [c for c in METADATA[:13] if not c.startswith("has_")]
FLAGGED = ["has_monthly_spike", "has_yearly_spike"]
ZERO = ["clean_component", "monthly_component", "yearly_component", "spike_boost", "reliability", "slang_score"]


def scored_occurrences(rows: DataFrame, scope: Scope) -> DataFrame:
    """Occurrences left joined with token_features, in the result's form; tokens without features score 0."""
    corpus = [] if scope.mode == "subreddit" else ["corpus"]
    out = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in FLAGGED} | {c: F.coalesce(c, F.lit(0.0)) for c in ZERO})
    return out.select(*OCCURRENCE, *corpus, *PLAIN, *FLAGGED, *ZERO)


def occurrence_scores(tokens: DataFrame, ratio: DataFrame, monthly: DataFrame, yearly: DataFrame, params: Params, scope: Scope) -> DataFrame:
    """Every occurrence with its token's features and score; tokens without features score 0."""
    return scored_occurrences(tokens.join(token_features(ratio, monthly, yearly, params, scope), scope.join, "left"), scope)


def scored_rows(rows: DataFrame, lexicons: list[DataFrame]) -> DataFrame:
    """Rows whose tokens get a score."""
    return without_lexicons(rows, list(lexicons)).where(~is_gibberish(F.col("token"), laughter=True))


def token_scores(ratio: DataFrame, monthly: DataFrame, yearly: DataFrame, params: Params, scope: Scope, lexicons: list[DataFrame] = (), rare: DataFrame | None = None) -> DataFrame:
    """[subreddit,] token, slang_score in [0, 1], rescaled by rank over all tokens if rank_top_k is set.

    Rows of `rare` are further ratios, of tokens without spikes: they need not meet the spikes.
    """
    needed = [*scope.keys, F.col("count_reddit").alias("count_reddit_all_time"), "clean_ratio_score"]
    rows = _with_spikes(scored_rows(ratio.select(*needed), lexicons), monthly, yearly, scope)
    if rare is not None:
        rows = rows.unionByName(scored_rows(rare.select(*needed), lexicons), allowMissingColumns=True)
    rows = rows.withColumns(_components(params, "max_spike_score_monthly", "max_spike_score_yearly"))
    boost = F.greatest("monthly_component", "yearly_component")
    reliability = F.least(F.lit(1.0), F.log1p("count_reddit_all_time") / math.log(params.reliability_log))
    w = params.spike_boost_weight
    raw = reliability * F.col("clean_component") * ((1.0 - w) + w * boost)
    # ranked by rounded scores: those equal but for the last bits tie, and ranks don't depend on the platform
    score = F.pow(raw, F.lit(params.power_transform))
    if not params.rank_top_k:
        return rows.select(*scope.join, score.alias("slang_score"))
    rows = rows.select(*scope.join, F.round(score, 12).alias("power"))
    ranked = global_rank(rows, [F.desc("power"), *scope.join], "rank")
    k, floor = params.rank_top_k, params.rank_top_k_floor
    top = floor + (1.0 - floor) * (1.0 - (F.col("rank") - 1) / float(max(k - 1, 1)))
    tail = floor * F.exp(-params.tail_decay * (F.col("rank") - k))
    return ranked.select(*scope.join, F.when(F.col("rank") <= k, top).otherwise(tail).alias("slang_score"))
