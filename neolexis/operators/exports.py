"""Lookups, exports and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TIME, Scope
from .candidates import METADATA

SPIKE_COLUMNS = ["baseline_count_reddit", "baseline_total_tokens", "baseline_periods", "p_baseline", "p_current_smoothed", "p_baseline_smoothed", "spike_score"]


def with_columns_in_order(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns in order; missing ones are null."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns])


def prefixed(df: DataFrame, prefix: str, columns: list[str] = SPIKE_COLUMNS) -> list[Column]:
    return [F.col(c).alias(f"{prefix}_{c}") for c in columns if c in df.columns]


def plotting_rows(combined: DataFrame, stats: dict[str, DataFrame], spikes: dict[str, DataFrame], scope: Scope) -> DataFrame:
    """Every period row of the combined candidates, monthly and yearly, with spike columns where there are any."""
    meta = [c for c in METADATA if c in combined.columns]
    known = combined.select(*scope.keys, *meta).distinct()
    out = None
    for grain in ("monthly", "yearly"):
        keys = [*scope.keys, *TIME[grain]]
        spike = spikes[grain].select(*keys, "period_id", *prefixed(spikes[grain], grain))
        rows = stats[grain].join(known, scope.keys).join(spike, keys, "left").withColumn("time_grain", F.lit(grain))
        rows = rows if grain == "monthly" else rows.withColumn("month", F.lit(None).cast("int"))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    spiky = [f"{g}_{c}" for g in ("monthly", "yearly") for c in SPIKE_COLUMNS]
    return with_columns_in_order(out, [*scope.keys, "time_grain", "year", "month", "period_id", "count_reddit", "total_tokens", "p_reddit", *meta, *spiky])


def candidate_tokens(candidates: DataFrame) -> DataFrame:
    return candidates.select("token").distinct()


def lookup(scores: DataFrame, tokens: list[str], subreddit: str | None = None) -> DataFrame:
    """Scores of given tokens, best first; the list reaches the scan as a filter."""
    rows = scores.where(F.col("token").isin(tokens))
    community = "subreddit" in scores.columns
    if subreddit is not None:
        if not community:
            raise ValueError("global scores have no community")
        rows = rows.where(F.col("subreddit") == subreddit)
    return rows.orderBy(*(["token", F.desc("slang_score"), "subreddit"] if community else ["token", F.desc("slang_score")]))


def missing_tokens(scores: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted tokens that have no score. The list meets the scores first, so that they aren't shuffled for a short one."""
    found = scores.select("token").join(wanted.select("token"), "token", "left_semi").distinct()
    return wanted.join(found, "token", "left_anti")


#: Columns that order rows which tie in a preview's own columns.
_TIES = ["token", "subreddit", "corpus", "year", "month", "post_id", "token_start"]


def preview(df: DataFrame, sort: list[tuple[str, bool]] = (), limit: int = 20) -> DataFrame:
    """First rows by (column, falling) pairs, nulls last; columns that aren't there are skipped."""
    order = [F.desc_nulls_last(c) if falling else F.asc_nulls_last(c) for c, falling in sort if c in df.columns]
    ties = [F.asc_nulls_last(c) for c in _TIES if c in df.columns and c not in {c for c, _ in sort}]
    return (df.orderBy(*order, *ties) if order else df).limit(limit)


#: Named orders of each viewer; fixed values.
PREVIEWS: dict[str, dict[str, list[tuple[str, bool]]]] = {
    "clean_posts": {"default": [("timestamp", False), ("post_id", False)]},
    "tokens": {"default": [("timestamp", False), ("post_id", False), ("token_start", False)]},
    "clean_stats": {"default": [("count_clean", True)]},
    "stats": {"default": [("count_reddit", True), ("p_reddit", True)], "probability": [("p_reddit", True), ("count_reddit", True)], "time": [("year", False), ("month", False), ("count_reddit", True)]},
    "clean_ratio": {"default": [("clean_ratio_score", True), ("count_reddit", True)]},
    "spikes": {"default": [("spike_score", True), ("count_reddit", True)], "time": [("year", False), ("month", False), ("spike_score", True)], "count": [("count_reddit", True), ("spike_score", True)]},
    "candidates": {"default": [("clean_ratio_score", True), ("count_reddit_all_time", True)], "spike": [("max_spike_score", True), ("clean_ratio_score", True)], "count": [("count_reddit_all_time", True), ("clean_ratio_score", True)]},
    "combined": {
        "default": [("clean_ratio_score", True), ("count_reddit_all_time", True)], "monthly_spike": [("max_spike_score_monthly", True), ("clean_ratio_score", True)], "yearly_spike": [("max_spike_score_yearly", True), ("clean_ratio_score", True)],
        "count": [("count_reddit_all_time", True), ("clean_ratio_score", True)], "profile": [("has_monthly_spike", True), ("has_yearly_spike", True), ("clean_ratio_score", True)],
    },
    "occurrences": {"default": [("timestamp", False), ("post_id", False), ("token_start", False)], "ratio": [("clean_ratio_score", True), ("timestamp", False)], "spike": [("max_spike_score", True), ("clean_ratio_score", True), ("timestamp", False)]},
    "bert_inputs": {"default": [("timestamp", False), ("token", False)], "token": [("token", False), ("timestamp", False)], "subreddit": [("subreddit", False), ("timestamp", False), ("token", False)]},
    "token_scores": {"default": [("slang_score", True), ("token", False)], "token": [("token", False), ("slang_score", True)], "subreddit": [("subreddit", False), ("slang_score", True), ("token", False)]},
}


def score_histogram(scores: DataFrame, bins: int = 50) -> DataFrame:
    """Counts of scores in equal bins over [0, 1], the last one closed; others and NaN are left out."""
    s = F.col("slang_score")
    ok = scores.where(s.isNotNull() & ~F.isnan(s) & (s >= 0) & (s <= 1))
    return ok.groupBy(F.least(F.floor(s * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def profile_counts(combined: DataFrame) -> DataFrame:
    return combined.groupBy("spike_profile").agg(F.count("*").alias("n"))


METRICS = ["clean_ratio_score", "max_spike_score_monthly", "max_spike_score_yearly"]


def unique_candidates(rows: DataFrame, scope: Scope) -> DataFrame:
    """Of plotting rows, the candidates: a row each of the scope's keys."""
    return rows.select(*scope.keys, *[c for c in METADATA if c in rows.columns]).distinct()


def _falling(df: DataFrame) -> list[Column]:
    return [*(F.desc_nulls_last(m) for m in METRICS), *(F.asc_nulls_last(c) for c in ("token", "subreddit", "corpus") if c in df.columns)]


def candidate_summary(candidates: DataFrame, top_n: int = 20) -> DataFrame:
    """The best 5 * top_n candidates by ratio, then monthly, then yearly spike; nulls last."""
    return candidates.orderBy(*_falling(candidates)).limit(5 * top_n)


def top_tokens(candidates: DataFrame, metric: str, n: int = 20) -> DataFrame:
    """The best n candidates (token, metric) by one metric; those without it are left out."""
    some = candidates.where(F.col(metric).isNotNull() & ~F.isnan(metric))
    ties = [F.asc_nulls_last(c) for c in ("token", "subreddit", "corpus") if c in some.columns]
    return some.orderBy(F.desc(metric), *ties).limit(n).select("token", metric)


def auto_tokens(candidates: DataFrame, n: int = 10) -> DataFrame:
    """The first n distinct tokens in the order of candidate_summary; each token stands where its best row does."""
    best = candidates.groupBy("token").agg(F.max(F.struct(*[F.coalesce(m, F.lit(float("-inf"))).alias(m) for m in METRICS])).alias("_best"))
    return best.orderBy(F.desc("_best"), "token").limit(n).select("token")


def plot_dates(rows: DataFrame) -> DataFrame:
    """Plotting rows with plot_date: the first day of their month, or of their year."""
    return rows.withColumn("plot_date", F.make_date("year", F.coalesce(F.when(F.col("time_grain") == "monthly", F.col("month")), F.lit(1)), F.lit(1)))


def token_series(rows: DataFrame, token: str, grain: str) -> DataFrame:
    """One token's rows of a grain in time order, for its panels."""
    kept = ["plot_date", "count_reddit", "p_reddit", *(f"{grain}_{c}" for c in ("spike_score", "p_baseline", "p_current_smoothed"))]
    one = plot_dates(rows).where((F.col("token") == token) & (F.col("time_grain") == grain))
    keys = [c for c in ("subreddit", "corpus") if c in one.columns]
    return one.orderBy("plot_date", *keys).select(*keys, *kept)


def score_rows(scores: DataFrame) -> DataFrame:
    """What the score histogram is drawn from."""
    return scores.select("slang_score")


def distinct_tokens(tokens: DataFrame) -> DataFrame:
    return tokens.agg(F.count_distinct("token").alias("distinct_tokens"))
