"""Token frequencies by community and period, of the clean corpus, and their ratio."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import TIME, Params, Scope
from ..functions.text import is_candidate, tokens_of
from ..sources.scratch import Scratch

CORPUS = "reddit"


def monthly_base(tokens: DataFrame, params: Params) -> DataFrame:
    """subreddit, year, month, token, n (all tokens), candidate: the one shuffle of token occurrences.

    Every grain and scope is summed up from this table, so it should be written once. Only distinct tokens meet
    the candidate patterns.
    """
    base = tokens.groupBy("subreddit", "year", "month", "token").agg(F.count("*").alias("n"))
    return base.withColumn("candidate", is_candidate(F.col("token"), params.min_len, allow_numbers=params.allow_numbers))


def counted_base(tokens: DataFrame, params: Params, scope: Scope) -> DataFrame:
    """entity, year, month, token, n, and n_year, n_all: the token's count in that year and in all.

    first_of_year and first_of_all mark one row each for these, so that statistics of a community are filters of this
    table at every grain, and rare tokens are left out before anything else is shuffled. Tokens that can't be
    candidates are counted together, as '' (`candidate` is false), since only the totals have them.
    """
    form = is_candidate(F.col("token"), params.min_len, allow_numbers=params.allow_numbers)
    keys = ["token"] if scope.mode == "global" else scope.keys
    rows = tokens.select(*keys[:-1], "year", "month", F.when(form, F.col("token")).otherwise("").alias("token"))
    return _counted(rows.groupBy(*keys, "year", "month").agg(F.count("*").alias("n")), keys, scope)


def summed_base(base: DataFrame, scope: Scope) -> DataFrame:
    """The counted base of the whole corpus, from that of its communities."""
    return _counted(base.groupBy("token", "year", "month").agg(F.sum("n").alias("n")), ["token"], scope)


def _counted(rows: DataFrame, keys: list[str], scope: Scope) -> DataFrame:
    # at most a row a month in each of these, and one order for both
    whole = Window.partitionBy(*keys).orderBy("year", "month")
    year = Window.partitionBy(*keys, "year").orderBy("month")
    every = (Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"n_all": F.sum("n").over(whole.rowsBetween(*every)), "first_of_all": F.row_number().over(whole) == 1})
    rows = rows.withColumns({"n_year": F.sum("n").over(year.rowsBetween(*every)), "first_of_year": F.row_number().over(year) == 1})
    entity = F.col("subreddit") if scope.mode == "subreddit" else F.lit(CORPUS).alias("corpus")
    return rows.select(entity, "year", "month", "token", "n", "n_year", "n_all", "first_of_year", "first_of_all", (F.col("token") != "").alias("candidate"))


def bucket_totals(base: DataFrame, scope: Scope) -> DataFrame:
    """entity, year, month, total_tokens, candidate (whether it has any): a row for each entity and month."""
    return base.groupBy(scope.entity, "year", "month").agg(F.sum("n").alias("total_tokens"), F.max("candidate").alias("candidate"))


def counted_stats(base: DataFrame, totals: DataFrame, grain: str, scope: Scope, least: int = 0) -> DataFrame:
    """token_stats from a counted base and its bucket totals, of tokens that are counted `least` times in all: no shuffle."""
    n, first = {"monthly": ("n", F.lit(True)), "yearly": ("n_year", F.col("first_of_year")), "all_time": ("n_all", F.col("first_of_all"))}[grain]
    bucket = [scope.entity, *TIME[grain]]
    rows = base.where(F.col("candidate") & first & (F.col("n_all") >= least)).select(*bucket, "token", F.col(n).alias("count_reddit"))
    small = totals.groupBy(*bucket).agg(F.sum("total_tokens").alias("total_tokens"))
    return rows.join(small, bucket).select(*bucket, "token", "count_reddit", "total_tokens", (F.col("count_reddit") / F.col("total_tokens")).alias("p_reddit"))


def counted_buckets(totals: DataFrame, grain: str, scope: Scope) -> DataFrame:
    """entity, period, _t: totals of the periods in which an entity has candidate tokens, as spike_scores reads them from statistics."""
    rows = totals.groupBy(scope.entity, *TIME[grain]).agg(F.sum("total_tokens").alias("_t"), F.max("candidate").alias("_any"))
    return rows.where("_any").drop("_any")


def period_totals(base: DataFrame) -> DataFrame:
    """subreddit, year, month, total_tokens: all tokens, candidates or not; a row for each community and month."""
    return base.groupBy("subreddit", "year", "month").agg(F.sum("n").alias("total_tokens"))


def token_stats(base: DataFrame, grain: str, scope: Scope, totals: DataFrame | None = None) -> DataFrame:
    """entity, period, token, count_reddit, total_tokens, p_reddit.

    Counts are of candidate tokens, totals of all tokens. The totals are sums of `totals` (period_totals of the
    base; give a written one to keep it from being formed anew), a table of one row for each bucket. The base has
    a row for each community, month and token, so at that grain nothing is summed.
    """
    rows, small = (df if scope.mode == "subreddit" else df.withColumn("corpus", F.lit(CORPUS)) for df in (base, period_totals(base) if totals is None else totals))
    bucket = [scope.entity, *TIME[grain]]
    counts = rows.where("candidate")
    if scope.mode == "subreddit" and grain == "monthly":
        counts = counts.select(*bucket, "token", F.col("n").alias("count_reddit"))
    else:
        counts = counts.groupBy(*bucket, "token").agg(F.sum("n").alias("count_reddit"))
    small = small.groupBy(*bucket).agg(F.sum("total_tokens").alias("total_tokens"))
    return counts.join(small, bucket).select(*bucket, "token", "count_reddit", "total_tokens", (F.col("count_reddit") / F.col("total_tokens")).alias("p_reddit"))


def clean_stats(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """token, count_clean, total_clean_tokens, p_clean of a reference corpus; all tokens count."""
    counts = texts.select(F.explode(tokens_of(F.col(text_col))).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("count_clean"))
    total = counts.agg(F.sum("count_clean").alias("total_clean_tokens"))
    return counts.crossJoin(F.broadcast(total)).withColumn("p_clean", F.col("count_clean") / F.col("total_clean_tokens"))  # one row


def clean_ratio(all_time: DataFrame, clean: DataFrame, scope: Scope) -> DataFrame:
    """Log ratio of a token's frequency to that in the clean corpus; 1e-12 stands for absence there."""
    rows = all_time.join(clean, "token", "left").withColumn("clean_ratio_score", F.log(F.col("p_reddit") / F.coalesce("p_clean", F.lit(1e-12))))
    return rows.select("token", scope.entity, "count_reddit", "total_tokens", "p_reddit", "count_clean", "total_clean_tokens", "p_clean", "clean_ratio_score")


def broad_candidates(ratio: DataFrame, params: Params, scope: Scope) -> DataFrame:
    """Tokens worth a spike score: counted often enough, and not rarer than in the clean corpus."""
    rows = ratio.where((F.col("count_reddit") >= params.min_token_count) & (F.col("clean_ratio_score") >= params.spike_min_clean_ratio_score))
    return rows.select(*scope.keys, F.col("count_reddit").alias("count_reddit_all_time"), F.col("p_reddit").alias("p_reddit_all_time"), "p_clean", "clean_ratio_score")


def period_id(grain: str):
    year = F.col("year").cast("string")
    return F.concat_ws("-", year, F.lpad(F.col("month").cast("string"), 2, "0")) if grain == "monthly" else year


def spike_scores(stats: DataFrame, candidates: DataFrame, params: Params, scope: Scope, grain: str, buckets: DataFrame | None = None) -> DataFrame:
    """Log ratio of a token's smoothed frequency in a period to that over the previous periods.

    Previous periods are the last `window` observed anywhere in stats; in those a token without a row counts 0,
    and an entity without rows has a total of 0. A dense token x period grid would say that directly. Here only
    rows that exist are touched: periods are numbered once (a row a month or year, the only window without a
    partition), and entity totals and token counts are summed by range frames over period numbers.
    A period count of at least 1 is needed for that, since only periods with a row can score. With `buckets` (entity,
    period, _t) for the totals, stats needs only the candidates' rows.
    """
    if params.min_period_count < 1:
        raise ValueError("min_period_count must be at least 1")
    time, n = TIME[grain], params.window(grain)
    buckets = stats.groupBy(scope.entity, *time).agg(F.max("total_tokens").alias("_t")) if buckets is None else buckets
    numbered = buckets.select(*time).distinct().withColumn("_at", F.row_number().over(Window.orderBy(*time)))
    before = Window.partitionBy(scope.entity).orderBy("_at").rangeBetween(-n, -1)
    totals = buckets.join(numbered, time).select(scope.entity, *time, "_at", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("baseline_total_tokens"), F.coalesce(F.sum((F.col("_t") > 0).cast("long")).over(before), F.lit(0)).alias("baseline_periods"))
    # written: by its size on disk Spark sees whether it can be broadcast
    totals = Scratch(stats.sparkSession).save(totals, "totals")
    rows = stats.join(candidates, scope.keys).join(totals, [scope.entity, *time])
    same = Window.partitionBy(*scope.keys).orderBy("_at").rangeBetween(-n, -1)
    rows = rows.withColumn("baseline_count_reddit", F.coalesce(F.sum("count_reddit").over(same), F.lit(0)))
    rows = rows.where((F.col("baseline_periods") >= params.min_baseline_periods) & (F.col("count_reddit") >= params.min_period_count) & (F.col("baseline_total_tokens") >= params.min_baseline_total_tokens))
    a = F.lit(float(params.smoothing_alpha))
    rows = rows.withColumns({
        "period_id": period_id(grain),
        "p_baseline": F.when(F.col("baseline_total_tokens") > 0, F.col("baseline_count_reddit") / F.col("baseline_total_tokens")).otherwise(0.0),
        "p_current_smoothed": (F.col("count_reddit") + a) / (F.col("total_tokens") + a),
        "p_baseline_smoothed": (F.col("baseline_count_reddit") + a) / (F.col("baseline_total_tokens") + a),
    })
    rows = rows.withColumn("spike_score", F.log(F.col("p_current_smoothed") / F.col("p_baseline_smoothed"))).withColumn("time_grain", F.lit(grain))
    return rows.select(
        scope.entity, *time, "token", "count_reddit", "total_tokens", "count_reddit_all_time", "p_reddit_all_time", "p_clean", "clean_ratio_score", "p_reddit", "period_id",
        "baseline_count_reddit", "baseline_total_tokens", "baseline_periods", "p_baseline", "p_current_smoothed", "p_baseline_smoothed", "spike_score", "time_grain",
    )
