"""Token counts kept up to date as posts arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens_of


def rolling_counts(posts: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts of tokens by community and event-time window over a stream of posts (timestamp, subreddit, body)."""
    rows = posts.withWatermark("timestamp", late).select("timestamp", "subreddit", F.explode(tokens_of(F.col("body"))).alias("token"))
    counts = rows.groupBy(F.window("timestamp", window).alias("w"), "subreddit", "token").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), "subreddit", "token", "n")
