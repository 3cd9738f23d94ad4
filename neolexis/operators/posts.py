"""From raw posts to tokens and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Scope
from ..functions.text import distinct_surfaces, tokenize_with_lexicon, tokenize_with_offsets
from .ranks import global_rank

POST_COLUMNS = ["post_id", "subreddit", "timestamp", "year", "month", "week_start_date", "body", "score"]
TOKEN_KEYS = ["post_id", "subreddit", "timestamp", "year", "month", "week_start_date"]


def clean_posts(raw: DataFrame) -> DataFrame:
    """raw: id, subreddit, created_utc (seconds, any type), body, score. Rows without an id, community, valid
    time or body, and removed bodies, go. Weeks start on Mondays; the session's time zone should be UTC."""
    seconds = F.col("created_utc").cast("string").try_cast("bigint")
    rows = raw.select(F.col("id").cast("string").alias("post_id"), "subreddit", seconds.alias("created_utc"), "body", F.col("score").cast("int").alias("score"))
    rows = rows.where(F.col("post_id").isNotNull() & F.col("subreddit").isNotNull() & F.col("created_utc").isNotNull() & F.col("body").isNotNull() & ~F.col("body").isin("[deleted]", "[removed]"))
    time = F.timestamp_seconds("created_utc")
    rows = rows.withColumns({"timestamp": time, "year": F.year(time), "month": F.month(time), "week_start_date": F.date_trunc("week", time).cast("date")})
    return rows.select(*POST_COLUMNS)


def tokenize(posts: DataFrame) -> DataFrame:
    """A row for each token occurrence of each post, with code-point offsets into the body."""
    return tokenize_with_offsets(posts, "body", TOKEN_KEYS)


def dealt(posts: DataFrame, pieces: int) -> DataFrame:
    """Posts dealt by id over pieces, to be written once: also _piece, and _texts, the texts of all posts of an id that repeats."""
    same = Window.partitionBy("post_id")
    rows = posts.repartition(pieces, "post_id").withColumn("_texts", F.when(F.count("*").over(same) > 1, F.collect_list("body").over(same)))
    return rows.withColumn("_piece", F.pmod(F.hash("post_id"), F.lit(pieces))).sortWithinPartitions("_piece", "subreddit")


def texts_of_id() -> Column:
    """The texts that a join by id would give each dealt post."""
    return F.coalesce("_texts", F.array("body"))


def tokens_with(posts: DataFrame, lexicon: DataFrame, scope: Scope, columns: list[str], how: str, pieces: int, more: dict[str, Column] | None = None) -> DataFrame:
    """Tokens of dealt posts with columns of a lexicon that has each of the scope's join keys once, by `left`, `inner` or `anti` join.

    Only the surface forms of each piece, once each, are shuffled to the lexicon and back. `more`: further columns of the posts.
    """
    keys = ["_piece", "subreddit"] if scope.mode == "subreddit" else ["_piece"]
    forms = distinct_surfaces(posts, "body", keys).withColumn("token", F.lower("surface"))
    known = forms.join(lexicon.select(*scope.join, *columns), scope.join).select(*keys, "surface", *columns)
    for name, value in (more or {}).items():
        posts = posts.withColumn(name, value)
    return tokenize_with_lexicon(posts, "body", [*TOKEN_KEYS, *(more or {})], known, keys, columns, how, pieces)


def chosen(key: Column, fraction: float | Column, seed: int) -> Column:
    """Whether a key falls into a sample: by 32 bits of the MD5 of key and seed, as any engine can. It depends
    on the key alone, not on how rows are partitioned. Null keys are never chosen."""
    place = F.conv(F.substring(F.md5(F.concat_ws("|", key, F.lit(str(seed))).cast("binary")), 1, 8), 16, 10).cast("long")
    return key.isNotNull() & (place < F.lit(fraction) * F.lit(float(1 << 32)))


def sample_tokens(tokens: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """All tokens of a share of the posts of every month: a hash of the post decides, so there is no shuffle.

    Posts are told apart by id, year and month.
    """
    if not 0 < fraction <= 1:
        raise ValueError("fraction must lie in (0, 1]")
    return tokens.where(chosen(F.concat_ws("|", "post_id", "year", "month"), fraction, seed))


def posts_of(posts: DataFrame, tokens: DataFrame) -> DataFrame:
    """The posts that tokens come from."""
    return posts.join(tokens.select("post_id"), "post_id", "left_semi").select(*POST_COLUMNS)


def sample_posts_by_week(posts: DataFrame, limit: int, seed: int = 8540) -> DataFrame:
    """About limit / weeks posts of every week, and no more than `limit` in all.

    A hash of the post decides within its week. Rows beyond the limit go, those with the largest hashes of the
    whole table first, so that a rerun keeps the same rows.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    counts = posts.groupBy("week_start_date").agg(F.count("*").alias("_n"))
    weeks = counts.agg(F.greatest(F.count("*"), F.lit(1)).alias("_weeks"))
    share = counts.crossJoin(F.broadcast(weeks)).select(F.col("week_start_date").alias("_week"), F.least(F.lit(1.0), F.ceil(F.lit(limit) / F.col("_weeks")) / F.col("_n")).alias("_share"))  # one row
    picked = posts.join(share, F.col("week_start_date").eqNullSafe(F.col("_week"))).where(chosen(F.col("post_id"), F.col("_share"), seed)).select(*posts.columns)
    ranked = global_rank(picked.withColumn("_hash", F.md5(F.concat_ws("|", "post_id", F.lit(str(seed))).cast("binary"))), ["_hash", "post_id"], "_rank")
    return ranked.where(F.col("_rank") <= limit).select(*posts.columns)


def weeks(posts: DataFrame) -> DataFrame:
    """The weeks that posts are of."""
    return posts.select("week_start_date").distinct()
