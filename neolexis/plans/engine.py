"""All stages over one corpus: the small ones written once as shared tables, those of token grain lazy."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Params, Scope
from ..functions.text import tokens_of
from ..operators import candidates as C
from ..operators import stats as S
from ..operators.posts import dealt, texts_of_id, tokenize, tokens_with
from ..sources.scratch import Scratch


class Engine:
    """Stages as attributes and methods.

    Tables of distinct tokens (base, spikes, candidates) are written to the shared folder when first asked for, and
    read by every later stage: each plan stays as short as its own stage. Statistics are rows of the base; rare
    tokens, most of them, stay behind there. Occurrences of tokens are many times larger than the texts and are
    formed anew where a result needs them. `pieces` is the least number of shuffle partitions for written tables.
    """

    def __init__(self, posts: DataFrame, clean_texts: DataFrame, params: Params = Params(), lexicons: list[DataFrame] = (), pieces: int = 0):  # noqa: B008
        self.posts, self.clean_texts, self.params, self.lexicons, self.pieces = posts, clean_texts, params, list(lexicons), pieces
        self.scratch = Scratch(posts.sparkSession, pieces)
        self._tables: dict[tuple, DataFrame] = {}

    def _once(self, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
        if key not in self._tables:
            self._tables[key] = self.scratch.save(build(), "_".join(key))
        return self._tables[key]

    def forget(self) -> None:
        """Delete what was written."""
        for df in self._tables.values():
            self.scratch.drop(df)
        self._tables = {}

    @cached_property
    def tokens(self) -> DataFrame:
        return tokenize(self.posts)

    @property
    def dealt_posts(self) -> DataFrame:
        return self._once(("posts",), lambda: dealt(self.posts, self._pieces))

    @property
    def _pieces(self) -> int:
        return max(self.pieces, self.posts.sparkSession.sparkContext.defaultParallelism)

    def tokens_with(self, lexicon: Callable[[], DataFrame], mode: str, columns: list[str], how: str, keep: dict[str, Column] | None = None) -> DataFrame:
        """Tokens joined with a lexicon, which reads the dealt posts too; `keep`: more columns of the posts."""
        return tokens_with(self.dealt_posts, lexicon(), Scope(mode), columns, how, self._pieces, keep)

    def base(self, mode: str) -> DataFrame:
        def build() -> DataFrame:
            if mode == "global" and ("base", "subreddit") in self._tables:
                return S.summed_base(self.base("subreddit"), Scope(mode))
            # counting needs no offsets, so it starts from plain tokens and stays in the JVM
            plain = self._tables.get(("posts",), self.posts).select("subreddit", "year", "month", F.explode(tokens_of(F.col("body"))).alias("token"))
            return S.counted_base(plain, self.params, Scope(mode))

        return self._once(("base", mode), build)

    def totals(self, mode: str) -> DataFrame:
        return self._once(("totals", mode), lambda: S.bucket_totals(self.base(mode), Scope(mode)))

    @property
    def clean(self) -> DataFrame:
        return self._once(("clean",), lambda: S.clean_stats(self.clean_texts))

    def stats(self, grain: str, mode: str, least: int = 0) -> DataFrame:
        """Statistics of tokens counted `least` times in all: rows of the base, so they are not written again."""
        return S.counted_stats(self.base(mode), self.totals(mode), grain, Scope(mode), least)

    def ratio(self, mode: str) -> DataFrame:
        return S.clean_ratio(self.stats("all_time", mode), self.clean, Scope(mode))

    def frequent(self, mode: str) -> DataFrame:
        """The ratios that candidates and spikes are made from: of tokens counted often enough for either."""
        return self._once(("frequent", mode), lambda: S.clean_ratio(self.stats("all_time", mode, self.params.min_token_count), self.clean, Scope(mode)))

    def rare(self, mode: str) -> DataFrame:
        """The other ratios; their tokens have no spikes."""
        return self.ratio(mode).where(F.col("count_reddit") < self.params.min_token_count)

    def broad(self, mode: str) -> DataFrame:
        return S.broad_candidates(self.frequent(mode), self.params, Scope(mode))

    def spikes(self, grain: str, mode: str) -> DataFrame:
        def build() -> DataFrame:
            rows, buckets = self.stats(grain, mode, self.params.min_token_count), S.counted_buckets(self.totals(mode), grain, Scope(mode))
            return S.spike_scores(rows, self.broad(mode), self.params, Scope(mode), grain, buckets)

        return self._once(("spikes", grain, mode), build)

    def candidates(self, mode: str) -> DataFrame:
        return self._once(("candidates", mode), lambda: C.clean_ratio_candidates(self.frequent(mode), self.params, Scope(mode), self.lexicons))

    def spiking(self, grain: str, mode: str) -> DataFrame:
        return self._once(("spiking", grain, mode), lambda: C.spiking_candidates(self.candidates(mode), self.spikes(grain, mode), self.params, Scope(mode)))

    def combined(self, mode: str) -> DataFrame:
        return self._once(("combined", mode), lambda: C.combined_candidates(self.spiking("monthly", mode), self.spiking("yearly", mode), Scope(mode)))

    def of_type(self, kind: str, mode: str, grain: str | None = None) -> DataFrame:
        """Candidates of a type: clean_ratio, spiking (of a grain) or spiking_combined."""
        return self.candidates(mode) if kind == "clean_ratio" else self.spiking(grain, mode) if kind == "spiking" else self.combined(mode)

    def occurrences(self, mode: str, full_text: bool = False, kind: str = "spiking_combined", grain: str | None = None) -> DataFrame:
        self.dealt_posts  # noqa: B018 - before the candidates, which then read it
        candidates = self.of_type(kind, mode, grain)
        rows = self.tokens_with(lambda: candidates, mode, C.known_of(candidates), "inner")
        rows = C.tagged(rows, C.known_of(candidates), Scope(mode), kind, grain)
        return C.with_text(rows, self.posts) if full_text else rows

    def bert_inputs(self, mode: str, kind: str = "spiking_combined", grain: str | None = None, digest: bool = False) -> DataFrame:
        rows = self.tokens_with(lambda: self.of_type(kind, mode, grain), mode, [], "inner", _text(digest))
        return rows.withColumn("is_slang_candidate", F.lit(True)).select(*_bert(digest), "is_slang_candidate")

    def labelled(self, mode: str, keep: dict[str, Column] | None = None) -> DataFrame:
        """All tokens with whether they are combined candidates."""
        known = lambda: self.combined(mode).select(*Scope(mode).join, F.lit(True).alias("_is"))
        return self.tokens_with(known, mode, ["_is"], "left", keep).withColumn("is_slang_candidate", F.coalesce("_is", F.lit(False))).drop("_is")

    def all_bert_inputs(self, mode: str, digest: bool = False) -> DataFrame:
        return self.labelled(mode, _text(digest)).select(*_bert(digest), "is_slang_candidate")

    def scored_bert_inputs(self, mode: str, params: Params, digest: bool = False, finish: Callable[[DataFrame], DataFrame] = lambda scores: scores) -> DataFrame:
        """All tokens with their scores and texts, or the texts' MD5, which is formed once a text; `finish` is applied to the scores."""
        rows = self.tokens_with(lambda: finish(self.token_scores(mode, params)), mode, ["slang_score"], "left", _text(digest))
        return rows.select(*_bert(digest), F.coalesce("slang_score", F.lit(0.0)).alias("slang_score"))

    def non_candidates(self, mode: str) -> DataFrame:
        return self.tokens_with(lambda: self.combined(mode), mode, [], "anti").select(*C.OCCURRENCE)

    def token_scores(self, mode: str, params: Params | None = None) -> DataFrame:
        return C.token_scores(self.frequent(mode), self.spikes("monthly", mode), self.spikes("yearly", mode), params or self.params, Scope(mode), self.lexicons, self.rare(mode))

    def scored_tokens(self, mode: str) -> DataFrame:
        """The tokens that token_scores has, without their scores."""
        return C.scored_rows(self.stats("all_time", mode), self.lexicons)

    def occurrence_scores(self, mode: str, finish: Callable[[DataFrame], DataFrame] = lambda features: features) -> DataFrame:
        """`finish` is applied to the features, once a token."""

        def features() -> DataFrame:
            return finish(C.token_features(self.frequent(mode), self.spikes("monthly", mode), self.spikes("yearly", mode), self.params, Scope(mode), self.rare(mode)))

        corpus = [] if mode == "subreddit" else ["corpus"]
        rows = self.tokens_with(features, mode, [*corpus, *C.PLAIN, *C.FLAGGED, *C.ZERO], "left")
        return C.scored_occurrences(rows, Scope(mode))


def _text(digest: bool) -> dict[str, Column]:
    return {"full_text_md5": F.explode(F.transform(texts_of_id(), F.md5))} if digest else {"full_text": F.explode(texts_of_id())}


def _bert(digest: bool) -> list[str]:
    return [*C.BERT[:6], "full_text_md5" if digest else "full_text"]
