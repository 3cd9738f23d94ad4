"""Command line: runs one stage on tables below an output folder.

    python -m neolexis.cli --config config.json --stage spikes --mode subreddit --time-grain monthly
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Params, Scope, fraction_label, load_params
from .operators import candidates as C
from .operators import exports as X
from .operators import posts as P
from .operators import records as R
from .operators import stats as S
from .session import session
from .sources import plots, readers, writers

TYPES = ("clean_ratio", "spiking", "spiking_combined")
STAGES: dict[str, Callable[[Run], DataFrame | None]] = {}


def stage(f: Callable[[Run], DataFrame | None]) -> Callable[[Run], DataFrame | None]:
    STAGES[f.__name__] = f
    return f


class Run:
    """What a stage needs: arguments, parameters, folders, tables."""

    def __init__(self, args: argparse.Namespace, spark: SparkSession):
        self.args, self.spark, self.scope = args, spark, Scope(args.mode)
        self.params = load_params(args.config, **vars(args))
        with open(args.config, encoding="utf-8") as f:
            self.paths = json.load(f).get("paths", {})
        self.out, self.mode = self.paths["out_dir"], args.mode
        self.grains = ("monthly", "yearly") if args.time_grain == "both" else (args.time_grain,)
        self.label = fraction_label(args.fraction)

    def read(self, name: str) -> DataFrame:
        return readers.table(self.spark, self.out, name)

    def write(self, df: DataFrame, name: str, sort: list | None = None) -> DataFrame:
        """Write a table; with --sample-csv also its first rows (in the order given) as CSV."""
        done = self.spark.read.parquet(writers.write_table(df, self.out, name))
        if self.args.sample_csv:
            writers.write_csv(done.select(*[F.col(c) for c, t in done.dtypes if not t.startswith("array")]), f"{self.out}/{name}_csv", sort or [], self.args.sample_csv)
        return done

    def tokens(self) -> DataFrame:
        return self.read(f"tokens_subset_{self.label}" if self.args.subset else "tokens")

    def lexicons(self) -> list[DataFrame]:
        return [readers.lexicon(self.spark, x) for x in self.paths.get("lexicons", [])]

    def spikes(self) -> tuple[DataFrame, DataFrame]:
        return self.read(f"spikes_monthly_{self.mode}"), self.read(f"spikes_yearly_{self.mode}")

    def tag(self) -> str:
        """What the tables of a candidate type are called."""
        a = self.args
        return {"clean_ratio": "", "spiking": f"_spiking_{a.spike_time_grain}", "spiking_combined": "_combined"}[a.candidate_type] + f"_{self.mode}"


@stage
def clean_posts(r: Run) -> DataFrame:
    raw = readers.zstd_posts(r.spark, r.paths["raw_posts"]) if r.paths["raw_posts"].endswith(".zst") else readers.raw_posts(r.spark, r.paths["raw_posts"], None if r.args.infer_schema else readers.RAW)
    return r.write(P.clean_posts(raw), "clean_posts")


@stage
def sample_posts(r: Run) -> DataFrame:
    """A weekly sample of the posts with its weeks."""
    done = r.write(P.sample_posts_by_week(r.read("clean_posts"), r.args.post_limit), "clean_posts_sample")
    writers.write_csv(P.weeks(done), f"{r.out}/weeks_csv", ["week_start_date"])
    writers.write_csv(done, f"{r.out}/clean_posts_sample_csv", limit=100)
    return done


@stage
def tokens(r: Run) -> DataFrame:
    return r.write(P.tokenize(r.read("clean_posts")), "tokens")


@stage
def tokens_subset(r: Run) -> DataFrame:
    return r.write(P.sample_tokens(r.read("tokens"), r.args.fraction, r.args.seed), f"tokens_subset_{r.label}")


@stage
def posts_subset(r: Run) -> DataFrame:
    return r.write(P.posts_of(r.read("clean_posts"), r.read(f"tokens_subset_{r.label}")), f"clean_posts_subset_{r.label}")


@stage
def stats(r: Run) -> DataFrame:
    base = r.write(S.monthly_base(r.tokens(), r.params), "monthly_base")
    totals = r.write(S.period_totals(base), "period_totals")
    for grain in ("monthly", "yearly", "all_time"):
        done = r.write(S.token_stats(base, grain, r.scope, totals), f"stats_{grain}_{r.mode}")
    return done


@stage
def clean_stats(r: Run) -> DataFrame:
    return r.write(S.clean_stats(r.spark.read.parquet(r.paths["clean_corpus"])), "clean_stats", [F.desc("count_clean"), "token"])


@stage
def clean_ratio(r: Run) -> DataFrame:
    return r.write(S.clean_ratio(r.read(f"stats_all_time_{r.mode}"), r.read("clean_stats"), r.scope), f"clean_ratio_{r.mode}", [F.desc("clean_ratio_score"), "token"])


@stage
def spikes(r: Run) -> DataFrame:
    broad = S.broad_candidates(r.read(f"clean_ratio_{r.mode}"), r.params, r.scope)
    for grain in r.grains:
        done = r.write(S.spike_scores(r.read(f"stats_{grain}_{r.mode}"), broad, r.params, r.scope, grain), f"spikes_{grain}_{r.mode}", [F.desc("spike_score"), "token"])
    return done


@stage
def candidates(r: Run) -> DataFrame:
    known = r.write(C.clean_ratio_candidates(r.read(f"clean_ratio_{r.mode}"), r.params, r.scope, r.lexicons()), f"candidates_{r.mode}", [F.desc("clean_ratio_score"), "token"])
    for grain in r.grains:
        done = r.write(C.spiking_candidates(known, r.read(f"spikes_{grain}_{r.mode}"), r.params, r.scope), f"candidates_spiking_{grain}_{r.mode}", [F.desc("max_spike_score"), F.desc("clean_ratio_score"), "token"])
    return done


@stage
def combined(r: Run) -> DataFrame:
    return r.write(C.combined_candidates(r.read(f"candidates_spiking_monthly_{r.mode}"), r.read(f"candidates_spiking_yearly_{r.mode}"), r.scope), f"candidates_combined_{r.mode}", [F.desc("clean_ratio_score"), "token"])


@stage
def occurrences(r: Run) -> DataFrame:
    a = r.args
    texts = r.read("clean_posts") if a.include_full_text else None
    return r.write(C.occurrences(r.tokens(), r.read(f"candidates{r.tag()}"), r.scope, a.candidate_type, a.spike_time_grain if a.candidate_type == "spiking" else None, posts=texts), f"occurrences{r.tag()}")


@stage
def bert_inputs(r: Run) -> DataFrame:
    return r.write(C.bert_inputs(r.tokens(), r.read(f"candidates{r.tag()}"), r.read("clean_posts"), r.scope), f"bert_inputs{r.tag()}")


@stage
def bert_inputs_all(r: Run) -> DataFrame:
    return r.write(C.all_bert_inputs(r.tokens(), r.read(f"occurrences{r.tag()}"), r.read("clean_posts")), f"bert_inputs_all{r.tag()}")


@stage
def bert_inputs_scored(r: Run) -> DataFrame:
    return r.write(C.scored_bert_inputs(r.tokens(), r.read(f"scores_{r.mode}"), r.read("clean_posts"), r.scope), f"bert_inputs_scored_{r.mode}")


@stage
def scores(r: Run) -> DataFrame:
    done = r.write(C.token_scores(r.read(f"clean_ratio_{r.mode}"), *r.spikes(), r.params, r.scope, r.lexicons()), f"scores_{r.mode}", [F.desc("slang_score"), "token"])
    print(f"scores_table=scores_{r.mode}\nrank_top_k={r.params.rank_top_k}")
    return done


@stage
def occurrence_scores(r: Run) -> DataFrame:
    return r.write(C.occurrence_scores(r.tokens(), r.read(f"clean_ratio_{r.mode}"), *r.spikes(), r.params, r.scope), f"occurrence_scores_{r.mode}")


@stage
def plotting(r: Run) -> DataFrame:
    two = ("monthly", "yearly")
    done = X.plotting_rows(r.read(f"candidates_combined_{r.mode}"), {g: r.read(f"stats_{g}_{r.mode}") for g in two}, {g: r.read(f"spikes_{g}_{r.mode}") for g in two}, r.scope)
    writers.write_csv(done, f"{r.out}/plotting_{r.mode}_csv", [*r.scope.keys, "time_grain", "year", "month"])
    return done


@stage
def export_tokens(r: Run) -> DataFrame:
    """The distinct tokens of a candidate type, sorted, as one CSV file."""
    done = X.candidate_tokens(r.read(f"candidates{r.tag()}"))
    writers.write_csv(done, f"{r.out}/candidate_tokens{r.tag()}_csv", ["token"])
    print(f"wrote_csv={r.out}/candidate_tokens{r.tag()}_csv")
    return done


@stage
def export_scores(r: Run) -> DataFrame:
    """All scores, sorted, as one CSV file."""
    name = r.args.table or f"scores_{r.mode}"
    done = X.score_rows(r.read(name))
    writers.write_csv(done, f"{r.out}/{name}_csv", ["slang_score"])
    print(f"scores_table={name}\nwrote_plotting_csv={r.out}/{name}_csv")
    return done


@stage
def plot_candidates(r: Run) -> DataFrame:
    """From the plotting CSV: summary and top bars, and panels of the best (or given) tokens."""
    rows = readers.plotting_rows(r.spark, f"{r.out}/plotting_{r.mode}_csv")
    known = X.unique_candidates(rows, r.scope)
    summary, top_n, out = X.candidate_summary(known, r.args.top_n), r.args.top_n, f"{r.args.plot_dir}"
    writers.write_csv(summary, f"{r.out}/candidate_summary_{r.mode}_csv")
    plots.bars([(x.spike_profile, x.n) for x in X.profile_counts(known).collect()], "Candidates by spike profile", "tokens", f"{out}/spike_profile_counts.svg")
    for metric in X.METRICS:
        plots.bars([tuple(x) for x in X.top_tokens(known, metric, top_n).collect()], f"Top candidates by {metric}", metric, f"{out}/top_{metric}.svg")
    wanted = json.loads(r.args.tokens_json) if r.args.tokens_json else [x.token for x in X.auto_tokens(known, r.args.auto_tokens).collect()]
    for n, token in enumerate(wanted):
        for grain in ("monthly", "yearly"):
            found = X.token_series(rows, token, grain).collect()
            if found:
                col = lambda c: [x[c] for x in found]  # noqa: B023, E731
                three = {c: col(f"{grain}_{c}") for c in ("spike_score", "p_baseline", "p_current_smoothed")}
                plots.panels([str(x.plot_date) for x in found], [("count_reddit", {"count": col("count_reddit")}), ("p_reddit", {"share": col("p_reddit")}), ("spike/baseline", three)], f"{token}: {grain} usage", f"{out}/{n:03d}_{grain}.svg")
    return summary


@stage
def plot_scores(r: Run) -> DataFrame:
    found = X.score_histogram(r.read(r.args.table or f"scores_{r.mode}"), r.args.bins)
    counts = {x.bin: x.n for x in found.collect()}
    if not counts:
        raise ValueError("no scores to plot")
    plots.histogram(counts, r.args.bins, "Scores", "slang_score", f"{r.args.plot_dir}/scores_{r.mode}.svg")
    print(f"rows_plotted={sum(counts.values())}\nbins={r.args.bins}")
    return found


@stage
def lookup(r: Run) -> DataFrame:
    wanted = readers.token_list(r.args.tokens_json, r.args.tokens_file)
    done = X.lookup(r.read(f"scores_{r.mode}"), wanted, r.args.subreddit)
    done.show(r.args.limit, truncate=r.args.truncate)
    X.missing_tokens(r.read(f"scores_{r.mode}"), readers.words(r.spark, wanted)).show(r.args.limit)
    return done


@stage
def preview(r: Run) -> DataFrame:
    """A table's first rows in one of its viewer's orders."""
    done = X.preview(r.read(r.args.table), X.PREVIEWS[r.args.viewer][r.args.sort] if r.args.viewer else [], r.args.limit)
    done.show(r.args.limit, truncate=r.args.truncate)
    return done


@stage
def label_counts(r: Run) -> DataFrame:
    done = C.label_counts(r.tokens(), r.read(f"occurrences{r.tag()}"))
    for x in done.collect():
        print(f"{'candidate' if x.is_slang_candidate else 'other'}={x.occurrences}")
    return done


@stage
def distinct_tokens(r: Run) -> DataFrame:
    done = X.distinct_tokens(r.tokens())
    print(f"distinct_tokens={done.first()[0]}")
    return done


@stage
def inspect_raw(r: Run) -> DataFrame:
    """The first raw posts with their tokens."""
    raw = readers.zstd_posts(r.spark, r.paths["raw_posts"]) if r.paths["raw_posts"].endswith(".zst") else readers.raw_posts(r.spark, r.paths["raw_posts"])
    done = P.tokenize(P.clean_posts(raw.limit(r.args.limit)))
    done.show(r.args.limit, truncate=r.args.truncate)
    return done


@stage
def json_extract(r: Run) -> DataFrame:
    """Links and hashtags of records; the merged values as JSON lines."""
    lines = readers.json_lines(r.spark, r.paths["records"])
    done = R.merge_links(R.extract_links(lines, "value", []))
    writers.write_json(done.groupBy("kind").agg(F.sort_array(F.collect_set("value")).alias("values")), f"{r.out}/merged_links_json")
    return done


@stage
def dedupe_names(r: Run) -> DataFrame:
    """Names of a size-path list, each once, in the order of their first lines."""
    done = R.first_names(readers.size_path_lines(r.spark, r.paths["names"]))
    writers.write_lines(done.orderBy("line").select("name").coalesce(1), f"{r.out}/names_txt")
    return done


@stage
def corpus_parts(r: Run) -> DataFrame:
    """A random sample of a corpus in parts of 10,000 rows."""
    done = readers.shuffled_corpus(r.spark.read.parquet(r.paths["clean_corpus"]), r.args.corpus_rows, r.args.seed)
    writers.write_parts(done, f"{r.out}/clean_corpus_parts", r.args.part_rows)
    return r.read("clean_corpus_parts")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--config", required=True)
    p.add_argument("--stage", choices=tuple(STAGES), required=True)
    p.add_argument("--mode", choices=("subreddit", "global"), default="subreddit")
    p.add_argument("--time-grain", choices=("monthly", "yearly", "both"), default="both")
    p.add_argument("--candidate-type", choices=TYPES, default="spiking_combined")
    p.add_argument("--spike-time-grain", choices=("monthly", "yearly"), default="monthly")
    p.add_argument("--include-full-text", action="store_true")
    p.add_argument("--infer-schema", action="store_true", help="infer the schema of raw posts")
    p.add_argument("--fraction", type=float, default=0.1)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--subset", action="store_true", help="read the token subset instead of all tokens")
    p.add_argument("--post-limit", type=int, default=1_000_000)
    p.add_argument("--corpus-rows", type=int, default=1_000_000)
    p.add_argument("--part-rows", type=int, default=10_000)
    p.add_argument("--sample-csv", type=int, default=0, help="also write this many first rows as CSV")
    p.add_argument("--tokens-json")
    p.add_argument("--tokens-file")
    p.add_argument("--subreddit")
    p.add_argument("--table", help="a table's name")
    p.add_argument("--viewer", choices=tuple(X.PREVIEWS), help="whose orders --sort names")
    p.add_argument("--sort", choices=tuple(sorted({s for v in X.PREVIEWS.values() for s in v})), default="default")
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--truncate", type=int, default=80)
    p.add_argument("--plot-dir", default="plots")
    p.add_argument("--top-n", type=int, default=20)
    p.add_argument("--auto-tokens", type=int, default=10)
    p.add_argument("--bins", type=int, default=50)
    for name, kind in Params.__annotations__.items():
        if kind in ("int", "float"):
            p.add_argument("--" + name.replace("_", "-"), type={"int": int, "float": float}[kind])
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame | None:
    """Runs a stage; returns what it wrote or showed."""
    args = parser().parse_args(argv)
    return STAGES[args.stage](Run(args, spark or session()))


if __name__ == "__main__":
    main()
