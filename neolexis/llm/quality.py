"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes.

1. Document evidence. On a bounded sample of labelled documents, words and stems get log-likelihood ratios for
   toxic and for poor documents, by language, from grouped counts of the documents that hold them. A language's
   ratios are shrunk towards those of all other languages; where a language has no documents with a word, or is null,
   the ratio pooled over all languages holds. A document's evidence is those words' ratios with a few measures of its form, through a logistic regression for each of the two faults.
2. Sites. Over all documents, hosts (here: source) and paths within hosts (here: source and lang) sum the
   evidence by grouped aggregation. A host's rate of faults is a beta-binomial posterior around the global rate,
   a path's one around its host's posterior; the strengths of both priors are estimated from the spread of
   rates between hosts, and between paths of a host, by the method of moments. Sparse sites stay near the prior.
3. A document's posterior odds are its evidence's odds times the odds of its path without it over the global
   odds, damped by `site_weight`: its own evidence is taken out of its path's and host's sums first, so that it
   counts once. It is kept if the posterior probability that it has a fault is below `reject_at`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Labelled documents about which words are counted in each stratum, and about which the regressions are fitted on: those with small hashes of their ids.
SAMPLE = 20_000
#: Words with ratios that are kept for each fault, pooled and of each stratum.
LEXICON = 2_000
#: Deviation of a word's ratio between strata.
BETWEEN = 1.0
#: Documents of the common rate of faults that are added to each stratum's.
PRIOR = 20
#: Sampled labels up to which they are broadcast to the documents.
BROADCAST_LABELS = 200_000
#: Sites up to which their rates are broadcast to the documents.
BROADCAST_SITES = 50_000
_WORD = re.compile(r"[^\W\d_]+")
FEATURES = ("toxic_max", "toxic_sum", "poor_max", "upper", "marks", "bars", "symbols", "digits", "repeats", "lines", "length", "short", "letters", "empty")


def words_of(text: str) -> set[str]:
    """Distinct words of a text and their beginnings of 4 to 6 letters (with a hyphen): stems that take many endings."""
    words = set(_WORD.findall(text.lower()))
    return words.union(*({w[:n] + "-" for w in words if len(w) > n} for n in (4, 5, 6)))


def shape(text: str) -> list[float]:
    """Shares of capitals, exclamation, bars, other marks, digits, repeated words and lines, and lengths."""
    n = len(text)
    tokens = text.split()
    if not tokens:
        return [0.0] * 9 + [0.0, 1.0]
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ascii_ = np.bincount(np.minimum(raw, 128), minlength=129)
    upper, digit = ascii_[65:91].sum(), ascii_[48:58].sum()
    letters = upper + ascii_[97:123].sum() + ascii_[128]
    lines = [x for x in text.split("\n") if x.strip()]
    k = len(tokens)
    return [
        float(upper / max(1, letters)), float(ascii_[33] / k), float(ascii_[124] / k), float(sum(ascii_[ord(c)] for c in "#$%&*@~^<>{}\\") / k), float(digit / n),
        1 - len(set(tokens)) / k if k > 20 else max(0.0, 1 - len(set(tokens)) / k - 0.3), 1 - len(set(lines)) / max(1, len(lines)), float(np.log1p(k) / 10), 1.0 if k < 5 else 0.0, float(letters / n), 0.0,
    ]


@dataclass
class Classifier:
    """lexicons: stratum (language) -> word -> log-likelihood ratio, for toxic and for poor, with the pooled ratios at None; weights: standardised
    logistic regressions."""

    lexicons: tuple[dict[str, dict[str, float]], dict[str, dict[str, float]]]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # 2 x (features + 1)

    def features(self, text: str, stratum: str | None) -> list[float]:
        found = words_of(text)
        toxic, poor = ([x[w] for w in found if w in x] if (x := lexicon.get(stratum, lexicon[None])) else [] for lexicon in self.lexicons)
        return [max(toxic, default=0.0), min(sum(toxic), 20.0), max(poor, default=0.0), *shape(text)]

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of toxic and of poor; rows of features in."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return z @ self.weights[:, :-1].T + self.weights[:, -1]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept."""
    a = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(a.shape[1])
    pull = np.full(a.shape[1], ridge * len(x))
    pull[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(pull + 1e-9), a.T @ (p - y) + pull * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, stratum_col: str, scratch: Scratch) -> DataFrame:
    """Sampled labelled rows with texts: id, text, stratum, toxic, poor, fitted (whether the regressions see it).

    A stratum of more than SAMPLE labelled documents gives about SAMPLE of them, a smaller one all.
    """
    some = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy(F.col("doc_id").alias("_id"))
    some = some.agg(F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"), F.max(F.lit(1) - F.coalesce("quality", F.lit(1))).alias("poor"))
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit(""))
    pairs = docs.select(F.col(id_col).alias("_key"), stratum.alias("_stratum")).distinct()
    pairs = scratch.save(pairs.join(some, F.col("_key") == F.col("_id")).drop("_key"), "labels")
    sizes = pairs.groupBy("_stratum").agg(F.count("*").alias("_n"))
    whole = pairs.agg(F.count("*").alias("_all"))
    place = F.shiftrightunsigned(F.xxhash64(F.lit(8), "_id"), 11) / float(1 << 53)
    chosen = pairs.join(sizes, "_stratum").crossJoin(F.broadcast(whole)).where(place < F.lit(float(SAMPLE)) / F.col("_n"))  # one row
    chosen = scratch.save(chosen.select("_id", "_stratum", "toxic", "poor", (place < F.lit(float(SAMPLE)) / F.col("_all")).alias("fitted")), "chosen")
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_LABELS else chosen
    return docs.join(chosen, (F.col(id_col) == F.col("_id")) & (stratum == F.col("_stratum"))).select(F.col("_id").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col("_stratum").alias("stratum"), "toxic", "poor", "fitted")


def _ratio(n: str, bad: str, due: str, tag: str) -> list[Column]:
    """Log-likelihood ratio, its error and the likelihood-ratio statistic of n documents, bad with the fault where `due` are expected.

    A word counts if its documents have the fault far more often than expected: by the statistic, of which 25
    (five deviations) is no accident even among many words. Its weight is a lower bound of the ratio.
    """
    n_, with_, due_ = F.expr(n), F.expr(bad), F.expr(due)
    without, rest = n_ - with_, n_ - due_
    ratio = F.log((with_ + 0.5) / (due_ + 0.5)) - F.log((without + 0.5) / (rest + 0.5))
    error = F.sqrt(1.0 / (with_ + 0.5) + 1.0 / (without + 0.5))
    part = lambda a, b: F.when((a > 0) & (b > 0), a * F.log(a / b)).otherwise(0.0)
    odd = F.when(with_ > due_, 2.0 * (part(with_, due_) + part(without, rest))).otherwise(0.0)
    return [ratio.alias(f"ratio{tag}"), error.alias(f"error{tag}"), odd.alias(f"odd{tag}")]


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", lexicon: int = LEXICON) -> Classifier:
    """The document classifier. Without labels it finds no fault anywhere.

    Of the words with significant ratios the `lexicon` most significant of each fault are kept, pooled and of each
    stratum: a bound on the model that workers load, not on the documents that count.
    """
    sample = scratch.save(_labelled(docs, labels, id_col, text_col, stratum_col, scratch), "labelled")
    totals = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"), F.coalesce(F.sum("poor"), F.lit(0)).alias("poor")).first()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # words of a batch, by stratum, with how many of its documents hold them
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, counts = batch.slice(at, 500), {}
                for text, stratum, toxic, poor in zip(*(c.to_pylist() for c in part.columns)):
                    for w in words_of(text):
                        c = counts.setdefault((stratum, w), [0, 0, 0])
                        c[0] += 1
                        c[1] += toxic
                        c[2] += poor
                cols = list(zip(*counts.values())) if counts else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), *(pa.array(c, pa.int64()) for c in cols)], names=["stratum", "word", "n", "toxic", "poor"])

    faults = ("toxic", "poor")
    counted = sample.select("text", "stratum", *faults).mapInArrow(split, "stratum string, word string, n long, toxic long, poor long")
    counted = counted.groupBy("stratum", "word").agg(*(F.sum(c).alias(c) for c in ("n", *faults)))
    strata = sample.groupBy("stratum").agg(F.count("*").alias("all_n"), *(F.sum(c).alias(f"all_{c}") for c in faults))
    counted = scratch.save(counted.join(strata, "stratum"), "words")
    lexicons: list[dict[str | None, dict[str, float]]] = []
    for fault in faults:
        share = (F.col(f"all_{fault}") + PRIOR * totals[fault] / max(1, totals.n)) / (F.col("all_n") + PRIOR)
        own = counted.where((F.col("stratum") != "")).select("stratum", "word", F.col("n").cast("double").alias("n"), F.col(fault).cast("double").alias("bad"), (F.col("n") * share).alias("due"))
        # what the strata's own rates make of a word's documents: a stratum of many faults makes no word of it faulty
        pooled = counted.groupBy("word").agg(F.sum("n").cast("double").alias("n0"), F.sum(fault).cast("double").alias("bad0"), F.sum(F.round(F.col("n") * share, 9).cast("decimal(28,9)")).cast("double").alias("due0"))
        pooled = scratch.save(pooled.where("n0 >= 4 and bad0 >= 4").select("*", *_ratio("n0", "bad0", "due0", "0")), "pooled")
        counts = pooled.where("ratio0 - 1.5 * error0 > 0.7 and odd0 > 25").orderBy(F.desc("odd0"), "word").limit(lexicon)
        common = {r.word: float(r.ratio0 - 1.5 * r.error0) for r in counts.collect()}
        # a stratum's ratio and that of all others, each by its precision
        rest = own.join(pooled.select("word", "n0", "bad0", "due0"), "word").select("*", *_ratio("n", "bad", "due", "1"), *_ratio("n0 - n", "bad0 - bad", "due0 - due", "2"))
        mine, prior = 1 / F.pow("error1", 2), F.when(F.expr("n0 > n"), 1 / (BETWEEN**2 + F.pow("error2", 2))).otherwise(0.0)
        rest = rest.select("stratum", "word", "odd1", ((mine * F.col("ratio1") + prior * F.col("ratio2")) / (mine + prior) - 1.5 / F.sqrt(mine + prior)).alias("ratio"), F.expr("n >= 4 and bad >= 4 and odd1 > 25").alias("strong"))
        top = F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("odd1"), "word"))
        strong = rest.where("strong and ratio > 0.7").withColumn("_row", top).where(F.col("_row") <= lexicon).select("stratum", "word", "ratio")
        # the stratum's own view of the pooled words
        known = rest.join(F.broadcast(counts.select("word")), "word", "left_semi").select("stratum", "word", "ratio")
        found: dict[str | None, dict[str, float]] = {None: common}
        for r in known.union(strong).collect():
            words = found.setdefault(r.stratum, dict(common))
            if r.ratio > 0.7:
                words[r.word] = float(r.ratio)
            else:
                words.pop(r.word, None)
        lexicons.append(found)
    n = len(FEATURES)
    model = Classifier(tuple(lexicons), np.zeros(n), np.ones(n), np.zeros((2, n + 1)))
    model.weights[:, -1] = -10.0
    if not totals.n:
        return model

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [model.features(t, k) for t, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(2), batch.column(3)], names=["x", "toxic", "poor"])

    rows = sample.where("fitted").select("text", "stratum", "toxic", "poor").mapInArrow(measure, "x array<double>, toxic int, poor int").collect()
    rows.sort(key=lambda r: (r.x, r.toxic, r.poor))  # sums in the same order in every run
    x = np.array([r.x for r in rows])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = np.clip((x - mean) / scale, -8, 8)
    weights = np.stack([logistic(z, np.array([float(r[f]) for r in rows])) for f in ("toxic", "poor")])
    return Classifier(tuple(lexicons), mean, scale, weights)


def evidence(docs: DataFrame, model: Classifier, keep: list[str], text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """`keep`, p_toxic and p_poor: the document classifier's probabilities for whole texts."""
    fields = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "p_toxic double", "p_poor double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                x = np.array([model.features(t or "", k) for t, k in zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist())]).reshape(-1, len(FEATURES))
                p = 1 / (1 + np.exp(-np.clip(model.odds(x), -30, 30)))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(p[:, 0]), pa.array(p[:, 1])], names=[*keep, "p_toxic", "p_poor"])

    return docs.select(*keep, F.col(text_col).alias("_text"), F.col(stratum_col).cast("string").alias("_stratum")).mapInArrow(run, fields)


def _strength(sites: DataFrame, centre: str) -> Column:
    """Prior documents around a rate: by moments, the spread of site rates beyond what sampling explains."""
    spread = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col(centre), 2)) / F.sum("n")
    noise = F.sum(F.col(centre) * (1 - F.col(centre))) / F.sum("n")
    level = F.sum(F.col("n") * F.col(centre) * (1 - F.col(centre))) / F.sum("n")
    between = F.greatest(spread - noise, level / 10_000)
    return F.greatest(level / between - 1, F.lit(2.0))


def site_rates(paths: DataFrame) -> DataFrame:
    """From _host, _path, n, bad (evidence summed): a row a path with the posterior rates, and what they are made of.

    _h, _p, rate (global), host_n, host_bad, host_strength, host_rate, path_n, path_bad, path_strength, path_rate.
    """
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = hosts.agg(((F.sum("bad") + 0.5) / (F.sum("n") + 1)).alias("rate"))
    hosts = hosts.crossJoin(F.broadcast(whole))  # one row
    hosts = hosts.crossJoin(F.broadcast(hosts.agg(_strength(hosts, "rate").alias("strength"))))  # one row
    hosts = hosts.select(F.col("_host").alias("_h"), "rate", F.col("n").alias("host_n"), F.col("bad").alias("host_bad"), F.col("strength").alias("host_strength"), ((F.col("bad") + F.col("rate") * F.col("strength")) / (F.col("n") + F.col("strength"))).alias("host_rate"))
    rows = paths.join(hosts, paths["_host"].eqNullSafe(hosts["_h"]))
    rows = rows.crossJoin(F.broadcast(rows.agg(_strength(rows, "host_rate").alias("strength"))))  # one row
    return rows.select(
        "_h", F.col("_path").alias("_p"), "rate", "host_n", "host_bad", "host_strength", "host_rate", F.col("n").alias("path_n"), F.col("bad").alias("path_bad"), F.col("strength").alias("path_strength"),
        ((F.col("bad") + F.col("host_rate") * F.col("strength")) / (F.col("n") + F.col("strength"))).alias("path_rate"),
    )


def classify(docs: DataFrame, labels: DataFrame, keep: list[str], host_col: str = "source", path_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", reject_at: float = 0.6, site_weight: float = 0.25, lexicon: int = LEXICON) -> DataFrame:
    """Per row of docs: `keep`, p_toxic, p_poor (document evidence), host_rate, path_rate (posterior rates of
    faults), p_fault (posterior) and kept (boolean).

    `lexicon` bounds the model's size: the words with ratios kept for each fault, pooled and of each language.
    Null hosts and paths are sites of their own; null and empty texts have only the evidence of being empty.
    Equal rows give equal results. Labels with null ids or without values play no part; of repeated labels the
    worse counts. Without labels everything is kept. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    model = fit(docs, labels, scratch, id_col, text_col, path_col, lexicon)
    scratch.keep()
    named = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(host_col).alias("_host"), F.col(path_col).alias("_path"), F.col(text_col).alias("_body"))
    saved = scratch.save(evidence(named, model, [*(f"_k{i}" for i in range(len(keep))), "_host", "_path"], "_body", "_path"), "evidence")
    # the two faults as independent given the text
    fault = 1 - (1 - F.col("p_toxic")) * (1 - F.col("p_poor"))
    rows = saved.withColumn("_own", F.greatest(F.least(fault, F.lit(1 - 1e-6)), F.lit(1e-6)))
    paths = scratch.save(rows.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum("_own").alias("bad")), "paths")
    sites = scratch.save(site_rates(paths), "sites")
    scratch.keep(saved, sites)
    logit = lambda p: F.log(p / (1 - p))
    # a row a site: broadcast only behind this check, joined by shuffle beyond it
    sites = F.broadcast(sites) if sites.count() <= BROADCAST_SITES else sites
    out = rows.join(sites, rows["_host"].eqNullSafe(sites["_h"]) & rows["_path"].eqNullSafe(sites["_p"]))
    clip = lambda p: F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    own, rate = F.col("_own"), F.col("rate")
    host = (F.col("host_bad") - own + rate * F.col("host_strength")) / (F.col("host_n") - 1 + F.col("host_strength"))
    path = (F.col("path_bad") - own + host * F.col("path_strength")) / (F.col("path_n") - 1 + F.col("path_strength"))
    odds = logit(own) + F.lit(site_weight) * (logit(clip(path)) - logit(clip(rate)))
    out = out.withColumn("p_fault", 1 / (1 + F.exp(-odds)))
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "p_toxic", "p_poor", "host_rate", "path_rate", "p_fault", (F.col("p_fault") < reject_at).alias("kept"))
