import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from neolexis.llm import quality
from neolexis.llm.common import Scratch


def corpus(n=500, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "er", "th", "in", "on", "re"]) for _ in range(r.randint(1, 3)))
    docs, labels, truth = [], [], {}
    for i in range(n):
        w = [word() for _ in range(r.choice([8, 40, 200]))]
        toxic, poor = r.random() < 0.15, r.random() < 0.15
        if toxic:
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(["moron", "scumly", "scuming"]))
        text = " ".join(x.upper() + "!!" for x in w) if poor else " ".join(w)
        docs.append((i, text, "en", f"s{r.randrange(4)}" if i % 3 else "hot", len(text)))
        truth[i] = toxic or poor
        if i < n * 0.7:
            labels.append((i, int(not poor), int(toxic)))
    return docs, labels, truth


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus()
    d, lab = frames(spark, docs, labels)
    out = {r.doc_id: r for r in quality.classify(d, lab, ["doc_id"]).collect()}
    held = [i for i in truth if i >= 350]
    right = sum(out[i].kept != truth[i] for i in held)
    assert len(out) == 500 and right / len(held) > 0.97
    for r in out.values():
        assert 0 < r.path_rate < 1 and 0 < r.host_rate < 1 and r.kept == (r.p_fault < 0.6)


def test_null_unseen_and_rare_languages_have_pooled_words(spark):
    docs, labels, _ = corpus(900)
    base = "an er th in on re anre thin oner inth"
    rare = [(2000 + i, f"{base} {'moron' if i % 2 else 'onre'}", lang, "s1", 1) for i, lang in enumerate([None, None, "new", "new", "few", "few"])]
    harmless = [(3000 + i, f"{base} moron w{i}", "other", "s1", 1) for i in range(60)]
    d, lab = frames(spark, docs + rare + harmless, [*labels, (2004, 1, 0), *((3000 + i, 1, 0) for i in range(50))])
    model = quality.fit(d, lab, Scratch(spark))
    for lang in (None, "", "new", "few"):
        assert model.features(base + " moron", lang)[0] > 0.7 and model.features(base, lang)[0] == 0
    assert model.features(base + " moron", "other")[0] == 0  # its own documents say otherwise
    out = {r.doc_id: r.p_toxic for r in quality.classify(d, lab, ["doc_id"]).collect()}
    for i in (0, 2, 4):
        assert out[2001 + i] > 0.5 > out[2000 + i]


def test_each_language_has_its_own_sample(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", 100)
    docs, labels, _ = corpus(900)
    some = [(5000 + i, "x", "rare", "s1", 1) for i in range(30)]
    d, lab = frames(spark, docs + some, [*labels, *((5000 + i, 1, 0) for i in range(30))])
    rows = quality._labelled(d, lab, "doc_id", "text", "lang", Scratch(spark)).collect()
    assert sum(r.stratum == "rare" for r in rows) == 30
    assert 60 < sum(r.stratum == "en" for r in rows) < 140 and 60 < sum(r.fitted for r in rows) < 140


def test_sites_shrink_to_their_prior(spark):
    docs, labels, _ = corpus()
    docs.append((900, "an er th in on re an er", "en", "tiny", 5))
    d, lab = frames(spark, docs, labels)
    rows = quality.classify(d, lab, ["doc_id", "source"]).collect()
    own = {}
    for r in rows:
        own.setdefault(r.source, []).append(1 - (1 - r.p_toxic) * (1 - r.p_poor))
    whole = np.mean([x for xs in own.values() for x in xs])
    rate = {r.source: r.host_rate for r in rows}
    for s, xs in own.items():
        lo, hi = sorted((np.mean(xs), whole))
        assert lo - 1e-3 <= rate[s] <= hi + 1e-3
    assert abs(rate["tiny"] - whole) < 0.5 * abs(np.mean(own["tiny"]) - whole)


def test_posteriors_match_brute_force(spark):
    docs, labels, _ = corpus()
    docs += [(900, "an er th in on re an er", None, "tiny", 5), (901, "an er", "xx", None, 5), (902, None, None, None, 5)]
    d, lab = frames(spark, docs, labels)
    rows = quality.classify(d, lab, ["doc_id", "source", "lang"]).collect()
    own = {r.doc_id: min(max(1 - (1 - r.p_toxic) * (1 - r.p_poor), 1e-6), 1 - 1e-6) for r in rows}
    hosts, paths = {}, {}
    for r in rows:
        for table, key in ((hosts, r.source), (paths, (r.source, r.lang))):
            n, bad = table.get(key, (0, 0.0))
            table[key] = (n + 1, bad + own[r.doc_id])

    def strength(sites):  # n, bad, centre
        n = sum(s[0] for s in sites)
        spread = sum(a * (b / a - c) ** 2 for a, b, c in sites) / n
        noise, level = sum(c * (1 - c) for *_, c in sites) / n, sum(a * c * (1 - c) for a, _, c in sites) / n
        return max(level / max(spread - noise, level / 10_000) - 1, 2.0)

    rate = (sum(b for _, b in hosts.values()) + 0.5) / (sum(n for n, _ in hosts.values()) + 1)
    s1 = strength([(n, b, rate) for n, b in hosts.values()])
    host_rate = {h: (b + rate * s1) / (n + s1) for h, (n, b) in hosts.items()}
    s2 = strength([(n, b, host_rate[h]) for (h, _), (n, b) in paths.items()])
    logit = lambda p: np.log(p / (1 - p))
    for r in rows:
        (hn, hb), (pn, pb), mine = hosts[r.source], paths[r.source, r.lang], own[r.doc_id]
        assert r.host_rate == pytest.approx(host_rate[r.source]) and r.path_rate == pytest.approx((pb + host_rate[r.source] * s2) / (pn + s2))
        without = (pb - mine + (hb - mine + rate * s1) / (hn - 1 + s1) * s2) / (pn - 1 + s2)
        p = 1 / (1 + np.exp(-(logit(mine) + 0.25 * (logit(min(max(without, 1e-6), 1 - 1e-6)) - logit(rate)))))
        assert r.p_fault == pytest.approx(p) and r.kept == (p < 0.6)


def test_nulls_empty_texts_repeats_and_tables_without_rows(spark):
    docs, labels, _ = corpus(200)
    odd = [(1000, None, None, None, None), (1001, "", "en", "x", 0), (None, "an er", "en", "x", 5), (3, docs[3][1], "en", docs[3][3], 1), (1002, "x" * 300_000, None, "x", 1)]
    d, lab = frames(spark, docs + odd, [*labels, (None, 1, 0), (1, None, None), (2, 0, None), (2, 1, 0)])
    d = d.withColumn("rate", F.lit(1)).withColumn("p_toxic", F.lit("x"))
    assert quality.classify(d, lab, ["doc_id"]).count() == len(docs) + len(odd)
    assert quality.classify(d, lab.limit(0), ["doc_id"]).where("not kept").count() == 0
    assert quality.classify(d.limit(0), lab, ["doc_id"]).count() == 0
    model = quality.fit(d.limit(0), lab, Scratch(spark))
    assert model.odds(np.array([model.features("", None)])).shape == (1, 2)


def test_logistic_regression_finds_the_weights():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20_000, 2))
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))).astype(float)
    assert quality.logistic(x, y, ridge=1e-6) == pytest.approx([2, -1, 0.5], abs=0.15)
