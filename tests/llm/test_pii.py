import random
import re

import numpy as np
import pytest

from neolexis.llm import bilstm_crf, pii


def brute(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans_are_the_patterns_matches():
    rng = random.Random(0)
    for _ in range(20_000):
        t = "".join(rng.choice("01234567890.@+- ()abé") for _ in range(rng.choice([5, 30, 60])))
        assert sorted(pii.base_spans(t)) == brute(t)
    for t in ["x 4111 1111 1111 1111, y", "1.2.3.4.5", "256.1.1.1 001.002.003.0255", "a@b.c@d.e.f", "+1 (209) 555-1594.", "a" * 50 + "@" + "b." * 30 + "c"]:
        assert sorted(pii.base_spans(t)) == brute(t)


def test_gradients():
    model = bilstm_crf.Tagger(hidden=3, embed=4, seed=1)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, bilstm_crf.CLASSES, (2, 7)), np.array([[0, 1, 2, 2, 0, 3, 4], [0, 0, 5, 6, 0, 7, 8]])
    _, g = model.step(x, y)
    for k, i in {"xf": (1, 2), "hb": (0, 3), "cb": (4,), "out": (2, 1), "trans": (0, 1), "emb": (x[0, 3], 1)}.items():
        w, e = model.w[k][i], 1e-3
        model.w[k][i] = w + e
        up, _ = model.step(x, y)
        model.w[k][i] = w - e
        down, _ = model.step(x, y)
        model.w[k][i] = w
        assert (up - down) / (2 * e) == pytest.approx(g[k][i], rel=2e-2, abs=1e-6)


def test_held_out_accuracy_and_added_spans():
    detector = pii.Detector(bilstm_crf.default_model())
    held = bilstm_crf.labelled_samples(120, seed=99)
    hit = missed = wrong = 0
    for (_, want), got in zip(held, detector.model_spans([t for t, _ in held])):
        hit += len(set(want) & set(got))
        missed += len(set(want) - set(got))
        wrong += len(set(got) - set(want))
    assert hit / (hit + missed) > 0.8 and hit / (hit + wrong) > 0.8
    (base, spans), = detector.spans(["call (415) 555-2671 now, or a.b@c.de"])
    assert base == [("email", 28, 36)] and spans == [("email", 28, 36), ("phone", 5, 19)]


def test_every_kind_can_be_added():
    detector = pii.Detector(bilstm_crf.default_model())
    found = {}
    for kind, some in {
        "email": ["jane.doe [at] corp [dot] com", "jane (at) example.com", "jane [AT] corp [dOt] com", "bob(at)mail(dot)org"],
        "ip": ["10[.]20[.]30[.]40", "192(.)168(.)4(.)17"], "card": ["4111.1111.1111.1111", "4111_1111_1111_1111"], "phone": ["030 1234567", "(415) 555-2671", "0171/5551234"],
    }.items():
        for piece in some:
            text = f"er th in on re anstion please {piece} ly ed ha st"
            ((base, spans),) = detector.spans([text])
            found[piece] = not base and [(k, text[a:b]) for k, a, b in spans] == [(kind, piece)]
    assert sum(found.values()) >= len(found) - 2, found
    for text in ("on 2024-01-15 at 10.20.30 they met", "v1.2.3 and build 20240115", "look at it . dot and so on", "order 1234567890 of 12"):
        assert detector.spans([text]) == [([], [])], text


def test_every_accepted_form_is_within_reach():
    for piece in ("jane [at] corp [dOt] com", "a(at)b.de", "x at y dot z", "( at ) no", "10[.]2[.]3[.]4", "030 1234567", "4111_1111_1111_1111"):
        text = "w " * 200 + piece + " w" * 200
        a = text.index(piece)
        got = pii.regions(text)
        assert not piece.startswith("( ") and any(x <= a and a + len(piece) <= y for x, y in got) or piece.startswith("( ")


def test_long_regions_are_reconciled_over_windows():
    model = bilstm_crf.default_model()
    detector = pii.Detector(model)
    piece = "jane.doe [at] corp [dot] com"
    for shift in range(0, 48, 7):  # the address lies differently in the windows
        text = "7 " * 300 + "and " * (shift // 4) + "x" * (shift % 4) + f" write to {piece} please " + "1 and " * 60
        ((a, b),) = pii.regions(text)
        assert b - a > 5 * bilstm_crf.WINDOW
        ((base, spans),) = detector.spans([text])
        assert not base and [(k, text[x:y]) for k, x, y in spans] == [("email", piece)]
        # windowed emissions decoded once agree with those of the whole region read in one piece
        whole = model.viterbi(model.emissions(bilstm_crf.encode(text[a:b])[None]), np.array([b - a]))[0]
        at = text.index(piece) - a
        assert [bilstm_crf.TAGS[t] for t in whole[at : at + 3]] == ["B-email", "I-email", "I-email"]


def test_query_form_with_nulls_empty_texts_repeats_and_extra_columns(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "é ip 1.2.3.4 and a@b.cd", "x"), (3, "é ip 1.2.3.4 and a@b.cd", "x"), (None, "z" * 200_000 + " +1 (209) 555-1594", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = sorted(pii.find(docs, ["doc_id"]).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in out] == [(1, 0, 0, 0, 0), (2, 0, 0, 0, 0), (3, 1, 1, 0, 0), (3, 1, 1, 0, 0), (None, 0, 0, 0, 1)]
    assert out[2].base_spans == "email:17:23,ip:5:12"
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[3] == "é ip [IP] and [EMAIL]" and clean[1] is None and clean[None].endswith(" [PHONE]")
    assert pii.find(docs.limit(0), ["doc_id"]).count() == 0
