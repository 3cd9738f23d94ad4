"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import random

import numpy as np

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
WINDOW, STRIDE = 96, 48
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Character classes: 0 padding, 1 other, 2 white space, 3 digit, then letters and marks.
_CLASS = np.ones(128, np.int64)
_CLASS[[9, 10, 11, 12, 13, 32]] = 2
_CLASS[[ord(c) for c in "0123456789"]] = 3
for _i, _c in enumerate(_LOWER + _UPPER + _MARKS):
    _CLASS[ord(_c)] = 4 + _i
CLASSES = 4 + 52 + len(_MARKS)


def encode(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, _CLASS[np.minimum(codes, 127)], 1)


def allowed() -> np.ndarray:
    """Transitions that make sense: an inside tag only follows its own kind."""
    ok = np.ones((len(TAGS), len(TAGS)), bool)
    for j, t in enumerate(TAGS):
        if t[0] == "I":
            ok[:, j] = [s[2:] == t[2:] for s in TAGS]
    return ok


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


class Tagger:
    """Weights by name; windows are batch x length arrays of character classes."""

    def __init__(self, hidden: int = 16, embed: int = 12, seed: int = 0):
        rng, k = np.random.default_rng(seed), len(TAGS)
        u = lambda *shape, s: rng.uniform(-s, s, shape).astype(np.float32)
        self.h = hidden
        self.w = {"emb": u(CLASSES, embed, s=0.5), "out": u(2 * hidden, k, s=0.3), "bias": np.zeros(k, np.float32), "trans": np.zeros((k, k), np.float32)}
        for d in "fb":
            self.w |= {f"x{d}": u(embed, 4 * hidden, s=0.3), f"h{d}": u(hidden, 4 * hidden, s=0.3), f"c{d}": np.zeros(4 * hidden, np.float32)}
            self.w[f"c{d}"][hidden : 2 * hidden] = 1.0  # forget gate
        self.ban = np.where(allowed(), 0.0, -1e4).astype(np.float32)

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        n, length, h = x.shape[0], x.shape[1], self.h
        pre = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, saved = np.empty((n, length, h), np.float32), []
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            g = pre[:, t] + state @ self.w[f"h{d}"]
            s = _sigmoid(g[:, : 3 * h])
            i, f, o, z = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :], np.tanh(g[:, 3 * h :])
            new = f * cell + i * z
            tc = np.tanh(new)
            if keep:
                saved.append((t, i, f, o, z, cell, tc, state))
            state, cell = o * tc, new
            out[:, t] = state
        return out, saved

    def emissions(self, windows: np.ndarray) -> np.ndarray:
        x = self.w["emb"][windows]
        both = np.concatenate([self._run(x, d, False)[0] for d in "fb"], 2)
        return both @ self.w["out"] + self.w["bias"]

    def viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best tags, batch x length; what lies beyond a row's length is O."""
        n, length, k = scores.shape
        trans = self.w["trans"] + self.ban
        start = np.where([t[0] == "I" for t in TAGS], -1e4, 0.0)
        best, back = scores[:, 0] + start, np.zeros((n, length, k), np.int8)
        for t in range(1, length):
            cand = best[:, :, None] + trans
            back[:, t] = cand.argmax(1)
            new = cand.max(1) + scores[:, t]
            best = np.where((t < lengths)[:, None], new, best)
        tags, at, rows = np.zeros((n, length), np.int8), best.argmax(1), np.arange(n)
        for t in range(length - 1, -1, -1):
            inside = t < lengths
            tags[inside, t] = at[inside]
            at = np.where(inside, back[rows, t, at], at) if t else at
        return tags

    def step(self, windows: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood a character, and its gradients."""
        w, n, length, k, h = self.w, *windows.shape, len(TAGS), self.h
        x = w["emb"][windows]
        (hf, sf), (hb, sb) = (self._run(x, d, True) for d in "fb")
        both = np.concatenate([hf, hb], 2)
        em = (both @ w["out"] + w["bias"]).astype(np.float64)
        trans = (w["trans"] + self.ban).astype(np.float64)
        alpha, beta = np.empty((n, length, k)), np.zeros((n, length, k))
        alpha[:, 0] = em[:, 0]
        for t in range(1, length):
            alpha[:, t] = _logsum(alpha[:, t - 1, :, None] + trans, 1) + em[:, t]
        for t in range(length - 2, -1, -1):
            beta[:, t] = _logsum(trans + (em[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = _logsum(alpha[:, -1], 1)
        rows, cols = np.arange(n)[:, None], np.arange(length)
        gold = em[rows, cols, tags].sum(1) + trans[tags[:, :-1], tags[:, 1:]].sum(1)
        loss = float((z - gold).mean() / length)
        dem = np.exp(alpha + beta - z[:, None, None])
        dtrans = np.zeros((k, k))
        for t in range(1, length):
            dtrans += np.exp(alpha[:, t - 1, :, None] + trans + (em[:, t] + beta[:, t])[:, None, :] - z[:, None, None]).sum(0)
        np.add.at(dtrans, (tags[:, :-1], tags[:, 1:]), -1.0)
        dem[rows, cols, tags] -= 1
        scale = 1.0 / (n * length)
        dem = (dem * scale).astype(np.float32)
        g = {"trans": np.where(allowed(), dtrans * scale, 0).astype(np.float32), "bias": dem.sum((0, 1)), "out": both.reshape(-1, 2 * h).T @ dem.reshape(-1, k)}
        dboth, dx = dem @ w["out"].T, np.zeros_like(x)
        for d, saved, dh_all in (("f", sf, dboth[..., :h]), ("b", sb, dboth[..., h:])):
            dpre = np.zeros((n, length, 4 * h), np.float32)
            dh, dc, gh = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), np.zeros_like(w[f"h{d}"])
            for t, i, f, o, zz, cell, tc, state in reversed(saved):
                dh = dh + dh_all[:, t]
                dc = dc + dh * o * (1 - tc * tc)
                dg = np.concatenate([dc * zz * i * (1 - i), dc * cell * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - zz * zz)], 1)
                dpre[:, t] = dg
                gh += state.T @ dg
                dh, dc = dg @ w[f"h{d}"].T, dc * f
            g |= {f"h{d}": gh, f"c{d}": dpre.sum((0, 1)), f"x{d}": x.reshape(-1, x.shape[2]).T @ dpre.reshape(-1, 4 * h)}
            dx += dpre @ w[f"x{d}"].T
        g["emb"] = np.zeros_like(w["emb"])
        np.add.at(g["emb"], windows, dx)
        return loss, g


def window_tags(text: str, spans: list[tuple[str, int, int]]) -> np.ndarray:
    tags = np.zeros(len(text), np.int64)
    for kind, a, b in spans:
        tags[a:b] = TAGS.index(f"I-{kind}")
        tags[a] = TAGS.index(f"B-{kind}")
    return tags


def train(samples: list[tuple[str, list[tuple[str, int, int]]]], steps: int = 420, batch: int = 48, rate: float = 0.02, seed: int = 0, hidden: int = 16) -> Tagger:
    """Fit on labelled spans (text, [(kind, start, end)]) by Adam; the same input gives the same weights."""
    rng, model = np.random.default_rng(seed), Tagger(hidden=hidden, seed=seed)
    xs, ys = [], []
    for text, spans in samples:
        codes, tags = encode(text), window_tags(text, spans)
        for at in range(0, max(1, len(codes) - STRIDE), STRIDE):
            x, y = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int64)
            part = codes[at : at + WINDOW]
            x[: len(part)], y[: len(part)] = part, tags[at : at + WINDOW]
            if y[0] and TAGS[y[0]][0] == "I":
                y[0] -= 1  # a window may begin inside a span
            xs.append(x)
            ys.append(y)
    x, y = np.stack(xs), np.stack(ys)
    m = {k: np.zeros_like(v) for k, v in model.w.items()}
    v2 = {k: np.zeros_like(v) for k, v in model.w.items()}
    for t in range(1, steps + 1):
        pick = rng.integers(0, len(x), batch)
        _, g = model.step(x[pick], y[pick])
        norm = float(np.sqrt(sum((q.astype(np.float64) ** 2).sum() for q in g.values())))
        pace = rate * min(1.0, 5.0 * (1 - t / (steps + 1)))
        for k, q in g.items():
            q = q * min(1.0, 1.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * q
            v2[k] = 0.99 * v2[k] + 0.01 * q * q
            model.w[k] -= (pace * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
    return model


_SYLLABLES = "an er th in on re est ou tion ly ed ha st é en ai ch ü ie ge ción os ñ ar la de der und pas que".split()


def labelled_samples(count: int = 1000, seed: int = 1) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Invented prose with labelled personal data, and with numbers, keys and versions that are none."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda: "".join(r.choice(_LOWER) for _ in range(r.randint(3, 9)))

    def word() -> str:
        w = "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 3)))
        return w.upper() + r.choice(["", "!!"]) if r.random() < 0.04 else w.capitalize() if r.random() < 0.1 else w

    def personal() -> tuple[str, str]:
        kind = r.choice(["email", "email", "masked", "masked", "masked", "ip", "ip", "card", "card", "phone", "national", "national"])
        host = name() + r.choice(["", digits(1)])
        end = r.choice(["com", "org", "net", "de", "example.com"])
        local = name() + r.choice(["", "." + name(), "." + digits(2), "_" + digits(1)])
        if kind == "email":
            return "email", f"{local}@{host}.{end}"
        if kind == "masked":
            at, dot = r.choice([("[at]", "[dot]"), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot "), ("(at)", "."), ("[at]", "."), (" (at) ", "."), (" [at] ", ".")])
            return "email", f"{local.replace('.', dot)}{at}{host}{dot}{r.choice(['com', 'org', 'net', 'de'])}"
        if kind == "ip":
            return "ip", r.choice([".", ".", ".", "[.]", "(.)", "[dot]", "(dot)", " [dot] "]).join(str(r.randint(0, 255)) for _ in range(4))
        if kind == "card":
            s = r.choice(["", "", " ", "-", ".", "_", "/", "  ", " - "])
            return "card", s.join(digits(4) for _ in range(4))
        if kind == "phone":
            return "phone", f"+{r.randint(1, 99)} {r.choice(['({}) {}-{}', '{} {} {}', '{}-{}-{}'])}".format(digits(3), digits(3), digits(4))
        if r.random() < 0.4:
            area = "0" + digits(r.randint(1, 4))
            return "phone", r.choice(["{} {}", "{}/{}", "({}) {}", "{}-{}"]).format(area, r.choice([digits(6), digits(7), digits(3) + " " + digits(4), digits(8)]))
        return "phone", r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}"]).format(digits(3), digits(3), digits(4))

    def other() -> str:
        return r.choice([
            lambda: str(r.randint(0, 99999)), lambda: f"{r.randint(1, 9)}.{r.randint(0, 9)}", lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}",
            lambda: "AKIA" + "".join(r.choice(_UPPER + "234567") for _ in range(16)), lambda: '"' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"', lambda: f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}",
            lambda: f"${r.randint(1, 999)},{digits(3)}.{digits(2)}", lambda: f"Version {r.randint(1, 4)}.0.", lambda: f"{digits(2)}:{digits(2)}", lambda: "at", lambda: "dot", lambda: digits(r.choice([9, 11, 21])), lambda: f"@{name()}",
        ])()

    out = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(r.randint(6, 26)):
            p = r.random()
            if p < 0.14:
                kind, s = personal()
                spans.append((kind, len(text), len(text) + len(s)))
            else:
                s = other() if p < 0.26 else word()
            text += s + r.choice([" ", " ", " ", " ", ", ", ". ", "\n"])
        out.append((text, spans))
    return out


_models: dict[tuple, Tagger] = {}


def default_model() -> Tagger:
    """The model of labelled_samples(), fitted once in a process."""
    if () not in _models:
        _models[()] = train(labelled_samples())
    return _models[()]
