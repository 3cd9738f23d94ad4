"""Personal data: fixed patterns, and a BiLSTM-CRF that adds what they miss."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bilstm_crf import KINDS, STRIDE, TAGS, WINDOW, Tagger, default_model, encode

#: Characters of context on both sides of a trigger.
REACH = 48
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match of the ip pattern can only begin where a run of digits begins; saying so keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_TRIGGER = re.compile(r"[0-9@]+|[\[(]\s?(?:at|dot)\s?[\])]| dot ", re.IGNORECASE)
_NATIONAL = re.compile(r"\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}|\(?0[0-9]{1,4}\)?[ /-][0-9]{3,8}(?:[ -][0-9]{2,5}){0,2}")
_MASKED = re.compile(r"[a-z0-9._%+()\[\] -]*?(?:\s?[\[(]\s?at\s?[\])]\s?[a-z0-9-]+(?:(?:\s?[\[( ]\s?dot\s?[\]) ]\s?|\.)[a-z0-9-]+)+| at [a-z0-9-]+(?: dot [a-z0-9-]+)+)", re.IGNORECASE)
_DEFANGED = re.compile(r"([0-9]{1,3})(?:\s?[\[(](?:\.|dot)[\])]\s?|\.)([0-9]{1,3})(?:\s?[\[(](?:\.|dot)[\])]\s?|\.)([0-9]{1,3})(?:\s?[\[(](?:\.|dot)[\])]\s?|\.)([0-9]{1,3})", re.IGNORECASE)
_SPACED = re.compile(r"[0-9]{4}(?:[._/]|\s?[-–]\s?|\s\s)[0-9]{4}(?:[._/]|\s?[-–]\s?|\s\s)[0-9]{4}(?:[._/]|\s?[-–]\s?|\s\s)[0-9]{4}")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    # the local part has no @, so a match ends its local part at the next @; walk back from each
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield "email", begin, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """The fixed patterns, leftmost and non-overlapping per kind; matches that fail their check are dropped."""
    out = list(_emails(text)) if "@" in text else []
    if not _ANY.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in (q[-4:] if q.lstrip("0") == q[-3:].lstrip("0") else q for q in m[0].split(".")))]
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 40:
            d = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches that can hold spans: REACH characters around digits, @, and at or dot written in brackets or (dot) as a word, merged.

    Every form that `_valid` accepts has one of these, so no span it would accept is out of reach.
    """
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _valid(kind: str, piece: str) -> bool:
    """Whether an added span has an outer form of its kind: the model proposes, this keeps dates, versions and keys out.

    Phones are national numbers, emails addresses with at or dot written out, ips and cards those with other
    separators than the fixed patterns allow.
    """
    if kind == "phone":
        return bool(_NATIONAL.fullmatch(piece)) and 9 <= sum(c.isdigit() for c in piece) <= 12
    if kind == "ip":
        m = _DEFANGED.fullmatch(piece)
        return bool(m) and all(int(x) <= 255 for x in m.groups())
    if kind == "card":
        return bool(_SPACED.fullmatch(piece)) and luhn("".join(c for c in piece if c.isdigit()))
    return bool(_MASKED.fullmatch(piece))


class Detector:
    def __init__(self, model: Tagger):
        self.model = model
        self.blend = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)

    def model_spans(self, texts: list[str]) -> list[list[Span]]:
        """Spans of each text by the model.

        Regions are read in windows that overlap by half; where windows overlap their emissions are averaged,
        weighted towards window middles, and one Viterbi pass over the whole region decides.
        """
        found: list[list[Span]] = [[] for _ in texts]
        jobs = [(i, a, b) for i, t in enumerate(texts) for a, b in regions(t)]
        jobs.sort(key=lambda j: j[2] - j[1])
        at = 0
        while at < len(jobs):
            end = at + 1
            while end < len(jobs) and end - at < 256 and (end - at + 1) * (jobs[end][2] - jobs[end][1]) <= 1 << 17:
                end += 1
            part, at = jobs[at:end], end
            lengths = np.array([b - a for _, a, b in part])
            codes = [encode(texts[i][a:b]) for i, a, b in part]
            places = [(n, s) for n, c in enumerate(codes) for s in range(0, max(1, len(c) - STRIDE), STRIDE)]
            scores = np.zeros((len(part), int(lengths.max()) + WINDOW, len(TAGS)), np.float32)
            weight = np.zeros(scores.shape[:2], np.float32)
            for k in range(0, len(places), 512):
                some = places[k : k + 512]
                windows = np.zeros((len(some), WINDOW), np.int64)
                for row, (n, s) in enumerate(some):
                    c = codes[n][s : s + WINDOW]
                    windows[row, : len(c)] = c
                for (n, s), e in zip(some, self.model.emissions(windows)):
                    scores[n, s : s + WINDOW] += e * self.blend[:, None]
                    weight[n, s : s + WINDOW] += self.blend
            scores /= np.maximum(weight, 1e-6)[:, :, None]
            tags = self.model.viterbi(scores[:, : int(lengths.max())], lengths)
            for (i, a, _), row, length in zip(part, tags, lengths):
                marks = np.flatnonzero(row[:length])
                if not len(marks):
                    continue
                begin = None
                for p in [*marks.tolist(), int(length) + 1]:
                    tag = TAGS[row[p]] if p < length else "O"
                    if begin is not None and (p != last + 1 or tag[0] == "B" or p > length):  # noqa: F821
                        found[i].append((kind, a + begin, a + last + 1))  # noqa: F821
                        begin = None
                    if tag != "O" and begin is None:
                        begin, kind = p, tag[2:]  # noqa: F841
                    last = p  # noqa: F841
        return found

    def spans(self, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
        """Base spans and all spans of each text, by kind as in KINDS, then start."""
        order = {k: n for n, k in enumerate(KINDS)}
        out = []
        for text, extra in zip(texts, self.model_spans(texts)):
            base = sorted(base_spans(text), key=lambda s: (order[s[0]], s[1]))
            added = []
            for kind, a, b in extra:
                while a < b and text[a] in " \n\t,;:":
                    a += 1
                while a < b and text[b - 1] in " \n\t,;:.!?":
                    b -= 1
                if _valid(kind, text[a:b]) and all(b <= x or y <= a for _, x, y in base):
                    added.append((kind, a, b))
            out.append((base, sorted(base + added, key=lambda s: (order[s[0]], s[1]))))
        return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _pieces(batch: pa.RecordBatch, col: int, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def find(docs: DataFrame, keep: list[str], text_col: str = "text", model: Tagger | None = None) -> DataFrame:
    """Per row: `keep`, n_email, n_ip, n_card, n_phone (long, base), base_spans, spans (strings kind:start:end by kind, then start).

    Whole texts; null is empty. The model adds spans that overlap no base span; base spans stay. Positions are
    code points. Rows are independent: repeated rows give repeated results, an empty table an empty one.
    """
    model = model or default_model()
    fields = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"n_{k} bigint" for k in KINDS), "base_spans string", "spans string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector(model)
        for whole in batches:
            for batch in _pieces(whole, len(keep)):
                found = detector.spans([t or "" for t in batch.column(len(keep)).to_pylist()])
                counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
                cols = [batch.column(i) for i in range(len(keep))] + counts + [pa.array([_joined(b) for b, _ in found], pa.string()), pa.array([_joined(a) for _, a in found], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *(f"n_{k}" for k in KINDS), "base_spans", "spans"])

    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, fields)


def redact(docs: DataFrame, text_col: str = "text", model: Tagger | None = None) -> DataFrame:
    """docs with every span replaced by its kind in brackets, as in [EMAIL]; overlapping spans become one. Null stays null."""
    model = model or default_model()
    names = docs.columns

    def clean(text: str, spans: list[Span]) -> str:
        out, done = [], 0
        for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a >= done:
                out += [text[done:a], f"[{kind.upper()}]"]
            done = max(done, b)
        return "".join(out) + text[done:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector, at = Detector(model), names.index(text_col)
        for whole in batches:
            for batch in _pieces(whole, at):
                texts = batch.column(at).to_pylist()
                found = detector.spans([t or "" for t in texts])
                new = [None if t is None else clean(t, spans) if spans else t for t, (_, spans) in zip(texts, found)]
                cols = [pa.array(new, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, docs.schema)


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
