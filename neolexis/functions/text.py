"""Token, filter and gibberish expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A token: word characters, joined by single hyphens or apostrophes.
TOKEN = r"[\p{L}\p{N}_]+(?:[-'][\p{L}\p{N}_]+)*"
#: Repetition patterns. In the first, the second branch names group 1, which is unset there, so it
#: never matches; `strict` names group 2. The second has laughter, fillers and short repeated units.
REPEATED = r"(.)\1{4,}|^(.{1,3})\1{3,}$"
REPEATED_STRICT = r"(.)\1{4,}|^(.{1,3})\2{3,}$"
LAUGHTER = r"^(?:ha){3,}h?$|^(?:he){3,}h?$|^(?:lo){3,}l?$|^(?:um){2,}m?$|^(?:uh){2,}h?$|^(.)\1{3,}$|^(.{1,4})(?:\2){2,}.?$"


def tokens_of(text: Column | str) -> Column:
    """Lower-cased tokens; null for null text."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), 0), F.lower)


def _word_table() -> np.ndarray:
    """For each code point whether it is a letter, number or underscore."""
    global _WORD
    if _WORD is None:
        table = np.zeros(0x110000, bool)
        table[[c for c in range(0x110000) if chr(c).isalnum()]] = True
        table[ord("_")] = True
        _WORD = table
    return _WORD


_WORD: np.ndarray | None = None


def _find_tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Row, surface, start and end (code points of the row's text) of every token, by whole-array operations.

    A hyphen or apostrophe between two word characters belongs to a token; tokens are then the maximal runs.
    """
    texts = pc.fill_null(texts, "")
    size = pc.binary_length(texts).to_numpy().astype(np.int64)
    raw = _bytes(texts)
    codes = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    width = np.ones(len(codes), np.int64)
    if len(codes) < len(raw):
        width += (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
    after = np.cumsum(width)  # bytes up to and with each code point
    first = np.searchsorted(after, np.cumsum(size) - size, side="right")  # each text's first code point
    n = len(codes)
    begins = np.zeros(n + 1, bool)
    begins[first[first < n]] = True
    word = np.append(_word_table()[codes], False)
    joint = np.append((codes == 45) | (codes == 39), False)
    inside = word[:n].copy()
    # the neighbours are of the same text unless the character, or the next, begins one
    inside[1:] |= joint[1:n] & word[: n - 1] & word[2 : n + 1] & ~begins[1:n] & ~begins[2 : n + 1]
    before = np.append(False, inside[:-1]) & ~begins[:n]
    start = np.flatnonzero(inside & ~before)
    following = np.append(inside[1:], False) & ~begins[1 : n + 1]
    end = np.flatnonzero(inside & ~following) + 1
    row = np.searchsorted(first, start, side="right") - 1
    data = np.frombuffer(raw, np.uint8)
    keep = inside if len(codes) == len(raw) else np.repeat(inside, width)
    lengths = after[end - 1] - after[start] + width[start] if len(start) else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    surface = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[keep].tobytes()))
    return row, surface, (start - first[row]).astype(np.int32), (end - first[row]).astype(np.int32)


def _bytes(texts: pa.Array) -> bytes:
    """The texts' UTF-8, end to end."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return texts.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]] if len(texts) and texts.buffers()[2] is not None else b""


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes, at least a row each."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most)))
        yield at, end
        at = end


def _nested(rows: int, row: np.ndarray, values: list[pa.Array], names: list[str]) -> pa.ListArray:
    """The tokens of each of `rows` rows, as a list of structs; `row` is ascending."""
    offsets = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(values, names))


def _typed(df: DataFrame, columns: list[str]) -> list[str]:
    return [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns]


def _sizes(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)


def tokenize_with_offsets(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """A row for each token: `keep`, token, surface, token_start, token_end (int, code points, end exclusive).

    Rows without tokens vanish; null text has none. There is no shuffle. Offsets need a running position, which
    built-in expressions form only by summing over arrays element by element; here whole Arrow batches are split
    Tokens come back as a list a text, so that `keep` isn't repeated for each of them before the JVM has it.
    """
    fields = ", ".join([*_typed(df, keep), "_tokens array<struct<surface: string, token_start: int, token_end: int>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = whole.column(len(keep)).cast(pa.string())
            for a, b in _slices(_sizes(texts), 1 << 20):
                row, surface, start, end = _find_tokens(texts.slice(a, b - a))
                found = _nested(b - a, row, [surface, pa.array(start), pa.array(end)], ["surface", "token_start", "token_end"])
                yield pa.RecordBatch.from_arrays([*(whole.column(i).slice(a, b - a) for i in range(len(keep))), found], names=[*keep, "_tokens"])

    found = df.select(*keep, text_col).mapInArrow(run, fields).select(*keep, F.inline("_tokens"))
    return found.select(*keep, F.lower("surface").alias("token"), "surface", "token_start", "token_end")


def _runs(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of rows that are equal in all keys, none of which is null."""
    codes = [pc.dictionary_encode(batch.column(k)).indices.to_numpy(zero_copy_only=False) for k in keys]
    cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        if b > a:
            yield tuple(batch.column(k)[int(a)].as_py() for k in keys), batch.slice(a, b - a)


def distinct_surfaces(df: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """keys, surface: the surface forms of the texts of each run of rows with equal keys, once a run and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def out() -> pa.RecordBatch:
            surface = pc.unique(pa.concat_arrays(held))
            return pa.RecordBatch.from_arrays([*(pa.repeat(pa.scalar(v, t), len(surface)) for v, t in zip(at, kinds)), surface], names=[*keys, "surface"])

        for whole in batches:
            kinds = [whole.schema.field(k).type for k in keys]
            for key, part in _runs(whole, keys):
                if key != at and held:
                    yield out()
                    held = []
                at, texts = key, part.column(len(keys)).cast(pa.string())
                held += [pc.unique(_find_tokens(texts.slice(a, b - a))[1]) for a, b in _slices(_sizes(texts), 1 << 20)]
        if held:
            yield out()

    return df.select(*keys, text_col).mapInArrow(run, ", ".join([*_typed(df, keys), "surface string"]))


def tokenize_with_lexicon(df: DataFrame, text_col: str, keep: list[str], lexicon: DataFrame, keys: list[str], columns: list[str], how: str, pieces: int) -> DataFrame:
    """tokenize_with_offsets with `columns` of a lexicon (keys, surface, columns).

    how: `left` keeps all tokens, `inner` those in the lexicon, `anti` the others. Texts and lexicon are dealt by
    keys, each group's part of the lexicon before its texts; so tokens themselves are never shuffled, and a common
    one is a row a group. Columns of the lexicon must not be names of df.
    """
    spans = ["surface", "token_start", "token_end"]
    extra = [] if how == "anti" else columns
    struct = ", ".join(["surface: string, token_start: int, token_end: int", *(f"`{c}`: {lexicon.schema[c].dataType.simpleString()}" for c in extra)])
    sides = df.select(*keys, F.lit(1).alias("_side"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text"))
    sides = sides.unionByName(lexicon.select(*keys, F.lit(0).alias("_side"), F.col("surface").alias("_text"), *[F.col(c).alias(f"_x{i}") for i, c in enumerate(extra)]), allowMissingColumns=True)
    sides = sides.repartition(pieces, *keys).sortWithinPartitions(*keys, "_side")
    fields = ", ".join([*(f"`_k{i}` {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), f"_tokens array<struct<{struct}>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, known = None, [], None
        for whole in batches:
            for (*key, side), part in _runs(whole, [*keys, "_side"]):
                if key != at:
                    at, held, known = key, [], None
                if side == 0:
                    held.append(part.select(["_text", *(f"_x{i}" for i in range(len(extra)))]))
                    continue
                if known is None:
                    empty = part.select(["_text", *(f"_x{i}" for i in range(len(extra)))]).slice(0, 0)
                    known = pa.Table.from_batches([empty, *held]).combine_chunks()
                    words, held = pa.concat_arrays([c.cast(pa.string()) for c in known.column(0).chunks] or [pa.array([], pa.string())]), []
                texts = part.column("_text").cast(pa.string())
                for a, b in _slices(_sizes(texts), 1 << 20):
                    row, surface, start, end = _find_tokens(texts.slice(a, b - a))
                    values, place = [surface, pa.array(start), pa.array(end)], pc.index_in(surface, value_set=words)
                    if how != "left":
                        keep_ = place.is_null() if how == "anti" else place.is_valid()
                        row, values, place = row[keep_.to_numpy(zero_copy_only=False)], [v.filter(keep_) for v in values], place.filter(keep_)
                    more = [pa.concat_arrays(t.chunks) if t.num_chunks else pa.nulls(len(place), t.type) for t in (known.column(i + 1).take(place) for i in range(len(extra)))]
                    yield pa.RecordBatch.from_arrays([*(part.column(f"_k{i}").slice(a, b - a) for i in range(len(keep))), _nested(b - a, row, [*values, *more], [*spans, *extra])], names=[*(f"_k{i}" for i in range(len(keep))), "_tokens"])

    found = sides.mapInArrow(run, fields).select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.inline("_tokens"))
    return found.select(*keep, F.lower("surface").alias("token"), *spans, *extra)


def is_candidate(token: Column, min_len: int = 3, alphabetic_only: bool = False, allow_hyphen: bool = True, allow_apostrophe: bool = True, allow_underscore: bool = False, allow_numbers: bool = True) -> Column:
    """Whether a token has the form of a candidate: length, allowed characters, single connectors inside."""
    letters = "a-zA-Z" + ("0-9" if allow_numbers and not alphabetic_only else "") + ("_" if allow_underscore and not alphabetic_only else "")
    joints = ("-" if allow_hyphen else "") + ("'" if allow_apostrophe else "")
    form = f"^[{letters}]+([{joints}][{letters}]+)*$" if joints else f"^[{letters}]+$"
    # what isn't allowed isn't in the form's classes either
    return token.isNotNull() & (F.length(token) >= min_len) & token.rlike(form)


def is_gibberish(token: Column, strict: bool = False, laughter: bool = False) -> Column:
    found = token.rlike(REPEATED_STRICT if strict else REPEATED)
    return found | token.rlike(LAUGHTER) if laughter else found


def is_shouted(surface: Column) -> Column:
    """Whether a surface form is all capitals."""
    return (surface == F.upper(surface)) & (surface != F.lower(surface))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
