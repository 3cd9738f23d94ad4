"""Substring duplicates: seed on winnowed anchors, extend both ways, remove maximal repeats.

A window is `window` consecutive words. Anchors are k-word sequences picked by winnowing: of every
window - k + 1 consecutive k-word sequences the one with the smallest hash. Whether one is picked depends only
on the words of a window around it, so equal windows hold the same anchors at the same places, and a repeated
window is found from its anchors.

1. Seed: count anchors by hash; those that occur once can't lie in a repeated window.
2. Extend: an anchor's reach is the text that windows around it can cover, window - k words on both sides. Where
   the whole reach repeats (same hash of the reach), every window around the anchor repeats. Otherwise the
   extension stops somewhere inside the reach: one occurrence of every distinct reach hashes the windows around
   the anchor, and those that repeat among distinct reaches are found by hash.
3. The union of repeated windows is each document's maximal repeats.

Hashes are 64 bits of polynomials over 64-bit word hashes; windows are compared by two of them (128 bits).
Hot anchors (a passage in a third of all documents) meet only map-side combined counts and joins that Spark
can split; no group is gathered. No step compares pairs of occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

ANCHOR = 8
_R1, _R2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def word_hashes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of words; `known` remembers those of a batch."""
    import xxhash

    out = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh64_intdigest(w, 9)
        out[i] = h
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(hashes: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """Hash of every run of `length` consecutive words, by doubling."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power, block, size, done, out = base, hashes.copy(), 1, 0, None
        left = length
        while left:
            if left & 1:
                out = block[:n].copy() if out is None else out * power + block[done : done + n]
                done += size
            left >>= 1
            if left:
                m = len(block) - size
                block = block[:m] * power + block[size : size + m]
                power, size = power * power, size * 2
        return _mixed(out)


def anchors(hashes: np.ndarray, window: int, k: int = ANCHOR) -> np.ndarray:
    """Places of the picked k-word sequences; the last of equal smallest hashes is picked."""
    grams = rolling(hashes, k, _R1)
    span = window - k + 1
    if len(grams) < span:
        return np.zeros(0, np.int64)
    # sliding minimum by doubling: of a pair of equal hashes the later place wins
    value, place, size = grams.copy(), np.arange(len(grams)), 1
    while size < span:
        step = min(size, span - size)
        a, b = slice(0, len(value) - step), slice(step, len(value))
        later = value[b] <= value[a]
        value, place = np.where(later, value[b], value[a]), np.where(later, place[b], place[a])
        size += step
    return np.unique(place)


def reach_hashes(hashes: np.ndarray, places: np.ndarray, window: int, k: int = ANCHOR) -> np.ndarray:
    """Hash of the words that windows around each anchor cover, and of where the document ends in it."""
    wide = window - k
    length = 2 * wide + k
    ends = np.concatenate([np.full(wide, 1, np.uint64), hashes, np.full(wide, 2, np.uint64)])  # beyond the document
    return rolling(ends, length, _R2)[places]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _texts(batch: pa.RecordBatch, col: int) -> Iterator[tuple[int, list[bytes]]]:
    for i, t in enumerate(batch.column(col)):
        t = t.as_py()
        yield i, (t.encode("utf-8", "surrogatepass").split() if t else [])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """Per row: id_col, n_words, n_removed (long), kept (string, the kept words joined by one space), kept_sha256.

    Words are runs of other characters than ASCII white space, unchanged. A word goes if a window that covers it
    also starts elsewhere, in the same or another document; the input decides, not what is left. Null and empty
    texts have no words. Repeated rows repeat each other's windows. Rows of equal id and text give equal
    results. Texts are read whole. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    wide = window - ANCHOR
    keyed = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("body")).withColumn("print", F.xxhash64("body"))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[bytes, int] = {}
            rows: list[np.ndarray] = []
            found: list[tuple[np.ndarray, ...]] = []
            held = 0
            for i, words in _texts(batch, 2):
                if len(words) < window:
                    continue
                h = word_hashes(words, known)
                at = anchors(h, window)
                found.append((rolling(h, ANCHOR, _R1)[at], reach_hashes(h, at, window), at))
                rows.append(np.full(len(at), i))
                held += len(at)
                if held > 100_000:
                    yield seed_batch(batch, rows, found)
                    rows, found, held = [], [], 0
                if len(known) > 300_000:
                    known = {}
            if rows:
                yield seed_batch(batch, rows, found)

    def seed_batch(batch: pa.RecordBatch, rows: list[np.ndarray], found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        take = pa.array(np.concatenate(rows))
        anchor, reach, at = (np.concatenate(x) for x in zip(*found))
        return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(at.astype(np.int32)), _signed(anchor), _signed(reach)], names=["doc", "print", "place", "anchor", "reach"])

    kind = keyed.schema["doc"].dataType.simpleString()
    seeded = scratch.save(keyed.select("doc", "print", "body").mapInArrow(seeds, f"doc {kind}, print bigint, place int, anchor bigint, reach bigint"), "seeds")
    # written first: Spark splits the tasks of a hot key only in joins whose sides come straight from a shuffle
    repeated = scratch.save(seeded.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    live = scratch.save(seeded.join(repeated, "anchor"), "live")
    scratch.drop(seeded)
    # per anchor and reach: how often, and any one occurrence
    counted = live.groupBy("anchor", "reach").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("doc", "print", "place")))
    reaches = scratch.save(counted, "reaches")
    several = reaches.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor")
    several = scratch.save(several, "several")
    # every window around an occurrence of a repeated reach repeats
    whole = live.join(reaches.where("n > 1").select("anchor", "reach"), ["anchor", "reach"]).select("doc", "print", "place", F.lit(True).alias("whole"))
    # where an anchor has several reaches, one occurrence of each says which windows they share
    probes = reaches.join(several, "anchor").select("doc", "print", "place", (F.col("n") > 1).alias("whole"))
    asked = probes.groupBy("doc", "print").agg(F.collect_set(F.struct("place", "whole")).alias("probes"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, words in _texts(batch, 2):
                h = word_hashes(words, {})
                first, second = rolling(h, window, _R1), rolling(h, window, _R2)
                own: dict[int, bool] = {}
                for p in batch.column(3)[i].as_py():
                    for s in range(max(0, p["place"] - wide), min(len(first), p["place"] + 1)):
                        own[s] = own.get(s, False) or p["whole"]
                starts = np.fromiter(own, np.int64, len(own))
                known = np.fromiter(own.values(), bool, len(own))
                take = pa.array(np.full(len(starts), i))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(starts.astype(np.int32)), pa.array(known), _signed(first[starts]), _signed(second[starts])], names=["doc", "print", "start", "known", "first", "second"])

    def with_text(right: DataFrame, column: str) -> DataFrame:
        right = right.select(F.col("doc").alias("_d"), F.col("print").alias("_p"), column)
        return keyed.join(right, keyed["doc"].eqNullSafe(right["_d"]) & keyed["print"].eqNullSafe(right["_p"]))

    probed = with_text(asked, "probes").select("doc", "print", "body", "probes").mapInArrow(extend, f"doc {kind}, print bigint, start int, known boolean, first bigint, second bigint")
    windows = scratch.save(probed, "windows")
    # a window known from a repeated reach counts as two places already
    many = windows.groupBy("first", "second").agg(F.count("*").alias("n"), F.bool_or("known").alias("any")).where("n > 1 or any").select("first", "second")
    many = scratch.save(many, "many")
    single = windows.where("not known").join(many, ["first", "second"]).select("doc", "print", F.col("start").alias("place"), F.lit(False).alias("whole"))
    marks = scratch.save(whole.unionByName(single).groupBy("doc", "print").agg(F.collect_set(F.struct("place", "whole")).alias("marks")), "marks")
    for done_with in (repeated, several, many, live, reaches, windows):
        scratch.drop(done_with)
    marks = marks.select(F.col("doc").alias("_d"), F.col("print").alias("_p"), "marks")
    final = keyed.join(marks, keyed["doc"].eqNullSafe(marks["_d"]) & keyed["print"].eqNullSafe(marks["_p"]), "left").select("doc", "body", "marks")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for i, words in _texts(batch, 1):
                marked = batch.column(2)[i].as_py() or []
                if marked:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for m in marked:
                        a, b = (max(0, m["place"] - wide), min(len(words), m["place"] + window)) if m["whole"] else (m["place"], m["place"] + window)
                        edge[a] += 1
                        edge[b] -= 1
                    gone = np.cumsum(edge[:-1]) > 0
                    left = [w for w, g in zip(words, gone.tolist()) if not g]
                else:
                    left = words
                kept = b" ".join(left)
                out.append((i, len(words), len(words) - len(left), kept.decode("utf-8", "surrogatepass"), hashlib.sha256(kept).hexdigest()))
                held += len(kept)
                if held > 8 << 20:
                    yield done(batch, out)
                    out, held = [], 0
            yield done(batch, out)

    def done(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        at, n, gone, kept, sha = (pa.array(c, k) for c, k in zip(cols, kinds))
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), n, gone, kept, sha], names=[id_col, "n_words", "n_removed", "kept", "kept_sha256"])

    return final.mapInArrow(finish, f"`{id_col}` {kind}, n_words bigint, n_removed bigint, kept string, kept_sha256 string")
