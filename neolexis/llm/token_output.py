"""Token ids in ORC: run-length encoded stripes, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_path

#: Encoded pieces of words that a worker keeps; beyond it the least recently used half goes.
CACHE_WORDS = 500_000
#: Letters whose lower case is one character each, and marks after them: the splitter cuts between the two.
_CORE = r"^(?P<letters>[a-zA-Z\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{012F}]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"
#: Folder below the data with the number of ids of each file; readers of the data pass over it.
TOTALS = "_totals"
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Encodes texts with a tokenizer that drops white space, each distinct piece of a word of a batch once.

    The vocabulary's normalizer and splitter never join characters over white space, so a text's ids are the
    ids of its words between ASCII white space, one after the other; neither do they join letters with marks
    other than the apostrophe (tests compare this with encoding whole texts). Words are split, lower-cased and
    looked up by Arrow's kernels; only pieces not seen before meet the tokenizer. The ids of known pieces lie
    in one array; the number of known pieces is bounded.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # lower-cased runs of letters and of marks are left as they are by the normalizer and the splitter
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.mark = self.tokenizer.encode("7", add_special_tokens=False).ids
        self.known = pa.array([], pa.string())
        self.flat, self.begin, self.size, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.end = self.batch = 0

    def _add(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        at, n = len(self.known), len(words)
        while self.end + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while at + n > len(self.begin):
            self.begin, self.size, self.used = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size, self.used))
        self.flat[self.end : self.end + len(ids)] = ids
        self.begin[at : at + n] = self.end + np.cumsum(sizes) - sizes
        self.size[at : at + n] = sizes
        self.end += len(ids)
        self.known = pa.concat_arrays([self.known, words])

    def _encode_new(self, words: pa.Array, plain: bool) -> None:
        """Distinct pieces that aren't known yet; plain ones are runs of lower-case letters or of marks."""
        # a digit is always a token of its own, so many plain pieces go in one call and are cut apart at it
        for at in range(0, len(words), 4096):
            part = words.slice(at, 4096)
            if plain and len(self.mark) == 1:
                ids = np.array(self.plain.encode_batch_fast([" 7 ".join(part.to_pylist())], add_special_tokens=False)[0].ids, np.int32)
                inside = ids != self.mark[0]
                cuts = np.flatnonzero(~inside)
                if len(cuts) == len(part) - 1:
                    edges = np.concatenate([[-1], cuts, [len(ids)]])
                    self._add(part, ids[inside], np.diff(edges) - 1)
                    continue
            found = [e.ids for e in self.tokenizer.encode_batch_fast(part.to_pylist(), add_special_tokens=False)]
            self._add(part, np.array([i for x in found for i in x], np.int32), np.fromiter(map(len, found), np.int64, len(found)))

    def _forget(self) -> None:
        n = len(self.known)
        keep = np.flatnonzero(self.used[:n] > np.partition(self.used[:n], n // 2)[n // 2])
        words, sizes, flat, used = self.known.take(pa.array(keep)), self.size[keep], self._gather(keep), self.used[keep]
        self.known, self.end = pa.array([], pa.string()), 0
        self._add(words, flat, sizes)
        self.used[: len(keep)] = used

    def _gather(self, slots: np.ndarray) -> np.ndarray:
        sizes = self.size[slots].astype(np.int64)
        total = np.cumsum(sizes)
        return self.flat[np.repeat(self.begin[slots] - total + sizes, sizes) + np.arange(total[-1] if len(total) else 0)]

    def _slots(self, pieces: pa.Array, plain: np.ndarray) -> np.ndarray:
        """Places of pieces among the known; `plain` says which are runs of lower-case letters or of marks."""
        coded = pieces.dictionary_encode()
        distinct, indices = coded.dictionary, coded.indices.to_numpy()
        is_plain = np.zeros(len(distinct), bool)
        is_plain[indices] = plain
        slots = pc.fill_null(pc.index_in(distinct, value_set=self.known), -1).to_numpy().astype(np.int64)
        new = slots < 0
        for kind in (True, False):
            at, begin = np.flatnonzero(new & (is_plain == kind)), len(self.known)
            self._encode_new(distinct.take(pa.array(at)), kind)
            slots[at] = np.arange(begin, begin + len(at))
        self.used[slots] = self.batch
        return slots[indices]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and each text's number of ids."""
        self.batch += 1
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        # a distinct word is one piece, or letters in lower case and marks, the latter often empty
        parts = pc.extract_regex(words, _CORE)
        whole = parts.is_null()
        letters = pc.if_else(whole, words, pc.utf8_lower(parts.field(0)))
        marks = pc.if_else(whole, "", parts.field(1))
        n, whole = len(words), whole.to_numpy(zero_copy_only=False)
        has = np.flatnonzero(pc.not_equal(marks, "").to_numpy(zero_copy_only=False))
        slots = self._slots(pa.concat_arrays([letters, marks.take(pa.array(has))]), np.concatenate([~whole, np.ones(len(has), bool)]))
        # the two pieces of a word next to each other
        row = np.argsort(np.concatenate([np.arange(n), has]), kind="stable")
        slots = slots[row]
        count = np.ones(n, np.int64)
        count[has] = 2
        ends = np.concatenate([[0], np.cumsum(self.size[slots])])[np.concatenate([[0], np.cumsum(count)])]
        each = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(self._gather(slots)))
        taken = each.take(coded.indices)
        total = np.asarray(taken.offsets)
        offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        if len(self.known) > CACHE_WORDS:
            self._forget()
        return np.asarray(taken.values)[total[0] : total[-1]], (total[offsets[1:]] - total[offsets[:-1]]).astype(np.int64)


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _pieces(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about `most` bytes of text, at least a row each."""
    at = 0
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most)))
        yield batch.slice(at, end - at)
        at = end


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, stripe_bytes: int = 16 << 20, row_stride: int = 1000) -> None:
    """Write doc_id, part, before, n_tokens, ids as ORC in ascending id order (null ids first).

    Files hold disjoint ascending ranges of ids; within a file rows ascend, so stripe and row-group minima and
    maxima prune ranges of ids and the Bloom filters prune single ids. ORC's run-length encoding holds the ids.
    `before` counts the ids of earlier rows of the same file. Null or empty text gives the end id alone. Rows
    with equal ids stay together in one file. An empty table writes files without rows. The files' totals are
    written beside them, so that a reader of few documents need not read all to know where they start.
    """
    schema = "doc_id bigint, part int, before bigint, n_tokens int, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, done = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in _pieces(whole):
                ids, sizes = enc.encode(batch.column(1))
                ends = np.cumsum(sizes)
                ids = np.insert(ids, ends, end_id)
                sizes = sizes + 1
                ends = np.cumsum(sizes)
                before = done + ends - sizes
                done += int(ends[-1]) if len(ends) else 0
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(sizes), part, np.int32)), pa.array(before), pa.array(sizes.astype(np.int32)), lists], names=["doc_id", "part", "before", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    (
        ordered.mapInArrow(run, schema).write.option("compression", "zstd").option("orc.stripe.size", stripe_bytes).option("orc.create.index", "true")
        .option("orc.row.index.stride", row_stride).option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path)
    )
    totals = _rows(docs.sparkSession, path).groupBy("part").agg(F.max(F.col("before") + F.col("n_tokens")).alias("total"))
    totals.write.parquet(f"{path}/{TOTALS}")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id bigint, part int, before bigint, n_tokens int, ids array<int>").orc(path)


def _with_start(rows: DataFrame, path: str) -> DataFrame:
    """Replace part and before by start, from the totals written beside the data: one row a file."""
    totals = rows.sparkSession.read.schema("part int, total bigint").parquet(f"{path}/{TOTALS}")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("part").alias("_part"), F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("_base"))
    return rows.join(bases, rows["part"] == bases["_part"]).withColumn("start", F.col("_base") + F.col("before")).drop("part", "before", "_part", "_base")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The written rows with start: the number of ids of all documents before, over all files.

    Rows are read stripe-parallel.
    """
    return _with_start(_rows(spark, path), path)


def lookup(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """One document's ids: stripes and row groups without it are pruned by minima, maxima and Bloom filters."""
    return _with_start(_rows(spark, path).where(F.col("doc_id") == doc_id), path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens (long) and ids_crc32 (long) of the written ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            offsets = np.asarray(lists.offsets)
            values = np.asarray(lists.values).astype("<u4")
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, pa.int64())], names=["doc_id", "part", "before", "n_tokens", "ids_crc32"])

    rows = _rows(spark, path)
    sums = rows.select("doc_id", "part", "before", F.col("n_tokens").cast("long").alias("n_tokens"), "ids").mapInArrow(run, "doc_id long, part int, before long, n_tokens long, ids_crc32 long")
    return _with_start(sums, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def written_tokens(docs: DataFrame, tokenizer_path: str) -> str:
    """Write docs below the shared folder; returns the path."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path)
    return path
