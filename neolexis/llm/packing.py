"""Optimal length buckets and token-budget batches."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, running_before

#: Lengths up to this have a bin each; above it every doubling has half as many bins.
EXACT = 1024


def length_bin(length: Column) -> Column:
    """Bin number of a length: exact up to EXACT, then EXACT / 2 bins an octave. At most about 28,000 for any long."""
    octave = F.greatest(F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double"))) - int(math.log2(EXACT)) + 1, F.lit(0)).cast("int")
    return F.when(length < EXACT, length).otherwise(F.lit(EXACT // 2) * octave.cast("long") + F.call_function("shiftright", length, octave)).cast("long")


def choose_buckets(longest: np.ndarray, count: np.ndarray, buckets: int) -> list[int]:
    """Upper lengths of at most `buckets` buckets with the least padding, by dynamic programming over the histogram.

    longest: longest length of each bin, ascending; count: documents in it. The padding of bins i..j in one
    bucket is longest[j] * (documents in i..j) less the words there, and the words add up to a constant. The
    best cut moves right with j, so each layer is solved by divide and conquer.
    """
    n = len(longest)
    if not n:
        return []
    docs = np.concatenate([[0.0], np.cumsum(count.astype(float))])
    best = longest * docs[1:]
    cuts = [np.zeros(n, np.int64)]
    for _ in range(1, min(buckets, n)):
        new, cut = np.empty(n), np.zeros(n, np.int64)
        todo = [(0, n - 1, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            first, last = min(a, mid), min(b, mid)
            starts = np.arange(first, last + 1)  # first bin of the last bucket
            cost = longest[mid] * (docs[mid + 1] - docs[starts]) + np.where(starts > 0, best[np.maximum(starts - 1, 0)], 0.0)
            k = int(np.argmin(cost))
            new[mid], cut[mid] = cost[k], first + k
            todo += [(lo, mid - 1, a, first + k), (mid + 1, hi, first + k, b)]
        best = new
        cuts.append(cut)
    out, j = [], n - 1
    for cut in reversed(cuts):
        out.append(int(longest[j]))
        j = int(cut[j]) - 1
        if j < 0:
            break
    return sorted(out)


def pack(docs: DataFrame, scratch: Scratch, columns: list[str], length: Column, order: Column, buckets: int = 16, budget: int = 65_536) -> DataFrame:
    """Per row of docs: `columns`, n_tokens, bucket (from 0), bucket_tokens (its upper length), batch (within the
    bucket), slot (within the batch).

    The histogram has a bounded number of bins whatever the input, and covers every row. A batch of a bucket
    holds max(1, budget // bucket_tokens) documents, so a padded batch stays within the budget unless a single
    document exceeds it. Only a bucket's last batch is not full. Null lengths count as 0; documents of length 0
    share the first bucket. Equal rows are interchangeable. `order` is a 64-bit hash that shuffles documents
    within a bucket. An empty table gives an empty result.
    """
    rows = scratch.save(docs.select(*columns, F.coalesce(length.cast("long"), F.lit(0)).alias("n_tokens"), order.alias("_order")), "lengths")
    bins = rows.groupBy(length_bin(F.col("n_tokens")).alias("bin")).agg(F.max("n_tokens").alias("longest"), F.count("*").alias("n")).orderBy("bin").collect()
    tops = choose_buckets(np.array([r.longest for r in bins], float), np.array([r.n for r in bins]), buckets)
    tops = tops or [0]
    found = F.lit(len(tops) - 1)
    for k in range(len(tops) - 2, -1, -1):
        found = F.when(F.col("n_tokens") <= tops[k], F.lit(k)).otherwise(found)
    top = F.element_at(F.array(*[F.lit(t).cast("long") for t in tops]), found + 1)
    rows = rows.withColumn("bucket", found).withColumn("bucket_tokens", top).withColumn("_one", F.lit(1).cast("long"))
    ranked = running_before(rows, "bucket", ["_order"], "_one", "_rank")
    room = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("bucket_tokens"), F.lit(1))), F.lit(1)).cast("long")
    return ranked.select(*columns, "n_tokens", "bucket", "bucket_tokens", F.floor(F.col("_rank") / room).cast("long").alias("batch"), (F.col("_rank") % room).cast("long").alias("slot"))
