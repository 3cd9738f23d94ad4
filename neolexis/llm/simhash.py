"""SimHash near-duplicates by pivot distance tables.

A fingerprint's pivot distances are its Hamming distances to fixed reference fingerprints. They are computed
once for each distinct fingerprint and stored as a column beside it (pivot_table). If two fingerprints
differ in at most r bits, no distance differs by more than r (triangle inequality): pairs with a larger
coordinate difference are discarded, and survivors are verified on the fingerprints themselves.

Distances to references spread over all 64 bits concentrate around 32 and can't index a large table alone. So
the tables that propose pairs use references within groups of bits: zero and the unit fingerprints of the
group. The differences between a fingerprint's distance to zero and to the group's units are exactly the
group's bits, so equal coordinate vectors are equal masked fingerprints, and that is how they are computed.
With 6 groups, fingerprints that differ in at most 4 bits agree on all coordinates of at least 2 groups: the
15 tables for pairs of groups lose no link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch
from .components import components

#: Rows of one side of a comparison in one task.
BLOCK = 1024
_M = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mix(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent 64-bit hash made from a 64-bit hash (splitmix64); k=0 is the hash itself."""
    if not k:
        return x
    with np.errstate(over="ignore"):
        z = x + np.uint64((0x9E3779B97F4A7C15 * k) & _M)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def text_fingerprint(text: str | None, shingle: int, words: int = 1) -> list[int]:
    """Signed 64-bit fingerprints of a text; all zero if it has no words."""
    return _majority(shingle_hashes(text, shingle), words)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """64-bit hashes of a text's shingles, in order; of a shorter text the hash of all its words, of one without words none."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    if not parts:
        return np.array([], np.uint64)
    if len(parts) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), 42)], np.uint64)
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip((ends - lengths)[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())], np.uint64)


def _majority(hashes: np.ndarray, words: int) -> list[int]:
    if not len(hashes):
        return [0] * words
    out = []
    for k in range(words):
        mixed, ones = _mix(hashes, k), np.zeros(64, np.int64)
        for at in range(0, len(mixed), 1 << 16):
            part = mixed[at : at + (1 << 16)]
            ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        bits = ones * 2 > len(mixed)
        out.append(_signed(int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")))
    return out


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", shingle: int = 4, words: int = 1) -> DataFrame:
    """The columns `keep` and f0, f1, ... (long): fingerprints of the whole text."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(f"f{k}", T.LongType()) for k in range(words)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_fingerprint(t, shingle, words) for t in batch.column(len(keep)).to_pylist()]
            cols = [batch.column(i) for i in range(len(keep))] + [pa.array([f[k] for f in found], pa.int64()) for k in range(words)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *(f"f{k}" for k in range(words))])

    return docs.select(*keep, text_col).mapInArrow(run, schema)


def group_masks(groups: int = 6, same: int = 2) -> list[list[int]]:
    """Masks of all choices of `same` out of `groups` bit groups of one fingerprint."""
    cuts = np.linspace(0, 64, groups + 1).round().astype(int).tolist()
    parts = [sum(1 << i for i in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    return [[sum(c)] for c in combinations(parts, same)]


def sampled_masks(tables: int, bits: int, words: int, seed: int = 7) -> list[list[int]]:
    """Masks of random groups of bits out of all bits of `words` fingerprints; each round uses every bit about once."""
    rng, out, pool = np.random.default_rng(seed), [], []
    for _ in range(tables):
        if len(pool) < bits:
            pool = rng.permutation(64 * words).tolist()
        chosen, pool = pool[:bits], pool[bits:]
        out.append([sum(1 << (i % 64) for i in chosen if i // 64 == k) for k in range(words)])
    return out


def pivots(words: int, count: int = 16, seed: int = 11) -> np.ndarray:
    """Reference fingerprints: count x words, random and thus spread over all bits."""
    return np.random.default_rng(seed).integers(0, 1 << 63, (count, words), np.uint64) * np.uint64(2) + np.uint64(1)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int16)


def pivot_distances(prints: np.ndarray) -> np.ndarray:
    """Rows x references (uint8): distances of fingerprints (rows x words). One of 256 counts as 255, which only shrinks differences."""
    return np.stack([np.minimum(_distance(prints, r), 255) for r in pivots(prints.shape[1])], 1).astype(np.uint8)


def _packed(table: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    n, width = table.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(table).tobytes())])


def _unpacked(column: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.uint8)


def pivot_table(prints: DataFrame, words: int) -> DataFrame:
    """prints with the column d: the pivot distances of f0, f1, ..., a byte each."""
    names = prints.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.stack([batch.column(names.index(f"f{k}")).to_numpy(zero_copy_only=False) for k in range(words)], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, _packed(pivot_distances(np.ascontiguousarray(rows).view(np.uint64)))], names=[*names, "d"])

    return prints.mapInArrow(run, T.StructType([*prints.schema.fields, T.StructField("d", T.BinaryType())]))


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components, at most n - 1: each node with the first of its component."""
    from numpy import minimum

    label = np.arange(n)
    while True:
        low = minimum(label[left], label[right])
        new = label.copy()
        minimum.at(new, left, low)
        minimum.at(new, right, low)
        new = minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(n))
    return label[at], at


#: A set's size; its hashes from the shared one on; those that another set may share; where its prefix ends in the order.
PLACE = ("size", "room", "left", "last")


def _reachable(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two sets (rows of PLACE) that meet at their first shared hash may share 8/18 of both sizes' sum, which 0.8 takes.

    What they share lies at or behind that hash in both. And of the set whose prefix ends first, a hash of the prefix
    that the other holds is in the other's prefix too: those that no other prefix has are not shared (left is without them).
    """
    left = np.where(a[:, 3] < b[:, 3], a[:, 2], np.where(a[:, 3] > b[:, 3], b[:, 2], np.maximum(a[:, 2], b[:, 2])))
    return 9 * np.minimum(left, np.minimum(a[:, 1], b[:, 1])) >= 4 * (a[:, 0] + b[:, 0])


def _link_runs(batches: Iterator[pa.RecordBatch], words: int, most: int, placed: bool = False) -> Iterator[pa.RecordBatch]:
    """From rows sorted by unit, with their pivot distances: the links within each unit, as a forest. Holds one unit and one batch.

    placed: rows are sets at a hash of theirs, with the columns PLACE; pairs that can't share enough for 0.8 are discarded first.
    """
    names = ["unit", "id", *(f"f{k}" for k in range(words)), *(PLACE if placed else ())]
    rest: tuple[np.ndarray, np.ndarray] | None = None

    def link(rows: np.ndarray, table: np.ndarray) -> Iterator[pa.RecordBatch]:
        unit, ids = rows[:, 0], rows[:, 1]
        prints, table = np.ascontiguousarray(rows[:, 2 : 2 + words]).view(np.uint64), table.astype(np.int16)
        found_a, found_b = [], []
        live = np.arange(len(rows))
        for step in range(1, len(rows)):
            live = live[live + step < len(rows)]
            live = live[unit[live] == unit[live + step]]
            if not len(live):
                break
            a = live
            if placed:
                a = a[_reachable(rows[a, -4:], rows[a + step, -4:])]
            for c in range(table.shape[1]):  # coordinate by coordinate: most pairs fail early
                a = a[np.abs(table[a, c] - table[a + step, c]) <= most]
                if not len(a):
                    break
            if len(a):
                a = a[_distance(prints[a], prints[a + step]) <= most]
                found_a.append(a)
                found_b.append(a + step)
        if found_a:
            a, b = _forest(len(rows), np.concatenate(found_a), np.concatenate(found_b))
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names], 1)
        table = _unpacked(batch.column(batch.schema.get_field_index("d")))
        if rest is not None:
            rows, table = np.concatenate([rest[0], rows]), np.concatenate([rest[1], table])
        cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))  # the last unit may go on
        yield from link(rows[:cut], table[:cut])
        rest = rows[cut:], table[cut:]
    if rest is not None:
        yield from link(*rest)


def _units(sized: DataFrame, cols: list[str], block: int) -> DataFrame:
    """From key, n (its rows), id and cols: unit, id, cols, sorted by unit; any two rows of a key meet in a unit of about `block` rows."""
    chunks = F.when(F.col("n") <= block, F.lit(1)).otherwise(F.ceil(F.col("n") / (block // 2)))
    own = F.pmod(F.xxhash64("id", F.lit("chunk")), F.col("chunks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    units = (
        sized.withColumn("chunks", chunks.cast("long")).withColumn("own", own).select("id", *cols, "key", "chunks", "own", other.alias("other"))
        .select(F.when(F.col("chunks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).alias("unit"), "id", *cols)
    )
    return units.repartition("unit").sortWithinPartitions("unit")


def link_fingerprints(prints: DataFrame, masks: list[list[int]], most: int, words: int, scratch: Scratch) -> DataFrame:
    """Links a, b (ids) with the components of all pairs that share a masked fingerprint and differ in at most `most` bits.

    prints: id, f0, f1, ..., d (their pivot distances); ids and fingerprints distinct, in the shared folder.
    Within a table a bucket of up to BLOCK fingerprints is one unit. A larger one is cut into chunks of about
    BLOCK / 2, and each pair of chunks is a unit: no task gets an unbounded group, and nothing is left out.
    """
    cols = [f"f{k}" for k in range(words)]
    keyed = prints.select("id", *cols, "d", F.explode(F.array(*[F.xxhash64(F.lit(t), *[F.col(c).bitwiseAND(F.lit(_signed(m))) for c, m in zip(cols, mask)]) for t, mask in enumerate(masks)])).alias("key"))
    # written first: a join with it can then be split where a key is hot
    counts = scratch.save(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    return _units(keyed.join(counts, "key"), [*cols, "d"], BLOCK).mapInArrow(lambda batches: _link_runs(batches, words, most), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, most: int = 4, words: int = 1, masks: list[list[int]] | None = None, carry: list[str] = ()) -> DataFrame:
    """Per document: id_col, the columns `carry`, f0.. (long), component_id (smallest id reachable by links of at most `most` differing bits).

    Every row of docs gives one row. Null and empty texts have fingerprint zero and are linked like any other.
    Equal fingerprints are one class; a null id takes part, and is a component's id only if it has no other.
    Very long texts are read whole. Other columns of docs play no part. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    cols = [f"f{k}" for k in range(words)]
    carried = [f"carry{i}" for i in range(len(carry))]
    named = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("body"), *[F.col(c).alias(n) for c, n in zip(carry, carried)])
    rows = scratch.save(fingerprints(named, ["doc", *carried], "body", shingle, words), "fingerprints")
    # a class's id is a hash of its fingerprint: for one word the fingerprint itself, which is unique
    class_id = F.col("f0") if words == 1 else F.xxhash64(*cols)
    classes = rows.groupBy(*cols).agg(F.min("doc").alias("least"), F.count("*").alias("copies")).withColumn("id", class_id)
    classes = scratch.save(pivot_table(classes, words), "classes")
    links = link_fingerprints(classes.select("id", *cols, "d"), masks or group_masks(), most, words, scratch)
    label = components(spark, links, scratch)
    linked = classes.select("id", *cols, "least").join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    linked = scratch.save(linked, "labelled")
    # a component or a fingerprint may hold a third of the rows: what joins them is written first, so that Spark can split them
    smallest = scratch.save(linked.groupBy("component").agg(F.min("least").alias("component_id")), "smallest")
    of_class = scratch.save(linked.join(smallest, "component").select(*cols, "component_id"), "of_class")
    return rows.join(of_class, cols).select(F.col("doc").alias(id_col), *[F.col(n).alias(c) for c, n in zip(carry, carried)], *cols, "component_id")


#: Shingle sets of one side of an exact comparison in one task.
SETS = 256
#: One text in as many is read for the hashes that many texts share; so many of them at most are told to all tasks.
SAMPLED, COMMON = 32, 1 << 18
#: Sets of a large group that all its other sets are compared with.
HUBS = 4


def _often(hashes: np.ndarray, common: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """How often each hash was seen in the sample; 0 for those not in `common` (sorted)."""
    if not len(common):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    return np.where(common[at] == hashes, seen[at], 0)


def prefix_end(prefix: np.ndarray, often: np.ndarray) -> int:
    """Where the last hash of a prefix stands in the order, but for hashes that agree in their first half."""
    return (int(often[-1]) << 32) + (int(prefix[-1]) >> 32) if len(prefix) else 0


def prefix(hashes: np.ndarray, often: np.ndarray | None = None) -> np.ndarray:
    """Of sorted distinct hashes the first that two sets of similarity 0.8 can't both miss: the rarest, equally rare ones by value.

    The sets share at least 0.8 of either's members, so each misses at most a fifth of its own: the first
    shared one is among the first n - ceil(0.8 n) + 1 of both. That holds in any order which is the same for
    all sets; with common hashes last, a line in a tenth of all texts proposes next to none of their pairs.
    """
    n = len(hashes)
    if often is not None and often.any():
        hashes = hashes[np.argsort(often, kind="stable")]
    return hashes[: n - (4 * n + 4) // 5 + 1] if n else hashes


def common_hashes(docs: DataFrame, shingle: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """From print, body: shingle hashes that a sample of the texts holds twice or more, ascending, and how often; at most COMMON.

    They only set the order of hashes, on which no link depends: what the sample misses costs time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                sets = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in whole.column(0).slice(at, 64).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets))], names=["key"])

    sample = docs.where(F.pmod(F.xxhash64("print", F.lit("sample")), F.lit(SAMPLED)) == 0).select("body")
    counts = scratch.save(sample.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "common")
    least, held = None, 0
    for n, keys in sorted(counts.groupBy("n").count().collect(), reverse=True):
        held += keys
        if held > COMMON:
            break
        least = n
    if least is None:
        return np.array([], np.uint64), np.array([], np.int64)
    found = counts.where(F.col("n") >= least).toArrow()
    scratch.drop(counts)
    keys = found.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found.column("n").to_numpy()[order]


def alike(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of sets (distinct hashes each) of Jaccard similarity 0.8 or more, in whole numbers."""
    n, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    _, code, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)[held[code] > 1]
    code = np.unique(code[held[code] > 1], return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    shared = np.zeros((n, n), np.float32)  # counts below 2 ** 24 are exact
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        a, b = np.searchsorted(code, [at, at + 4096])
        x = np.zeros((n, 4096), np.float32)
        x[row[a:b], code[a:b] - at] = 1
        shared += x @ x.T
    both = shared.astype(np.int64)
    return np.nonzero(np.triu((both > 0) & (5 * both >= 4 * (sizes[:, None] + sizes[None, :] - both)), 1))


def _alike_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows unit, id, hashes sorted by unit: the links within each unit, as a forest."""
    unit, ids, sets = None, [], []

    def link() -> Iterator[pa.RecordBatch]:
        if len(ids) > 1:
            a, b = _forest(len(ids), *alike(sets))
            names = np.array(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names[a]), pa.array(names[b])], names=["a", "b"])

    for batch in batches:
        hashes = batch.column(2)
        for k, (u, i) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if u != unit:
                yield from link()
                unit, ids, sets = u, [], []
            ids.append(i)
            sets.append(hashes[k].values.to_numpy(zero_copy_only=False).copy())
    yield from link()


def _exact_components(sets: DataFrame, sizes: DataFrame, loose: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component of all links between sets (id, key, hashes) of one key; sizes: key, n. loose: id, key, own (hashes not common).

    Keys of up to SETS sets are one unit. A larger one is cut into pieces of about SETS, each compared within itself
    and with the key's hubs, its sets of fewest own hashes: near copies of one text meet there in one class. Pairs
    within the largest class need no more links; every set outside it is compared with all others. So a group of near
    copies costs what its size is, not its square, and no component depends on the hubs.
    """
    spark, half = sets.sparkSession, SETS // 2
    unit = F.when(F.col("n") <= SETS, F.col("key")).otherwise(F.xxhash64("key", "piece")).alias("unit")
    pieces = sizes.withColumn("pieces", F.ceil(F.col("n") / SETS).cast("long"))
    rows = sets.join(pieces, "key").withColumn("piece", F.pmod(F.xxhash64("id", F.lit("piece")), F.col("pieces"))).select(unit, "id", "hashes")
    large = sizes.where(F.col("n") > SETS)
    if large.isEmpty():
        return components(spark, _alike(rows), scratch)
    hubs = loose.join(large, "key").groupBy("key", F.pmod(F.xxhash64("id", F.lit("hub")), F.lit(HUBS)).alias("hub")).agg(F.min(F.struct("own", "id"))["id"].alias("id"))
    hubs = scratch.save(hubs.join(pieces, "key").select("id", "n", "pieces"), "hubs")
    copies = sets.join(hubs, "id").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).select(unit, "id", "hashes")
    near = scratch.save(_alike(rows.union(copies)), "near")
    label = components(spark, near, scratch)
    members = loose.join(large.select("key"), "key").join(label.withColumnRenamed("node", "id"), "id", "left").select("id", "key", F.coalesce("component", "id").alias("class"))
    members = scratch.save(members, "members")
    classes = scratch.save(members.groupBy("key", "class").agg(F.count("*").alias("n")), "classes")
    main = classes.groupBy("key").agg(F.max(F.struct("n", "class")).alias("main"), F.sum("n").alias("all"))
    main = scratch.save(main.select("key", F.col("main.class").alias("main"), F.col("main.n").alias("inner"), (F.col("all") - F.col("main.n")).alias("outer")).where("outer > 0"), "main")
    if main.isEmpty():
        return label
    # pieces of the largest class are numbered first, then those of the other sets, which meet all
    at = lambda n: F.ceil(F.col(n) / half).cast("long")
    piece = lambda n: F.pmod(F.xxhash64("id", F.lit("piece")), at(n))
    placed = members.join(main, "key").withColumn("inside", F.col("class") == F.col("main"))
    placed = placed.withColumn("piece", F.when(F.col("inside"), piece("inner")).otherwise(at("inner") + piece("outer")))
    meets = F.sequence(F.when(F.col("inside"), at("inner")).otherwise(F.lit(0).cast("long")), at("inner") + at("outer") - 1)
    placed = placed.select("id", F.explode(meets).alias("other"), "key", "piece").select("id", F.xxhash64("key", F.least("piece", "other"), F.greatest("piece", "other")).alias("unit"))
    placed = scratch.save(placed, "placed")
    more = _alike(sets.select("id", "hashes").join(placed, "id").select("unit", "id", "hashes"))
    return components(spark, label.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), scratch)


def _alike(rows: DataFrame) -> DataFrame:
    """From unit, id, hashes: links a, b that connect all pairs of similarity 0.8 or more within each unit."""
    return rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(_alike_runs, "a long, b long")


def similar_documents(docs: DataFrame, id_col: str, print_col: str, text_col: str = "text", shingle: int = 5, most: int = 80, words: int = 4) -> DataFrame:
    """Per row of docs: id_col, print_col (a hash of the text), set (long, the same for equal shingle sets) and component.

    Components are those of all pairs whose sets of shingles have a Jaccard similarity of 0.8 or more. Sets that
    share a hash of their prefixes are proposed, which no such pair escapes. Proposals are discarded where the first
    shared hash comes so late that the rest can't reach 0.8, and where fingerprints of the sets differ in more than
    `most` bits; what remains is compared exactly within the proposals' components.
    Texts without words are one set. An empty table gives an empty result. The result is written; what led to it goes.
    """
    import xxhash

    spark = docs.sparkSession
    scratch = Scratch(spark)
    cols = [f"f{k}" for k in range(words)]
    named = docs.select(F.col(id_col).alias("doc"), F.col(print_col).alias("print"), F.col(text_col).alias("body"))
    kinds = f"doc {named.schema['doc'].dataType.simpleString()}, print long"

    common, seen = common_hashes(named.select("print", "body"), shingle, scratch)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = [np.unique(shingle_hashes(t, shingle)) for t in batch.column(2).to_pylist()]
                found = [_majority(x, words) for x in sets]
                often = [_often(x, common, seen) for x in sets]
                own = [int((o == 0).sum()) for o in often]
                keys = [prefix(x, o) for x, o in zip(sets, often)]
                last = [prefix_end(k, np.sort(o)[: len(k)]) for k, o in zip(keys, often)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([_signed(xxhash.xxh64_intdigest(x.tobytes())) for x in sets], pa.int64()), *(pa.array([f[k] for f in found], pa.int64()) for k in range(words)), _packed(pivot_distances(np.array(found, np.int64).reshape(-1, words).view(np.uint64))), pa.array([k.view(np.int64) for k in keys], pa.list_(pa.int64())), *(pa.array(x, pa.int64()) for x in (list(map(len, sets)), own, last))],
                    names=["doc", "print", "set", *cols, "d", "keys", "size", "own", "last"],
                )

    rows = scratch.save(named.mapInArrow(sketch, f"{kinds}, set long, {', '.join(f'{c} long' for c in cols)}, d binary, keys array<long>, size long, own long, last long"), "sketches")
    # room: a set's hashes from this one on. A pair's first shared hash has all that they share behind it
    keyed = rows.select(F.col("set").alias("id"), "size", F.posexplode("keys").alias("at", "key")).select("id", "key", "size", (F.col("size") - F.col("at")).alias("room"))
    # equal sets have equal keys: count each once
    first = rows.groupBy("set").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "print")).alias("first"), *[F.first(c).alias(c) for c in (*cols, "d", "own", "last")], F.first(F.col("size") - F.size("keys")).alias("rest"))
    first = scratch.save(first.select(F.col("set").alias("id"), "first.doc", "first.print", *cols, "d", "own", "last", "rest"), "sets")
    keyed = scratch.save(keyed.distinct(), "keys")
    counts = scratch.save(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("size").alias("low")).where("n > 1"), "counts")
    shared = scratch.save(keyed.join(counts, "key"), "shared")
    scratch.drop(keyed)
    held = scratch.save(shared.groupBy("id").agg(F.count("*").alias("held")), "held")
    known = first.join(held, "id").select("id", *cols, "d", "last", (F.col("rest") + F.col("held")).alias("left"))
    # what no partner of any size at the key can make up for goes at once
    sized = shared.where("9 * room >= 4 * (size + low)").join(known, "id")
    proposed = scratch.save(_units(sized, [*cols, "d", *PLACE], BLOCK).mapInArrow(lambda batches: _link_runs(batches, words, most, True), "a long, b long").distinct(), "proposed")
    scratch.drop(shared)
    scratch.drop(counts)
    loose = components(spark, proposed, scratch).select(F.col("node").alias("id"), F.col("component").alias("key"))
    loose = scratch.save(loose.join(first.select("id", "doc", "print", "own"), "id").select("id", "key", "own", F.col("doc").alias("_doc"), F.col("print").alias("_print")), "loose")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["id", "key", "hashes"])

    texts = named.join(loose, named["doc"].eqNullSafe(loose["_doc"]) & (named["print"] == loose["_print"])).select("id", "key", "body")
    # of rows equal in id and text one is enough
    sets = scratch.save(texts.groupBy("id", "key").agg(F.first("body").alias("body")).mapInArrow(hashes, "id long, key long, hashes array<long>"), "hashes")
    sizes = scratch.save(loose.groupBy("key").agg(F.count("*").alias("n")), "sizes")
    label = _exact_components(sets, sizes, loose.select("id", "key", "own"), scratch).select(F.col("node").alias("set"), "component")
    scratch.drop(sets)
    out = rows.select(F.col("doc").alias(id_col), F.col("print").alias(print_col), "set").join(label, "set", "left").withColumn("component", F.coalesce("component", "set"))
    out = scratch.save(out, "similar")
    scratch.keep(out)
    return out
