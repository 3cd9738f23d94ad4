"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find

    found = find(_table(spark, sf_dir, "documents"), ["doc_id"])
    return found.withColumn("base_sha256", F.sha2("base_spans", 256)).drop("base_spans")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    out = near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, most=4)
    return out.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_output import checksums, written_tokens

    return checksums(spark, written_tokens(_table(spark, sf_dir, "documents"), _tokenizer()))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .multi_index import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ["doc_id"])


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .forest import search

    vectors = _table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 50 = 0"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import Scratch, word_count
    from .packing import pack

    docs = _table(spark, sf_dir, "documents")
    return pack(docs, Scratch(spark), ["doc_id"], word_count(F.col("text")), F.xxhash64(F.lit(6), "doc_id", "text"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import Scratch
    from .mixing import mix

    mixed = mix(_table(spark, sf_dir, "documents"), Scratch(spark), ["doc_id"])
    # training positions in billionths of the whole
    places = F.concat_ws(",", F.transform("uses", lambda u: F.round(u["position"] * 1e9).cast("long").cast("string")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", places.alias("positions"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive

    return archive(_table(spark, sf_dir, "pages")).drop("payload")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_output, op2_pii, op3_simhash, op4_substrings, op5_embedding_dedup, op6_packing, op7_mixing, op8_quality, op9_nearest, op10_warc)}


#: 35-word windows of whole texts: those that start at two places take their words away.
OP4_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), CAST([] AS VARCHAR[])) AS w FROM documents),
words AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
windows AS (SELECT r, p, count(*) OVER v AS n, md5(string_agg(x, ' ') OVER v) AS h FROM words WINDOW v AS (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
repeats AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY h) AS c FROM windows WHERE n = 35) WHERE c > 1),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS p FROM repeats),
kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS k FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
#: All pairs, and whom each vector reaches over links.
OP5_SQL = """
WITH RECURSIVE good AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN least ON least.a = vec_id LEFT JOIN counts ON counts.a = vec_id
"""
#: Targets in closed form, as source_targets has them; each source's words are taken in the order of a hash, up to thrice.
OP7_SQL = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, substr(md5(concat_ws('|', '20', CAST(doc_id AS VARCHAR), coalesce(text, ''))), 1, 16) AS h FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
turns AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS turn FROM sizes),
caps AS (SELECT *, CAST([5, 2, 1][turn % 3 + 1] AS DOUBLE) AS weight, CAST(source_size * 3 AS DOUBLE) AS cap FROM turns),
ordered AS (SELECT *, row_number() OVER r AS n, sum(source_size) OVER () AS everything, coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS capped, sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM caps WINDOW r AS (ORDER BY cap / weight, turn)),
levels AS (SELECT *, (CAST(everything AS DOUBLE) - capped) / rest AS level FROM ordered),
shares AS (SELECT arg_min(level, n) AS share FROM levels WHERE level <= cap / weight),
targets AS (SELECT source AS s, source_size, turn, least(cap, coalesce(weight * share, cap)) AS target FROM levels, shares),
placed AS (SELECT d.*, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY h < '8', h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins FROM d),
used AS (SELECT *, [k for k in range(3) if least(size, CAST(round(target) AS BIGINT) - begins - k * source_size) > 0] AS passes, [0.5, 1.0, 1.5][turn % 3 + 1]::DOUBLE AS a, [1.5, 1.0, 0.5][turn % 3 + 1]::DOUBLE AS b FROM placed JOIN targets ON placed.source IS NOT DISTINCT FROM targets.s),
demands AS (SELECT *, [least(CAST(begins + k * source_size AS DOUBLE) / greatest(target, 1.0), 1.0) * (a + b) for k in passes] AS wholes FROM used)
SELECT doc_id, size, source_size, target, CAST(coalesce(list_sum([least(size, CAST(round(target) AS BIGINT) - begins - k * source_size) for k in passes]), 0) AS BIGINT) AS taken,
array_to_string([CAST(round(w / (a + sqrt(greatest(a * a + (b - a) * w, 0.0))) * 1e9) AS BIGINT) for w in wholes], ',') AS positions FROM demands
"""
#: Base 32 of SHA-1: each five of its forty hex digits are four letters.
OP10_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS b, sha1(coalesce(html, '')) AS s FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY s, b) AS first FROM p)
SELECT page_id, CAST(b AS BIGINT) AS payload_bytes,
array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(s, (i // 4) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1) for i in range(32)], '') AS payload_digest,
CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN first IS NULL OR page_id = first THEN NULL ELSE first END AS refers_to FROM f
"""


def oracle_sql() -> dict[str, str]:
    """What SQL can express. The others are tested against brute force: trained models, tokenizers, fingerprints by
    XXH64, orders by a hash that DuckDB lacks, approximate search."""
    return {"op4_substrings": OP4_SQL, "op5_embedding_dedup": OP5_SQL, "op7_mixing": OP7_SQL, "op10_warc": OP10_SQL}
