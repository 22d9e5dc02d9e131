"""The text operators over the given tables, each on the whole of its table.

Every query asks its operator for its general result and derives the digest columns from it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontamination, exact_dedup, filter_audit, language_model, line_dedup, mixing, near_dedup, quality, sharding, substring_dedup, toxicity,
    url_filter, whitening,
)
from .common import id_remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return register


@query("op1_mix_sources")
def mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query("op2_near_dedup")
def near(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = near_dedup.component_of(docs.select(F.col("doc_id").alias("id"), "text"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def held_out(modulus: int, rest: int):
    """Whether a row is kept from the fit, by the remainder of its id's crc32."""
    return lambda doc_id: id_remainder(doc_id, modulus) == rest


@query("op3_toxicity")
def toxic(spark: SparkSession, folder: str) -> DataFrame:
    held = held_out(4, 2)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.ToxicityModel(docs, table(spark, folder, "labels"), "toxic", lambda doc_id: ~held(doc_id))
    scored = model.score(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ["doc_id"])
    return scored.select("doc_id", held(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query("op4_decontamination")
def leaks(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.leaks(docs, table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "score", "n_items", "contaminated")


@query("op5_line_dedup")
def lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.drop_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query(
    "op6_exact_dedup",
    r"""
    WITH n AS (
      SELECT doc_id, coalesce(length(text), 0) AS points,
        regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
      FROM documents)
    SELECT doc_id,
      first_value(doc_id) OVER w AS keep_id,
      count(*) OVER (PARTITION BY norm) AS group_size,
      row_number() OVER w = 1 AS kept,
      sha256(norm) AS text_sha256
    FROM n WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST)
    """,
)
def exact(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return exact_dedup.exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op7_quality")
def good(spark: SparkSession, folder: str) -> DataFrame:
    held = held_out(5, 0)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.QualityModel(docs, table(spark, folder, "labels"), "quality", lambda doc_id: ~held(doc_id))
    scored = model.score(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ["doc_id"])
    return scored.select("doc_id", held(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query("op8_url_filter")
def urls(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, table(spark, folder, "labels")).select("page_id", "host", "path", "rule", "verdict", "confidence")


@query("op9_lm_scoring")
def lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    held = held_out(7, 2)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = language_model.score_texts(docs, ~held(F.col("doc_id")))
    return scored.select("doc_id", held(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op10_substring_dedup")
def substrings(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    cut = substring_dedup.cut_repeats(docs, keep_text=False)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query(
    "op11_sharding",
    r"""
    WITH RECURSIVE bits AS (
      SELECT list(c ORDER BY n) AS t FROM (
        SELECT n, list_reduce([n::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
          LAMBDA c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c
        FROM range(256) r(n))),
    sized AS (
      SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size,
        xor(list_reduce([4294967295::UBIGINT] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), LAMBDA h: ('0x' || h)::UBIGINT),
          LAMBDA c, b: xor(c >> 8, t[(xor(c, b) & 255)::INT + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32
      FROM documents, bits),
    keyed AS (
      SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 16))::UBIGINT::HUGEINT AS key,
        ('0x' || substr(md5(concat_ws(chr(31), doc_id, size, text_crc32)), 1, 16))::UBIGINT::HUGEINT AS draw
      FROM sized),
    jumps AS (
      SELECT DISTINCT key, key AS state, 0::BIGINT AS dest FROM keyed
      UNION ALL
      SELECT key, state, floor((dest + 1) * (2147483648::DOUBLE / (state // 8589934592 + 1)::DOUBLE))::BIGINT
      FROM (SELECT key, dest, (state * 2862933555777941757 + 1) % 18446744073709551616 AS state FROM jumps WHERE dest < 9)),
    dealt AS (SELECT key, max(dest) FILTER (dest < 8) AS shard, max(dest) FILTER (dest < 9) AS grown FROM jumps GROUP BY key)
    SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
      row_number() OVER (PARTITION BY shard ORDER BY CASE WHEN draw >= 9223372036854775808 THEN draw - 18446744073709551616 ELSE draw END,
        doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
      grown::INT AS grown_shard
    FROM keyed JOIN dealt USING (key)
    """,
)
def shards(spark: SparkSession, folder: str) -> DataFrame:
    rows = sharding.measured(table(spark, folder, "documents"))
    return sharding.sharded(rows).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query(
    "op12_filter_audit",
    r"""
    WITH letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
    seen AS (
      SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
      FROM documents),
    masked AS (
      SELECT doc_id, part,
        CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
        + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN min(doc_id) OVER (PARTITION BY body) < coalesce(doc_id, 9223372036854775807) THEN 16 ELSE 0 END AS mask
      FROM seen),
    marks AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    cells AS (
      SELECT part, mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
      FROM masked LEFT JOIN marks USING (doc_id) GROUP BY ALL),
    orders AS (
      SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
        AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
    steps AS (
      SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::BIGINT AS earlier
      FROM orders, unnest([1, 2, 3, 4, 5]) AS s(step)),
    told AS (
      SELECT part, filter_order, step::INT AS step, bit,
        sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN mask & bit > 0 AND mask & earlier > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
      FROM cells, steps GROUP BY ALL)
    SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM told
    """,
)
def audited(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op13_whitening")
def components(spark: SparkSession, folder: str) -> DataFrame:
    """``deviation`` is null where it is beyond a long; the operator has it as a decimal."""
    found = whitening.whitened(table(spark, folder, "embeddings").select("vec_id", "embedding"))
    return found.select("vec_id", "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error")
