"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resight.llm import bpe, extraction, hosts, lines, middles, neardup, negatives, packing, passages, rollups, sharding, topk, urls
from resight.llm.common import table
from resight.session import cut, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_sum_of_squares")
def op1_sum_of_squares(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
        public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


@query("op2_suffix_arrays")
def op2_suffix_arrays(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = passages.remove_repeats(table(spark, folder, "documents"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: Vectors that take part.
FIT_VECTORS = "embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0"


@query("op3_branch_and_bound", f"""
WITH fit AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND {FIT_VECTORS}),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM fit q JOIN fit c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
""")
def op3_branch_and_bound(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024.0)


@query("op4_odd_sketches")
def op4_odd_sketches(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"))


@query("op5_host_rules")
def op5_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = hosts.judge_documents(table(spark, folder, "documents"))
    return judged.select("doc_id", *hosts.MEASURES, "base_failed", "kept")


@query("op6_redirect_rules")
def op6_redirect_rules(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge_pages(table(spark, folder, "pages"))


@query("op7_feistel_shards")
def op7_feistel_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents"))


def digest_row(ids: list[int], decoded: bytes) -> dict:
    return {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            "decoded_sha256": hashlib.sha256(decoded).hexdigest()}


@query("op8_token_rollups")
def op8_token_rollups(spark: SparkSession, folder: str) -> DataFrame:
    """Totals after every document was inserted, those not in English recounted with the multilingual vocabulary, that
    batch sent again, and later copies of a text deleted as they were last counted."""
    versions = {v: public_tokenizers.path(f"{v}.tiktoken") for v in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    counted = cut(rollups.count_tokens(table(spark, folder, "documents").select("doc_id", "source", "lang", "text"),
                                       versions, public_tokenizers.PATTERN), "counts")

    def under(rows: DataFrame, version: str) -> DataFrame:
        return rows.withColumns({"tokenizer": F.lit(version), "tokens": F.col(f"tokens_{version}")})

    first, second = versions
    foreign = F.coalesce(F.col("lang") != "en", F.lit(True))
    total = rollups.Rollup(spark, scratch_path(spark, "rollup"))
    total.commit("load", rollups.inserted(under(counted, first)))
    recount = rollups.revised(under(counted.where(foreign), first), under(counted.where(foreign), second))
    total.commit("recount", recount)
    total.commit("recount", recount)
    copies = rollups.repeated_texts(counted)
    total.commit("copies", rollups.deleted(
        under(copies.where(~foreign), first).unionAll(under(copies.where(foreign), second))))
    return total.totals()


@query("op9_byte_bpe")
def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_documents(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
        row=digest_row, fields="n_tokens bigint, ids_sha256 string, decoded_sha256 string")


@query("op10_fuzzy_lines")
def op10_fuzzy_lines(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_groups(table(spark, folder, "documents"))


@query("op11_block_rotation", r"""
WITH tokens AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t FROM documents),
drawn AS (
  SELECT doc_id, text, len(t) AS n, t, ('0x' || h[1:8])::BIGINT % (len(t) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(t) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM tokens),
parts AS (
  SELECT doc_id, text, n, form, array_to_string(t[1:least(a, b)], '') AS prefix,
         array_to_string(t[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(t[greatest(a, b) + 1:], '') AS suffix FROM drawn)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
              ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
""")
def op11_block_rotation(spark: SparkSession, folder: str) -> DataFrame:
    made = middles.restore_texts(middles.fill_in_middle(table(spark, folder, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))


@query("op12_multi_index", f"""
WITH fit AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {FIT_VECTORS}),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM fit a JOIN fit b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT same
  AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
""")
def op12_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label)


@query("op13_tag_path_ratios")
def op13_tag_path_ratios(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extract_pages(table(spark, folder, "pages"))
