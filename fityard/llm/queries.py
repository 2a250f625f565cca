"""Registered queries of the training-data operators, each with SQL where SQL can express it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from fityard.llm import (byte_bpe, fingerprints, importance, language_id, line_dedup, minhash_join, mixing, multi_index,
                         quality_ranking, suffix_dedup, token_alignment, toxicity, url_filter)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# The rules that op2 applies (host, path, verdict).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
VOCABULARY = os.environ.get("FITYARD_BYTE_BPE") or public_tokenizers.path("byte_bpe_50k.json")
PIECES = os.environ.get("FITYARD_PIECE_BPE") or public_tokenizers.path("piece_bpe_32k.model")


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_url_digest_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, url_filter.RULE_SCHEMA)
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


_RULE_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLES["op2_url_digest_array"] = f"""
with rules(rule_host, rule_path, verdict) as (values {_RULE_VALUES}),
parts as (
  select page_id, coalesce(url, '') as url,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{_UPPER}', '{_UPPER.lower()}') as host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path
  from pages)
select page_id, host, path,
       (select rule_host || rule_path from rules
        where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
        order by length(rule_host || rule_path) desc limit 1) as rule,
       coalesce((select verdict from rules
        where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
        order by length(rule_host || rule_path) desc limit 1), 'allow') as verdict
from parts"""


@query
def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, docs.filter(~language_id.is_held_out("doc_id")))
    return found.select("doc_id", language_id.is_held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query
def op4_line_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", "n_links", "class_id",
                       F.sha2("text", 256).alias("kept_sha256"))


@query
def op5_one_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.neighbour_fingerprints(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
                        F.lower(F.hex("fingerprint")).alias("fingerprint"),
                        F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"),
                        "near_edited", "near_next")


@query
def op6_interval_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(table(spark, sf_dir, "embeddings"))


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.encode_documents(table(spark, sf_dir, "documents"), VOCABULARY)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op9_soft_membership_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_minhash_coordinate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.aligned_documents(table(spark, sf_dir, "documents"), VOCABULARY, PIECES)


@query
def op12_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ranking.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# CRC-32 of a word's UTF-8 bytes, from the table that its polynomial gives.
ORACLES["op13_importance_resampling"] = f"""
with crc_table(steps) as (
  select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i:
    case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end))),
words as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
                                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from documents),
wanted as (
  select unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
                                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from benchmark),
every as (select distinct word from (select word from words union all select word from wanted)),
hexed as (select word, hex(word) as h from every),
bucket_of as (
  select word, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(h), 2), lambda i:
             (strpos('0123456789ABCDEF', substr(h, i, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(h, i + 1, 1)) - 1)),
           lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1])), 4294967295) % 10000 as bucket
  from hexed, crc_table),
source as (select bucket, count(*) as s from words join bucket_of using (word) group by 1),
target as (select bucket, count(*) as t from wanted join bucket_of using (word) group by 1),
sizes as (select (select coalesce(sum(s), 0) from source) + 10000 as big_s,
                 (select coalesce(sum(t), 0) from target) + 10000 as big_t),
gain as (
  select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * big_s::double
                                 / ((coalesce(s, 0) + 1)::double * big_t::double)))::bigint as gain
  from source full join target using (bucket), sizes),
weighed as (
  select doc_id, count(*) as n_features, sum(gain) as total
  from words join bucket_of using (word) join gain using (bucket) group by 1),
scored as (
  select doc_id, coalesce(n_features, 0) as n_features,
         case when n_features > 0
              then ((total - ((total % n_features) + n_features) % n_features) / n_features)::bigint else 0 end as weight,
         list_reduce(list_prepend(0::bigint, list_transform(range(1, 9), lambda i:
           strpos('0123456789abcdef', substr(sha256('2024:' || doc_id), i, 1)) - 1)), lambda a, d: a * 16 + d) as h
  from documents left join weighed using (doc_id)),
noisy as (
  select doc_id, n_features, weight,
         weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from scored),
ranked as (
  select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as n
  from noisy where n_features >= 20)
select doc_id, n_features::bigint as n_features, weight::bigint as weight, score::bigint as score,
       case when place <= 10 * n // 100 then place end as rank
from noisy left join ranked using (doc_id)"""
