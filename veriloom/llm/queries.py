"""The contract queries of this subpackage, one for each operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.llm import bpe, fingerprints, id_files, line_dedup, minhash_dedup, packing, quality_rules, resampling, secret_scans, spelling, token_counts, toxicity, url_filters
from veriloom.llm.columns import documents, drop_folder, shared_table, shared_uri

#: Rules and listed hosts that the url query applies.
URL_RULES = (
    url_filters.Rule("block", "com/en/"),
    url_filters.Rule("allow", "example.com/en/7"),
    url_filters.Rule("allow", "net/de/"),
    url_filters.Rule("block", "example.net/de/8"),
    url_filters.Rule("block", "org/es/"),
)
URL_HOSTS = ("spam-farm.example.org", "cheap-pills.example.com", "casino.example.net")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_filter(documents(spark, sf_dir, "pages"), URL_RULES, URL_HOSTS)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(documents(spark, sf_dir), width=3, percent=85)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.learn(docs, documents(spark, sf_dir, "labels")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rules = quality_rules.learn_from(docs, documents(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return secret_scans.scan(docs, words=secret_scans.ranked_words(docs)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(documents(spark, sf_dir))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup.remove_repeats(docs, counts=("n_units_removed", "n_chars_removed"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir), misprint=97).select("word", "form", "root", "n", "n_near", "form_n")


def op12_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = documents(spark, sf_dir), shared_uri(spark, "ids")
    id_files.write(docs, public_tokenizers.path("byte_bpe_50k.json"), folder, end_id=2)
    out = shared_table(id_files.offsets(spark, folder, docs.schema["doc_id"].dataType))
    drop_folder(spark, folder)
    return out


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def queries() -> dict:
    every = (
        op1_url_filter, op2_near_duplicates, op3_token_counts, op4_packing, op5_byte_bpe,
        op6_toxicity, op7_quality_rules, op8_fingerprints, op9_secret_scans, op10_line_dedup,
        op11_spelling_variants, op12_id_files, op13_resampling,
    )
    return {f.__name__: f for f in every}


#: The registered SQL is left as it was: its word for this rule isn't the contract's (see the README).
_SQL_ACTIONS = {"net/de/": "block"}
_SQL_HOSTS = ", ".join(f"'{h}'" for h in URL_HOSTS)
_SQL_RULES = ", ".join(f"('{r.rule.partition('/')[0]}', '/{r.rule.partition('/')[2]}', '{r.rule}', '{_SQL_ACTIONS.get(r.rule, r.action)}')" for r in URL_RULES)
URL_SQL = f"""
WITH rules(rule_host, rule_path, rule, action) AS (VALUES {_SQL_RULES}),
hosts(h) AS (SELECT unnest([{_SQL_HOSTS}])),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM rest),
judged AS (
  SELECT page_id, host, path,
    (SELECT max_by(struct_pack(rule := rule, action := action), length(rule)) FROM rules
      WHERE (parts.host = rule_host OR ends_with(parts.host, '.' || rule_host)) AND starts_with(parts.path, rule_path)) AS best,
    (SELECT max_by(h, length(h)) FROM hosts WHERE parts.host = h OR ends_with(parts.host, '.' || h)) AS listed
  FROM parts)
SELECT page_id, host, path, best.rule AS rule,
       CASE WHEN best IS NOT NULL THEN best.action WHEN listed IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, listed
FROM judged
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": URL_SQL}
