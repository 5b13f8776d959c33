"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hard_negatives, near_dup, prefix_trie, warc
from .common import table

TOKENIZER = "byte_bpe_50k.json"


#: Host and path rules of the url query: fixed values.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secret_scan

    return secret_scan(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import url_filter

    return url_filter(table(spark, sf_dir, "pages"), RULES)


def domain_of_source():
    """The domain level of the mixture: sources are dealt to four domains by their number."""
    number = F.coalesce(F.regexp_extract("source", "[0-9]+", 0).try_cast("long"), F.lit(0))
    return F.concat(F.lit("d"), F.pmod(number, F.lit(4)).cast("string"))


#: Production parameters of the mixture.
MIX_WEIGHTS = [{"d0": 1.0, "d1": 2.0, "d2": 2.0, "d3": 3.0}, {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 3.0}, {}]


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"), domain_of_source(), MIX_WEIGHTS)


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import derive, responses

    out = derive(responses(table(spark, sf_dir, "pages")), keep=["page_id"])
    text = {c: F.col(c).cast("string") for c in ("http_headers", "content")}  # the pages of the table are UTF-8
    return out.withColumns(text).drop("other_headers", "error")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    return identify(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokens import token_counts

    out = token_counts(table(spark, sf_dir, "documents"), str(public_tokenizers.path(TOKENIZER)))
    return out.withColumn("over_limit", F.col("n_tokens") > 512)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hash_forest import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_decontamination": op2_decontamination,
    "op3_url_filter": op3_url_filter,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_mix_sources": op5_mix_sources,
    "op6_language_id": op6_language_id,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_token_counts": op9_token_counts,
    "op10_warc_derivatives": op10_warc_derivatives,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_hard_negatives": op13_hard_negatives,
}
SQL: dict[str, str] = {"op4_near_duplicates": near_dup.SQL, "op10_warc_derivatives": warc.SQL, "op11_conversation_trie": prefix_trie.SQL, "op13_hard_negatives": hard_negatives.SQL}
