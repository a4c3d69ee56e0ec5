"""The operators of this folder over the driver tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfline.llm import decontaminate, lines, ranked, trie
from shelfline.llm.decontaminate import leak_report
from shelfline.llm.html import article_report
from shelfline.llm.langid import language_report
from shelfline.llm.lines import line_report
from shelfline.llm.packing import pack
from shelfline.llm.pieces import piece_report
from shelfline.llm.quality import quality_report
from shelfline.llm.ranked import ranked_search
from shelfline.llm.simhash import near_duplicates
from shelfline.llm.substrings import without_repeats
from shelfline.llm.token_counts import count_tokens
from shelfline.llm.trie import conversation_report
from shelfline.llm.wavelet import documents_of, write_shards
from shelfline.session import fresh_path


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_simhash_vantage(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates(table(spark, d, "documents"))


def op2_language_filters(spark: SparkSession, d: str) -> DataFrame:
    return language_report(table(spark, d, "documents"))


def op3_wavelet_matrix(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "shards")
    write_shards(table(spark, d, "documents"), path, end_id=2)
    return documents_of(spark, path)


def op4_mixture_packing(spark: SparkSession, d: str) -> DataFrame:
    # Shares by the square root of what a source holds: small sources last shorter and are met more often till then.
    return pack(table(spark, d, "documents"), end_id=1, temper=0.5)


def op5_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return count_tokens(table(spark, d, "documents"))


def op6_perplexity_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality_report(table(spark, d, "documents"))


def op7_prefix_free_parsing(spark: SparkSession, d: str) -> DataFrame:
    return without_repeats(table(spark, d, "documents"))


def op8_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return leak_report(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op9_line_winnowing(spark: SparkSession, d: str) -> DataFrame:
    return line_report(table(spark, d, "documents"))


def op10_best_region(spark: SparkSession, d: str) -> DataFrame:
    return article_report(table(spark, d, "pages"))


def op11_piece_chunks(spark: SparkSession, d: str) -> DataFrame:
    return piece_report(table(spark, d, "documents"))


def op12_conversation_trie(spark: SparkSession, d: str) -> DataFrame:
    return conversation_report(table(spark, d, "conversations"))


def op13_ranked_search(spark: SparkSession, d: str) -> DataFrame:
    return ranked_search(table(spark, d, "documents"), table(spark, d, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_vantage": op1_simhash_vantage,
    "op2_language_filters": op2_language_filters,
    "op3_wavelet_matrix": op3_wavelet_matrix,
    "op4_mixture_packing": op4_mixture_packing,
    "op5_token_counts": op5_token_counts,
    "op6_perplexity_quality": op6_perplexity_quality,
    "op7_prefix_free_parsing": op7_prefix_free_parsing,
    "op8_decontamination": op8_decontamination,
    "op9_line_winnowing": op9_line_winnowing,
    "op10_best_region": op10_best_region,
    "op11_piece_chunks": op11_piece_chunks,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_ranked_search": op13_ranked_search,
}

ORACLES: dict[str, str] = {
    "op8_decontamination": decontaminate.SQL,
    "op9_line_winnowing": lines.SQL,
    "op12_conversation_trie": trie.SQL,
    "op13_ranked_search": ranked.SQL,
}
