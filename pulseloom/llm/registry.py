"""The queries of this package, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .alignment import alignment_report
from .bpe import bpe_digest
from .common import lean_workers, small_batches, table
from .divergence import ORACLE_SQL as DIVERGENCE_SQL
from .divergence import divergence_report
from .embeddings import embedding_links
from .lines import line_report
from .mixing import mix_report
from .novelty import secret_report
from .sharding import assign_shards
from .simhash import near_duplicate_report
from .substrings import repeat_report
from .tokenfile import token_digest
from .topk import ORACLE_SQL as TOPK_SQL
from .topk import search_top
from .toxicity import toxicity_report


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(table(small_batches(spark), sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(small_batches(spark), sf_dir, "documents"))


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(table(small_batches(spark), sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_report(table(small_batches(spark), sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(small_batches(spark), sf_dir, "documents"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(small_batches(spark), sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(table(small_batches(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(small_batches(spark), sf_dir, "documents"))


def op9_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_top(table(spark, sf_dir, "embeddings"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_report(table(small_batches(spark), sf_dir, "documents"))


def op12_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(small_batches(spark), sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_report(table(lean_workers(spark), sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffixes": op1_suffixes,
    "op2_token_file": op2_token_file,
    "op3_simhash": op3_simhash,
    "op4_mixing": op4_mixing,
    "op5_lines": op5_lines,
    "op6_toxicity": op6_toxicity,
    "op7_sharding": op7_sharding,
    "op8_bpe": op8_bpe,
    "op9_lattice": op9_lattice,
    "op10_topk": op10_topk,
    "op11_divergence": op11_divergence,
    "op12_novelty": op12_novelty,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL: dict[str, str] = {"op10_topk": TOPK_SQL, "op11_divergence": DIVERGENCE_SQL}
