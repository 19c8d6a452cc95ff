"""The queries of this package, over whole tables, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from . import bpe, decontam, edits, htmltext, lattice, licenses, linededup, neardup, prefixtrie, quality, replay, sharding, vectorcodes
from .common import table
from .oracles import ORACLES  # noqa: F401

#: The vocabulary of op6; a parameter of the operator.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
#: The ranks of op13, and the pattern that cuts texts for them.
BYTE_RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
#: The pieces of op3; likewise.
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op2_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.counts(table(spark, sf_dir, "documents"), BYTE_BPE)


def op3_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(table(spark, sf_dir, "documents"), PIECES)


def op4_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85, width=5)


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licences(licenses.laid_out(table(spark, sf_dir, "documents")))


def op6_bpe_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), BYTE_BPE)


def op7_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op8_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_deletion_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digests(table(spark, sf_dir, "documents"))


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), 8)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.digests(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op13_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.digests(table(spark, sf_dir, "documents"), BYTE_RANKS, PATTERN)


QUERIES = {
    "op1_robust_outliers": op1_robust_outliers,
    "op2_edit_aware_counts": op2_edit_aware_counts,
    "op3_subword_lattice": op3_subword_lattice,
    "op4_minhash_hamming": op4_minhash_hamming,
    "op5_licence_scan": op5_licence_scan,
    "op6_bpe_backtracking": op6_bpe_backtracking,
    "op7_line_blocks": op7_line_blocks,
    "op8_suffix_automaton": op8_suffix_automaton,
    "op9_deletion_neighbourhood": op9_deletion_neighbourhood,
    "op10_hilbert_shards": op10_hilbert_shards,
    "op11_vector_codes": op11_vector_codes,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_merge_replay": op13_merge_replay,
}
