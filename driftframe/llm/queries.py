"""One query for each corpus operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .collocations import COLLOCATIONS_SQL, collocations
from .common import read
from .decontamination import DECONTAMINATION_SQL, contaminated
from .hard_negatives import HARD_NEGATIVES_SQL, hard_negatives
from .line_dedup import LINE_DEDUP_SQL, line_dedup_report
from .lm_scoring import cross_entropy_difference
from .minhash_dedup import NEAR_DUPLICATES_SQL, near_duplicates
from .packing import pack_sequences
from .quality_classifier import quality_scores
from .quality_rules import quality_rules
from .run_length_index import remove_repeats
from .secret_scan import secrets
from .token_counts import token_counts
from .vantage_trees import nearest_neighbours

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup_report(read(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(read(spark, sf_dir, "documents"))


def op5_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_entropy_difference(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))


def op9_distribution_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))


def op10_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(read(spark, sf_dir, "documents"))


def op11_vantage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(read(spark, sf_dir, "embeddings"))


def op12_residue_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(read(spark, sf_dir, "embeddings"))


def op13_count_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


_ALL = (
    op1_quality_classifier,
    op2_minhash_dedup,
    op3_line_dedup,
    op4_packing,
    op5_cross_entropy_difference,
    op6_separator_scan,
    op7_decontamination,
    op8_run_length_index,
    op9_distribution_rules,
    op10_markov_secrets,
    op11_vantage_trees,
    op12_residue_negatives,
    op13_count_automata,
)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}
ORACLE_SQL: dict[str, str] = {
    "op2_minhash_dedup": NEAR_DUPLICATES_SQL,
    "op3_line_dedup": LINE_DEDUP_SQL,
    "op7_decontamination": DECONTAMINATION_SQL,
    "op12_residue_negatives": HARD_NEGATIVES_SQL,
    "op13_count_automata": COLLOCATIONS_SQL,
}
