"""The corpus pipeline: quality rules, near duplicates, personal data, source mix, token ids.

Each stage is (spark, docs, sf_dir) -> DataFrame, by one operator of loomq.llm, on all that the stage before it kept; its
result is written as Parquet and read again as the next one's docs. All but the last return the columns of `documents`.

Defined cases, by stage: null and empty texts fail the base rule, and go; repeated rows stay or go alike in the first stage, and
one of them stays after the second; rows without doc_id stay, are not compared, and draw by their text in the mix. An
empty table gives an empty result of each stage. Other columns come along, whatever their names. Texts count whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomq.llm import _shared, personal_data, piece_viterbi, quality_rules, source_mix, token_groups
from loomq.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the rules' posterior reject go."""
    return quality_rules.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of Jaccard 0.75 over five-word shingles connect, the first by doc_id stays."""
    return token_groups.one_of_each(docs, words=5, percent=75)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts gives way to its kind's name; n_chars is that of the new text."""
    clean = personal_data.redacted(docs)
    return clean.withColumns({c: F.length("text").cast(clean.schema[c].dataType) for c in clean.columns if c.lower() == "n_chars"})


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated by a Poisson count whose mean brings their source to its weight; other sources' and null's has mean 1."""
    return source_mix.mixed(docs, source_mix.WEIGHTS, others=source_mix.OTHERS).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids of every document and copy."""
    return piece_viterbi.encoded(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("personal data", personal), ("source mix", mix), ("token ids", token_ids)]

#: Viterbi search is beyond SQL: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = _shared.written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
