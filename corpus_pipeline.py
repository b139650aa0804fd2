"""From raw documents to token shards: the stages, each of which works on all that the one before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arborel.llm import decontaminate, jaccard, mixing, records, toxicity
from arborel.llm.common import saved, table

STAGES = [
    ("toxicity", toxicity.reject),
    ("ngram_jaccard_join", jaccard.one_of_each),
    ("benchmark_decontamination", decontaminate.clean),
    ("source_mix", mixing.mixed),
    ("token_records", records.stage),
]
#: SQL can't express the learned, iterative and seeded stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the token shards: a row for each record."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
