"""From raw documents to tokens: toxicity, repeated lines, near copies, mixing, byte-level BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hexafact.llm import stages
from hexafact.llm.session import materialise, prepare

#: Each stage takes (spark, docs, sf_dir); its rows are written as Parquet and read again as the next one's docs.
STAGES = [
    ("toxicity", stages.without_toxic),
    ("line_dedup", stages.without_repeated_lines),
    ("jaccard_join", stages.without_near_copies),
    ("mixing", stages.mixed),
    ("byte_bpe", stages.encoded),
]

#: SQL cannot express the stages (trained compression, BPE merges). Tests compare the operators of line dedup, Jaccard join and BPE
#: with brute force, and toxicity with labels; of the whole pipeline they check which ids come out.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
