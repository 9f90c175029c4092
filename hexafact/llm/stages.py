"""Stages of a corpus pipeline: each takes documents and the folder of the tables, and returns documents (the last: digests of tokens).

Defined results: a null text is an empty one, and is kept unless a stage says
otherwise; an empty table gives an empty table; repeated rows are decided alike,
each for itself; columns other than doc_id, text and source pass through, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexafact.llm import jaccard, lines, mixing, queries, toxicity
from hexafact.llm.session import prepare

_REST = "rest_of_row"


def _apart(docs: DataFrame, own: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but ``own`` in one struct, so that no name can clash, and the way back."""
    others = [c for c in docs.columns if c not in own]
    packed = docs.select(*own, (F.struct(*(f"`{c}`" for c in others)) if others else F.lit(0)).alias(_REST))
    return packed, lambda df: df.select(*(F.col(c) if c in own else F.col(_REST).getField(c).alias(c) for c in docs.columns))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier calls toxic."""
    prepare(spark)
    packed, back = _apart(docs, ["doc_id", "text"])
    return back(toxicity.score(packed, queries.toxicity_model(spark, docs, sf_dir)).where("score < 0.5"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of line runs, to their last line; a document that loses its last word this way goes. ``n_chars`` follows the text."""
    own = ["doc_id", "text", *(["n_chars"] if "n_chars" in docs.columns else [])]
    packed, back = _apart(docs, own)
    kept = lines.dedup(packed, whole=True).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in own:
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return back(kept)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, keep the one with the smallest id; a null id stays unless all its copies have ids."""
    found = jaccard.join(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_doc_id")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["kept_doc_id"]), "left_semi")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to twice."""
    prepare(spark)
    packed, back = _apart(docs, ["doc_id", "text", "source"])
    return back(mixing.mix(packed))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes, a row for each time that a document is taken."""
    prepare(spark)
    return queries.bpe_digests(docs.select("doc_id", "text"))
