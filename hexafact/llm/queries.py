"""One query for each operator, over its whole table."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexafact.llm import bpe, jaccard, lines, mixing, neighbours, oracles, passages, quality, sharding, simhash, suffixes, toxicity
from hexafact.llm.session import documents, materialise, parallelism
from hexafact.llm.text import slices

VOCABULARY = "byte_bpe_50k.tiktoken"


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(documents(spark, sf_dir))


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Encode every text, decode its ids, and digest both."""
    path = public_tokenizers.path(VOCABULARY)
    coded = bpe.encode(docs, path, keep=["doc_id"])
    both = bpe.decode(coded, path)
    return both.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixes.remove(documents(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SHARDS = 24


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(documents(spark, sf_dir), SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    counts = materialise(quality.measure(docs, ["doc_id", "lang"]), "quality-counts")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    found = quality.cutoffs(counts.join(labels, "doc_id"), "lang")
    return counts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality.base_failed().alias("base_failed"),
        (~quality.base_failed() & quality.verdict(found, "lang")).alias("kept"),
    )


HELD_OUT = "pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0"


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """Trained on the labelled rows that are not held out; a document labelled more than once is toxic if one label says so."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~F.expr(HELD_OUT)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return toxicity.train(docs, labels)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir), keep=["doc_id"])
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _edited(own: list[str], following: list[str]) -> dict:
    """Fingerprints of each text, of the next one, and of the text with its last quarter taken from the next one."""
    cut = [len(t) // 4 for t in own]
    edited = [(t[: len(t) - k] + f[:k]).encode("utf-8", "surrogatepass") for t, f, k in zip(own, following, cut, strict=True)]
    plain = {t: i for i, t in enumerate(dict.fromkeys([*own, *following]))}
    raw = [t.encode("utf-8", "surrogatepass") for t in plain]

    def prints(texts: list[bytes]) -> list[str]:
        out: list[str] = []
        offs = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        for a, b in slices(offs, 1 << 20):
            out += [f.hex() for f in simhash.fingerprints(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])]
        return out

    found = prints(raw)
    return {
        "n_chars": [len(t) for t in own],
        "edited_sha256": [hashlib.sha256(t).hexdigest() for t in edited],
        "fingerprint": [found[plain[t]] for t in own],
        "edited_fingerprint": prints(edited),
        "next_fingerprint": [found[plain[t]] for t in following],
    }


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also, for ids divisible by 50, what lies within the radius, its own fingerprint included: n_within different fingerprints, near_doc_ids (the smallest id that has each) and n_near_docs documents with them."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rows = neighbours.with_next(docs, 3 * parallelism(spark), _edited, "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string")
    rows = materialise(rows, "fingerprints")
    found = simhash.matches(rows, rows.where("doc_id % 50 = 0"))
    within = found.select(
        "fingerprint",
        F.size("found").cast("bigint").alias("n_within"),
        F.array_sort("found.doc_id").alias("near_doc_ids"),
        F.expr("aggregate(found.n_docs, 0L, (a, n) -> a + n)").alias("n_near_docs"),
    )
    asked = rows.where("doc_id % 50 = 0").select("doc_id", "fingerprint").distinct().join(within, "fingerprint").drop("fingerprint")
    return rows.join(asked, "doc_id", "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        simhash.likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        simhash.likeness("fingerprint", "next_fingerprint").alias("near_next"),
        "n_within", "near_doc_ids", "n_near_docs",
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = passages.remove(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each time that the mixture takes a document."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source").withColumn("n_tokens", mixing.word_count())
    return mixing.mix(docs, F.col("n_tokens")).select("doc_id", "source", "n_tokens", F.col("mix_epoch").alias("epoch"), F.col("mix_block").alias("block"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op1_simhash": op1_simhash, "op2_byte_bpe": op2_byte_bpe, "op3_suffix_dedup": op3_suffix_dedup, "op4_sharding": op4_sharding, "op5_quality_rules": op5_quality_rules, "op6_toxicity": op6_toxicity, "op7_line_dedup": op7_line_dedup, "op8_passages": op8_passages, "op9_mixing": op9_mixing, "op10_jaccard_join": op10_jaccard_join}
SQL = dict(oracles.SQL)
