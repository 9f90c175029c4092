"""Rows beside their successor by id, without a global window.

Splitters taken from the ids cut the table into buckets; each bucket is sorted
and read once. A bucket's last row needs the first row of the next bucket, so
that row is sent to both. The driver holds one splitter and one first id for
each bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (own texts, texts of their successors) -> columns
PairFunction = Callable[[list[str], list[str]], dict]


def with_next(docs: DataFrame, buckets: int, fn: PairFunction, new: str, batch_bytes: int = 2 << 20) -> DataFrame:
    """doc_id and the columns that ``fn`` makes of each text and the next document's (after the last: the first's).

    Order is ascending doc_id, nulls first; rows with equal ids follow by text. ``new`` is the schema of the made columns.
    """
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    cuts = ids.where("doc_id is not null").approxQuantile("doc_id", [k / buckets for k in range(1, buckets)], 0.2 / buckets) if buckets > 1 else []
    cuts = sorted({int(c) for c in cuts or []})
    lowest = F.coalesce(F.col("doc_id"), F.lit(np.iinfo(np.int64).min))
    bucket = F.lit(0)
    if cuts:
        bucket = F.expr(f"{len(cuts)} - aggregate(array({', '.join(f'{c}L' for c in cuts)}), 0, (n, c) -> n + if(coalesce(doc_id, -9223372036854775808) < c, 1, 0))")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("bucket", bucket.cast("int"))
    firsts = {r["bucket"]: r["f"] for r in rows.groupBy("bucket").agg(F.min(lowest).alias("f")).collect()}
    used = sorted(firsts)
    if not used:
        return docs.sparkSession.createDataFrame([], f"doc_id bigint, {new}")
    before = dict(zip(used[1:] + used[:1], used, strict=True))  # the bucket whose last row needs this bucket's first
    # candidates for "first row of the bucket": all rows with its lowest id; the reader takes the first by text
    target = F.create_map(*[F.lit(x) for b in used for x in (b, before[b])])
    first_id = F.create_map(*[F.lit(x) for b in used for x in (b, firsts[b])])
    is_first = lowest == first_id[F.col("bucket")]
    sent = rows.select(
        "doc_id", "text",
        F.explode(F.when(is_first, F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("extra")), F.struct(target[F.col("bucket")].alias("b"), F.lit(1).alias("extra")))).otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("extra"))))).alias("to"),
    ).select("doc_id", "text", F.col("to.b").alias("bucket"), F.col("to.extra").alias("extra"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []  # rows whose successor is known, with it
        size, last, done = 0, None, None
        for b in batches:
            for doc, text, buck, extra in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if last is not None and last[2] == buck and done != buck:
                    kept.append((last[0], last[1], text))
                    size += len(last[1]) + len(text)
                    if size > batch_bytes:
                        yield made(kept)
                        kept, size = [], 0
                if extra:
                    done, last = buck, None
                else:
                    last = (doc, text, buck)
        if kept:
            yield made(kept)

    def made(kept: list[tuple]) -> pa.RecordBatch:
        columns = fn([k[1] for k in kept], [k[2] for k in kept])
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.int64()), *map(pa.array, columns.values())], names=["doc_id", *columns])

    dealt = sent.repartition(max(1, (len(used) + 2) // 3), "bucket").sortWithinPartitions("bucket", "extra", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.mapInArrow(run, f"doc_id bigint, {new}")
