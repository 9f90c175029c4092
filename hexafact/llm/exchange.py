"""Dealing packed entries (key, document, place) to buckets and flags back to documents.

Entries travel as a few binary values for each (slice, bucket), so a shuffle of
many millions of entries is thousands of rows. Within a slice, entries of one
key are merged before they are sent: what the slice can decide alone is decided
there, and one entry a key goes on. A key held by a third of all documents then
costs one entry for each slice, not for each document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexafact.llm.session import parallelism
from hexafact.llm.text import trim

ENTRY_SCHEMA = "bucket int, keys binary, docs binary, places binary"
FLAG_SCHEMA = "doc_id bigint, places binary"
#: Entries that one bucket is planned to hold.
BUCKET_ENTRIES = 1 << 20


def bucket_count(docs: DataFrame, bytes_per_entry: float) -> int:
    """Buckets for entries made of all texts: as many as keep each near BUCKET_ENTRIES."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(parallelism(docs.sparkSession), int(total / bytes_per_entry / BUCKET_ENTRIES) + 1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each full window of ``width`` values."""
    span, out = 1, x
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def packed(bucket: np.ndarray, keys: np.ndarray, docs: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket. ``keys`` may be a structured array."""
    order = np.argsort(bucket, kind="stable")
    bucket, keys, docs, places = bucket[order], keys[order], docs[order], places[order]
    head = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(head[1:], len(bucket))[: len(head)]

    def cut(x: np.ndarray) -> pa.Array:
        raw, size = np.ascontiguousarray(x).tobytes(), x.dtype.itemsize
        return pa.array([raw[a * size : b * size] for a, b in zip(head.tolist(), ends.tolist(), strict=True)], pa.binary())

    return pa.RecordBatch.from_arrays([pa.array(bucket[head].astype(np.int32)), cut(keys), cut(docs), cut(places)], names=["bucket", "keys", "docs", "places"])


def flags(docs: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """A row of values (places, or spans) for each document."""
    order = np.argsort(docs, kind="stable")
    docs, values = docs[order], values[order]
    head = np.flatnonzero(np.append(True, docs[1:] != docs[:-1])) if len(docs) else np.zeros(0, np.int64)
    ends = np.append(head[1:], len(docs))[: len(head)].tolist()
    raw, size = np.ascontiguousarray(values).tobytes(), values.dtype.itemsize
    made = [raw[size * a : size * b] for a, b in zip(head.tolist(), ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(docs[head], pa.int64()), pa.array(made, pa.binary())], names=["doc_id", "places"])


#: the joined columns of a whole bucket -> flagged documents and their values
Decide = Callable[..., tuple[np.ndarray, np.ndarray]]
#: Rows with this bucket carry flags that a slice has decided alone.
DECIDED = -1


def reduced(entries: DataFrame, fn: Callable[..., pa.RecordBatch], types: list, schema: str, passed: Callable | None = None) -> DataFrame:
    """``fn`` of each bucket's joined columns. ``entries`` has bucket and binary columns of element types ``types``; ``passed`` takes a DECIDED row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple[bytes, ...]] = []
        at = None

        def close() -> Iterator[pa.RecordBatch]:
            if own:
                yield fn(*(np.frombuffer(b"".join(c), t) for c, t in zip(zip(*own, strict=True), types, strict=True)))

        for b in batches:
            for bucket, *columns in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket == DECIDED:
                    yield passed(*columns)
                    continue
                if bucket != at:
                    yield from close()
                    own, at = [], bucket
                own.append(tuple(columns))
        yield from close()
        own.clear()
        trim()

    n = parallelism(entries.sparkSession)
    spread = F.when(F.col("bucket") == DECIDED, F.xxhash64("docs")).otherwise(F.col("bucket").cast("bigint"))
    dealt = entries.repartition(n, spread).sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, schema)


def decided(entries: DataFrame, decide: Decide, types: list, value_type) -> DataFrame:
    """Flags (doc_id, places) from dealt entries; in a DECIDED row, docs and places are the flags, and are passed on."""

    def passed(keys: bytes, docs: bytes, places: bytes, *_) -> pa.RecordBatch:
        return flags(np.frombuffer(docs, np.int64), np.frombuffer(places, value_type))

    return reduced(entries, lambda *columns: flags(*decide(*columns)), types, FLAG_SCHEMA, passed)


def gathered(flagged: DataFrame, out: str) -> DataFrame:
    """One row for each document: the concatenated places of its flags (a document has no more places than words or bytes)."""
    return flagged.groupBy("doc_id").agg(F.collect_list("places").alias(out)).select(F.col("doc_id").alias("flag_doc_id"), out)
