"""Range sharding by sampled splitters, so that shards hold nearly equal bytes.

A row's size is the UTF-8 length of its text plus a fixed overhead. Rows are
ordered by (hash of the text, hash of the id), so equal texts are neighbours.
A size-weighted sample gives quantile boundaries of many fine ranges; a range
that turns out overfull is sampled again, denser, and subdivided, if need be
within one group of equal texts. Consecutive fine ranges then make a shard,
cut where the running total of bytes is nearest to its share; cuts prefer the
start of a group of equal texts when one is near enough.

What reaches the driver: the sample (``SAMPLE`` rows expected) and two numbers
for each fine range; both are parameters, not functions of the input.

Defined results: a null text has no bytes and the checksum of the empty string;
null ids sort with the hash of null; an empty table gives an empty result;
repeated rows (same id, same text) are equal keys and stay in one range.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hexafact.llm.session import materialise, prepare

OVERHEAD = 8
SAMPLE = 40_000
RANGES_PER_SHARD = 256
#: A range with more than this many times its share is subdivided.
OVERFULL = 2.0
ROUNDS = 3
#: A cut may move by this share of a shard to keep a group of equal texts whole.
SLACK = 0.004
LOWEST = np.iinfo(np.int64).min


@dataclass
class Layout:
    """Fine ranges: splitters (first keys of ranges after the first), shard and first slot of each."""

    high: np.ndarray
    low: np.ndarray
    shard: np.ndarray
    first_slot: np.ndarray

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The range of each key: the number of splitters not above it."""
        a = np.searchsorted(self.high, high, "left")
        b = np.searchsorted(self.high, high, "right")
        several = np.flatnonzero(b - a > 1)
        at = a + ((b - a == 1) & (self.low[np.minimum(a, max(len(self.low) - 1, 0))] <= low) if len(self.low) else 0)
        for h in np.unique(high[several]):
            own = several[high[several] == h]
            i, j = np.searchsorted(self.high, h, "left"), np.searchsorted(self.high, h, "right")
            at[own] = i + np.searchsorted(self.low[i:j], low[own], "right")
        return at


def _located(df: DataFrame, layout: Layout) -> DataFrame:
    """Add each row's range, and its shard and first slot if they are decided."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = [b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("key_high", "key_low")]
            at = layout.find(*key)
            made = [at.astype(np.int32), layout.shard[at].astype(np.int32), layout.first_slot[at]]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, made)], names=[*b.schema.names, "range_id", "shard", "first_slot"])

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{columns}, range_id int, shard int, first_slot bigint")


def _sample(df: DataFrame, rate: float, seed: int) -> tuple[np.ndarray, ...]:
    """Keys drawn with probability min(1, size * rate), and what each stands for."""
    u = (F.xxhash64("key_high", "key_low", F.lit(seed)) / F.lit(2.0**64)) + F.lit(0.5)
    rows = df.where(u < F.col("size") * F.lit(rate)).select("key_high", "key_low", F.greatest(F.col("size").cast("double"), F.lit(1 / rate)).alias("w")).toPandas()
    rows = rows.sort_values(["key_high", "key_low"], kind="stable")
    return rows["key_high"].to_numpy(np.int64), rows["key_low"].to_numpy(np.int64), rows["w"].to_numpy(float)


def _quantiles(high: np.ndarray, low: np.ndarray, weight: np.ndarray, parts: int, begun: int | None = None) -> list[tuple[int, int]]:
    """Boundaries of ``parts`` ranges of equal weight; a group's first boundary moves to its start, unless a range begins with that group (``begun``)."""
    if not len(high) or parts < 2:
        return []
    total = np.cumsum(weight)
    at = np.unique(np.minimum(np.searchsorted(total, total[-1] * np.arange(1, parts) / parts), len(high) - 1))
    out, seen = [], {begun}
    for i in at.tolist():
        h = int(high[i])
        out.append((h, LOWEST if h not in seen else int(low[i])))
        seen.add(h)
    return out


def _layout(splitters: set[tuple[int, int]]) -> Layout:
    ordered = sorted(splitters)
    n = len(ordered) + 1
    return Layout(np.array([s[0] for s in ordered], np.int64), np.array([s[1] for s in ordered], np.int64), np.zeros(n, np.int32), np.zeros(n, np.int64))


def _totals(df: DataFrame, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    got = _located(df, layout).groupBy("range_id").agg(F.sum("size").alias("b"), F.count("*").alias("n")).toPandas()
    size, count = np.zeros(len(layout.shard)), np.zeros(len(layout.shard), np.int64)
    size[got["range_id"]], count[got["range_id"]] = got["b"], got["n"]
    return size, count


def shard(docs: DataFrame, shards: int, sample: int = SAMPLE, ranges_per_shard: int = RANGES_PER_SHARD, seed: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of ``docs`` (doc_id, text)."""
    if shards < 1:
        raise ValueError("there must be a shard")
    prepare(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("key_high"),
        F.xxhash64(F.col("doc_id"), F.lit(seed)).alias("key_low"),
    )
    keyed = materialise(keyed, "shard-keys")
    total = keyed.agg(F.sum("size")).first()[0] or 0
    parts = shards * ranges_per_shard
    splitters: set[tuple[int, int]] = set()
    if total:
        splitters.update(_quantiles(*_sample(keyed, sample / total, seed), parts))
    layout = _layout(splitters)
    size, count = _totals(keyed, layout)
    for again in range(1, ROUNDS + 1):
        full = np.flatnonzero((size > OVERFULL * total / parts) & (count > 1))
        if not len(full):
            break
        layout.shard[full] = 1
        inside = _located(keyed, layout).where("shard = 1")
        high, low, weight = _sample(inside, sample * 4**again / total, seed + again)
        where = layout.find(high, low)
        before = len(splitters)
        for r in full.tolist():
            own = where == r
            pieces = int(np.ceil(size[r] / (total / parts)))
            begun = int(layout.high[r - 1]) if r else None
            splitters.update(_quantiles(high[own], low[own], weight[own], pieces, begun))
        if len(splitters) == before:
            break
        layout = _layout(splitters)
        size, count = _totals(keyed, layout)
    _assign(layout, size, count, shards)
    order = Window.partitionBy("range_id").orderBy("key_high", "key_low", F.col("doc_id").asc_nulls_first())
    return _located(keyed, layout).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + F.row_number().over(order) - 1).cast("bigint").alias("slot")
    )


def _assign(layout: Layout, size: np.ndarray, count: np.ndarray, shards: int) -> None:
    """Cut the ranges into shards and give each range its first slot."""
    ends = np.cumsum(size)
    total = ends[-1] if len(ends) else 0
    whole = np.append(layout.low == LOWEST, True)  # does a group start where range i ends?
    cuts = [0]
    for k in range(1, shards):
        goal = total * k / shards
        near = int(np.argmin(np.abs(ends - goal))) + 1 if len(ends) else 0
        clean = np.flatnonzero(whole)
        best = int(clean[np.argmin(np.abs(ends[clean] - goal))]) + 1
        if abs(ends[best - 1] - goal) <= SLACK * total / shards:
            near = best
        cuts.append(max(near, cuts[-1]))
    cuts.append(len(size))
    for s in range(shards):
        a, b = cuts[s], cuts[s + 1]
        layout.shard[a:b] = s
        layout.first_slot[a:b] = np.cumsum(count[a:b]) - count[a:b]
