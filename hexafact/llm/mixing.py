"""Mixing sources by temperature.

A source's weight is its share of tokens raised to an exponent and normalised.
The exponent is bisected between 0 (all sources alike) and 1 (as they come) for
the flattest mixture that keeps to a limit: an entropy not above
``target_entropy`` (as a share of the largest possible), or no source repeated
more than ``max_repeats`` times. ``budget`` is the number of tokens wanted; by
default the least that takes every document once.

A source's part of the budget is realised by permutations of blocks: whole
epochs first, each taking every document once; of the last epoch, blocks in
hashed order until the budget is met, and in the block where that happens,
documents in hashed order. Blocks hold about ``BLOCK_TOKENS`` tokens, so
nothing larger than a block's documents or a source's list of blocks is ordered
together, however large a source is. All of it is DataFrame operations.

The driver holds one row for each source, at most ``MAX_SOURCES`` (ValueError).

Defined results: a null source is a source of its own; null and empty texts
have no tokens and go with their block; a source without tokens has each of its
documents once; an empty table gives an empty result; rows with equal id and
text are decided alike; columns whose names begin with mix_ are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, exp, floor, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_TOKENS = 200_000
MAX_SOURCES = 100_000
MAX_REPEATS = 2.0
STEPS = 60


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


@dataclass(frozen=True)
class Share:
    """One source: its tokens and weight, whole epochs, tokens of the last epoch, and blocks."""

    source: str | None
    tokens: int
    weight: float
    epochs: int
    rest: float
    blocks: int


def weights(tokens: dict[str | None, int], exponent: float) -> dict[str | None, float]:
    """Normalised weights; sources without tokens get none."""
    total = sum(tokens.values())
    raw = {s: exp(exponent * log(n / total)) for s, n in tokens.items() if n > 0}
    whole = sum(raw.values())
    return {s: r / whole for s, r in raw.items()}


def entropy(w: dict[str | None, float]) -> float:
    """Entropy as a share of the largest possible; 1 for a single source."""
    return 1.0 if len(w) < 2 else -sum(x * log(x) for x in w.values() if x > 0) / log(len(w))


def _budget(tokens: dict, w: dict, budget: float | None) -> float:
    return budget if budget is not None else max((tokens[s] / x for s, x in w.items()), default=0.0)


def solve(tokens: dict[str | None, int], target_entropy: float | None, max_repeats: float | None, budget: float | None) -> float:
    """The least exponent that keeps to the limit; 1 if none does."""

    def keeps(exponent: float) -> bool:
        w = weights(tokens, exponent)
        if target_entropy is not None and entropy(w) > target_entropy:
            return False
        return max_repeats is None or max((x * _budget(tokens, w, budget) / tokens[s] for s, x in w.items()), default=0) <= max_repeats * (1 + 1e-12)

    if not any(tokens.values()) or keeps(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (low, mid) if keeps(mid) else (mid, high)
    return high


def plan(tokens: dict[str | None, int], target_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS, budget: float | None = None) -> list[Share]:
    exponent = solve(tokens, target_entropy, max_repeats, budget)
    w = weights(tokens, exponent)
    total = _budget(tokens, w, budget)
    out = []
    for s, n in tokens.items():
        if s not in w:
            out.append(Share(s, 0, 0.0, 1, 0.0, 1))
            continue
        part = w[s] * total
        epochs = floor(part / n + 1e-9)
        out.append(Share(s, n, w[s], epochs, max(0.0, part - epochs * n), max(1, ceil(n / BLOCK_TOKENS))))
    return out


def mix(docs: DataFrame, tokens: Column | None = None, target_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS, budget: float | None = None, seed: int = 5) -> DataFrame:
    """``docs`` (doc_id, text, source and others) with each row as often as the mixture takes it, and its ``mix_epoch`` and ``mix_block``."""
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c.lower().startswith("mix_")])
    tokens = word_count() if tokens is None else tokens
    own = F.xxhash64("doc_id", "text", F.lit(seed))
    small = docs.select("source", tokens.alias("n"), own.alias("h"))
    totals = small.groupBy("source").agg(F.sum("n").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    shares = plan({r["source"]: r["n"] for r in sorted(totals, key=lambda r: (r["source"] is not None, r["source"] or ""))}, target_entropy, max_repeats, budget)
    rows = [(s.source, s.epochs, float(s.rest), s.blocks) for s in shares]
    table = F.broadcast(spark.createDataFrame(rows, "mix_source string, mix_epochs int, mix_rest double, mix_blocks int"))  # MAX_SOURCES rows at most
    block = F.pmod(F.xxhash64(F.col("mix_hash"), F.lit(1)), F.col("mix_blocks")).cast("int")

    def placed(df: DataFrame) -> DataFrame:
        return df.join(table, df["source"].eqNullSafe(F.col("mix_source"))).withColumn("mix_block", block)

    # of the last epoch: for each block, the highest hash that still belongs
    last = placed(small.withColumnRenamed("h", "mix_hash")).where("mix_rest > 0").withColumn("order", F.xxhash64(F.col("mix_hash"), F.lit(2)))
    sums = last.groupBy("mix_source", "mix_block", "mix_rest").agg(F.sum("n").alias("n"))
    by_source = Window.partitionBy("mix_source").orderBy(F.xxhash64("mix_block", "mix_source", F.lit(seed)), "mix_block")
    sums = sums.withColumn("before", F.sum("n").over(by_source.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    crossing = sums.where("before < mix_rest and before + n > mix_rest").select("mix_source", "mix_block", "before")
    inside = last.join(crossing.select(F.col("mix_source").alias("s"), F.col("mix_block").alias("b"), "before"), F.col("mix_source").eqNullSafe(F.col("s")) & (F.col("mix_block") == F.col("b")))
    in_block = Window.partitionBy("mix_source", "mix_block").orderBy("order").rangeBetween(Window.unboundedPreceding, 0)
    # a document belongs if at least half of it fits
    inside = inside.withColumn("upto", F.col("before") + F.sum("n").over(in_block)).where(F.col("upto") - F.col("n") / 2 <= F.col("mix_rest"))
    cut = inside.groupBy("mix_source", "mix_block").agg(F.max("order").alias("cut"))
    full = sums.where("before + n <= mix_rest").select("mix_source", "mix_block", F.lit((1 << 63) - 1).alias("cut"))
    decided = full.unionByName(cut).select(F.col("mix_source").alias("mix_s"), F.col("mix_block").alias("mix_b"), F.col("cut").alias("mix_cut"))

    rows = placed(docs.withColumn("mix_hash", own))
    rows = rows.join(decided, F.col("mix_source").eqNullSafe(F.col("mix_s")) & (F.col("mix_block") == F.col("mix_b")), "left")
    copies = F.col("mix_epochs") + F.when(F.xxhash64(F.col("mix_hash"), F.lit(2)) <= F.col("mix_cut"), 1).otherwise(0)
    rows = rows.withColumn("mix_copies", copies).where("mix_copies > 0")
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1)).alias("mix_epoch"), "mix_block")
