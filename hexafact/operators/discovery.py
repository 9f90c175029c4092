"""Counts over facts: what exists, how much of it, and how selective a query's parts are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexafact.plans.ir import Discovery
from hexafact.plans.lower import key, predicate


def _entities() -> F.Column:
    return F.countDistinct("entity_id").cast("bigint").alias("entity_count")


def _facts() -> F.Column:
    return F.count("*").cast("bigint").alias("fact_count")


def by_dimension(facts: DataFrame) -> DataFrame:
    return facts.groupBy("dimension").agg(_entities(), _facts()).orderBy(F.desc("fact_count"), "dimension")


def by_key(facts: DataFrame, dimension: str, limit: int | None = None, values: bool = False) -> DataFrame:
    """Keys of a dimension, and how many different values each has if asked."""
    more = [F.countDistinct("value").cast("bigint").alias("value_count")] if values else []
    out = facts.where(F.col("dimension") == dimension.lower()).groupBy("semantic_key").agg(_entities(), _facts(), *more)
    out = out.orderBy(F.desc("fact_count"), "semantic_key")
    return out.limit(limit) if limit else out


def by_value(facts: DataFrame, dimension: str, field: str, limit: int | None = None) -> DataFrame:
    out = facts.where(key(dimension, field)).groupBy("value").agg(_entities()).orderBy(F.desc("entity_count"), "value")
    return out.limit(limit) if limit else out


def discovered(facts: DataFrame, request: Discovery, limit: int | None = None) -> DataFrame:
    if request.scope == "all":
        return by_dimension(facts)
    if request.scope == "dimension":
        return by_key(facts, request.dimension, limit)
    return by_value(facts, request.dimension, request.field, limit)


def schema(facts: DataFrame) -> DataFrame:
    """All keys of all dimensions with entity and value counts."""
    out = facts.groupBy("dimension", "semantic_key").agg(_entities(), F.countDistinct("value").cast("bigint").alias("value_count"))
    return out.orderBy("dimension", F.desc("entity_count"), "semantic_key")


def affordances(facts: DataFrame) -> DataFrame:
    """Every value with its coordinate and counts. Fact counts add up over values; entity counts do not."""
    return facts.groupBy("dimension", "semantic_key", "value", "coordinate").agg(_entities(), _facts())


def describe(facts: DataFrame) -> DataFrame:
    """Facts and entities by dimension, and in total (a null dimension)."""
    return facts.rollup("dimension").agg(_facts(), _entities())


def estimates(facts: DataFrame, constraints: list, numeric_eq: str = "strict") -> DataFrame:
    """For each constraint: entities that meet it and its share of all, the most selective first; one scan for all."""
    names = [f"{c.dimension}.{c.field} {c.op} {c.value}" for c in constraints]
    counts = [F.countDistinct(F.when(predicate(c, numeric_eq), F.col("entity_id"))).alias(f"n{i}") for i, c in enumerate(constraints)]
    row = facts.agg(F.countDistinct("entity_id").alias("every"), *counts)
    pairs = F.array(*[F.struct(F.lit(n).alias("constraint"), F.col(f"n{i}").cast("bigint").alias("entity_count")) for i, n in enumerate(names)])
    out = row.select("every", F.inline(pairs))
    return out.select("constraint", "entity_count", F.round(100 * F.col("entity_count") / F.greatest("every", F.lit(1)), 2).alias("percent")).orderBy("entity_count", "constraint")


def column_uniqueness(df: DataFrame) -> DataFrame:
    """For each column: values, different values, and whether over 95 % of them differ."""
    columns = [c for c in df.columns]
    row = df.agg(*[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(columns)], *[F.countDistinct(f"`{c}`").alias(f"d{i}") for i, c in enumerate(columns)])
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").cast("bigint").alias("n_values"), F.col(f"d{i}").cast("bigint").alias("n_distinct")) for i, c in enumerate(columns)])
    out = row.select(F.inline(items))
    return out.withColumn("unique", F.col("n_values").cast("double") * 0.95 < F.col("n_distinct"))
