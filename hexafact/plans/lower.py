"""From a normalised query to one DataFrame of entity ids.

Every query is a boolean formula over facts that an entity has. ``flags``, the
default, evaluates all of it in one scan and one aggregation by entity: each
distinct predicate is a bool_or, and the formula filters the result. A single
predicate needs no formula, only distinct ids. ``semi_joins`` composes
left-semi joins and unions instead; both give the same ids.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexafact.functions import scalars as S
from hexafact.plans.ir import Constraint, Exclusive, Query, UnknownOperator

STRICT, LENIENT = "strict", "lenient"


class ComparisonError(ValueError):
    """Bounds that cannot be compared with each other."""


def _number(value) -> bool:
    return isinstance(value, (int, float))


def spellings(value, numeric_eq: str) -> list[str]:
    """The texts that equal a literal: its own, and for a whole number, if lenient, that without a decimal point."""
    text = S.literal_text(value)
    if numeric_eq == LENIENT and isinstance(value, float) and value.is_integer():
        return [text, str(int(value))]
    return [text]


def key(dimension: str, field: str) -> Column:
    return (F.col("dimension") == dimension.lower()) & (F.col("semantic_key") == field)


def test(c: Constraint, numeric_eq: str = STRICT) -> Column:
    """The predicate on a fact's value."""
    value = F.col("value")
    if c.op in ("eq", "not_eq"):
        own = spellings(c.value, numeric_eq)
        same = value == own[0] if len(own) == 1 else value.isin(*own)
        return same if c.op == "eq" else ~same
    if c.op in ("gt", "lt", "gte", "lte"):
        left, right = (S.safe_double(value), F.lit(float(c.value))) if _number(c.value) else (value, F.lit(S.literal_text(c.value)))
        return {"gt": left > right, "lt": left < right, "gte": left >= right, "lte": left <= right}[c.op]
    if c.op == "between":
        if not _number(c.value):
            return value.between(S.literal_text(c.value), S.literal_text(c.value2))
        try:
            high = float(c.value2)
        except (TypeError, ValueError):
            raise ComparisonError(f"BETWEEN {c.value!r} AND {c.value2!r}: the second bound is no number") from None
        return S.safe_double(value).between(float(c.value), high)
    if c.op == "contains":
        return S.contains(value, S.literal_text(c.value))
    if c.op == "prefix":
        return S.prefixed(value, S.literal_text(c.value))
    raise UnknownOperator(f"unknown operator: {c.op!r}")


def predicate(c: Constraint, numeric_eq: str = STRICT) -> Column:
    return key(c.dimension, c.field) & F.coalesce(test(c, numeric_eq), F.lit(False))


def _allowed(o: Exclusive, numeric_eq: str) -> list[list[str]]:
    return [spellings(v, numeric_eq) for v in o.values]


def flags(facts: DataFrame, query: Query, numeric_eq: str = STRICT) -> DataFrame:
    """entity_id of every match."""
    if query.empty:
        return facts.select("entity_id").where(F.lit(False))
    atoms = list(dict.fromkeys(c for conjunct in query.conjuncts for c in conjunct))
    if len(atoms) == 1 and not query.only and not query.clauses:
        return facts.where(predicate(atoms[0], numeric_eq)).select("entity_id").distinct()
    columns: list[Column] = []
    scans: list[Column] = []
    name = {}
    for i, c in enumerate(atoms):
        p = predicate(c, numeric_eq)
        name[c] = f"f{i}"
        columns.append(F.bool_or(p).alias(f"f{i}"))
        scans.append(p)
    keep: list[Column] = []
    for j, o in enumerate(query.only):
        guard, values = key(o.dimension, o.field), _allowed(o, numeric_eq)
        every = [s for v in values for s in v]
        columns.append(F.bool_or(guard & ~F.col("value").isin(*every)).alias(f"other{j}"))
        keep.append(~F.col(f"other{j}"))
        for k, own in enumerate(values):
            columns.append(F.bool_or(guard & F.col("value").isin(*own)).alias(f"has{j}_{k}"))
            keep.append(F.col(f"has{j}_{k}"))
        scans.append(guard)
    for i, clause in enumerate(query.clauses):
        p = reduce(or_, [predicate(c, numeric_eq) for c in clause])
        columns.append(F.bool_or(p).alias(f"any{i}"))
        keep.append(F.col(f"any{i}"))
        scans.append(p)
    dims = sorted({c.dimension.lower() for c in (*atoms, *(c for clause in query.clauses for c in clause))} | {o.dimension.lower() for o in query.only})
    # the dimensions on their own prune partitions; the predicates reach the scan as filters
    scanned = facts.where(F.col("dimension").isin(*dims)).where(reduce(or_, scans))
    if query.conjuncts:
        keep.append(reduce(or_, [reduce(and_, [F.col(name[c]) for c in conjunct]) for conjunct in query.conjuncts if conjunct]))
    return scanned.groupBy("entity_id").agg(*columns).where(reduce(and_, keep)).select("entity_id")


def semi_joins(facts: DataFrame, query: Query, numeric_eq: str = STRICT) -> DataFrame:
    """The same ids by set operations."""
    if query.empty:
        return facts.select("entity_id").where(F.lit(False))

    def ids(condition: Column) -> DataFrame:
        return facts.where(condition).select("entity_id").distinct()

    def both(parts: list[DataFrame]) -> DataFrame:
        return reduce(lambda a, b: a.join(b, "entity_id", "left_semi"), parts)

    parts = []
    if query.conjuncts:
        parts.append(reduce(lambda a, b: a.unionByName(b), [both([ids(predicate(c, numeric_eq)) for c in conjunct]) for conjunct in query.conjuncts if conjunct]).distinct())
    parts += [ids(reduce(or_, [predicate(c, numeric_eq) for c in clause])) for clause in query.clauses]
    for o in query.only:
        guard, values = key(o.dimension, o.field), _allowed(o, numeric_eq)
        own = both([ids(guard & F.col("value").isin(*v)) for v in values])
        parts.append(own.join(ids(guard & ~F.col("value").isin(*[s for v in values for s in v])), "entity_id", "left_anti"))
    return both(parts)


STRATEGIES = {"flags": flags, "semi_joins": semi_joins}
