"""What queries return: lazy wrappers over DataFrames."""

from __future__ import annotations

import html
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHOWN = 50


def hydrate(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """All facts of the entities, ordered by entity, dimension and key."""
    return facts.join(ids.select("entity_id").distinct(), "entity_id", "left_semi").orderBy("entity_id", "dimension", "semantic_key", "value")


def pivot(facts: DataFrame, ids: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A row for each entity and a column for each key: its distinct values in order, joined by a bar; no value is an empty text."""
    own = facts.join(ids.select("entity_id").distinct(), "entity_id", "left_semi")
    if keys is None:
        keys = [r[0] for r in own.select("semantic_key").distinct().orderBy("semantic_key").collect()]
    if not keys:
        return own.select("entity_id").distinct()
    # hashing leaves each value once; only those are gathered, in one aggregation for all keys
    once = own.where(F.col("semantic_key").isin(*keys)).select("entity_id", "semantic_key", "value").distinct()
    texts = [F.array_join(F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("semantic_key") == k, F.col("value"))))), " | ").alias(k) for k in keys]
    return once.groupBy("entity_id").agg(*texts)


def pivot_first(facts: DataFrame, ids: DataFrame, limit: int = 20) -> DataFrame:
    """A wide view for display: the least value of each key."""
    own = facts.join(ids.select("entity_id").distinct().orderBy("entity_id").limit(limit), "entity_id", "left_semi")
    return own.groupBy("entity_id").pivot("semantic_key").agg(F.min("value")).na.fill("").orderBy("entity_id")


class ResultSet:
    """Matching entities in ascending order. Nothing runs until rows are asked for."""

    def __init__(self, ids: DataFrame, facts: DataFrame, text: str = "", limit: int | None = None) -> None:
        if limit is not None and limit < 0:
            raise ValueError("a limit is not negative")
        self._all, self._facts, self.text, self.limit = ids, facts, text, limit or None
        self._ids: list[str] | None = None

    @property
    def ids(self) -> DataFrame:
        ordered = self._all.select("entity_id").orderBy("entity_id")
        return ordered.limit(self.limit) if self.limit else ordered

    @property
    def entity_ids(self) -> list[str]:
        if self._ids is None:
            self._ids = [r["entity_id"] for r in self.ids.collect()]
        return self._ids

    @property
    def count(self) -> int:
        if self._ids is not None:
            return len(self._ids)
        return self.ids.count()

    def __len__(self) -> int:
        return self.count

    def __iter__(self) -> Iterator[str]:
        return iter(self.entity_ids)

    def to_dataframe(self) -> DataFrame:
        return hydrate(self._facts, self.ids)

    def pivot(self) -> DataFrame:
        return pivot(self._facts, self.ids)

    def to_pandas(self):
        return self.to_dataframe().toPandas()

    def __repr__(self) -> str:
        return f"ResultSet({self.text!r}, {self.count} entities)"

    def _repr_html_(self) -> str:
        return _table(f"{self.count} entities", self.text, self.to_dataframe().limit(SHOWN))


class DiscoveryResult:
    """Counts of what exists at a scope."""

    def __init__(self, scope: str, rows: DataFrame, dimension: str | None = None, field: str | None = None) -> None:
        self.scope, self.rows, self.dimension, self.field = scope, rows, dimension, field

    def to_dataframe(self) -> DataFrame:
        return self.rows

    def collect(self) -> list[dict]:
        return [r.asDict() for r in self.rows.collect()]

    def __iter__(self) -> Iterator[dict]:
        return iter(self.collect())

    def __len__(self) -> int:
        return self.rows.count()

    def __repr__(self) -> str:
        rows = [r.asDict() for r in self.rows.limit(SHOWN).collect()]
        if not rows:
            return f"nothing found ({self.scope})"
        names = list(rows[0])
        width = {n: max(len(n), *(len(str(r[n])) for r in rows)) for n in names}
        line = lambda r: "  ".join(str(r[n]).ljust(width[n]) for n in names)
        return "\n".join([line({n: n for n in names}), *map(line, rows)])

    def _repr_html_(self) -> str:
        return _table(self.scope, "|".join(x for x in (self.dimension, self.field, "*") if x), self.rows.limit(SHOWN))


def _table(title: str, badge: str, rows: DataFrame) -> str:
    head = "".join(f"<th>{html.escape(c)}</th>" for c in rows.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in rows.collect())
    return f"<div><b>{html.escape(title)}</b> <code>{html.escape(badge)}</code><table><tr>{head}</tr>{body}</table></div>"
