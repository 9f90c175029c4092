"""Compiled facts of one lens, to be queried many times."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexafact.lang import parser
from hexafact.operators import compile as C
from hexafact.operators import discovery as D
from hexafact.operators.results import DiscoveryResult, ResultSet
from hexafact.plans.ir import Constraint, Discovery, GroupPlan, Query, UnsupportedNegation, normalise, settled_plan
from hexafact.plans.lower import STRATEGIES, STRICT

DEFAULT_LIMIT = 20


class DiscoveryError(ValueError):
    """A query where a discovery expression is needed, or the other way round."""


class Substrate:
    """A handle on facts; all of its operations are lazy DataFrames."""

    def __init__(self, facts: DataFrame, lens_id: str, numeric_eq: str = STRICT, compat: bool = False, strategy: str = "flags") -> None:
        self.facts = facts.where(F.col("lens_id") == lens_id)
        self.lens_id, self.numeric_eq, self.compat, self.strategy = lens_id, numeric_eq, compat, strategy

    def persist(self) -> Substrate:
        self.facts = self.facts.persist()
        return self

    def close(self) -> None:
        self.facts.unpersist()

    def ids(self, query: Query) -> DataFrame:
        return STRATEGIES[self.strategy](self.facts, query, self.numeric_eq)

    def query(self, constraints: list) -> list[str]:
        """One conjunct of plain constraints: sorted ids, none for no constraints."""
        return [r["entity_id"] for r in self.ids(normalise([constraints], self.compat)).orderBy("entity_id").collect()]

    def dimensions(self) -> list[str]:
        return [r[0] for r in self.facts.select("dimension").distinct().orderBy("dimension").collect()]

    def count(self) -> int:
        return self.facts.count()

    def entity_count(self) -> int:
        return self.facts.agg(F.countDistinct("entity_id")).first()[0]

    def describe(self) -> dict:
        rows = {r["dimension"]: r for r in D.describe(self.facts).collect()}
        total = rows.pop(None, None)
        return {
            "lens_id": self.lens_id,
            "fact_count": total["fact_count"] if total else 0,
            "entity_count": total["entity_count"] if total else 0,
            "dimensions": {d: rows[d]["fact_count"] for d in sorted(rows)},
        }

    def to_dataframe(self) -> DataFrame:
        return self.facts.orderBy("entity_id", "dimension", "semantic_key", "value")

    def get_facts(self, entity_id: str) -> DataFrame:
        return self.facts.where(F.col("entity_id") == entity_id)

    def coordinates(self) -> DataFrame:
        return self.facts.select("coordinate").distinct()

    def values_for(self, dimension: str, field: str) -> DataFrame:
        return D.by_value(self.facts, dimension, field)

    def __repr__(self) -> str:
        d = self.describe()
        return f"Substrate({self.lens_id!r}, {d['entity_count']} entities, {d['fact_count']} facts: {d['dimensions']})"

    def _repr_html_(self) -> str:
        return DiscoveryResult("all", D.by_dimension(self.facts))._repr_html_()


def _checked(substrate) -> Substrate:
    if not isinstance(substrate, Substrate):
        raise TypeError(f"a Substrate is needed, not {type(substrate).__name__}")
    return substrate


def planned(substrate: Substrate, text: str) -> Query:
    """The normalised query of a text."""
    tree = parser.read(text)
    if isinstance(tree, Discovery):
        raise DiscoveryError(f"{text!r} is a discovery expression: use discover()")
    if not substrate.compat and any(parser.negated_groups(c) for c in tree):
        raise UnsupportedNegation("NOT before a group is not defined")
    return normalise(parser.conjuncts(tree), substrate.compat)


def query(substrate: Substrate, text: str, limit: int | None = DEFAULT_LIMIT) -> ResultSet:
    """Entities that match a query text, ascending; ``limit`` None or 0 gives all."""
    ids = _checked(substrate).ids(planned(substrate, text))
    return ResultSet(ids, substrate.facts, text, limit)


def execute(constraints, substrate: Substrate) -> ResultSet:
    """Entities for plain constraints: one conjunct as a flat list, a list of conjuncts, or what parse_to_constraints gives."""
    _checked(substrate)
    if isinstance(constraints, dict):
        if not constraints.get("success", True):
            raise parser.QuerySyntaxError(constraints.get("error", ""), constraints.get("position", 0), constraints.get("token"))
        if constraints.get("type") == "discovery":
            raise DiscoveryError("a discovery expression: use discover()")
        constraints = constraints["conjuncts"]
    flat = all(isinstance(c, (dict, Constraint)) for c in constraints)
    return ResultSet(substrate.ids(normalise([constraints] if flat else constraints, substrate.compat)), substrate.facts)


def execute_plan(plan: GroupPlan, substrate: Substrate) -> ResultSet:
    """Entities for a grouped plan: any constraint of each group."""
    return ResultSet(_checked(substrate).ids(settled_plan(plan, substrate.compat)), substrate.facts)


def discover(substrate: Substrate, expression: str, limit: int | None = None) -> DiscoveryResult:
    request = parser.read(expression)
    if not isinstance(request, Discovery):
        raise DiscoveryError(f"{expression!r} is no discovery expression: *, DIM|* or DIM|field|*")
    return DiscoveryResult(request.scope, D.discovered(_checked(substrate).facts, request, limit), request.dimension, request.field)


def explain(substrate: Substrate, text: str) -> DataFrame:
    """How many entities meet each constraint of a query."""
    q = planned(_checked(substrate), text)
    return D.estimates(substrate.facts, list(dict.fromkeys(c for conjunct in q.conjuncts for c in conjunct)), substrate.numeric_eq)


def compile_data(source, lens, into: str | None = None, spark: SparkSession | None = None, dedup: bool = False, **options) -> Substrate:
    """Compile a DataFrame or CSV file under a lens; ``into`` also writes the facts and the lens (parquet://, csv:// or sql://)."""
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    lens = C.read_lens(lens)
    facts = C.compile_frame(C.as_frame(spark, source), lens, dedup)
    if into is not None:
        from hexafact.sources import sinks

        path = sinks.write(facts, lens, into)
        if into.startswith("parquet://"):
            facts = spark.read.schema(C.FACT_SCHEMA).parquet(str(Path(path)))
    return Substrate(facts, lens["lens_id"], **options)
