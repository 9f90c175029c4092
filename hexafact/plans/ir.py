"""Queries as data: constraints, disjunctions of conjunctions, discovery requests, and grouped plans."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

COMPARISONS = ("eq", "not_eq", "gt", "lt", "gte", "lte")
OPERATORS = (*COMPARISONS, "contains", "prefix", "between", "only")
FLIPPED = {"eq": "not_eq", "not_eq": "eq", "gt": "lte", "lte": "gt", "lt": "gte", "gte": "lt"}


class UnsupportedNegation(ValueError):
    """NOT before a predicate that has no opposite among facts."""


class UnknownOperator(ValueError):
    """A constraint with an operator that the engine does not have."""


@dataclass(frozen=True)
class Constraint:
    """One predicate on the facts of a dimension and field."""

    dimension: str
    field: str
    op: str
    value: Any
    value2: Any = None
    negated: bool = False
    #: True equals 1 in Python, but not in a query.
    kinds: tuple[str, ...] = field(init=False, repr=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "kinds", (type(self.value).__name__, type(self.value2).__name__))

    @classmethod
    def of(cls, raw: Constraint | dict) -> Constraint:
        """From the plain form: category, field, op, value, and maybe value2 and negated."""
        if isinstance(raw, Constraint):
            return raw
        return cls(str(raw["category"]).upper(), raw["field"], raw.get("op", "eq"), raw["value"], raw.get("value2"), bool(raw.get("negated")))

    def plain(self) -> dict:
        out = {"category": self.dimension, "field": self.field, "op": self.op, "value": self.value}
        if self.op == "between":
            out["value2"] = self.value2
        if self.negated:
            out["negated"] = True
        return out

    def settled(self, compat: bool) -> Constraint:
        """Without negation: a comparison turns into its opposite. Other predicates have none among facts; ``compat`` keeps them as they are."""
        if self.op not in OPERATORS:
            raise UnknownOperator(f"unknown operator: {self.op!r}")
        if not self.negated:
            return self
        if self.op in FLIPPED:
            return replace(self, op=FLIPPED[self.op], negated=False)
        if compat:
            return replace(self, negated=False)
        raise UnsupportedNegation(f"NOT is not defined for {self.op.upper()} on {self.dimension}.{self.field}")


@dataclass(frozen=True)
class Exclusive:
    """ONLY: the field has all these values and no other."""

    dimension: str
    field: str
    values: tuple


@dataclass(frozen=True)
class Query:
    """Any of the conjuncts, every ONLY set, and of every clause one constraint at least."""

    conjuncts: tuple[tuple[Constraint, ...], ...]
    only: tuple[Exclusive, ...] = ()
    clauses: tuple[tuple[Constraint, ...], ...] = ()

    @property
    def empty(self) -> bool:
        return not self.only and not any(self.conjuncts) and not self.clauses


@dataclass(frozen=True)
class Discovery:
    """What exists: everywhere, in a dimension, or in a field."""

    scope: str
    dimension: str | None = None
    field: str | None = None


@dataclass(frozen=True)
class Group:
    """Alternatives within one dimension."""

    dimension: str
    constraints: tuple[Constraint, ...]


@dataclass(frozen=True)
class GroupPlan:
    """All of the groups, any constraint of each."""

    groups: tuple[Group, ...]
    unsatisfiable: bool = False

    def query(self) -> Query:
        """The same as a disjunction of conjunctions."""
        if self.unsatisfiable or not self.groups:
            return Query(())
        conjuncts: list[tuple[Constraint, ...]] = [()]
        for g in self.groups:
            conjuncts = [(*c, own) for c in conjuncts for own in g.constraints]
        return Query(tuple(conjuncts))


def settled_plan(plan: GroupPlan, compat: bool = False) -> Query:
    """A grouped plan without multiplying its groups out, unless one holds ONLY, which is lifted from conjuncts."""
    if plan.unsatisfiable or not all(g.constraints for g in plan.groups):
        return Query(())
    if any(c.op == "only" for g in plan.groups for c in g.constraints):
        return normalise(plan.query().conjuncts, compat)
    return Query((), (), tuple(tuple(dict.fromkeys(c.settled(compat) for c in g.constraints)) for g in plan.groups))


def normalise(conjuncts, compat: bool = False) -> Query:
    """Settle negation; lift ONLY out of its conjunct, one set for each field in order of appearance; drop repeated conjuncts."""
    only: dict[tuple[str, str], dict] = {}
    plain: dict[tuple[Constraint, ...], None] = {}
    for conjunct in conjuncts:
        own: dict[Constraint, None] = {}
        for raw in conjunct:
            c = Constraint.of(raw).settled(compat)
            if c.op == "only":
                only.setdefault((c.dimension, c.field), {})[c.kinds, c.value] = None
            else:
                own[c] = None
        if own:
            plain[tuple(own)] = None
    return Query(tuple(plain), tuple(Exclusive(d, f, tuple(value for _, value in own)) for (d, f), own in only.items()))
