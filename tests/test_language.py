import pytest

from hexafact.lang.lexer import QuerySyntaxError
from hexafact.lang.parser import parse, parse_to_constraints, read
from hexafact.plans.ir import Constraint, Discovery, Exclusive, Group, GroupPlan, UnknownOperator, UnsupportedNegation, normalise, settled_plan


def only(text):
    out = parse_to_constraints(text)
    assert out["success"], out
    return out["conjuncts"]


@pytest.mark.parametrize(
    ("op", "name"), [("=", "eq"), ("!=", "not_eq"), (">", "gt"), ("<", "lt"), (">=", "gte"), ("<=", "lte"), ("CONTAINS", "contains"), ("prefix", "prefix")]
)
def test_operators(op, name):
    assert only(f'who.Artist {op} "x"') == [[{"category": "WHO", "field": "artist", "op": name, "value": "x"}]]


def test_values_and_escapes():
    assert only(r'WHAT.t = "a\"b"')[0][0]["value"] == 'a"b'
    assert only("WHEN.y = 2024")[0][0]["value"] == 2024.0
    assert only("WHEN.y = -1.5")[0][0]["value"] == -1.5
    assert only("WHAT.f = TRUE")[0][0]["value"] is True


def test_truth_is_not_one():
    assert len(normalise([[{"category": "WHAT", "field": "f", "value": v}] for v in (1.0, True)]).conjuncts) == 2
    assert normalise([[{"category": "WHAT", "field": "f", "op": "only", "value": v}] for v in (1.0, True)]).only[0].values == (1.0, True)


def test_structure():
    assert len(only('A.b = "1"'.replace("A", "WHO") + ' OR WHAT.c = "2" AND WHEN.d = "3"')) == 2
    grouped = only('(WHO.a = "1" AND WHO.b = "2") OR WHO.c = "3"')
    assert [len(c) for c in grouped] == [2, 1]
    between = only('WHEN.y BETWEEN "1" AND "2" AND WHO.a = "x"')[0]
    assert between[0]["value2"] == "2" and len(between) == 2
    assert only('WHAT.c ONLY ("a", "b")')[0] == [{"category": "WHAT", "field": "c", "op": "only", "value": v} for v in "ab"]
    assert only('NOT WHO.a = "x"')[0][0]["negated"] is True
    tree = parse('NOT (WHO.a = "x" AND WHO.b = "y")')["conjuncts"][0]["constraints"][0]
    assert tree["grouped"] and tree["negated"]


def test_discovery():
    assert read("*") == Discovery("all")
    assert read("who|*") == Discovery("dimension", "WHO")
    assert parse("WHAT|Color|*") == {"success": True, "type": "discovery", "scope": "field", "dimension": "WHAT", "field": "color"}


@pytest.mark.parametrize(
    ("text", "position"),
    [("", 0), ("WHO", 3), ("WHO.", 4), ('WHO.a "x"', 6), ('WHO.a = "x', 8), ("artist = 1", 0), ('WHO.a = "x" AND', 15), ('(WHO.a = "x"', 12), ('WHO.a = "x" WHO.b = "y"', 12), ("WHO.a # 1", 6), ('WHAT.c ONLY ("a",)', 17), ("WHEN.y BETWEEN 1 2", 17)],
)
def test_errors(text, position):
    out = parse_to_constraints(text)
    assert not out["success"] and out["position"] == position, out


def test_or_in_parentheses():
    with pytest.raises(QuerySyntaxError, match="OR inside parentheses"):
        read('(WHO.a = "x" OR WHO.b = "y")')


def test_normalise():
    q = normalise([[{"category": "WHO", "field": "a", "op": "gt", "value": 1.0, "negated": True}, {"category": "WHAT", "field": "c", "op": "only", "value": "x"}], [{"category": "WHAT", "field": "c", "op": "only", "value": "y"}]])
    assert q.conjuncts == ((Constraint("WHO", "a", "lte", 1.0),),)
    assert q.only == (Exclusive("WHAT", "c", ("x", "y")),)
    with pytest.raises(UnsupportedNegation):
        normalise([[Constraint("WHO", "a", "contains", "x", negated=True)]])
    assert normalise([[Constraint("WHO", "a", "contains", "x", negated=True)]], compat=True).conjuncts[0][0].op == "contains"
    with pytest.raises(UnknownOperator):
        normalise([[Constraint("WHO", "a", "like", "x")]])


def test_group_plan():
    a, b, c = (Constraint("WHO", "k", "eq", v) for v in "abc")
    assert GroupPlan((Group("WHO", (a, b)), Group("WHAT", (c,)))).query().conjuncts == ((a, c), (b, c))
    assert GroupPlan((Group("WHO", (a,)),), unsatisfiable=True).query().empty


def test_wide_group_plan_is_not_multiplied_out():
    groups = tuple(Group("WHO", tuple(Constraint("WHO", f"k{i}", "eq", str(v)) for v in range(50))) for i in range(10))
    assert [len(c) for c in settled_plan(GroupPlan(groups)).clauses] == [50] * 10
    assert settled_plan(GroupPlan(())).empty and settled_plan(GroupPlan((Group("WHO", ()),))).empty
