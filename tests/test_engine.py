import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexafact import catalogue, compile_data, discover, execute, query
from hexafact.functions import scalars as S
from hexafact.lens import draft
from hexafact.operators.compile import FACT_SCHEMA, CompileError, NucleusError
from hexafact.operators.substrate import DiscoveryError, Substrate
from hexafact.plans.ir import FLIPPED, Constraint, normalise
from hexafact.plans.lower import ComparisonError, flags, semi_joins
from hexafact.sources.readers import load_substrate
from hexafact.sources.sinks import write

SF = "/root/testdata/sf0.001"


def number(v):
    try:
        return float(v) if "_" not in v else None
    except ValueError:
        return None


def holds(c, value):
    if c.op in ("eq", "not_eq"):
        return (value == str(c.value)) == (c.op == "eq")
    if c.op == "contains":
        return c.value in value
    if c.op == "prefix":
        return value.startswith(c.value)
    if isinstance(c.value, float):
        value, bounds = number(value), (c.value, c.value2)
        if value is None:
            return False
    else:
        bounds = (str(c.value), c.value2)
    if c.op == "between":
        return bounds[0] <= value <= bounds[1]
    return {"gt": value > bounds[0], "lt": value < bounds[0], "gte": value >= bounds[0], "lte": value <= bounds[0]}[c.op]


def naive(rows, q):
    out = set()
    for e in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == e]
        meets = lambda c: any(r[1] == c.dimension.lower() and r[2] == c.field and holds(c, r[3]) for r in own)  # noqa: B023, E731
        good = not q.conjuncts or any(all(meets(c) for c in conjunct) for conjunct in q.conjuncts)
        for o in q.only:
            values = {r[3] for r in own if r[1] == o.dimension.lower() and r[2] == o.field}
            good = good and values == {str(v) for v in o.values}
        if good and not q.empty:
            out.add(e)
    return out


def test_lowerings_agree_with_a_naive_evaluator(spark):
    rnd = random.Random(3)
    keys = [("who", "a"), ("what", "b"), ("when", "c")]
    values = ["x", "y", "xy", "10", "9", "2.5", "z%"]
    rows = [(f"e{rnd.randrange(40)}", *rnd.choice(keys), rnd.choice(values)) for _ in range(200)]
    facts = spark.createDataFrame([(e, d, k, v, f"{d.upper()}|{k}|{v}", "l") for e, d, k, v in rows], FACT_SCHEMA).persist()
    for _ in range(14):
        conjuncts = []
        for _ in range(rnd.randint(1, 3)):
            conjunct = []
            for _ in range(rnd.randint(1, 3)):
                d, k = rnd.choice(keys)
                op = rnd.choice([*FLIPPED, "contains", "prefix", "between", "only"])
                value = rnd.choice(["x", "9", "xy"]) if op in ("contains", "prefix", "only", "eq", "not_eq") or rnd.random() < 0.5 else 9.0
                conjunct.append(Constraint(d.upper(), k, op, value, (10.0 if isinstance(value, float) else "xy") if op == "between" else None, op in FLIPPED and rnd.random() < 0.3))
            conjuncts.append(conjunct)
        q = normalise(conjuncts)
        expected = naive(rows, q)
        for lower in (flags, semi_joins):
            assert {r[0] for r in lower(facts, q).collect()} == expected, (lower.__name__, q)


@pytest.fixture(scope="module")
def records(spark):
    rows = [("Ada Quill", "Tin Harbour", "1959", 7, "LP"), ("Bo Marsh", "Nine Lamps", "1964", 8, "LP"), (None, " ", "nan", 9, "LP, CD")]
    return spark.createDataFrame(rows, "Artist string, Title string, Released string, release_id long, Format string")


LENS = {
    "lens_id": "r1",
    "nucleus": {"type": "single", "field": "release_id", "prefix": "r"},
    "coordinate_map": {"Artist": {"dimension": "WHO", "semantic_key": "artist"}, "Title": {"dimension": "what", "semantic_key": "title"}, "Released": {"dimension": "when", "semantic_key": "released"}, "Format": {"dimension": "how", "semantic_key": "format"}, "Missing": {"dimension": "why", "semantic_key": "m"}},
}


def test_compile_and_query(spark, records, tmp_path):
    s = compile_data(records, LENS, spark=spark)
    assert (s.count(), s.entity_count(), s.dimensions()) == (9, 3, ["how", "what", "when", "who"])
    assert query(s, 'WHO.artist = "Ada Quill"').entity_ids == ["r:7"]
    assert query(s, "WHEN.released = 1959").count == 0
    assert query(compile_data(records, LENS, spark=spark, numeric_eq="lenient"), "WHEN.released = 1959").entity_ids == ["r:7"]
    assert query(s, "WHEN.released > 1960").entity_ids == ["r:8"]
    assert query(s, 'HOW.format CONTAINS "LP"', 2).entity_ids == ["r:7", "r:8"]
    assert len(execute([{"category": "HOW", "field": "format", "op": "eq", "value": "LP"}], s)) == 2
    assert s.query([]) == []
    wide = {r["entity_id"]: r.asDict() for r in query(s, 'HOW.format PREFIX "LP"').pivot().collect()}
    assert wide["r:9"]["artist"] == "" and wide["r:7"]["released"] == "1959"
    assert s.describe()["dimensions"] == {"how": 3, "what": 2, "when": 2, "who": 2}
    assert discover(s, "WHO|artist|*").collect() == [{"value": "Ada Quill", "entity_count": 1}, {"value": "Bo Marsh", "entity_count": 1}]
    with pytest.raises(DiscoveryError):
        query(s, "*")
    with pytest.raises(DiscoveryError):
        discover(s, 'WHO.artist = "x"')
    with pytest.raises(ValueError):
        query(s, 'HOW.format = "LP"', -1)
    with pytest.raises(ComparisonError):
        query(s, 'WHEN.released BETWEEN 1 AND "x"')
    with pytest.raises(TypeError):
        query("nothing", "*")
    for scheme in ("parquet", "csv"):
        uri = f"{scheme}://{tmp_path}/{scheme}"
        write(s.facts, LENS, uri)
        back = load_substrate(spark, uri)
        assert sorted(map(tuple, back.facts.select(*FACT_SCHEMA.names).collect())) == sorted(map(tuple, s.facts.select(*FACT_SCHEMA.names).collect()))
    write(s.facts, LENS, f"sql://{tmp_path}/sql")
    assert spark.read.text(f"{tmp_path}/sql").count() == 9


def test_nucleus_errors(spark, records):
    with pytest.raises(NucleusError):
        compile_data(records, {**LENS, "nucleus": {"type": "single", "field": "Artist"}}, spark=spark)
    with pytest.raises(CompileError):
        compile_data(records, {**LENS, "nucleus": {"type": "single", "field": "gone"}}, spark=spark)
    with pytest.raises(CompileError):
        compile_data(records, {"lens_id": "x"}, spark=spark)


def test_texts_of_values(spark):
    numbers = [0.0, -0.0, 1.0, 2024.0, 0.1 + 0.2, 1e7, 1.5e-4, 1e16, 1e-5, 1.5e300, 5e-324, float("inf"), -2.5, 123456789.125]
    df = spark.createDataFrame([(x,) for x in numbers], "x double").select(S.pystr(F.col("x"), T.DoubleType()).alias("v"))
    assert [r["v"] for r in df.collect()] == [str(x) for x in numbers]
    spaced = ["　a b ", "\tx\n", "y"]
    df = spark.createDataFrame([(x,) for x in spaced], "x string").select(S.pystrip(F.col("x")).alias("v"))
    assert [r["v"] for r in df.collect()] == [x.strip() for x in spaced]


def test_numbers_in_texts(spark):
    texts = ["1", " 2.5 ", "12d", "12f", "1_000", "1__0", "1_", "1e5", "0x10", ".5", "5.", "-3", "abc", "", "nan", "inf", "1e1_0"]
    got = [r["v"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(S.safe_double(F.col("t")).alias("v")).collect()]
    expected = [duckdb.execute("SELECT TRY_CAST(? AS DOUBLE)", [t]).fetchone()[0] for t in texts]
    assert list(map(str, got)) == list(map(str, expected))


def test_lens(spark, tmp_path, records):
    d = draft.suggest(records, spark=spark)
    assert d.get("Artist")["dimension"] == "who" and d.get("Released")["dimension"] == "when" and d.get("Format")["dimension"] == "how"
    with pytest.raises(ValueError):
        d.to_lens("x", "me")
    lens = d.nucleus("release_id", "r").map("Format", "what", "Format").to_lens("x", "me")
    assert draft.validate(lens) == {"valid": True} and lens["coordinate_map"]["Format"] == {"dimension": "what", "semantic_key": "format"}
    assert "why" not in lens["stats"]["by_dimension"]
    draft.save(lens, tmp_path / "a" / "lens.json")
    assert draft.load(tmp_path / "a" / "lens.json") == lens
    bad = draft.validate({"lens_id": 1, "coordinate_map": {"a": {"dimension": "x"}}, "nucleus": {"type": "composite", "fields": ["a"]}})
    assert len(bad["errors"]) == 3
    with pytest.raises(KeyError):
        d.nucleus("gone")


def test_plan_has_one_shuffle_and_prunes(spark, tmp_path):
    path = f"{tmp_path}/facts"
    write(catalogue.facts(spark, SF, "orders"), catalogue.ORDERS, f"parquet://{path}")
    s = Substrate(spark.read.schema(FACT_SCHEMA).parquet(path), "orders_v1")
    plan = query(s, 'WHERE.region = "ASIA" AND WHEN.year = "1995" AND WHY.priority = "5-LOW"', None)._all._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "PartitionFilters: [dimension" in plan.replace("isnotnull(dimension), ", "") or "PartitionFilters: [" in plan and "dimension" in plan.split("PartitionFilters")[1][:80]


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    rows = lambda df: sorted((tuple(r) for r in df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False)), key=str)
    got, expected = catalogue.queries()[name](spark, SF).toPandas(), con.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)
