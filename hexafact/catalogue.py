"""The engine's queries over the star schema, each with independent SQL over the base tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexafact.functions import scalars as S
from hexafact.lang import parser
from hexafact.operators import build, discovery, results, translators
from hexafact.operators import compile as C
from hexafact.operators.substrate import Substrate, compile_data, discover, execute, execute_plan, explain, planned, query
from hexafact.plans.ir import Constraint, Group, GroupPlan
from hexafact.records import marc, nested
from hexafact.sources import readers, sinks

Query = Callable[[SparkSession, str], DataFrame]

_DATE = "date_format({0}, 'yyyy-MM-dd')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lens(lens_id: str, nucleus: dict, **mapped: str) -> dict:
    """``column="dimension.key"`` for each mapped column."""
    return {"lens_id": lens_id, "nucleus": nucleus, "coordinate_map": {c: dict(zip(("dimension", "semantic_key"), m.split(".", 1), strict=True)) for c, m in mapped.items()}}


def _single(field: str, prefix: str) -> dict:
    return {"type": "single", "field": field, "prefix": prefix}


ORDERS = _lens("orders_v1", _single("o_orderkey", "order"), c_name="who.customer", o_orderstatus="what.status", o_totalprice="what.total", day="when.orderdate", year="when.year", n_name="where.nation", r_name="where.region", o_orderpriority="why.priority", c_mktsegment="how.segment")
LINES = _lens("order_lines_v1", _single("l_orderkey", "order"), l_returnflag="what.returnflag", l_linestatus="what.linestatus", l_quantity="how.quantity", l_suppkey="who.supplier", year="when.shipyear")
LINE = _lens("line_v1", {"type": "composite", "fields": ["l_orderkey", "l_linenumber"], "separator": "-", "prefix": "line"}, l_returnflag="what.returnflag", l_linestatus="what.linestatus", day="when.shipdate")
PARTS = _lens("part_v1", _single("p_partkey", "part"), p_name="what.name", p_brand="who.brand", p_type="why.type", p_size="how.size")
DOCS = _lens("docs_v1", _single("doc_id", "doc"), lang="what.lang", source="where.source", n_chars="how.n_chars", quality="why.quality")


def orders_frame(spark: SparkSession, d: str) -> DataFrame:
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    people = table(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = table(spark, d, "orders").join(people, F.col("o_custkey") == F.col("c_custkey"))
    return rows.withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd")).withColumn("year", F.year("o_orderdate").cast("string"))


def lines_frame(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").withColumn("day", F.date_format("l_shipdate", "yyyy-MM-dd")).withColumn("year", F.year("l_shipdate").cast("string"))


def docs_frame(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("label_doc_id"), "quality")
    docs = table(spark, d, "documents")
    return docs.join(labels, F.col("doc_id") == F.col("label_doc_id"), "left")


FRAMES = {
    "orders": (orders_frame, ORDERS),
    "lines": (lines_frame, LINES),
    "line": (lines_frame, LINE),
    "parts": (lambda s, d: table(s, d, "part"), PARTS),
    "docs": (docs_frame, DOCS),
}


def facts(spark: SparkSession, d: str, name: str, dedup: bool = False, keys: tuple[str, ...] | None = None) -> DataFrame:
    frame, lens = FRAMES[name]
    return C.compile_frame(frame(spark, d), lens, dedup, check=False, keys=keys)


def substrate(spark: SparkSession, d: str, name: str, keys: tuple[str, ...] | None = None, **options) -> Substrate:
    return Substrate(facts(spark, d, name, keys=keys), FRAMES[name][1]["lens_id"], **options)


def asked(name: str, text: str, limit: int | None = None, **options) -> Query:
    return lambda s, d: query(substrate(s, d, name, **options), text, limit).ids


_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, fn: Query, sql: str | None = None) -> None:
    _QUERIES[name] = fn
    if sql:
        _SQL[name] = sql


_ORDERS_FROM = "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_ORDER = f"SELECT 'order:' || o_orderkey AS entity_id {_ORDERS_FROM} WHERE "
_BY_ORDER = "SELECT 'order:' || l_orderkey AS entity_id FROM lineitem GROUP BY l_orderkey HAVING "
_PART = "SELECT 'part:' || p_partkey AS entity_id FROM part WHERE "


def _orders(name: str, text: str, where: str, **options) -> None:
    _add(name, asked("orders", text, **options), _ORDER + where)


def _lines(name: str, text: str, having: str, **options) -> None:
    _add(name, asked("lines", text, **options), _BY_ORDER + having)


# predicates
_orders("eq", 'WHERE.nation = "NATION_3"', "n_name = 'NATION_3'")
_lines("not_eq", 'WHAT.returnflag != "N"', "bool_or(l_returnflag <> 'N')")
_orders("gt_text", 'WHEN.orderdate > "1997-06-30"', "strftime(o_orderdate, '%Y-%m-%d') > '1997-06-30'")
_orders("lt_text", 'WHEN.orderdate < "1995-03-01"', "strftime(o_orderdate, '%Y-%m-%d') < '1995-03-01'")
_orders("gte_text", 'WHEN.year >= "1997"', "year(o_orderdate) >= 1997")
_orders("lte_text", 'WHEN.year <= "1995"', "year(o_orderdate) <= 1995")
_orders("gt_num", "WHAT.total > 300000", "o_totalprice > 300000")
_orders("lt_num", "WHAT.total < 5000", "o_totalprice < 5000")
_add("gte_num", asked("parts", "HOW.size >= 45"), _PART + "p_size >= 45")
_add("lte_num", asked("parts", "HOW.size <= 3"), _PART + "p_size <= 3")
_orders("between_text", 'WHEN.orderdate BETWEEN "1995-01-01" AND "1995-06-30"', "strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1995-01-01' AND '1995-06-30'")
_add("between_num", asked("parts", "HOW.size BETWEEN 9 AND 12"), _PART + "p_size BETWEEN 9 AND 12")
_add("contains", asked("parts", 'WHO.brand CONTAINS "#1"'), _PART + "contains(p_brand, '#1')")
_add("contains_wildcard", asked("parts", 'WHO.brand CONTAINS "_1%3"'), _PART + "p_brand LIKE '%_1%3%'")
_orders("prefix", 'WHY.priority PREFIX "1-"', "starts_with(o_orderpriority, '1-')")
_lines("not_eq_negated", 'NOT WHAT.returnflag = "N"', "bool_or(l_returnflag <> 'N')")
_add("not_gt", asked("parts", "NOT HOW.size > 5"), _PART + "p_size <= 5")
_add("eq_number_lenient", asked("orders", "WHEN.year = 1995", numeric_eq="lenient"), _ORDER + "year(o_orderdate) = 1995")
_add("eq_number_strict", asked("orders", "WHEN.year = 1995"), _ORDER + "CAST(year(o_orderdate) AS VARCHAR) = '1995.0'")

# boolean structure
_orders("and_two_dims", 'WHERE.region = "ASIA" AND HOW.segment = "BUILDING"', "r_name = 'ASIA' AND c_mktsegment = 'BUILDING'")
_orders("and_three_dims", 'WHERE.nation = "NATION_3" AND WHY.priority = "1-URGENT" AND WHEN.year = "1998"', "n_name = 'NATION_3' AND o_orderpriority = '1-URGENT' AND year(o_orderdate) = 1998")
_orders("and_five_dims", 'WHO.customer PREFIX "Customer" AND WHAT.status = "F" AND WHERE.region = "ASIA" AND WHY.priority = "2-HIGH" AND WHEN.year <= "1995"', "starts_with(c_name, 'Customer') AND o_orderstatus = 'F' AND r_name = 'ASIA' AND o_orderpriority = '2-HIGH' AND year(o_orderdate) <= 1995")
_lines("and_same_field", 'WHAT.returnflag = "R" AND WHAT.returnflag = "A"', "bool_or(l_returnflag = 'R') AND bool_or(l_returnflag = 'A')")
_orders("or_dnf", 'WHERE.nation = "NATION_1" AND WHEN.year = "1996" OR WHERE.nation = "NATION_2" AND WHEN.year = "1997" OR WHY.priority = "5-LOW" AND WHAT.status = "P"', "(n_name = 'NATION_1' AND year(o_orderdate) = 1996) OR (n_name = 'NATION_2' AND year(o_orderdate) = 1997) OR (o_orderpriority = '5-LOW' AND o_orderstatus = 'P')")
_orders("dnf_grouped", '(WHERE.region = "EUROPE" AND WHY.priority = "3-MEDIUM") OR (WHERE.region = "AFRICA" AND (WHY.priority = "1-URGENT"))', "(r_name = 'EUROPE' AND o_orderpriority = '3-MEDIUM') OR (r_name = 'AFRICA' AND o_orderpriority = '1-URGENT')")
_lines("and_semi_joins", 'WHAT.returnflag = "R" AND HOW.quantity > 45 OR WHAT.linestatus ONLY "O"', "(bool_or(l_returnflag = 'R') AND bool_or(l_quantity > 45)) AND bool_and(l_linestatus = 'O')", strategy="semi_joins")


def _group_plan(s: SparkSession, d: str) -> DataFrame:
    plan = GroupPlan((
        Group("WHERE", (Constraint("WHERE", "nation", "eq", "NATION_1"), Constraint("WHERE", "nation", "eq", "NATION_5"))),
        Group("WHEN", (Constraint("WHEN", "year", "eq", "1996"),)),
    ))
    return execute_plan(plan, substrate(s, d, "orders")).ids


_add("or_within_group_plan", _group_plan, _ORDER + "n_name IN ('NATION_1', 'NATION_5') AND year(o_orderdate) = 1996")

# exclusivity
_lines("only_scalar", 'WHAT.returnflag ONLY "R"', "bool_and(l_returnflag = 'R')")
_lines("only_set", 'WHAT.returnflag ONLY ("R", "A")', "bool_or(l_returnflag = 'R') AND bool_or(l_returnflag = 'A') AND bool_and(l_returnflag IN ('R', 'A'))")
_lines("only_with_plain", 'WHAT.returnflag ONLY "N" AND HOW.quantity >= 49', "bool_and(l_returnflag = 'N') AND bool_or(l_quantity >= 49)")
_lines("only_hoisted_over_or", '(HOW.quantity > 48 AND WHAT.linestatus ONLY "F") OR HOW.quantity < 2', "(bool_or(l_quantity > 48) OR bool_or(l_quantity < 2)) AND bool_and(l_linestatus = 'F')")

# order and limit
_add("limit_topk", asked("orders", 'WHERE.region = "ASIA"', 25), f"SELECT * FROM ({_ORDER} r_name = 'ASIA') ORDER BY entity_id LIMIT 25")
_add("limit_none", asked("orders", 'WHERE.region = "ASIA"', 0), _ORDER + "r_name = 'ASIA'")

# results
_PART_VALUES = " UNION ALL ".join(
    f"SELECT 'part:' || p_partkey AS entity_id, '{d}' AS dimension, '{k}' AS semantic_key, CAST({c} AS VARCHAR) AS value, '{d.upper()}|{k}|' || {c} AS coordinate, 'part_v1' AS lens_id FROM part"
    for d, k, c in (("what", "name", "p_name"), ("who", "brand", "p_brand"), ("why", "type", "p_type"), ("how", "size", "p_size"))
)
_add("hydrate", lambda s, d: query(substrate(s, d, "parts"), "HOW.size >= 48", None).to_dataframe(), f"WITH f AS ({_PART_VALUES}) SELECT * FROM f WHERE entity_id IN (SELECT 'part:' || p_partkey FROM part WHERE p_size >= 48)")
_bar = lambda c: f"string_agg(DISTINCT {c}, ' | ' ORDER BY {c})"
_WIDE = ("returnflag", "linestatus", "shipyear")
_add(
    "pivot_wide",
    lambda s, d: results.pivot(facts(s, d, "lines", keys=_WIDE), query(substrate(s, d, "lines", keys=("quantity",)), "HOW.quantity > 47", None).ids, list(_WIDE)),
    f"SELECT 'order:' || l_orderkey AS entity_id, {_bar('l_returnflag')} AS returnflag, {_bar('l_linestatus')} AS linestatus, {_bar('CAST(year(l_shipdate) AS VARCHAR)')} AS shipyear FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_quantity > 47)",
)

# discovery
_LINE_VALUES = " UNION ALL ".join(
    f"SELECT 'order:' || l_orderkey AS entity_id, '{d}' AS dimension, '{k}' AS semantic_key, CAST({c} AS VARCHAR) AS value FROM lineitem"
    for d, k, c in (("what", "returnflag", "l_returnflag"), ("what", "linestatus", "l_linestatus"), ("how", "quantity", "l_quantity"), ("who", "supplier", "l_suppkey"), ("when", "shipyear", "year(l_shipdate)"))
)
_COUNTS = "count(DISTINCT entity_id) AS entity_count, count(*) AS fact_count"
_add("discover_all", lambda s, d: discover(substrate(s, d, "lines"), "*").rows, f"SELECT dimension, {_COUNTS} FROM ({_LINE_VALUES}) GROUP BY 1")
_add("discover_dimension", lambda s, d: discover(substrate(s, d, "lines"), "WHAT|*").rows, f"SELECT semantic_key, {_COUNTS} FROM ({_LINE_VALUES}) WHERE dimension = 'what' GROUP BY 1")
_add("discover_field", lambda s, d: discover(substrate(s, d, "lines"), "WHO|supplier|*").rows, "SELECT CAST(l_suppkey AS VARCHAR) AS value, count(DISTINCT l_orderkey) AS entity_count FROM lineitem GROUP BY 1")
_add("schema_distinct_values", lambda s, d: discovery.schema(facts(s, d, "lines")), f"SELECT dimension, semantic_key, count(DISTINCT entity_id) AS entity_count, count(DISTINCT value) AS value_count FROM ({_LINE_VALUES}) GROUP BY 1, 2")
_add("affordances", lambda s, d: discovery.affordances(facts(s, d, "line").where("semantic_key <> 'quantity'")), "SELECT dimension, semantic_key, value, upper(dimension) || '|' || semantic_key || '|' || value AS coordinate, count(DISTINCT e) AS entity_count, count(*) AS fact_count FROM (SELECT l_orderkey || '-' || l_linenumber AS e, 'what' AS dimension, 'returnflag' AS semantic_key, l_returnflag AS value FROM lineitem UNION ALL SELECT l_orderkey || '-' || l_linenumber, 'what', 'linestatus', l_linestatus FROM lineitem UNION ALL SELECT l_orderkey || '-' || l_linenumber, 'when', 'shipdate', strftime(l_shipdate, '%Y-%m-%d') FROM lineitem) GROUP BY 1, 2, 3, 4")
_add("describe_counts", lambda s, d: discovery.describe(facts(s, d, "lines")), f"SELECT dimension, count(*) AS fact_count, count(DISTINCT entity_id) AS entity_count FROM ({_LINE_VALUES}) GROUP BY ROLLUP (dimension)")
_add(
    "explain_cardinality",
    lambda s, d: explain(substrate(s, d, "lines"), 'WHAT.returnflag = "R" AND HOW.quantity > 45').select("constraint", "entity_count"),
    "SELECT 'WHAT.returnflag eq R' AS \"constraint\", count(DISTINCT l_orderkey) AS entity_count FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'HOW.quantity gt 45.0', count(DISTINCT l_orderkey) FROM lineitem WHERE l_quantity > 45",
)
_add(
    "column_uniqueness",
    lambda s, d: discovery.column_uniqueness(table(s, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")),
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n_values, count(DISTINCT {c}) AS n_distinct, count({c}) * 0.95 < count(DISTINCT {c}) AS \"unique\" FROM part" for c in ("p_partkey", "p_brand", "p_type", "p_size")),
)

# compilation
_add("compile_single", lambda s, d: facts(s, d, "parts"), _PART_VALUES)
_add("compile_composite", lambda s, d: facts(s, d, "line").groupBy("entity_id", "coordinate").agg(F.count("*").alias("n")), " UNION ALL ".join(f"SELECT 'line:' || l_orderkey || '-' || l_linenumber AS entity_id, '{k}' || {c} AS coordinate, count(*) AS n FROM lineitem GROUP BY 1, 2" for k, c in (("WHAT|returnflag|", "l_returnflag"), ("WHAT|linestatus|", "l_linestatus"), ("WHEN|shipdate|", "strftime(l_shipdate, '%Y-%m-%d')"))))
_add("compile_nulls_dropped", lambda s, d: facts(s, d, "docs").where("semantic_key = 'quality'").select("entity_id", "value", "coordinate"), "SELECT 'doc:' || doc_id AS entity_id, CAST(quality AS VARCHAR) AS value, 'WHY|quality|' || quality AS coordinate FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
_add(
    "compile_multivalue_array",
    lambda s, d: C.spoke(table(s, d, "part"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")), "words_v1", [C.facts_from_array("what", "word", F.split("p_name", " "))], dedup=False).select("entity_id", "semantic_key", "value"),
    "SELECT 'part:' || p_partkey AS entity_id, 'word' AS semantic_key, w AS value FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w NOT IN ('', 'nan', 'undefined', 'null', 'None')",
)
_add(
    "compile_json_map",
    lambda s, d: C.spoke(table(s, d, "events"), F.concat(F.lit("event:"), F.col("event_id").cast("string")), "events_v1", [C.facts_from_map("why", "prop", F.from_json("props", "map<string,string>"))]).select("entity_id", "semantic_key", "value"),
    "SELECT 'event:' || event_id AS entity_id, 'prop_k' AS semantic_key, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL",
)
_add("dedup_coordinates", lambda s, d: facts(s, d, "lines", dedup=True).where("dimension = 'what'").select("entity_id", "coordinate"), "SELECT DISTINCT 'order:' || l_orderkey AS entity_id, 'WHAT|returnflag|' || l_returnflag AS coordinate FROM lineitem UNION SELECT DISTINCT 'order:' || l_orderkey, 'WHAT|linestatus|' || l_linestatus FROM lineitem")
_add(
    "multi_table_merge",
    lambda s, d: build.merge_facts([facts(s, d, "orders", keys=("priority",)), facts(s, d, "lines", keys=("returnflag",))]).select("entity_id", "coordinate"),
    f"SELECT 'order:' || o_orderkey AS entity_id, 'WHY|priority|' || o_orderpriority AS coordinate {_ORDERS_FROM} UNION SELECT 'order:' || l_orderkey, 'WHAT|returnflag|' || l_returnflag FROM lineitem",
)
_add("hub_labels", lambda s, d: build.hub_rows(facts(s, d, "parts").withColumn("semantic_key", F.when(F.col("semantic_key") == "name", "title").otherwise(F.col("semantic_key")))), "SELECT 'part:' || p_partkey AS entity_id, 'part:' || p_partkey AS nucleus, p_name AS label, p_brand AS sublabel FROM part")
_add(
    "hub_last_wins",
    lambda s, d: build.merge_hub([table(s, d, "customer").select(F.col("c_name").alias("entity_id"), F.col("c_name").alias("nucleus"), F.lit("first").alias("label"), F.lit("").alias("sublabel")), table(s, d, "customer").where("c_acctbal > 0").select(F.col("c_name").alias("entity_id"), F.col("c_name").alias("nucleus"), F.lit("second").alias("label"), F.col("c_mktsegment").alias("sublabel"))]),
    "SELECT c_name AS entity_id, c_name AS nucleus, CASE WHEN c_acctbal > 0 THEN 'second' ELSE 'first' END AS label, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE '' END AS sublabel FROM customer",
)
_add("row_identity", lambda s, d: C.row_id(table(s, d, "nation").select("n_name", "n_regionkey")).select("n_name", "_row_id"), "SELECT n_name, sha256(n_name || chr(1) || n_regionkey) AS _row_id FROM nation")


def _records_frame(s: SparkSession, d: str) -> DataFrame:
    """Suppliers and parts in the columns of a record collection."""
    return table(s, d, "part").select(
        F.col("p_partkey").alias("release_id"), F.concat("p_brand", F.lit(" (4)")).alias("Artist"), F.col("p_name").alias("Title"),
        F.concat_ws(", ", "p_brand", "p_type", "p_brand").alias("Label"), F.concat_ws(", ", "p_type", "p_brand").alias("Catalog#"),
        F.when(F.col("p_size") > 25, "LP, Album, Blu, 180").otherwise("CD, San, Mono").alias("Format"), F.concat(F.lit("03 "), 1950 + F.col("p_size")).alias("Released"),
    )


_add(
    "translate_records",
    lambda s, d: translators.records(_records_frame(s, d), "records_v1")[1].select("entity_id", "coordinate"),
    "WITH p AS (SELECT 'discogs:' || p_partkey AS entity_id, * FROM part) "
    + " UNION ALL ".join(
        f"SELECT DISTINCT entity_id, {c} AS coordinate FROM p {w}"
        for c, w in (
            ("'WHO|artist|' || p_brand", ""), ("'WHO|label|' || p_brand", ""), ("'WHO|label|' || trim(unnest(string_split(p_type, ',')))", ""), ("'WHAT|title|' || p_name", ""), ("'WHAT|catalog_no|' || trim(string_split(p_type, ',')[1])", ""),
            ("'WHAT|format|' || CASE WHEN p_size > 25 THEN 'LP' ELSE 'CD' END", ""), ("'WHAT|pressing_type|Album'", "WHERE p_size > 25"), ("'WHAT|color|Blue Vinyl'", "WHERE p_size > 25"), ("'WHAT|weight|180g'", "WHERE p_size > 25"), ("'WHAT|mix|Mono'", "WHERE p_size <= 25"), ("'WHEN|released|' || (1950 + p_size)", ""),
        )
    ),
)

# scalars
_add("slug_ids", lambda s, d: table(s, d, "part").select("p_partkey", S.slug(F.concat(F.lit(" "), "p_type", F.lit(" ")), translators.TITLE_ALIASES).alias("slug")), "SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part")
_add("year_extract", lambda s, d: table(s, d, "orders").select("o_orderkey", S.year(F.date_format("o_orderdate", "MMMM d, yyyy")).alias("y")), "SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders")
_add("split_distinct", lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(S.items(F.concat_ws(", ", "p_brand", "p_type", "p_brand", F.lit(" "))), "/").alias("parts")), "SELECT p_partkey, CASE WHEN p_brand = p_type THEN p_brand ELSE p_brand || '/' || p_type END AS parts FROM part")
_add("money_strip", lambda s, d: table(s, d, "supplier").select("s_suppkey", S.money(F.concat(F.lit("$"), F.format_number(F.abs("s_acctbal").cast("decimal(18,2)"), 2))).alias("v")), "SELECT s_suppkey, CAST(CAST(abs(s_acctbal) AS DECIMAL(18,2)) AS VARCHAR) AS v FROM supplier")
_add("strip_suffix", lambda s, d: table(s, d, "supplier").select("s_suppkey", S.without_number_suffix(F.concat("s_name", F.lit(" ("), F.col("s_nationkey").cast("string"), F.lit(")"))).alias("v")), "SELECT s_suppkey, s_name AS v FROM supplier")
_add("sublabel_join", lambda s, d: table(s, d, "customer").select("c_custkey", S.sublabel(F.col("c_mktsegment"), F.when(F.col("c_acctbal") > 0, F.col("c_name"))).alias("v")), "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_mktsegment || ' · ' || c_name ELSE c_mktsegment END AS v FROM customer")
_add("number_texts", lambda s, d: table(s, d, "lineitem").select(S.fact_value(F.col("l_quantity"), table(s, d, "lineitem").schema["l_quantity"].dataType).alias("v")).groupBy("v").agg(F.count("*").alias("n")), "SELECT CAST(l_quantity AS VARCHAR) AS v, count(*) AS n FROM lineitem GROUP BY 1")
_add("safe_numbers", lambda s, d: table(s, d, "part").select("p_partkey", S.safe_double(F.concat(F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, "d").otherwise("e1"))).alias("v")), "SELECT p_partkey, TRY_CAST(p_size || CASE WHEN p_size % 2 = 0 THEN 'd' ELSE 'e1' END AS DOUBLE) AS v FROM part")


# nested records, made of the tables' rows
def _record_rows(s: SparkSession, d: str) -> DataFrame:
    fact = lambda dim, key, v: F.struct(F.lit(dim).alias("dimension"), F.lit(key).alias("semantic_key"), v.alias("value"))
    rows = table(s, d, "part").select(
        F.to_json(F.struct(
            F.lit("1.0").alias("srf_version"), F.concat(F.lit("srf:part/"), "p_partkey").alias("srf_uri"), F.concat(F.lit("part:"), "p_partkey").alias("entity_id"),
            F.struct(F.lit("part").alias("type"), F.col("p_name").alias("value")).alias("nucleus"),
            F.array(fact("What", "Title", F.col("p_name")), fact("WHO", "brand", F.col("p_brand")), fact("UNKNOWN", "x", F.col("p_type"))).alias("facts"),
            F.struct(F.lit("tpc").alias("source"), F.lit("t").alias("translated_by"), F.lit("1").alias("translator_version"), F.lit("part_v1").alias("lens"), F.when(F.col("p_size") > 5, "2026-05-03T00:00:00Z").otherwise("yesterday").alias("translated_at")).alias("provenance"),
        )).alias("value")
    )
    return rows.select(F.from_json("value", nested.RECORD_SCHEMA).alias("r")).select("r.*")


_add("record_explode", lambda s, d: nested.record_facts(_record_rows(s, d)).select("entity_id", "coordinate"), "SELECT 'part:' || p_partkey AS entity_id, 'WHAT|title|' || p_name AS coordinate FROM part UNION ALL SELECT 'part:' || p_partkey, 'WHO|brand|' || p_brand FROM part")
_add("record_labels", lambda s, d: nested.record_hub(_record_rows(s, d)), "SELECT 'part:' || p_partkey AS entity_id, p_name AS nucleus, p_name AS label, p_brand AS sublabel FROM part")
_add("record_counters", lambda s, d: nested.record_counts(_record_rows(s, d)), "SELECT 'part:' || p_partkey AS entity_id, 3 AS fact_count, 2 AS routable_fact_count FROM part".replace("3 AS", "CAST(3 AS BIGINT) AS").replace("2 AS r", "CAST(2 AS BIGINT) AS r"))
_add("record_errors", lambda s, d: nested.validated(_record_rows(s, d), nested.record_failure()).where("error_field is not null").select("entity_id", "error_field"), "SELECT 'part:' || p_partkey AS entity_id, 'provenance.translated_at' AS error_field FROM part WHERE p_size <= 5")


def _bundle_rows(s: SparkSession, d: str) -> DataFrame:
    entry = F.struct(F.concat(F.lit("srf:"), "n_name").alias("srf_uri"), F.struct(F.when(F.col("n_nationkey") % 2 == 0, "place").otherwise("thing").alias("type"), F.col("n_name").alias("value"), F.lit(None).cast("string").alias("authority")).alias("nucleus"), F.array(F.lit("a"), F.concat(F.lit("k"), F.col("n_nationkey") % 3)).alias("entry_tags"), F.when(F.col("n_nationkey") % 5 == 0, "own_v1").alias("lens_id"))
    rows = table(s, d, "nation").groupBy("n_regionkey").agg(F.collect_list(entry).alias("entries"))
    return rows.select(F.lit("1.0").alias("fg_version"), F.concat(F.lit("exp:"), "n_regionkey").alias("expedition_id"), F.lit("c").alias("curator_id"), F.lit("t").alias("title"), F.array(F.lit("x")).alias("tags"), "entries", F.lit("2026-05-03T00:00:00Z").alias("published_at"), F.lit(None).cast("string").alias("abstract"), F.lit("bundle_v1").alias("lens_id"), F.lit(None).cast("string").alias("fork_of"), F.lit(None).cast("string").alias("feed_url"))


_add("bundle_tags", lambda s, d: nested.bundle_tags(_bundle_rows(s, d)), "SELECT 'exp:' || n_regionkey AS expedition_id, t AS tag, 'srf:' || n_name AS srf_uri, n_name AS nucleus, CASE WHEN n_nationkey % 5 = 0 THEN 'own_v1' ELSE 'bundle_v1' END AS lens_id FROM (SELECT *, unnest(['a', 'k' || (n_nationkey % 3)]) AS t FROM nation)")
_add("bundle_groups", lambda s, d: nested.bundle_groups(_bundle_rows(s, d), {"place": "Places"}).select("expedition_id", "group_label", "entry_count"), "SELECT 'exp:' || n_regionkey AS expedition_id, CASE WHEN n_nationkey % 2 = 0 THEN 'Places' ELSE 'Other' END AS group_label, count(*) AS entry_count FROM nation GROUP BY 1, 2")


def _marc_rows(s: SparkSession, d: str) -> DataFrame:
    sub = lambda code, v: F.struct(F.lit(code).alias("code"), v.alias("data"))
    field = lambda tag, *subs: F.struct(F.lit(tag).alias("tag"), F.lit(" ").alias("indicator1"), F.lit(" ").alias("indicator2"), F.array(*subs).alias("subfields"))
    control = F.array(F.struct(F.lit("001").alias("tag"), F.col("p_partkey").cast("string").alias("data")), F.struct(F.lit("003").alias("tag"), F.lit("DLC").alias("data")))
    data = F.array(field("245", sub("a", F.concat("p_name", F.lit(" /"))), sub("b", F.concat("p_brand", F.lit("."))), sub("n", F.lit("1"))), field("260", sub("b", F.concat("p_brand", F.lit(","))), sub("c", F.concat(F.lit("c"), 1950 + F.col("p_size"), F.lit(".")))), field("999", sub("a", F.lit("?"))))
    return table(s, d, "part").select(F.lit("").alias("leader"), control.alias("controlFields"), data.alias("dataFields"))


_add(
    "marc_facts",
    lambda s, d: marc.translate(_marc_rows(s, d), "loc", "marc_v1").select("entity_id", "coordinate"),
    "WITH p AS (SELECT 'marc:loc:' || p_partkey AS entity_id, * FROM part) " + " UNION ALL ".join(f"SELECT entity_id, {c} AS coordinate FROM p" for c in ("'WHAT|control_source|DLC'", "'WHAT|title|' || p_name || ' ' || p_brand", "'WHAT|part_number|1'", "'WHO|publisher|' || p_brand", "'WHEN|publication_date|' || (1950 + p_size)")),
)


# stored facts: written, read again, and asked
def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see: in the shared folder, or on this machine if all of Spark runs here."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        shared = tempfile.mkdtemp(prefix="stores-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _stored(s: SparkSession, d: str, name: str, scheme: str, **options) -> Substrate:
    uri = f"{scheme}://{_folder(s, name)}"
    sinks.write(facts(s, d, name), FRAMES[name][1], uri)
    return readers.load_substrate(s, uri, **options)


_add("store_parquet", lambda s, d: query(_stored(s, d, "orders", "parquet"), 'WHERE.region = "ASIA" AND WHEN.year = "1996"', None).ids, _ORDER + "r_name = 'ASIA' AND year(o_orderdate) = 1996")
_add("store_parquet_facts", lambda s, d: _stored(s, d, "parts", "parquet").facts.select(*C.FACT_COLUMNS), _PART_VALUES)
_add("store_csv_facts", lambda s, d: _stored(s, d, "parts", "csv").facts.select(*C.FACT_COLUMNS), _PART_VALUES)
_add("store_csv_query", lambda s, d: query(_stored(s, d, "parts", "csv"), 'HOW.size BETWEEN 9 AND 12 AND WHO.brand CONTAINS "#1"', None).ids, _PART + "p_size BETWEEN 9 AND 12 AND contains(p_brand, '#1')")


def _sql_lines(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "sql")
    sinks.write(facts(s, d, "parts"), PARTS, f"sql://{path}")
    return s.read.text(path).select(F.col("value").alias("statement"))


def _json_lines(s: SparkSession, d: str) -> DataFrame:
    path = sinks.to_jsonl(facts(s, d, "parts"), _folder(s, "jsonl"))
    return s.read.json(path).select("entity_id", "dimension", "semantic_key", "coordinate", "lens_id")


_QUOTED = "replace({0}, '''', '''''')"
_add("sink_sql", _sql_lines, f"SELECT 'INSERT INTO spoke (' || 'entity_id, dimension, semantic_key, value, coordinate, lens_id' || ') VALUES (''' || entity_id || ''', ''' || dimension || ''', ''' || semantic_key || ''', ''' || {_QUOTED.format('value')} || ''', ''' || {_QUOTED.format('coordinate')} || ''', ''' || lens_id || ''');' AS statement FROM ({_PART_VALUES})")
_add("sink_jsonl", _json_lines, f"SELECT entity_id, dimension, semantic_key, upper(dimension) || '.' || semantic_key || '=' || value AS coordinate, lens_id FROM ({_PART_VALUES})")


def _source_csv(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "source")
    table(s, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size").write.csv(path, header=True, escape='"')
    return compile_data(path, PARTS, spark=s).facts.select(*C.FACT_COLUMNS)


_add("compile_csv_source", _source_csv, _PART_VALUES)


def _gross_frame(s: SparkSession, d: str) -> DataFrame:
    """Parts in the columns of a table of films."""
    return table(s, d, "part").select(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("movie_title"), F.concat(F.lit("May 3, "), 1950 + F.col("p_size")).alias("release_date"), F.col("p_type").alias("genre"), F.when(F.col("p_size") > 25, "PG").alias("MPAA_rating"), F.concat(F.lit("$1,"), 100 + F.col("p_size")).alias("total_gross"), F.lit("nan").alias("inflation_adjusted_gross"))


def _voices_frame(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.col("p_brand").alias("character"), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(" ").alias("voice-actor"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("movie"))


def _appended(s: SparkSession, d: str) -> DataFrame:
    """Two builds into one store: the second adds to the first, and facts of both appear once."""
    path = _folder(s, "build")
    for sources in ([("disney_total_gross", _gross_frame(s, d).where("MPAA_rating is null"))], [("disney_total_gross", _gross_frame(s, d)), ("disney_voice_actors", _voices_frame(s, d))]):
        done = build.compile_job(build.BuildSpec(sources, f"parquet://{path}", "films_v1"), s)
        if not done.success:
            raise C.CompileError(done.error)
    return s.read.schema(C.FACT_SCHEMA).parquet(f"{path}/facts").select("entity_id", "coordinate")


_FILM = "'disney:' || trim(regexp_replace(lower(p_name || ' ' || p_partkey), '[^a-z0-9]+', '_', 'g'), '_')"
_TITLE = "'WHAT|title|' || p_name || ' ' || p_partkey"


def _union(entity: str, *parts: tuple[str, str], source: str = "part") -> str:
    return " UNION ".join(f"SELECT {entity} AS entity_id, {c} AS coordinate FROM {source} {w}" for c, w in parts)


_GROSS = ((_TITLE, ""), ("'WHAT|genre|' || p_type", ""), ("'WHAT|mpaa_rating|PG'", "WHERE p_size > 25"), ("'WHAT|total_gross|1' || (100 + p_size)", ""), ("'WHEN|released|' || (1950 + p_size)", ""))
_VOICES = (("'WHO|voice_actor|' || p_type", "WHERE p_size > 25"), ("'WHO|character|' || p_brand", ""), (_TITLE, ""))
_add("translate_gross", lambda s, d: translators.film_gross(_gross_frame(s, d), "films_v1")[1].select("entity_id", "coordinate"), _union(_FILM, *_GROSS))
_add("translate_voices", lambda s, d: translators.film_voices(_voices_frame(s, d), "films_v1")[1].select("entity_id", "coordinate"), _union(_FILM, *_VOICES))
_add("build_appended", _appended, _union(_FILM, *_GROSS, *_VOICES))
_add(
    "translate_characters",
    lambda s, d: translators.film_characters(_gross_frame(s, d).select("movie_title", "release_date", F.col("genre").alias("hero"), F.col("MPAA_rating").alias("villian"), F.lit(" ").alias("song")), "films_v1")[1].select("entity_id", "coordinate"),
    _union(_FILM, ("'WHO|hero|' || p_type", ""), ("'WHO|villain|PG'", "WHERE p_size > 25"), (_TITLE, ""), ("'WHEN|released|' || (1950 + p_size)", "")),
)
_add(
    "translate_directors",
    lambda s, d: translators.film_directors(_gross_frame(s, d).select(F.col("movie_title").alias("name"), F.coalesce("MPAA_rating", F.lit("")).alias("director")), "films_v1")[1].select("entity_id", "coordinate"),
    _union(_FILM, ("'WHO|director|PG'", "WHERE p_size > 25"), (_TITLE, "")),
)
_add(
    "translate_sessions",
    lambda s, d: translators.sessions(table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("eventid"), F.col("o_orderstatus").alias("artist"), F.lit(" t ").alias("title"), F.lit(None).cast("string").alias("host"), F.lit("1999").alias("release_year"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("date"), F.col("o_orderpriority").alias("day_of_week"), (F.col("o_orderkey") % 2).cast("string").alias("self-titled")), "sessions_v1")[1].select("entity_id", "coordinate"),
    _union("'shibuya:' || o_orderkey", ("'WHO|artist|' || o_orderstatus", ""), ("'WHAT|title|t'", ""), ("'WHAT|self_titled|true'", "WHERE o_orderkey % 2 = 1"), ("'WHEN|release_year|1999'", ""), ("'WHEN|session_year|' || year(o_orderdate)", ""), ("'WHEN|day_of_week|' || o_orderpriority", ""), source="orders"),
)
_CARD = {"id": "cast(p_partkey as string)", "name": "p_name", "type_line": "'Legendary Creature \u2014 Elf Druid'", "colors": "array('W', 'U')", "color_identity": "array('U')", "artist": "p_brand", "released_at": "concat(1990 + p_size, '-01-02')", "cmc": "cast(p_size as double)", "`set`": "'abc'", "legalities": "map('modern', 'legal', 'vintage', 'not_legal')"}
_add(
    "translate_cards",
    lambda s, d: translators.cards(s.createDataFrame([], translators.CARD_SCHEMA).unionByName(table(s, d, "part").selectExpr(*[f"{v} as {k}" for k, v in _CARD.items()]), allowMissingColumns=True), "cards_v1", "Abc").where("semantic_key <> 'guild'").select("entity_id", "coordinate"),
    _union("'scryfall:' || p_partkey", ("'WHAT|name|' || p_name", ""), ("'WHAT|title|' || p_name", ""), ("'WHO|artist|' || p_brand", ""), ("'WHAT|set|Abc'", ""), ("'WHEN|released_at|' || (1990 + p_size)", ""), ("'HOW|cmc|' || p_size", ""), ("'WHERE|set_code|ABC'", ""), *((f"'WHAT|card_type|{t}'", "") for t in ("Legendary", "Creature")), *((f"'WHAT|subtype|{t}'", "") for t in ("Elf", "Druid")), *((f"'WHAT|color|{t}'", "") for t in ("White", "Blue")), *((f"'WHAT|color_code|{t}'", "") for t in ("W", "U")), ("'WHY|format_legal|modern'", "")),
)

# the rest of the interface
_add("execute_constraints", lambda s, d: execute([{"category": "WHERE", "field": "nation", "op": "eq", "value": "NATION_3"}, {"category": "WHAT", "field": "total", "op": "gt", "value": 100000.0}], substrate(s, d, "orders")).ids, _ORDER + "n_name = 'NATION_3' AND o_totalprice > 100000")
_add("execute_parsed", lambda s, d: execute(parser.parse_to_constraints('WHERE.region = "ASIA" OR WHEN.year = "1997"'), substrate(s, d, "orders")).ids, _ORDER + "r_name = 'ASIA' OR year(o_orderdate) = 1997")
_add("two_lenses", lambda s, d: query(Substrate(facts(s, d, "orders").unionByName(facts(s, d, "lines")), "order_lines_v1"), 'WHEN.shipyear = "1997"', None).ids, _BY_ORDER + "bool_or(year(l_shipdate) = 1997)")
_lines("only_merged", 'WHAT.returnflag ONLY "R" AND WHAT.returnflag ONLY "A"', "bool_or(l_returnflag = 'R') AND bool_or(l_returnflag = 'A') AND bool_and(l_returnflag IN ('R', 'A'))")
_add(
    "wide_group_plan",
    lambda s, d: execute_plan(GroupPlan((Group("HOW", tuple(Constraint("HOW", "quantity", "eq", f"{n}.0") for n in range(1, 31))), Group("WHO", tuple(Constraint("WHO", "supplier", "eq", str(n)) for n in range(1, 41))), Group("WHAT", (Constraint("WHAT", "returnflag", "eq", "R"), Constraint("WHAT", "returnflag", "eq", "A"))))), substrate(s, d, "lines")).ids,
    _BY_ORDER + "bool_or(l_quantity BETWEEN 1 AND 30 AND l_quantity = floor(l_quantity)) AND bool_or(l_suppkey BETWEEN 1 AND 40) AND bool_or(l_returnflag IN ('R', 'A'))",
)
_add("dimensions", lambda s, d: substrate(s, d, "parts").facts.select("dimension").distinct(), "SELECT unnest(['what', 'who', 'why', 'how']) AS dimension")
_add("all_facts", lambda s, d: substrate(s, d, "parts").to_dataframe(), _PART_VALUES)
_add("facts_of_one", lambda s, d: substrate(s, d, "parts").get_facts("part:7"), f"SELECT * FROM ({_PART_VALUES}) WHERE entity_id = 'part:7'")
_add("coordinates", lambda s, d: substrate(s, d, "parts").coordinates(), f"SELECT DISTINCT coordinate FROM ({_PART_VALUES})")
_add("values_for", lambda s, d: substrate(s, d, "parts").values_for("WHY", "type"), "SELECT p_type AS value, count(*) AS entity_count FROM part GROUP BY 1")
_add("schema_of_dimension", lambda s, d: discovery.by_key(facts(s, d, "lines"), "WHAT", 500, values=True), f"SELECT semantic_key, {_COUNTS}, count(DISTINCT value) AS value_count FROM ({_LINE_VALUES}) WHERE dimension = 'what' GROUP BY 1")
_add("wide_view", lambda s, d: results.pivot_first(facts(s, d, "parts"), query(substrate(s, d, "parts"), "HOW.size >= 20", None).ids), "SELECT 'part:' || p_partkey AS entity_id, p_brand AS brand, p_name AS name, CAST(p_size AS VARCHAR) AS size, p_type AS type FROM part WHERE p_size >= 20 ORDER BY entity_id LIMIT 20")
_add("third_part", lambda s, d: table(s, d, "orders").select("o_orderkey", S.third_part(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("y")), "SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders")
_add("isbn", lambda s, d: table(s, d, "part").select("p_partkey", S.isbn(F.concat(F.lit("978-0-"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.lit("-X (pbk.)"))).alias("v")), "SELECT p_partkey, '9780' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || 'X' AS v FROM part")
_add("sql_quotes", lambda s, d: table(s, d, "part").select("p_partkey", S.sql_quoted(F.concat("p_name", F.lit("'s"))).alias("v")), "SELECT p_partkey, '''' || p_name || '''''s''' AS v FROM part")
_add("bundle_index", lambda s, d: nested.bundle_index(_bundle_rows(s, d)).select("expedition_id", "curator_id", "title", "entry_count", "lens_id"), "SELECT 'exp:' || n_regionkey AS expedition_id, 'c' AS curator_id, 't' AS title, count(*) AS entry_count, 'bundle_v1' AS lens_id FROM nation GROUP BY n_regionkey")
_add("bundle_errors", lambda s, d: nested.validated(_bundle_rows(s, d).withColumn("published_at", F.when(F.col("expedition_id") == "exp:1", "soon").otherwise(F.col("published_at"))).withColumn("title", F.when(F.col("expedition_id") == "exp:2", "").otherwise(F.col("title"))), nested.bundle_failure()).where("error_field is not null").select("expedition_id", "error_field"), "SELECT * FROM (VALUES ('exp:1', 'published_at'), ('exp:2', 'title')) AS t (expedition_id, error_field)")


def _marc_more(s: SparkSession, d: str) -> DataFrame:
    sub = lambda code, v: F.struct(F.lit(code).alias("code"), v.alias("data"))
    field = lambda tag, *subs: F.struct(F.lit(tag).alias("tag"), F.lit(" ").alias("indicator1"), F.lit(" ").alias("indicator2"), F.array(*subs).alias("subfields"))
    control = F.array(*[F.struct(F.lit(t).alias("tag"), v.alias("data")) for t, v in (("001", F.col("p_partkey").cast("string")), ("005", F.lit("20240102030405.0")), ("008", F.lit("fixed")))])
    data = F.array(field("100", sub("a", F.concat("p_brand", F.lit(",")))), field("650", sub("a", F.col("p_type")), sub("x", F.lit("History.")), sub("z", F.lit("Peru"))), field("650", sub("x", F.lit("lost"))), field("490", sub("a", F.lit("Series ;")), sub("v", F.col("p_size").cast("string"))), field("856", sub("u", F.lit("http://x.test"))), field("337", sub("a", F.lit("audio"))))
    return table(s, d, "part").select(F.lit("").alias("leader"), control.alias("controlFields"), data.alias("dataFields"))


_add(
    "marc_more",
    lambda s, d: marc.translate(_marc_more(s, d), "loc", "marc_v1").select("entity_id", "coordinate"),
    _union("'marc:loc:' || p_partkey", ("'WHEN|last_modified|20240102030405.0'", ""), ("'WHEN|fixed_field|fixed'", ""), ("'WHO|author|' || p_brand", ""), ("'WHAT|subject_topic|' || p_type", ""), ("'WHAT|subject_general|History'", ""), ("'WHAT|subject_geography|Peru'", ""), ("'WHAT|series|Series'", ""), ("'WHAT|series_volume|' || p_size", ""), ("'HOW|electronic_access|http://x.test'", ""), ("'HOW|media_type|audio'", "")),
)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


__all__ = ["facts", "oracle_sql", "planned", "queries", "substrate"]
