"""Reading facts and source rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexafact.operators.compile import FACT_COLUMNS, FACT_SCHEMA
from hexafact.operators.substrate import Substrate

_SEVEN = T.StructType([*FACT_SCHEMA.fields, T.StructField("translator_version", T.StringType())])


def facts_from_csv(spark: SparkSession, folder: str, prefix: str = "*") -> DataFrame:
    """All ``prefix_dimension.csv`` of a folder, whether of six or of seven columns; columns are matched by name."""
    paths = [f"{folder.rstrip('/')}/{prefix}_{d}.csv" for d in ("who", "what", "when", "where", "why", "how")]
    found = [p for p in paths if _exists(spark, p)]
    if not found:
        raise FileNotFoundError(f"no fact tables in {folder}")
    parts = [spark.read.csv(p, header=True, multiLine=True, escape='"', inferSchema=False, nullValue="\u0000") for p in found]
    # header-only tables have no rows but all names
    wide = [p.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in FACT_COLUMNS]) for p in parts if set(FACT_COLUMNS) <= set(p.columns)]
    out = wide[0]
    for w in wide[1:]:
        out = out.unionByName(w)
    return out


def _exists(spark: SparkSession, pattern: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return bool(found and len(found))


def load_substrate(spark: SparkSession, uri: str, lens_id: str | None = None, **options) -> Substrate:
    """From parquet:// or csv://; the lens is the only one there unless it is named."""
    scheme, _, path = uri.partition("://")
    if scheme == "parquet":
        facts = spark.read.schema(FACT_SCHEMA).parquet(path)
    elif scheme == "csv":
        facts = facts_from_csv(spark, path)
    else:
        raise ValueError(f"unknown source {uri!r}: parquet:// or csv://")
    if lens_id is None:
        ids = [r[0] for r in facts.select("lens_id").distinct().limit(2).collect()]
        if len(ids) != 1:
            raise ValueError("name one of the lenses" if ids else "there are no facts")
        lens_id = ids[0]
    return Substrate(facts, lens_id, **options)


def jdbc(spark: SparkSession, url: str, table: str, lens_id: str, properties: dict | None = None, **options) -> Substrate:
    """Facts in a relational database, filtered there."""
    return Substrate(spark.read.jdbc(url, table, properties=properties or {}), lens_id, **options)


def paginated(get: Callable[[str], dict], url: str) -> Iterator[dict]:
    """Items of a paginated JSON API with data, has_more and next_page; ``get`` fetches a page."""
    while url:
        page = get(url)
        yield from page.get("data", [])
        url = page.get("next_page") if page.get("has_more") else None


def json_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON value a file, read by a schema; broken ones are null."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("r")).select("r.*")


def from_items(spark: SparkSession, items: Iterator[dict], schema: T.StructType) -> DataFrame:
    """A frame from the items of a small API result."""
    return spark.createDataFrame([(json.dumps(i),) for i in items], "value string").select(F.from_json("value", schema).alias("r")).select("r.*")
