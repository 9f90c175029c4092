"""Source rows to facts, under a lens."""

from __future__ import annotations

import json
from collections.abc import Collection
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexafact.functions import scalars as S

FACT_COLUMNS = ("entity_id", "dimension", "semantic_key", "value", "coordinate", "lens_id")
FACT_SCHEMA = T.StructType([T.StructField(c, T.StringType(), False) for c in FACT_COLUMNS])


class CompileError(ValueError):
    """A lens or source that cannot be compiled."""


class NucleusError(CompileError):
    """A row without the values that make its identity."""


def coordinate(dimension: Column, key: Column, value: Column) -> Column:
    return F.concat_ws("|", F.upper(dimension), key, value)


def dotted_coordinate(dimension: Column, key: Column, value: Column) -> Column:
    """The second spelling: DIM.key=value."""
    return F.concat(F.upper(dimension), F.lit("."), key, F.lit("="), value)


def as_frame(spark: SparkSession, source) -> DataFrame:
    """A DataFrame from a Spark or pandas one, or from the path of a CSV file (all columns text)."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, (str, Path)):
        return spark.read.csv(str(source), header=True, multiLine=True, escape='"')
    if hasattr(source, "to_dict") and hasattr(source, "columns"):
        return spark.createDataFrame(source)
    raise TypeError(f"a source is a DataFrame or the path of a CSV file, not {type(source).__name__}")


def read_lens(lens) -> dict:
    if isinstance(lens, (str, Path)):
        with open(lens, encoding="utf-8") as f:
            lens = json.load(f)
    if not isinstance(lens, dict):
        raise CompileError("a lens is a dict or the path of one")
    for part in ("lens_id", "coordinate_map", "nucleus"):
        if not lens.get(part):
            raise CompileError(f"the lens has no {part}")
    return lens


def _field(df: DataFrame, name: str) -> Column:
    return S.fact_value(F.col(f"`{name}`"), df.schema[name].dataType)


def nucleus(df: DataFrame, spec: dict) -> tuple[Column, list[str]]:
    """The identity of a row (null if a part is missing), and the columns it needs."""
    kind = spec.get("type")
    if kind == "single":
        fields = [spec["field"]]
    elif kind == "composite":
        fields = list(spec["fields"])
    else:
        raise CompileError(f"unknown nucleus type: {kind!r}")
    absent = [f for f in fields if f not in df.columns]
    if absent:
        raise CompileError(f"nucleus columns are missing: {', '.join(absent)}")
    parts = [_field(df, f) for f in fields]
    whole = parts[0] if len(parts) == 1 else F.when(F.forall(F.array(*parts), lambda p: p.isNotNull()), F.concat_ws(spec.get("separator", "-"), *parts))
    return (F.concat(F.lit(f"{spec['prefix']}:"), whole) if spec.get("prefix") else whole), fields


def distinct_facts(facts: DataFrame) -> DataFrame:
    """Each (entity, coordinate) of one lens once, by hashing: a coordinate is made of the other columns. No key may hold a bar."""
    made = facts.select("entity_id", "dimension", "semantic_key", "value", "lens_id").distinct()
    return made.select("entity_id", "dimension", "semantic_key", "value", coordinate(F.col("dimension"), F.col("semantic_key"), F.col("value")).alias("coordinate"), "lens_id")


def compile_frame(df: DataFrame, lens: dict, dedup: bool = False, check: bool = True, keys: Collection[str] | None = None) -> DataFrame:
    """Facts of all rows, or only those of the ``keys`` named. Nulls, blanks and "nan" give none; mapped columns that the source lacks are skipped.

    With ``check`` a row without identity raises NucleusError before anything else runs; without, such rows are left out.
    """
    entity, fields = nucleus(df, lens["nucleus"])
    if check:
        bad = df.where(entity.isNull()).limit(1).count()
        if bad:
            raise NucleusError(f"a row has no value for {', '.join(fields)}")
    mapped = [(c, m["dimension"].lower(), m["semantic_key"].lower()) for c, m in lens["coordinate_map"].items() if c in df.columns]
    if keys is not None:
        mapped = [m for m in mapped if m[2] in keys]
    if not mapped:
        return df.sparkSession.createDataFrame([], FACT_SCHEMA)
    # upper case and bars are settled here, so that a row only joins a constant and a value
    facts = F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(k).alias("semantic_key"), F.lit(f"{d.upper()}|{k}|").alias("head"), _field(df, c).alias("value")) for c, d, k in mapped])
    out = df.select(entity.alias("entity_id"), F.inline(facts)).where(F.col("value").isNotNull() & F.col("entity_id").isNotNull())
    out = out.select("entity_id", "dimension", "semantic_key", "value", F.concat("head", "value").alias("coordinate"), F.lit(lens["lens_id"]).alias("lens_id"))
    if not dedup:
        return out
    return out.dropDuplicates(["entity_id", "coordinate"]) if any("|" in k for _, _, k in mapped) else distinct_facts(out)


def row_id(df: DataFrame, name: str = "_row_id") -> DataFrame:
    """An identity from content, for sources without an id column: equal rows share it, whatever their order."""
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for c in df.columns]
    return df.withColumn(name, F.sha2(F.concat_ws("\u0001", *parts), 256))


def fact(dimension: str, key: str, value: Column) -> Column:
    """One fact, or null where the value is null or a sentinel."""
    good = value.isNotNull() & ~value.isin("", "nan", "undefined", "null", "None")
    return F.when(good, F.struct(F.lit(dimension).alias("dimension"), F.lit(key).alias("semantic_key"), value.alias("value")))


def facts_from_array(dimension: str, key: str, values: Column) -> Column:
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: fact(dimension, key, v))


def facts_from_map(dimension: str, prefix: str, values: Column) -> Column:
    entries = F.coalesce(F.map_entries(values), F.array().cast("array<struct<key:string,value:string>>"))
    good = lambda v: v.isNotNull() & ~v.isin("", "nan", "undefined", "null", "None")
    return F.transform(entries, lambda e: F.when(good(e["value"]), F.struct(F.lit(dimension).alias("dimension"), F.concat(F.lit(f"{prefix}_"), e["key"]).alias("semantic_key"), e["value"].alias("value"))))


def spoke(df: DataFrame, entity: Column, lens_id: str, facts: list[Column], dedup: bool = True) -> DataFrame:
    """Facts from columns made by ``fact`` (one each) and the ``facts_from_`` functions (arrays)."""
    arrays = [f if _is_array(df, f) else F.array(f) for f in facts]
    rows = df.select(entity.alias("entity_id"), F.inline(F.filter(F.concat(*arrays), lambda f: f.isNotNull()))).where(F.col("entity_id").isNotNull())
    rows = rows.select("entity_id", "dimension", "semantic_key", "value", coordinate(F.col("dimension"), F.col("semantic_key"), F.col("value")).alias("coordinate"), F.lit(lens_id).alias("lens_id"))
    return rows.dropDuplicates(["entity_id", "coordinate"]) if dedup else rows


def _is_array(df: DataFrame, c: Column) -> bool:
    return isinstance(df.select(c.alias("c")).schema["c"].dataType, T.ArrayType)
