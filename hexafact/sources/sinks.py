"""Where facts are written: parquet://, csv://, sql:// and JSON lines, each with the lens beside it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexafact.functions.scalars import sql_quoted
from hexafact.operators.compile import FACT_COLUMNS, CompileError, dotted_coordinate


def _put(df: DataFrame, path: str, text: str) -> None:
    """A small text file through Hadoop's file system, so any store works."""
    jvm = df.sparkSession.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(target, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def write_lens(df: DataFrame, lens: dict, folder: str) -> None:
    _put(df, f"{folder.rstrip('/')}/lens.json", json.dumps(lens, indent=2, ensure_ascii=False))


def _by_key(facts: DataFrame) -> DataFrame:
    """Facts of a dimension and key together, in tasks of the advised size: adaptive execution splits large keys and joins small ones."""
    return facts.hint("rebalance", F.col("dimension"), F.col("semantic_key"))


def to_parquet(facts: DataFrame, path: str, mode: str = "overwrite") -> str:
    """A folder for each dimension; rows ordered by key and value, so that row groups can be skipped."""
    _by_key(facts).sortWithinPartitions("dimension", "semantic_key", "value").write.mode(mode).partitionBy("dimension").parquet(path)
    return path


def to_csv(facts: DataFrame, path: str, prefix: str = "spoke", columns: tuple[str, ...] = FACT_COLUMNS, empty: bool = False) -> str:
    """A folder ``prefix_dimension.csv`` for each dimension present (with ``empty``, for all six)."""
    present = {r[0] for r in facts.select("dimension").distinct().collect()}
    for d in ("who", "what", "when", "where", "why", "how") if empty else sorted(present):
        facts.where(F.col("dimension") == d).select(*columns).sort("entity_id", "semantic_key", "value").write.mode("overwrite").csv(f"{path.rstrip('/')}/{prefix}_{d}.csv", header=True, escape='"', emptyValue="")
    return path


def to_sql(facts: DataFrame, path: str, table: str = "spoke") -> str:
    """INSERT statements, one a line."""
    row = F.concat(F.lit(f"INSERT INTO {table} ({', '.join(FACT_COLUMNS)}) VALUES ("), F.concat_ws(", ", *[sql_quoted(F.col(c)) for c in FACT_COLUMNS]), F.lit(");"))
    facts.orderBy("entity_id", "dimension", "semantic_key", "value").select(row.alias("value")).write.mode("overwrite").text(path)
    return path


def to_jsonl(facts: DataFrame, path: str) -> str:
    """JSON lines with dotted coordinates, for loaders of other stores."""
    c = dotted_coordinate(F.col("dimension"), F.col("semantic_key"), F.col("value"))
    facts.select("entity_id", "dimension", "semantic_key", c.alias("coordinate"), "lens_id").write.mode("overwrite").partitionBy("dimension").json(path)
    return path


WRITERS = {"parquet": to_parquet, "csv": to_csv, "sql": to_sql, "jsonl": to_jsonl}


def write(facts: DataFrame, lens: dict, uri: str) -> str:
    scheme, _, path = uri.partition("://")
    if scheme not in WRITERS or not path:
        raise CompileError(f"unknown target {uri!r}: one of {', '.join(WRITERS)}")
    WRITERS[scheme](facts, path)
    # beside the data: inside a CSV folder, next to the others
    write_lens(facts, lens, path if scheme == "csv" else f"{path.rstrip('/')}.lens")
    return path


def import_package(facts: DataFrame, hub: DataFrame, path: str, lens_id: str, version: str, prefix: str = "spoke") -> dict:
    """A folder for loading into a relational database: DDL, six CSV tables, the hub, a load script and a report."""
    path = path.rstrip("/")
    facts = facts.withColumn("translator_version", F.lit(version))
    columns = (*FACT_COLUMNS, "translator_version")
    to_csv(facts, path, prefix, columns, empty=True)
    hub.select("*", F.lit(lens_id).alias("lens_id"), F.lit(version).alias("translator_version")).orderBy("entity_id").write.mode("overwrite").csv(f"{path}/hub.csv", header=True, escape='"')
    dims = ("who", "what", "when", "where", "why", "how")
    ddl = [f"CREATE TABLE {prefix}_{d} ({', '.join(f'{c} TEXT NOT NULL' for c in columns)}, UNIQUE (entity_id, coordinate));" for d in dims]
    ddl.append("CREATE TABLE hub (entity_id TEXT PRIMARY KEY, nucleus TEXT, label TEXT, sublabel TEXT, lens_id TEXT, translator_version TEXT);")
    union = " UNION ALL ".join(f"SELECT * FROM {prefix}_{d}" for d in dims)
    ddl.append(f"CREATE MATERIALIZED VIEW affordances AS SELECT dimension, semantic_key, value, coordinate, COUNT(DISTINCT entity_id) AS entity_count, COUNT(*) AS fact_count FROM ({union}) s GROUP BY 1, 2, 3, 4;")
    _put(facts, f"{path}/00_ddl.sql", "\n".join(ddl) + "\n")
    load = ["#!/bin/sh", "set -e", 'psql "$1" -f 00_ddl.sql']
    load += [f'for f in {t}.csv/part-*.csv; do psql "$1" -c "\\copy {t} FROM \'$f\' CSV HEADER"; done' for t in [*(f"{prefix}_{d}" for d in dims), "hub"]]
    _put(facts, f"{path}/load.sh", "\n".join([*load, 'psql "$1" -c "REFRESH MATERIALIZED VIEW affordances"']) + "\n")
    report = verification(facts, lens_id, version)
    _put(facts, f"{path}/verification_report.json", json.dumps(report, indent=2, ensure_ascii=False))
    return report


def verification(facts: DataFrame, lens_id: str, version: str) -> dict:
    """Counts in total and by dimension, with up to three sample facts of each."""
    from hexafact.operators.discovery import describe

    rows = {r["dimension"]: r for r in describe(facts).collect()}
    total = rows.pop(None, None)
    samples = {d: [r.asDict() for r in facts.where(F.col("dimension") == d).select("entity_id", "coordinate").orderBy("entity_id", "coordinate").limit(3).collect()] for d in rows}
    return {
        "lens_id": lens_id, "translator_version": version,
        "entity_count": total["entity_count"] if total else 0, "fact_count": total["fact_count"] if total else 0,
        "facts_by_dimension": {d: rows[d]["fact_count"] if d in rows else 0 for d in ("who", "what", "when", "where", "why", "how")},
        "samples": samples,
    }
