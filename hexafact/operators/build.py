"""Several source tables into one store: deduplicated facts, and a hub row for each entity."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hexafact.operators.compile import FACT_SCHEMA, CompileError, as_frame

HUB_COLUMNS = ("entity_id", "nucleus", "label", "sublabel")


@dataclass(frozen=True)
class Translated:
    """What a translator makes of a source: facts, hub rows, and the number of rows without identity."""

    facts: DataFrame
    hub: DataFrame
    skipped: Column | None = None


def merge_facts(parts: list[DataFrame]) -> DataFrame:
    """The union, each (entity, coordinate) once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["entity_id", "coordinate"])


def merge_hub(parts: list[DataFrame]) -> DataFrame:
    """The last load's row for each entity."""
    out = None
    for i, p in enumerate(parts):
        own = p.select(*HUB_COLUMNS).withColumn("seq", F.lit(i))
        out = own if out is None else out.unionByName(own)
    rows = out.groupBy("entity_id").agg(F.max_by(F.struct("nucleus", "label", "sublabel"), F.struct("seq", "label", "sublabel")).alias("r"))
    return rows.select("entity_id", "r.nucleus", "r.label", "r.sublabel")


def hub_rows(facts: DataFrame) -> DataFrame:
    """Hub rows from facts: label from WHAT.title, or the id; sublabel from the least WHO value."""
    title = F.min(F.when((F.col("dimension") == "what") & (F.col("semantic_key") == "title"), F.col("value")))
    who = F.min(F.when(F.col("dimension") == "who", F.col("value")))
    rows = facts.groupBy("entity_id").agg(title.alias("t"), who.alias("w"))
    return rows.select("entity_id", F.col("entity_id").alias("nucleus"), F.coalesce("t", "entity_id").alias("label"), F.coalesce("w", F.lit("")).alias("sublabel"))


@dataclass(frozen=True)
class BuildSpec:
    """Sources to compile: (translator name, path or DataFrame) pairs; where to; and whether to start anew."""

    sources: list
    target: str
    lens_id: str
    version: str = "1.0.0"
    overwrite: bool = False


@dataclass
class BuildResult:
    success: bool
    entity_count: int = 0
    fact_count: int = 0
    warnings: list[str] = field(default_factory=list)
    error: str | None = None


def compile_job(spec: BuildSpec, spark: SparkSession | None = None) -> BuildResult:
    """Compile and write; errors come back in the result."""
    from hexafact.operators.translators import TRANSLATORS
    from hexafact.sources import sinks

    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    try:
        if not spec.sources:
            raise CompileError("there are no sources")
        facts, hubs, warnings = [], [], []
        for name, source in spec.sources:
            if name not in TRANSLATORS:
                raise CompileError(f"unknown translator {name!r}: one of {', '.join(TRANSLATORS)}")
            rows = as_frame(spark, source)
            entity, own_facts, hub = TRANSLATORS[name](rows, spec.lens_id)
            skipped = rows.where(entity.isNull()).count()
            if skipped:
                warnings.append(f"{name}: {skipped} rows without identity were skipped")
            facts.append(own_facts)
            hubs.append(hub)
        scheme, _, path = spec.target.partition("://")
        path = path.rstrip("/")
        if scheme == "parquet" and not spec.overwrite:
            for name, parts, at in (("facts", facts, 0), ("hub", hubs, 0)):
                try:
                    old = spark.read.parquet(f"{path}/{name}")
                except Exception as e:
                    if "PATH_NOT_FOUND" not in str(e):
                        raise
                    continue
                parts.insert(at, old)
        merged, hub = merge_facts(facts), merge_hub(hubs)
        counts = merged.agg(F.count("*").alias("n"), F.countDistinct("entity_id").alias("e")).first()
        if scheme == "parquet":
            fresh = f"{path}/.next"
            merged.select(*FACT_SCHEMA.names).write.mode("overwrite").partitionBy("dimension").parquet(f"{fresh}/facts")
            hub.write.mode("overwrite").parquet(f"{fresh}/hub")
            _swap(spark, fresh, path)
        elif scheme == "csv":
            sinks.to_csv(merged.withColumn("translator_version", F.lit(spec.version)), path, columns=(*FACT_SCHEMA.names, "translator_version"))
        elif scheme == "package":
            sinks.import_package(merged, hub, path, spec.lens_id, spec.version)
        else:
            raise CompileError(f"unknown target {spec.target!r}: parquet://, csv:// or package://")
        return BuildResult(True, counts["e"], counts["n"], warnings)
    except Exception as e:  # the service boundary: the caller gets the message
        return BuildResult(False, error=str(e))


def _swap(spark: SparkSession, fresh: str, path: str) -> None:
    """Put freshly written tables in place of the old."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name in ("facts", "hub"):
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)
        fs.rename(jvm.org.apache.hadoop.fs.Path(f"{fresh}/{name}"), jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"))
    fs.delete(jvm.org.apache.hadoop.fs.Path(fresh), True)
