"""Appending facts from a stream of source rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hexafact.operators.compile import compile_frame


def compile_stream(rows: DataFrame, lens: dict, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Facts of a stream. With ``event_time``, a fact repeated within the delay is dropped; state older than that is forgotten.

    Rows without identity are left out, as a stream cannot be checked beforehand.
    """
    if event_time is None:
        return compile_frame(rows, lens, check=False)
    timed = rows.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, delay)
    keyed = {**lens, "coordinate_map": {c: m for c, m in lens["coordinate_map"].items() if c != event_time}}
    facts = _with_time(timed, keyed, event_time)
    return facts.dropDuplicatesWithinWatermark(["entity_id", "coordinate"]).drop("event_time")


def _with_time(rows: DataFrame, lens: dict, event_time: str) -> DataFrame:
    from hexafact.operators.compile import _field, coordinate, nucleus

    entity, _ = nucleus(rows, lens["nucleus"])
    mapped = [(c, m["dimension"].lower(), m["semantic_key"].lower()) for c, m in lens["coordinate_map"].items() if c in rows.columns]
    facts = F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(k).alias("semantic_key"), _field(rows, c).alias("value")) for c, d, k in mapped])
    out = rows.select(entity.alias("entity_id"), F.col(event_time).alias("event_time"), F.inline(facts)).where("value is not null and entity_id is not null")
    return out.select("entity_id", "dimension", "semantic_key", "value", coordinate(F.col("dimension"), F.col("semantic_key"), F.col("value")).alias("coordinate"), F.lit(lens["lens_id"]).alias("lens_id"), "event_time")


def append(facts: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write a stream of facts to the dimension folders of a store; the checkpoint makes it exactly once."""
    writer = facts.writeStream.format("parquet").outputMode("append").partitionBy("dimension").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
