"""Nested fact records and collections of them: schemas, validation, explosion.

Validation is a column: the dotted path and the reason of the first failure, in
the order of the wire format, or null. Strict reading raises on the first row
that has one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from hexafact.functions.scalars import iso_time
from hexafact.operators.compile import coordinate

# Field names of the two wire formats, and group labels.
RECORD_SCHEMA = (
    "srf_version string, srf_uri string, entity_id string, nucleus struct<type:string,value:string,authority:string>, "
    "facts array<struct<dimension:string,semantic_key:string,value:string,qualifiers:map<string,string>>>, "
    "provenance struct<source:string,translated_by:string,translator_version:string,lens:string,translated_at:string,source_record_id:string,source_url:string>, "
    "alternate_views array<struct<lens:string,srf_uri:string,label:string>>"
)
BUNDLE_SCHEMA = (
    "fg_version string, expedition_id string, curator_id string, title string, tags array<string>, "
    "entries array<struct<srf_uri:string,nucleus:struct<type:string,value:string,authority:string>,entry_tags:array<string>,lens_id:string>>, "
    "published_at string, abstract string, lens_id string, fork_of string, feed_url string"
)
VERSION = "1.0"
DIMENSIONS = ("WHO", "WHAT", "WHEN", "WHERE", "WHY", "HOW")
UNKNOWN = "UNKNOWN"


class RecordError(ValueError):
    """A record that does not follow its format: ``field`` and ``reason``."""

    def __init__(self, field: str, reason: str) -> None:
        super().__init__(f"{field}: {reason}")
        self.field, self.reason = field, reason


def _failure(path: Column | str, reason: Column | str) -> Column:
    return F.struct((F.lit(path) if isinstance(path, str) else path).alias("field"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def _first(*checks: tuple[Column, Column]) -> Column:
    """The failure of the first check whose condition holds."""
    return reduce(lambda later, check: F.when(check[0], check[1]).otherwise(later), reversed(checks), F.lit(None))


def _needed(c: Column, path: str) -> tuple[Column, Column]:
    return _blank(c), _failure(path, "required, must be a non-empty string")


def _in_array(array: str, check) -> Column:
    """The first failure among an array's items; ``check`` gives (condition, field, reason) triples of an item."""

    def one(item: Column, i: Column) -> Column:
        at = F.concat(F.lit(f"{array}["), i.cast("string"), F.lit("]"))
        return _first(*[(cond, _failure(F.concat(at, F.lit(f".{name}")), reason)) for cond, name, reason in check(item)])

    failures = F.filter(F.transform(array, one), lambda x: x.isNotNull())
    return F.try_element_at(failures, F.lit(1))


def record_failure() -> Column:
    """The first failure of a record: a struct of field and reason, or null."""

    def fact_checks(f: Column) -> list:
        dim = F.upper(F.trim(f["dimension"]))
        return [
            (_blank(f["dimension"]), "dimension", "required, must be a non-empty string"),
            (~dim.isin(*DIMENSIONS, UNKNOWN), "dimension", "not a valid dimension"),
            (_blank(f["semantic_key"]), "semantic_key", "required, must be a non-empty string"),
            (_blank(f["value"]), "value", "required, must be a non-empty string"),
        ]

    view_checks = lambda v: [(_blank(v[k]), k, "required, must be a non-empty string") for k in ("lens", "srf_uri")]
    in_facts, in_views = _in_array("facts", fact_checks), _in_array("alternate_views", view_checks)
    checks = [
        _needed(F.col("srf_version"), "srf_version"),
        (F.col("srf_version") != VERSION, _failure("srf_version", f"expected '{VERSION}'")),
        _needed(F.col("srf_uri"), "srf_uri"), _needed(F.col("entity_id"), "entity_id"),
        (F.col("nucleus").isNull(), _failure("nucleus", "required field is missing")),
        _needed(F.col("nucleus.type"), "nucleus.type"), _needed(F.col("nucleus.value"), "nucleus.value"),
        (F.col("facts").isNull(), _failure("facts", "required field is missing")),
        (F.size("facts") == 0, _failure("facts", "must contain at least one fact")),
        (in_facts.isNotNull(), in_facts),
        (F.col("provenance").isNull(), _failure("provenance", "required field is missing")),
        _needed(F.col("provenance.translated_at"), "provenance.translated_at"),
        (~iso_time(F.col("provenance.translated_at")), _failure("provenance.translated_at", "not a valid ISO 8601 timestamp")),
        *[_needed(F.col(f"provenance.{k}"), f"provenance.{k}") for k in ("source", "translated_by", "translator_version", "lens")],
        (in_views.isNotNull(), in_views),
    ]
    return _first(*checks)


def bundle_failure() -> Column:
    entry_checks = lambda e: [(_blank(e["srf_uri"]), "srf_uri", "required, must be a non-empty string"), (e["nucleus"].isNull(), "nucleus", "required field is missing"), *[(_blank(e["nucleus"][k]), f"nucleus.{k}", "required, must be a non-empty string") for k in ("type", "value")]]
    in_entries = _in_array("entries", entry_checks)
    checks = [
        _needed(F.col("fg_version"), "fg_version"),
        (F.col("fg_version") != VERSION, _failure("fg_version", f"expected '{VERSION}'")),
        *[_needed(F.col(k), k) for k in ("expedition_id", "curator_id", "title")],
        (F.col("tags").isNull(), _failure("tags", "required field is missing")),
        (F.col("entries").isNull(), _failure("entries", "required field is missing")),
        (in_entries.isNotNull(), in_entries),
        _needed(F.col("published_at"), "published_at"),
        (~iso_time(F.col("published_at")), _failure("published_at", "not a valid ISO 8601 timestamp")),
    ]
    return _first(*checks)


def validated(df: DataFrame, failure: Column, strict: bool = False) -> DataFrame:
    """``df`` with error_field and error_reason; ``strict`` raises RecordError on the first failure instead."""
    out = df.withColumn("failure", failure).select(*df.columns, F.col("failure.field").alias("error_field"), F.col("failure.reason").alias("error_reason"))
    if strict:
        bad = out.where("error_field is not null").select("error_field", "error_reason").first()
        if bad:
            raise RecordError(*bad)
        return out.drop("error_field", "error_reason")
    return out


def record_facts(df: DataFrame) -> DataFrame:
    """Facts of records; those of the unknown dimension stay in the record only."""
    known = F.filter("facts", lambda f: F.upper(F.trim(f["dimension"])) != UNKNOWN)
    rows = df.select("entity_id", F.col("provenance.lens").alias("lens_id"), F.inline(known))
    rows = rows.select("entity_id", F.lower(F.trim("dimension")).alias("dimension"), F.lower("semantic_key").alias("semantic_key"), "value", "lens_id")
    return rows.select("entity_id", "dimension", "semantic_key", "value", coordinate(F.col("dimension"), F.col("semantic_key"), F.col("value")).alias("coordinate"), "lens_id")


def record_hub(df: DataFrame) -> DataFrame:
    """Hub rows of records: label from WHAT.title or the id, sublabel from the first WHO fact."""
    at = lambda cond: F.try_element_at(F.filter("facts", cond), F.lit(1))["value"]
    title = at(lambda f: (F.upper(f["dimension"]) == "WHAT") & (F.lower(f["semantic_key"]) == "title"))
    who = at(lambda f: F.upper(f["dimension"]) == "WHO")
    return df.select("entity_id", F.col("nucleus.value").alias("nucleus"), F.coalesce(title, "entity_id").alias("label"), F.coalesce(who, F.lit("")).alias("sublabel"))


def record_counts(df: DataFrame) -> DataFrame:
    routable = F.size(F.filter("facts", lambda f: F.upper(F.trim(f["dimension"])) != UNKNOWN))
    return df.select("entity_id", F.size("facts").cast("bigint").alias("fact_count"), routable.cast("bigint").alias("routable_fact_count"))


def to_json(df: DataFrame) -> DataFrame:
    """Records as JSON text, without null fields."""
    return df.select("entity_id" if "entity_id" in df.columns else "expedition_id", F.to_json(F.struct(*[c for c in df.columns if not c.startswith("error_")])).alias("json"))


def bundle_tags(df: DataFrame) -> DataFrame:
    """Each entry's tags with its nucleus; the bundle's lens where the entry has none."""
    rows = df.select("expedition_id", F.col("lens_id").alias("bundle_lens"), F.inline("entries"))
    return rows.select("expedition_id", F.explode("entry_tags").alias("tag"), "srf_uri", F.col("nucleus.value").alias("nucleus"), F.coalesce("lens_id", "bundle_lens").alias("lens_id"))


def bundle_index(df: DataFrame) -> DataFrame:
    return df.select("expedition_id", "curator_id", "title", "tags", F.size("entries").cast("bigint").alias("entry_count"), "published_at", "abstract", "lens_id", "fork_of")


def bundle_groups(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Entries counted by group: a label for the type of nucleus, or Other."""
    from hexafact.functions.scalars import lookup

    rows = df.select("expedition_id", F.inline("entries"))
    group = F.coalesce(lookup(labels)[F.lower("nucleus.type")] if labels else F.lit(None), F.lit("Other"))
    return rows.groupBy("expedition_id", group.alias("group_label")).agg(F.count("*").cast("bigint").alias("entry_count"), F.array_sort(F.collect_list("srf_uri")).alias("entries"))
