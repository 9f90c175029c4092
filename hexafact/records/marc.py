"""Library records: reading binary and XML files, and translating records into facts.

A record is ``leader, controlFields[tag, data], dataFields[tag, indicator1,
indicator2, subfields[code, data]]`` whatever its source.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


from hexafact.operators.compile import coordinate
from hexafact.shipping import ship

SCHEMA = (
    "leader string, controlFields array<struct<tag:string,data:string>>, dataFields array<struct<tag:string,indicator1:string,indicator2:string,subfields:array<struct<code:string,data:string>>>>"
)

# Tags with one main fact: dimension, key, subfields that compose it.
MAIN = {
    "100": ("who", "author", "a"), "110": ("who", "corporate_author", "ab"), "111": ("who", "meeting_author", "a"),
    "130": ("what", "uniform_title", "a"), "240": ("what", "uniform_title", "a"), "245": ("what", "title", "ab"),
    "246": ("what", "varying_title", "a"), "250": ("what", "edition", "a"), "336": ("what", "content_type", "a"),
    "337": ("how", "media_type", "a"), "338": ("how", "carrier_type", "a"), "347": ("how", "digital_file_type", "a"),
    "500": ("what", "general_note", "a"), "504": ("what", "bibliography_note", "a"), "505": ("what", "contents", "a"),
    "520": ("what", "summary", "a"), "521": ("why", "audience", "a"), "586": ("what", "awards", "a"),
    "600": ("who", "subject_person", "a"), "610": ("who", "subject_organization", "ab"), "611": ("who", "subject_meeting", "a"),
    "630": ("what", "subject_uniform_title", "a"), "650": ("what", "subject_topic", "a"), "651": ("where", "subject_place", "a"),
    "655": ("what", "genre", "a"), "700": ("who", "contributor", "a"), "710": ("who", "corporate_contributor", "ab"),
    "711": ("who", "meeting_contributor", "a"), "780": ("what", "preceding_title", "t"), "785": ("what", "succeeding_title", "t"),
    "787": ("what", "related_work", "t"), "022": ("what", "issn", "a"), "024": ("what", "standard_identifier", "a"),
    "050": ("what", "lc_call_number", "ab"), "082": ("what", "dewey_number", "a"),
}
# Subfields with facts of their own, by tag. Those of a tag in MAIN count only if its main fact exists.
_SUBJECT = {"v": ("what", "subject_form"), "x": ("what", "subject_general"), "y": ("what", "subject_period"), "z": ("what", "subject_geography")}
OWN = {
    "245": {"n": ("what", "part_number"), "p": ("what", "part_name")},
    "260": {"a": ("where", "publication_place"), "b": ("who", "publisher"), "c": ("when", "publication_date"), "e": ("where", "manufacture_place"), "f": ("who", "manufacturer"), "g": ("when", "manufacture_date")},
    "264": {"a": ("where", "publication_place"), "b": ("who", "publisher"), "c": ("when", "publication_date")},
    "300": {"a": ("what", "extent"), "b": ("what", "physical_details"), "c": ("what", "dimensions"), "e": ("what", "accompanying")},
    "490": {"a": ("what", "series"), "v": ("what", "series_volume")},
    "600": _SUBJECT, "610": _SUBJECT, "611": _SUBJECT, "650": _SUBJECT, "655": _SUBJECT, "651": {k: v for k, v in _SUBJECT.items() if k != "z"},
    "830": {"a": ("what", "series"), "v": ("what", "series_volume")},
    "020": {"a": ("what", "isbn"), "z": ("what", "isbn_cancelled")},
    "856": {"u": ("how", "electronic_access"), "z": ("what", "access_note")},
}
CONTROL = {"003": ("what", "control_source"), "005": ("when", "last_modified"), "008": ("when", "fixed_field")}



def clean(value: Column, dimension: Column) -> Column:
    """Without punctuation at the end; for WHEN the year inside, if there is one."""
    bare = F.trim(F.regexp_replace(value, r"[.,/:;]+$", ""))
    year = F.regexp_extract(bare, r"(?:^|[^0-9])(1[0-9]{3}|20[0-9]{2})(?:[^0-9]|$)", 1)
    return F.when((dimension == "when") & (year != ""), year).otherwise(bare)


def _table(rows: dict[str, tuple[str, str]]) -> Column:
    return F.create_map(*[x for k, (d, s) in rows.items() for x in (F.lit(k), F.struct(F.lit(d).alias("dimension"), F.lit(s).alias("semantic_key")))])


def translate(records: DataFrame, source: str, lens_id: str) -> DataFrame:
    """Facts of records; fields without a meaning in the tables are left out. Records are joined by a hash of their content and id."""
    number = F.trim(F.try_element_at(F.filter("controlFields", lambda c: c["tag"] == "001"), F.lit(1))["data"])
    entity = F.concat(F.lit(f"marc:{source}:"), F.coalesce(number, F.lit("unknown")))
    control = F.transform(F.filter("controlFields", lambda c: c["tag"].isin(*CONTROL)), lambda c: F.struct(_table(CONTROL)[c["tag"]]["dimension"].alias("dimension"), _table(CONTROL)[c["tag"]]["semantic_key"].alias("semantic_key"), F.trim(c["data"]).alias("value")))
    own = _table({f"{tag}{code}": m for tag, codes in OWN.items() for code, m in codes.items()})
    main = F.create_map(*[x for t, (d, k, c) in MAIN.items() for x in (F.lit(t), F.struct(F.lit(d).alias("dimension"), F.lit(k).alias("semantic_key"), F.split(F.lit(c), "").alias("codes")))])

    def field_facts(f: Column) -> Column:
        m = main[f["tag"]]
        parts = F.flatten(F.transform(m["codes"], lambda code: F.transform(F.filter(f["subfields"], lambda s: s["code"] == code), lambda s: clean(s["data"], m["dimension"]))))
        value = F.trim(F.array_join(F.filter(parts, lambda p: p != ""), " "))
        first = F.when(m.isNotNull() & (value != ""), F.array(F.struct(m["dimension"].alias("dimension"), m["semantic_key"].alias("semantic_key"), value.alias("value")))).otherwise(F.array().cast("array<struct<dimension:string,semantic_key:string,value:string>>"))
        mapped = F.filter(f["subfields"], lambda s: own[F.concat(f["tag"], s["code"])].isNotNull())
        rest = F.transform(mapped, lambda s: F.struct(own[F.concat(f["tag"], s["code"])]["dimension"].alias("dimension"), own[F.concat(f["tag"], s["code"])]["semantic_key"].alias("semantic_key"), clean(s["data"], own[F.concat(f["tag"], s["code"])]["dimension"]).alias("value")))
        return F.when(m.isNull() | (F.size(first) > 0), F.concat(first, rest)).otherwise(first)

    every = F.concat(F.coalesce(control, F.array().cast("array<struct<dimension:string,semantic_key:string,value:string>>")), F.coalesce(F.flatten(F.transform("dataFields", field_facts)), F.array().cast("array<struct<dimension:string,semantic_key:string,value:string>>")))
    rows = records.select(entity.alias("entity_id"), F.inline(every)).where("trim(value) <> ''")
    return rows.select("entity_id", "dimension", "semantic_key", "value", coordinate(F.col("dimension"), F.col("semantic_key"), F.col("value")).alias("coordinate"), F.lit(lens_id).alias("lens_id"))


def split_binary(content: bytes) -> Iterator[dict]:
    """Records of an ISO 2709 file: they end with 0x1D; a record that cannot be read is left out."""
    for raw in content.split(b"\x1d"):
        raw = raw.lstrip(b"\r\n")
        if len(raw) < 25:
            continue
        try:
            yield _record(raw)
        except (ValueError, IndexError):
            continue


def _record(raw: bytes) -> dict:
    base = int(raw[12:17])
    control, data = [], []
    directory = raw[24 : base - 1]
    for i in range(0, len(directory) - 11, 12):
        tag, length, at = directory[i : i + 3].decode("ascii"), int(directory[i + 3 : i + 7]), int(directory[i + 7 : i + 12])
        field = raw[base + at : base + at + length].rstrip(b"\x1e").decode("utf-8", "replace")
        if tag < "010":
            control.append({"tag": tag, "data": field})
        else:
            subfields = [{"code": s[0], "data": s[1:]} for s in field[2:].split("\x1f") if s]
            data.append({"tag": tag, "indicator1": field[:1], "indicator2": field[1:2], "subfields": subfields})
    return {"leader": raw[:24].decode("ascii", "replace"), "controlFields": control, "dataFields": data}


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                found = list(split_binary(content))
                for i in range(0, len(found), 1000):
                    yield pd.DataFrame(found[i : i + 1000], columns=["leader", "controlFields", "dataFields"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, SCHEMA)


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    raw = ("leader string, controlfield array<struct<_tag:string,_VALUE:string>>, datafield array<struct<_tag:string,_ind1:string,_ind2:string,subfield:array<struct<_code:string,_VALUE:string>>>>")
    rows = spark.read.format("xml").option("rowTag", "record").schema(raw).load(path)
    control = F.transform("controlfield", lambda c: F.struct(c["_tag"].alias("tag"), c["_VALUE"].alias("data")))
    sub = lambda d: F.transform(d["subfield"], lambda s: F.struct(s["_code"].alias("code"), s["_VALUE"].alias("data")))
    data = F.transform("datafield", lambda d: F.struct(d["_tag"].alias("tag"), d["_ind1"].alias("indicator1"), d["_ind2"].alias("indicator2"), sub(d).alias("subfields")))
    return rows.select("leader", control.alias("controlFields"), data.alias("dataFields"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """By extension: .xml and .marcxml, or binary."""
    return read_xml(spark, path) if path.lower().endswith((".xml", ".marcxml")) else read_binary(spark, path)


SEARCH_ITEM = ("number_lccn array<string>, id string, title string, contributor array<string>, creator array<string>, publisher array<string>, date string, subject array<string>, language array<string>, description array<string>")


def from_search_items(items: DataFrame) -> DataFrame:
    """Catalogue search results (SEARCH_ITEM) in the shape of records."""
    sub = lambda code, v: F.struct(F.lit(code).alias("code"), v.alias("data"))
    field = lambda tag, *subs: F.struct(F.lit(tag).alias("tag"), F.lit(" ").alias("indicator1"), F.lit(" ").alias("indicator2"), F.filter(F.array(*subs), lambda s: s["data"].isNotNull()).alias("subfields"))
    names = F.coalesce("contributor", "creator", F.array().cast("array<string>"))
    each = lambda tag, values: F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: field(tag, sub("a", v)))
    data = F.concat(
        F.transform(F.slice(names, 1, 1), lambda v: field("100", sub("a", v))),
        F.array(field("245", sub("a", F.col("title")))),
        F.array(field("260", sub("b", F.try_element_at("publisher", F.lit(1))), sub("c", F.col("date")))),
        each("520", F.col("description")),
        each("650", F.col("subject")),
        F.transform(F.when(F.size(names) > 1, F.slice(names, F.lit(2), F.size(names))).otherwise(F.array().cast("array<string>")), lambda v: field("700", sub("a", v))),
    )
    number = F.coalesce(F.trim(F.try_element_at("number_lccn", F.lit(1))), F.col("id"))
    return items.select(F.lit("").alias("leader"), F.array(F.struct(F.lit("001").alias("tag"), number.alias("data"))).alias("controlFields"), data.alias("dataFields"))
