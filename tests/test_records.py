import pytest
from pyspark.sql import functions as F

from hexafact.cli import Shell
from hexafact.operators import build, translators
from hexafact.operators.compile import compile_frame
from hexafact.operators.substrate import Substrate
from hexafact.plugins import Candidate, Fetcher, InputMode, PluginError, Translator
from hexafact.records import marc, nested
from hexafact.sources.readers import paginated
from hexafact.streaming.facts import append, compile_stream


def iso2709(control, fields):
    body, directory, at = b"", b"", 0
    for tag, data in [*control, *fields]:
        raw = (data if isinstance(data, str) else "  " + "".join(f"\x1f{c}{v}" for c, v in data)).encode() + b"\x1e"
        directory += f"{tag}{len(raw):04d}{at:05d}".encode()
        body += raw
        at += len(raw)
    base = 24 + len(directory) + 1
    return f"{base + at + 1:05d}nam a22{base:05d} a 4500".encode() + directory + b"\x1e" + body + b"\x1d"


def test_marc_binary_and_xml(spark, tmp_path):
    one = iso2709([("001", "42"), ("005", "19940223")], [("245", [("a", "Title /"), ("b", "rest.")]), ("260", [("a", "Paris :"), ("c", "c1952.")]), ("999", [("a", "x")])])
    (tmp_path / "a.mrc").write_bytes(one + b"garbage that is no record at all..\x1d" + one)
    facts = marc.translate(marc.read(spark, str(tmp_path / "a.mrc")), "loc", "m1")
    expected = ["WHAT|title|Title rest", "WHEN|last_modified|19940223", "WHEN|publication_date|1952", "WHERE|publication_place|Paris"]
    assert sorted(r["coordinate"] for r in facts.distinct().collect()) == expected
    assert facts.select("entity_id").distinct().collect()[0][0] == "marc:loc:42"
    (tmp_path / "b.xml").write_text('<collection xmlns="http://www.loc.gov/MARC21/slim"><record><leader>x</leader><controlfield tag="001">7</controlfield><datafield tag="650" ind1=" " ind2="0"><subfield code="a">Cats.</subfield><subfield code="x">Care</subfield></datafield></record></collection>')
    got = marc.translate(marc.read(spark, str(tmp_path / "b.xml")), "loc", "m1")
    assert sorted(r["coordinate"] for r in got.collect()) == ["WHAT|subject_general|Care", "WHAT|subject_topic|Cats"]


def record(**change):
    base = {"srf_version": "1.0", "srf_uri": "u", "entity_id": "e", "nucleus": {"type": "t", "value": "v"}, "facts": [{"dimension": "WHAT", "semantic_key": "title", "value": "T"}, {"dimension": "unknown", "semantic_key": "k", "value": "v"}], "provenance": {"source": "s", "translated_by": "t", "translator_version": "1", "lens": "l", "translated_at": "2026-05-03T00:00:00Z"}}
    return base | change


def test_record_failures(spark):
    import json

    cases = [({}, None), ({"srf_version": "2"}, "srf_version"), ({"entity_id": " "}, "entity_id"), ({"nucleus": {"type": "t"}}, "nucleus.value"), ({"facts": []}, "facts"), ({"facts": [{"dimension": "WHAT", "semantic_key": "a", "value": "b"}, {"dimension": "X", "semantic_key": "a", "value": "b"}]}, "facts[1].dimension"), ({"alternate_views": [{"lens": "l"}]}, "alternate_views[0].srf_uri")]
    df = spark.createDataFrame([(i, json.dumps(record(**c))) for i, (c, _) in enumerate(cases)], "i int, v string")
    rows = df.select("i", F.from_json("v", nested.RECORD_SCHEMA).alias("r")).select("i", "r.*")
    got = {r["i"]: r["error_field"] for r in nested.validated(rows, nested.record_failure()).collect()}
    assert [got[i] for i in range(len(cases))] == [e for _, e in cases]
    good = rows.where("i = 0").drop("i")
    assert [r["coordinate"] for r in nested.record_facts(good).collect()] == ["WHAT|title|T"]
    assert nested.record_hub(good).first()["label"] == "T"
    assert '"srf_uri":"u"' in nested.to_json(good).first()["json"]
    with pytest.raises(nested.RecordError):
        nested.validated(rows, nested.record_failure(), strict=True)


def test_cards(spark):
    import json

    card = {"id": "1", "name": "N", "type_line": "Creature — Elf Druid", "colors": ["G", "W"], "color_identity": ["W", "G"], "released_at": "2018-10-05", "cmc": 2.0, "set": "grn", "legalities": {"modern": "legal", "vintage": "not_legal"}}
    df = spark.createDataFrame([(json.dumps(card),)], "v string").select(F.from_json("v", translators.CARD_SCHEMA).alias("r")).select("r.*")
    got = {r["coordinate"] for r in translators.cards(df, "c1", "Guilds").collect()}
    assert {"WHAT|guild|Selesnya", "WHAT|subtype|Elf", "WHAT|color|Green", "WHEN|released_at|2018", "HOW|cmc|2", "WHERE|set_code|GRN", "WHY|format_legal|modern"} <= got
    assert "WHY|format_legal|vintage" not in got


def test_build(spark, tmp_path):
    films = spark.createDataFrame([("\n101 Dalmatians", "January 25, 1961", "Pongo", None, None), (None, None, "x", None, None)], "movie_title string, release_date string, hero string, villian string, song string")
    directors = spark.createDataFrame([("One Hundred and One Dalmatians", "full credits"), ("101 Dalmatians", "Reitherman")], "name string, director string")
    target = f"parquet://{tmp_path}/store"
    out = build.compile_job(build.BuildSpec([("disney_characters", films)], target, "d1"), spark)
    assert (out.success, out.entity_count, out.fact_count, len(out.warnings)) == (True, 1, 3, 1), out
    out = build.compile_job(build.BuildSpec([("disney_director", directors)], target, "d1"), spark)
    assert (out.success, out.entity_count, out.fact_count) == (True, 1, 5), out
    assert build.compile_job(build.BuildSpec([("nobody", films)], target, "d1"), spark).error
    assert build.compile_job(build.BuildSpec([("disney_characters", films)], f"package://{tmp_path}/package", "d1"), spark).success
    assert (tmp_path / "package" / "verification_report.json").exists()


def test_plugins_and_pages(spark):
    class One(Fetcher):
        lens_id = "f1"

        def fetch(self):
            return [1, 2, 0]

        def translate(self, item):
            return [(f"e{item}", "WHO", "K", str(4 // item)), (f"e{item}", "what", "n", None)]

    with pytest.raises(ZeroDivisionError):
        One().run(spark)
    assert One().run(spark, skip_errors=True).count() == 2

    class Bad(Translator):
        def search(self, text, mode):
            return [Candidate("1", "t")]

        def translate(self, candidate):
            return {}

    with pytest.raises(PluginError):
        Bad().validate()
    assert InputMode.QUERY.value == "query"
    pages = {"a": {"data": [1], "has_more": True, "next_page": "b"}, "b": {"data": [2], "has_more": False}}
    assert list(paginated(pages.get, "a")) == [1, 2]


LENS = {"lens_id": "s1", "nucleus": {"type": "single", "field": "event_id"}, "coordinate_map": {"event_type": {"dimension": "what", "semantic_key": "type"}, "user_id": {"dimension": "who", "semantic_key": "user"}}}


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    (tmp_path / "in").mkdir()
    events.write.parquet(str(tmp_path / "in" / "x"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in" / "x"))
    append(compile_stream(stream, LENS, "ts"), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == compile_frame(events, LENS, dedup=True).count()


def test_shell(spark, capsys):
    import sys

    facts = compile_frame(spark.read.parquet("/root/testdata/sf0.001/events.parquet"), LENS)
    shell = Shell(Substrate(facts, "s1"), out=sys.stdout)
    for line in ('WHO.user = "1"', "WHAT|type|*", "\\schema", "\\schema WHO", '\\explain WHO.user = "1"', "\\pivot", "\\limit 3", "WHO.user ="):
        assert not shell.onecmd(line)
    assert shell.onecmd("\\q")
    assert "error: Expected a value" in capsys.readouterr().out
