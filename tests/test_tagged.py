import json

from mentionloom.operators import tagged
from mentionloom.session import shared_path

ARTICLE = {
    "pmc_id": "PMC1",
    "full_text": [{"section_type": "TITLE", "offset": 0, "text": "a"}, None, {"offset": 2, "text": "b"}],
    "patient": [{"patient_id": "P1", "mention": [{"text": "m0"}, None, {"offset": 3}]}, None, {"patient_id": "P2"}],
    "entities": [{"identifier": "HP:1", "text": "x"}],
    "association": [{"patient_id": "P1", "phenotype": ["HP:1", None, "HP:2"]}],
}
ROWS = {
    ("passage", -1, 0, "TITLE"), ("passage", -1, 2, ""), ("patient", -1, 0, "P1"), ("patient", -1, 2, "P2"), ("mention", 0, 0, "m0"), ("mention", 0, 2, ""),
    ("entity", -1, 0, "HP:1"), ("association", -1, 0, "P1"), ("phenotype", 0, 0, "HP:1"), ("phenotype", 0, 2, "HP:2"),
}


def flat(spark, lines):
    df = spark.createDataFrame([(i, p, "extra", None) for i, p in enumerate(lines)], "line_no bigint, payload string, child string, val string")
    path = shared_path(spark, "t")
    tagged.write_tables(tagged.flatten_records(df), path)
    out = {}
    for r in tagged.child_values(spark, path).collect():
        out.setdefault(r["line_no"], set()).add((r["child"], r["parent_pos"], r["pos"], r["val"]))
    return out


def test_shapes_of_one_article_give_the_same_rows(spark):
    plain = json.dumps(ARTICLE)
    encoded = {k: json.dumps(v) if isinstance(v, list) else v for k, v in ARTICLE.items()}
    lines = [plain, "﻿ " + plain, json.dumps({"schema": 2, "document": ARTICLE}), json.dumps(encoded), json.dumps({"a": {"b": json.dumps(encoded)}})]
    got = flat(spark, lines)
    assert all(got[i] == ROWS for i in range(len(lines)))


def test_lines_that_are_no_object_give_nothing(spark):
    whole = json.dumps(ARTICLE)
    assert flat(spark, [None, "", "  ", "null", "[]", '"text"', "7", whole[:-1], whole + "x", whole + whole, "{" * 5000, "nonsense", '{"entities": [{"identifier": NaN}]}', '{"entities": [Infinity]}', "[" * 100_000 + "]" * 100_000]) == {}


def test_object_or_value_in_place_of_an_array(spark):
    got = flat(spark, [json.dumps({"full_text": {"section_type": "A"}, "association": {"patient_id": "P", "phenotype": "HP:1"}, "patient": {"patient_id": 7, "mention": {"text": "t"}}, "entities": None})])
    assert got[0] == {("passage", -1, 0, "A"), ("association", -1, 0, "P"), ("phenotype", 0, 0, "HP:1"), ("patient", -1, 0, "7"), ("mention", 0, 0, "t")}


def test_lone_surrogates_long_texts_and_empty_table(spark):
    got = flat(spark, ['{"entities":[{"identifier":"\\ud800x"}]}', json.dumps({"entities": [{"identifier": "y" * 300_000}]})])
    assert {v[3] for v in got[0]} == {"�x"} and {len(v[3]) for v in got[1]} == {300_000}
    assert flat(spark, []) == {}


def test_tables_by_tag(spark, tmp_path):
    df = spark.createDataFrame([(5, json.dumps(ARTICLE))], "line_no bigint, payload string")
    tagged.write_tables(tagged.flatten_records(df), str(tmp_path / "t"))
    mentions = tagged.read_table(spark, str(tmp_path / "t"), "mention").orderBy("pos").collect()
    assert [(m["parent_key"], m["pos"], m["text"], m["offset"]) for m in mentions] == [("5/patient:0", 0, "m0", None), ("5/patient:0", 2, None, 3)]
    values = tagged.read_table(spark, str(tmp_path / "t"), "phenotype")
    assert {(r["pk"], r["value"]) for r in values.collect()} == {("5/association:0/phenotype:0", "HP:1"), ("5/association:0/phenotype:2", "HP:2")}


def test_any_depth(spark):
    record, deep = json.dumps(ARTICLE), "[" * 100_000 + "]" * 100_000
    for _ in range(50):
        record = json.dumps({"w": json.loads(record)})
    got = flat(spark, [record, '{"w":' * 50_000 + json.dumps(ARTICLE) + "}" * 50_000, json.dumps({"entities": [{"identifier": "a"}], "more": 1})[:-2] + deep + "}", '{"entities": [{"identifier": ' + deep + "}]}"])
    assert got[0] == got[1] == ROWS and got[2] == {("entity", -1, 0, "a")} and got[3] == {("entity", -1, 0, deep)}


def test_fields_of_another_type(spark, tmp_path):
    df = spark.createDataFrame([(1, '{"entities": [{"identifier": 7, "offset": "12", "length": "x", "note": true, "text": {"a": 1}}, "HP:1"]}')], "line_no bigint, payload string")
    tagged.write_tables(tagged.flatten_records(df), str(tmp_path / "t"))
    rows = tagged.read_table(spark, str(tmp_path / "t"), "entity").orderBy("pos").collect()
    assert [(r["identifier"], r["offset"], r["length"], r["note"], r["text"]) for r in rows] == [("7", 12, None, "true", '{"a": 1}'), ("HP:1", None, None, None, None)]
