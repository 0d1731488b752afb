import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mentionloom.operators.packed import split_packed, split_values

CASES = [
    ("HP:1;HP:2", ["HP:1", "HP:2"]),
    (" HP:1 ; ;-1;", ["HP:1", "-1"]),
    ('["HP:1", "HP:2"]', ["HP:1", "HP:2"]),
    ("HP:1 HP:2  HP:3", ["HP:1", "HP:2", "HP:3"]),
    ("HP:1，HP:2；HP:3、HP:4", ["HP:1", "HP:2", "HP:3", "HP:4"]),
    ("HP:1\tHP:2\nHP:3", ["HP:1", "HP:2", "HP:3"]),
    ("HP:1 (late; partial) | HP:2", ["HP:1 (late; partial)", "HP:2"]),
    ('"so-called ""frog"" posture";HP:3', ['so-called "frog" posture', "HP:3"]),
    ('HP:1,"tall, thin build"', ["HP:1", "tall, thin build"]),
    ("'HP:1';'HP:2'", ["HP:1", "HP:2"]),
    ("unmapped finding", ["unmapped finding"]),
    ("crow's feet, HP:1", ["crow's feet", "HP:1"]),
    ('5" cut; HP:1', ['5" cut', "HP:1"]),
    ("open (bracket; HP:1", ["open (bracket", "HP:1"]),
    ("HP:1 / HP:2 + HP:3", ["HP:1", "HP:2", "HP:3"]),
    ("\xa0HP:1　; HP:2", ["HP:1", "HP:2"]),
    (";", []),
    ("", []),
    (None, []),
]


@pytest.mark.parametrize(("text", "values"), CASES)
def test_one_field(text, values):
    assert split_packed(pa.array([text], pa.string())).to_pylist() == [values]


def test_rows_do_not_touch_each_other():
    column = pa.array([t for t, _ in CASES] * 3, pa.string())
    assert split_packed(column).to_pylist() == [v for _, v in CASES] * 3
    assert split_packed(column.slice(4, 5)).to_pylist() == [v for _, v in CASES[4:9]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["HP:12", "-1", "see remark", "a b", "ä語"]), min_size=1, max_size=4), max_size=6), st.sampled_from([";", " | ", "，", "\t"]), st.booleans())
def test_round_trip(rows, delimiter, quoted):
    text = [delimiter.join(f'"{v}"' if quoted else v for v in row) for row in rows]
    assert split_packed(pa.array(text, pa.string())).to_pylist() == rows


def test_table(spark):
    rows = [(1, "HP:1;HP:2", "x"), (1, "HP:1;HP:2", "y"), (2, "HP:1", None), (3, None, None), (4, "a;" + "b" * 200_000, None), (None, "HP:3;HP:3", None)]
    df = spark.createDataFrame(rows, "entity_id bigint, identifier string, val string")
    got = sorted(((r["entity_id"] or 0, r["pos"], r["val"][:9]) for r in split_values(df).collect()))
    assert got == [(0, 0, "HP:3"), (0, 1, "HP:3"), (1, 0, "HP:1"), (1, 1, "HP:2"), (4, 0, "a"), (4, 1, "b" * 9)]
    assert split_values(df.limit(0)).count() == 0
