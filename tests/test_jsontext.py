import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mentionloom.functions import jsontext

VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4), max_leaves=20)


@settings(max_examples=200, deadline=None)
@given(VALUES, st.booleans(), st.sampled_from([None, 1]))
def test_round_trip(value, ascii_, indent):
    text = json.dumps(value, ensure_ascii=ascii_, indent=indent)
    assert jsontext.walk(text) == (value, len(text), "whole") and jsontext.read(jsontext.write(value)) == value


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sampled_from("abcd"), st.lists(st.integers(0, 99) | st.text(alphabet='x"\\{[', max_size=4), max_size=4), min_size=1), st.floats(0, 1))
def test_what_is_cut_off_keeps_what_is_complete(value, share):
    text = json.dumps(value)
    cut = text[: int(len(text) * share)]
    try:
        kept = jsontext.recover(f"So be it: {cut}" if not cut.startswith(" ") else cut)
    except ValueError:
        return
    assert isinstance(kept, dict) and all(k in value and (v == value[k][: len(v)] or v[:-1] == value[k][: len(v) - 1]) for k, v in kept.items())


@pytest.mark.parametrize("text", ['{"a":1,}', "[1,]", "[,1]", '{"a"}', "{,}", '{"a":1 "b":2}', "[1 2]", "NaN", '{"a":NaN}', "[-Infinity]", "", '{"a":1}x', "[}", '{"a":1}}', "[1", '["a\tb"]'])
def test_what_is_no_json(text):
    with pytest.raises(ValueError):
        jsontext.read(text)
    value, at, state = jsontext.walk(text)
    assert state != "whole" or text[at:].strip()


def test_depth():
    deep = "[" * 200_000 + "]" * 200_000
    assert jsontext.write(jsontext.read(deep)) == deep
    with pytest.raises(ValueError):
        jsontext.read(deep[:-1])


@pytest.mark.parametrize(("reply", "value"), [('see [ref] for {"a": 1}', {"a": 1}), ('{"a": [1, x], "b": 2}', {"a": [1]}), ('{"a": {"b": [1, {"c": 2}, {"d"', {"a": {"b": [1, {"c": 2}]}}), ("7", 7), ('```\n[{"x": 1}, {"x": 2', [{"x": 1}])])
def test_replies(reply, value):
    assert jsontext.recover(reply) == value
