import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstore.functions import jsontext as J
from quillstore.functions.urltext import percent_decoded


@pytest.mark.parametrize(
    ("text", "canonical"),
    [
        ('{"n": 12.50, "m":1E+2 ,"z":-0,"a":1e3}', '{"n":12.50,"m":1E+2,"z":-0,"a":1e3}'),
        ('{"z":1,"b":2}', '{"z":1,"b":2}'),
        ('"\\b\\f\\n\\u0001\\u007f\\/"', '"\\u0008\\u000c\\n\\u0001\x7f/"'),
        ('"\\ud83d\\ude00é\\u2028"', '"😀é "'),
        (' [ null , true,false , {} , [] ]\r\n', "[null,true,false,{},[]]"),
        ("123456789012345678901234567890.0", "123456789012345678901234567890.0"),
    ],
)
def test_canonical_text(text, canonical):
    assert J.write(J.parse(text)) == canonical
    assert J.write(J.parse(canonical)) == canonical


@pytest.mark.parametrize(
    "text",
    ["", " ", "01", "1.", ".5", "-", "1e", "+1", "NaN", "Infinity", "-Infinity", "nul", "{'a':1}", '{"a":1,}', "[1,]", "[1 2]", '{"a" 1}', '{"a":1,"\\u0061":2}', '{"a":1} 2', '"\\ud800"', '"\\udc00x"', '"\\ud800\\u0041"', '{"\\ud800":1}', '"a\nb"', '"\\x"', '"\\u12"', '"open', "﻿1", " 1", "1\x0c", "{", "[", '{"a"'],
)
def test_refused(text):
    with pytest.raises(J.JsonTextError):
        J.parse(text)


def test_depth():
    J.parse("[" * 65 + "]" * 65)
    J.parse("[" * 64 + "1" + "]" * 64)
    for text in ("[" * 66 + "]" * 66, "[" * 65 + "1" + "]" * 65, "[" * 100_000, '{"a":' * 100_000):
        with pytest.raises(J.JsonTextError):
            J.parse(text)


def test_paths_and_matching():
    v = J.parse('{"a":{"b":{"c":"x"},"":1},"":2,"n":12.5,"s":"12.5","nil":null,"t":["x", "y"],"o":{"a":1, "b":2},"p.q":3,"bool":true,"e":""}')
    yes = [("a.b.c", "x"), ("a.", "1"), ("", "2"), ("n", "12.5"), ("s", "12.5"), ("nil", "null"), ("t", '["x","y"]'), ("o", '{"a":1,"b":2}'), ("bool", "true"), ("e", "")]
    no = [("a.b.d", "x"), ("n", "12.50"), ("n", "1.25e1"), ("gone", "null"), ("gone", ""), ("t.0", "x"), ("o", '{"b":2,"a":1}'), ("p.q", "3"), ("s", '"12.5"'), ("a.b.c.d", "x"), ("A.b.c", "x")]
    fields = J.flatten(v)
    for path, text in yes:
        assert J.matches(v, path, text) and fields[path] == text
    for path, text in no:
        assert not J.matches(v, path, text) and fields.get(path) != text
    assert J.flatten(J.parse('{"long":"' + "x" * 20_000 + '","k":1}')) == {"k": "1"}


_json = st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=12)


@settings(deadline=None, max_examples=150)
@given(_json)
def test_round_trip(value):
    import json

    text = json.dumps(value, ensure_ascii=False)
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    canonical = J.write(J.parse(text))
    assert json.loads(canonical) == value and J.write(J.parse(canonical)) == canonical


@pytest.mark.parametrize(("text", "query", "want"), [("a%20b", False, "a b"), ("a+b", False, "a+b"), ("a+b", True, "a b"), ("%2B", True, "+"), ("%zz", False, None), ("%4", False, None), ("%", True, None), ("%ff", False, None), ("%C3%A9é", False, "éé"), ("", True, "")])
def test_percent_decoding(text, query, want):
    assert percent_decoded(text, query) == want
