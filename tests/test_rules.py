"""Record rules: each keyword with passing and failing records."""

import json

import pytest

from tabulark.plans import rules

CASES = [
    ({"type": "string"}, ["a"], [1, None, [], {}]),
    ({"type": ["integer", "null"]}, [1, 2.0, None, -(10**17)], [1.5, "1", True]),
    ({"type": "number"}, [1, 1.5, 1e300], ["1", False]),
    ({"enum": ["a", 1, None, {"x": [1]}]}, ["a", 1, 1.0, None, {"x": [1]}], ["b", "1", 2, True, {"x": [2]}]),
    ({"const": True}, [True], [False, 1, "true"]),
    ({"pattern": "^a+$"}, ["aa", 5, None], ["ab", ""]),
    ({"format": "date"}, ["2024-02-29", 3], ["2024-13-01", "29.2.2024"]),
    ({"format": "email"}, ["a@b.org"], ["a b@c", "ab"]),
    ({"minLength": 2, "maxLength": 3}, ["äö", "abc", "𝄞𝄞𝄞", 1], ["a", "abcd"]),
    ({"minimum": 1, "maximum": 3}, [1, 3, "0", 2.5], [0, 3.01]),
    ({"exclusiveMinimum": 1, "exclusiveMaximum": 3}, [2, 1.01], [1, 3]),
    ({"minItems": 1, "maxItems": 2, "uniqueItems": True}, [[1], [1, 2], "x"], [[], [1, 2, 3], [{"a": 1}, {"a": 1}]]),
    ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, ["a", 6], [4]),
    ({"oneOf": [{"minimum": 5}, {"maximum": 7}]}, [4, 8], [6]),
    ({"allOf": [{"minimum": 5}, {"maximum": 7}]}, [6], [4, 8]),
    ({"not": {"type": "string"}}, [1, None], ["a"]),
    ({"additionalProperties": {"type": "string"}, "properties": {"n": {}}}, [{"n": 1, "o": "a"}, {}, 5], [{"o": 1}]),
    ({"$ref": "#/definitions/name", "definitions": {"name": {"minLength": 1}}}, ["a"], [""]),
    ({"properties": {"it's a": {"type": "string"}}}, [{"it's a": "x"}, {}], [{"it's a": 1}]),
]


def test_each_rule(spark):
    for schema, good, bad in CASES:
        rows = [(json.dumps(v), v in good and any(v is g or (v == g and type(v) is type(g)) for g in good)) for v in [*good, *bad]]
        got = rules.checked(spark.createDataFrame(rows, "text string, expected boolean"), "text", schema).collect()
        assert [(r.text, r.valid) for r in got] == [(r.text, r.expected) for r in got], schema


def test_paths_of_a_nested_record(spark):
    schema = {
        "title": "A dataset",
        "type": "object",
        "required": ["title", "contact"],
        "additionalProperties": False,
        "properties": {
            "title": {"type": "string", "minLength": 1},
            "contact": {"type": "object", "required": ["email"], "properties": {"email": {"format": "email"}}},
            "files": {"type": "array", "items": {"type": "object", "required": ["url"], "properties": {"url": {"format": "uri"}, "tags": {"items": {"type": "string"}}}}},
        },
    }
    texts = [
        '{"title": "a", "contact": {"email": "a@b"}, "files": [{"url": "http://x"}]}',
        '{"title": "", "contact": {}, "x": 1, "files": [{"url": "http://x", "tags": ["a", 1]}, {"url": "no"}, {}, 7]}',
        "[]",
        '{"title": ',
        None,
        '{"title": "a", "title": "b", "contact": {"email": "a@b"}}',
    ]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    done = rules.checked(frame, "text", schema)
    got = {r.id: [(f.path, f.rule) for f in r.failures] for r in done.collect()}
    assert got[0] == [] and got[2] == [("$", "type")]
    assert got[3] == got[4] == got[5] == [("$", "json")]
    assert sorted(got[1]) == sorted(
        [("$.title", "minLength"), ("$.contact.email", "required"), ("$.x", "additionalProperties"), ("$.files[0].tags[1]", "type"),
         ("$.files[1].url", "format"), ("$.files[2].url", "required"), ("$.files[3]", "type")]
    )
    counts = {(r.path, r.rule): r.records for r in rules.failure_counts(done).collect()}
    assert counts[("$", "json")] == 3 and counts[("$.files[].url", "required")] == 1 and len(counts) == 9
    assert rules.checked(frame.limit(0), "text", schema).collect() == []


def test_unknown_rules_are_refused(spark):
    frame = spark.createDataFrame([("1",)], "text string")
    loop = {"$ref": "#/definitions/a", "definitions": {"a": {"items": {"$ref": "#/definitions/a"}}}}
    for schema in ({"patternProperties": {}}, {"type": "text"}, {"format": "color"}, loop):
        with pytest.raises(ValueError):
            rules.checked(frame, "text", schema)
