"""Contracts on hand-made documents, one for each kind of violation."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from matchlake.functions.contracts import Contract, parsed

SCHEMA = {
    "title": "record", "type": "object", "additionalProperties": False, "required": ["version", "id", "t"],
    "$defs": {"box": {"type": "object", "required": ["x"], "properties": {"x": {"type": "number", "minimum": 0, "maximum": 1}, "tag": {"type": ["string", "null"], "maxLength": 3}}}},
    "properties": {
        "version": {"type": "integer", "const": 3}, "id": {"type": "string", "format": "uuid"}, "t": {"type": "number", "exclusiveMinimum": 0, "exclusiveMaximum": 100}, "team": {"type": ["integer", "null"]},
        "kind": {"type": "string", "enum": ["start", "shot", "end"]}, "name": {"type": "string", "minLength": 2, "pattern": "^[a-z]+$"}, "flag": {"type": "boolean"},
        "boxes": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"$ref": "#/$defs/box"}}, "ids": {"type": "array", "uniqueItems": True, "items": {"type": "integer"}},
        "odd": {"oneOf": [{"type": "integer"}, {"type": "number", "maximum": 5}]}, "any": {"anyOf": [{"type": "string"}, {"type": "boolean"}]}, "no": {"not": {"type": "null"}},
    },
    "allOf": [{"if": {"properties": {"kind": {"const": "start"}}, "required": ["kind"]}, "then": {"properties": {"team": {"type": "null"}}}, "else": {"properties": {"flag": {"const": True}}}}],
}
GOOD = {"version": 3, "id": "123e4567-e89b-12d3-a456-426614174000", "t": 1.5}


def told(spark, docs, schema=SCHEMA):
    texts = [d if isinstance(d, str) else json.dumps(d) for d in docs]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, value string")
    return [r.v for r in rows.select("i", Contract(schema).violation(F.try_parse_json("value")).alias("v")).orderBy("i").collect()]


CASES = [
    ({}, None), ({"team": None}, None), ({"team": 7, "kind": "shot", "boxes": [{"x": 0}, {"x": 1, "tag": None}], "ids": [1, 2], "name": "ab"}, None), ({"t": 7}, None), ({"version": 3.0}, None),
    ({"version": "3"}, "$.version: type"), ({"version": 4}, "$.version: const"), ({"id": "x"}, "$.id: format"), ({"t": 0}, "$.t: exclusiveMinimum"), ({"t": 100}, "$.t: exclusiveMaximum"),
    ({"t": "1"}, "$.t: type"), ({"team": 1.5}, "$.team: type"), ({"team": "x"}, "$.team: type"), ({"kind": "foul"}, "$.kind: enum"), ({"name": "a"}, "$.name: minLength"), ({"name": "aB"}, "$.name: pattern"),
    ({"flag": 1}, "$.flag: type"), ({"flag": False}, "$.flag: const"), ({"boxes": []}, "$.boxes: minItems"), ({"boxes": [{"x": 0}] * 4}, "$.boxes: maxItems"), ({"boxes": {}}, "$.boxes: type"),
    ({"boxes": [{"x": 0}, {"x": 2}]}, "$.boxes[1].x: maximum"), ({"boxes": [{"x": -1}]}, "$.boxes[0].x: minimum"), ({"boxes": [{"x": 0}, {}]}, "$.boxes[1].x: required"), ({"boxes": [{"x": 0, "tag": "long"}]}, "$.boxes[0].tag: maxLength"),
    ({"boxes": [3]}, "$.boxes[0]: type"), ({"ids": [1, 2, 1]}, "$.ids: uniqueItems"), ({"ids": [1, None]}, "$.ids[1]: type"), ({"odd": 3}, "$.odd: oneOf"), ({"odd": 9}, None), ({"odd": 4.5}, None), ({"odd": "x"}, "$.odd: oneOf"),
    ({"any": 3}, "$.any: anyOf"), ({"any": True}, None), ({"no": None}, "$.no: not"), ({"extra": 1}, "$.extra: additionalProperties"), ({"kind": "start", "team": 5}, "$.team: type"), ({"kind": "start", "team": None, "flag": False}, None),
]


def test_each_kind_of_violation(spark):
    got = told(spark, [GOOD | change for change, _ in CASES])
    assert [(c, g) for (c, w), g in zip(CASES, got) if g != w] == []
    without = [{k: v for k, v in GOOD.items() if k != name} for name in GOOD]
    assert told(spark, without) == [f"$.{name}: required" for name in GOOD]
    assert told(spark, ["not json", "[1]", "null", "3"]) == ["$: json", "$: type", "$: type", "$: type"]


def test_contracts_that_cannot_be_compiled(spark):
    value = F.try_parse_json(F.lit("{}"))
    for schema in ({"dependentRequired": {}}, {"$ref": "other.json"}, {"properties": {"a": {"propertyNames": {}}}}):
        with pytest.raises(ValueError):
            Contract(schema).violation(value)
    with pytest.raises(ValueError):
        Contract({"$defs": {"a": {"$ref": "#/$defs/a"}}, "$ref": "#/$defs/a"}).violation(value)


def test_records_are_typed_and_violations_counted(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(SCHEMA))
    contract = Contract.read(spark, f"file://{tmp_path}/c.json")
    assert contract.sql_type(SCHEMA["properties"]["boxes"]) == "array<struct<`x`:double,`tag`:string>>"
    docs = [GOOD | {"boxes": [{"x": 0.5, "tag": "a"}], "team": 7}, GOOD | {"boxes": [{"x": 2}]}, GOOD | {"boxes": [{"x": 0}, {"x": 3}]}, GOOD | {"version": 2}, GOOD | {"kind": "?"}]
    lines = spark.createDataFrame([(json.dumps(d),) for d in docs] + [("",), ("{",)], "value string")
    records, bad = parsed(lines, contract)
    (one,) = records.collect()
    assert one.team == 7 and one.boxes[0].x == 0.5 and one.t == 1.5 and one.kind is None and records.schema["version"].dataType.simpleString() == "bigint"
    assert {(r.path, r.keyword): r.lines for r in bad.collect()} == {("$.boxes[].x", "maximum"): 2, ("$.version", "const"): 1, ("$.kind", "enum"): 1, ("$", "json"): 1}
    lenient, same = parsed(lines, contract, lenient=["version"])
    assert sorted(r.version for r in lenient.collect()) == [2, 3] and same.count() == 4


def test_no_python_runs_per_row(spark):
    plan = spark.range(3).select(Contract(SCHEMA).violation(F.try_parse_json(F.lit("{}"))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
