import json

import pytest
from pyspark.sql import functions as F

from sagalog.functions.rules import parse_schema, violation
from sagalog.model import DuplicateType, InvalidArgument, NotFound, SchemaNotStrict
from sagalog.plans.registry import TASK_SCHEMA, ResourceRegistry, TypeRegistry, resource_matches, seed_examples


def schema(properties, required=(), strict=True):
    return parse_schema(json.dumps({"properties": properties, "required": list(required)} | ({"additionalProperties": False} if strict else {})))


CRATE = schema({"label": {"type": "string"}, "sealed": {"type": "boolean"}}, ["label"])
LOOSE = schema({"label": {"type": "string"}}, strict=False)
COUNT = schema({"pallets": {"type": "integer", "minimum": 2}})
GAUGE = schema({"fill": {"type": "number", "minimum": 0.5, "maximum": 48}, "floor": {"type": "integer", "minimum": -3, "maximum": 40}})
COLOUR = schema({"paint": {"type": "string", "enum": ["teal", "amber", "plum"]}}, ["paint"])
SHAPES = schema({"o": {"type": "object"}, "a": {"type": "array"}, "b": {"type": "boolean"}, "n": {"type": "number"}, "u": {}})
CASES = [
    (CRATE, '{"label":"L7"}', None),
    (CRATE, '{"label":"L7","sealed":false}', None),
    (CRATE, '{"sealed":"no","label":"L8"}', "expected boolean, got string"),
    (CRATE, '{"label":"L9","weight":12}', 'unknown field "weight" in input for tool. Valid fields: [label, sealed]'),
    (CRATE, "[7, 8]", "must be a JSON object"),
    (CRATE, "{label}", "must be a JSON object"),
    (CRATE, "null", 'required field "label" missing in input for tool'),
    (CRATE, "", 'required field "label" missing in input for tool'),
    (CRATE, None, 'required field "label" missing in input for tool'),
    (CRATE, '{"label":null}', None),
    (CRATE, '{"label":44}', "expected string, got number"),
    (CRATE, '{"label":{"k":[]}}', "expected string, got object"),
    (CRATE, '{"label":"a","label":"b"}', "must be a JSON object"),
    (LOOSE, '{"anything":[0]}', None),
    (COUNT, '{"pallets":0.25}', "expected integer, got 0.25 (number)"),
    (COUNT, '{"pallets":1}', "value 1 is below minimum 2"),
    (COUNT, '{"pallets":2}', None),
    (COUNT, '{"pallets":null}', "expected integer, got  (null)"),
    (COUNT, '{"pallets":"17"}', None),
    (COUNT, '{"pallets":"many"}', "expected integer, got string"),
    (COUNT, '{"pallets":8.0}', "expected integer, got"),
    (COUNT, '{"pallets":7e1}', "expected integer, got"),
    (COUNT, '{"pallets":12345678901234567890123}', "expected integer, got"),
    (GAUGE, '{"floor":40}', None),
    (GAUGE, '{"floor":41}', "value 41 is above maximum 40"),
    (GAUGE, '{"fill":48}', None),
    (GAUGE, '{"fill":48.25}', "value 48.25 is above maximum 48"),
    (GAUGE, '{"fill":0.25}', "value 0.25 is below minimum 0.5"),
    (GAUGE, '{"fill":7e999}', "outside the representable numeric range"),
    (GAUGE, '{"fill":null}', "outside the representable numeric range"),
    (COLOUR, '{"paint":"plum"}', None),
    (COLOUR, '{"paint":"grey"}', 'value "grey" not in enum [amber, plum, teal]'),
    (COLOUR, '{"paint":null}', 'value "" not in enum'),
    (SHAPES, '{"o":{},"a":[],"b":false,"n":1.5,"u":[1]}', None),
    (SHAPES, '{"o":null,"a":null,"b":null,"n":null}', None),
    (SHAPES, '{"o":[]}', "expected object, got array"),
    (SHAPES, '{"a":{}}', "expected array, got object"),
    (SHAPES, '{"n":true}', "expected number, got boolean"),
    (SHAPES, '{"a":1,"o":1}', 'field "a"'),
]


def test_violations(spark):
    for own in {id(s): s for s, _, _ in CASES}.values():
        rows = [(c, w) for s, c, w in CASES if s is own]
        got = spark.createDataFrame(rows, "content string, want string").select("content", "want", violation(F.col("content"), own, "tool")["message"].alias("m")).collect()
        for r in got:
            assert (r["m"] is None) if r["want"] is None else (r["m"] is not None and r["want"] in r["m"]), r


def test_unreadable_definitions_are_unconstrained(spark):
    odd = schema({"a": {"type": ["string", "null"]}, "b": {"type": "integer", "minimum": "x"}, "c": {"type": "string", "enum": ["x", 1]}})
    got = spark.range(1).select(violation(F.lit('{"a":1,"b":"q","c":"other"}'), odd, "t").alias("v")).first()["v"]
    assert got is None


def test_registry(tmp_path):
    types = TypeRegistry()
    assert types.names() == ["task"] and types.lookup("task").schema.required == ("status", "title")
    with pytest.raises(SchemaNotStrict):
        types.register("loose", '{"properties":{}}')
    with pytest.raises(DuplicateType):
        types.register("task", TASK_SCHEMA)
    assert seed_examples(tmp_path) == ["task.completed", "decision.recorded", "note.user"] and seed_examples(tmp_path) == []
    assert types.load_directory(tmp_path) == ["decision.recorded", "note.user", "task.completed"]


def test_resource_matches():
    fits = [("shelf://north", "shelf://north"), ("shelf://north", "shelf://north?row=3"), ("shelf://north", "shelf://north#top"), ("shelf://all{?row}", "shelf://all"), ("shelf://all{?row}", "shelf://all?row=9")]
    fails = [("shelf://north", "shelf://northern"), ("shelf://north", "shelf://north/3"), ("shelf://all{?row}", "shelf://all#top"), ("shelf://all{?row}", "shelf://al")]
    assert all(resource_matches(*x) for x in fits) and not any(resource_matches(*x) for x in fails)


def test_resources():
    found = ResourceRegistry()
    found.register("shelf://south{?row}", "a view", lambda uri: {"asked": uri})
    found.register("depot", "another", lambda uri: [])
    assert [(r["uri"], r["name"]) for r in found.listing()] == [("depot", "depot"), ("shelf://south{?row}", "south")]
    assert found.find("shelf://south?row=2").read("shelf://south?row=2") == {"asked": "shelf://south?row=2"}
    with pytest.raises(NotFound):
        found.find("shelf://west")
    with pytest.raises(InvalidArgument):
        found.find("")


def test_task_hook(spark):
    hook = TypeRegistry().lookup("task").on_ingest
    rows = [('{"title":"t","status":"done"}', True), ('{"status":"lost"}', False), ("{}", False), ("no json", False)]
    for r in spark.createDataFrame(rows, "c string, fine boolean").select("fine", hook(F.col("c")).alias("e")).collect():
        assert (r["e"] is None) == r["fine"]
