"""Stripping and flattening over any schema, against plain walks over the same values."""

import json

import pytest
from pyspark.sql import functions as F

from treeloom.definition import DefinitionError
from treeloom.plans.shapes import flatten_any, strip_any
from treeloom.sinks.package import PackageError, package_records

RECORDS = [
    {"id": 1, "a.b": {"Secret": "x", "n": [1, None, 3], "deep": [[{"k": "p", "SECRET": 1}, None], None, [{"k": None}]]}, "m": {"secret": {"v": 1}, "z": {"v": 2}}},
    {"id": 2, "a.b": None, "m": {}},
    {"id": 3, "a.b": {"Secret": None, "n": [], "deep": None}, "m": None},
]
SCHEMA = "id int, `a.b` struct<Secret:string,n:array<int>,deep:array<array<struct<k:string,SECRET:int>>>>, m map<string,struct<v:int>>, secret string"


def without(value, denied):
    if isinstance(value, dict):
        return {k: without(v, denied) for k, v in value.items() if k.lower() not in denied}
    return [without(v, denied) for v in value] if isinstance(value, list) else value


@pytest.fixture
def nested(spark):
    return spark.createDataFrame([json.dumps(r) for r in RECORDS], "string").select(F.from_json("value", SCHEMA).alias("r")).select("r.*")


def test_strips_structs_arrays_and_maps(nested):
    stripped = strip_any(nested, ["secret"])
    assert stripped.columns == ["id", "a.b", "m"] and "ecret" not in stripped.schema.simpleString().lower().replace("map<string", "")
    got = [json.loads(r[0]) for r in stripped.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in stripped.columns]), {"ignoreNullFields": "false"})).collect()]
    full = [{"id": r["id"], "a.b": r["a.b"], "m": r["m"]} for r in RECORDS]
    assert got == [without(r, {"secret"}) for r in full]
    assert strip_any(nested.select("id"), ["secret"]).columns == ["id"]


def test_strips_variants_and_keeps_digits(spark):
    texts = ['{"A":1.10,"secret":1,"b":[{"Secret":{"x":1},"c":12345678901234567890123}],"é":"\\"q"}', "[1,null,true]", '"secret"', "7", None]
    found = strip_any(spark.createDataFrame([(t,) for t in texts], "t string").select(F.try_parse_json("t").alias("v")), ["SECRET"])
    got = [r[0] for r in found.select(F.to_json("v")).collect()]
    assert [json.loads(t) if t else None for t in got] == [{"A": 1.1, "b": [{"c": 12345678901234567890123}], "é": '"q'}, [1, None, True], "secret", 7, None]


def collect(value, path):
    if value is None:
        return []
    if isinstance(value, list):
        return [v for item in value for v in collect(item, path)]
    if not path:
        return [] if isinstance(value, dict) else [value if isinstance(value, str) else json.dumps(value)]
    return collect(value.get(path[0]), path[1:]) if isinstance(value, dict) else []


def test_flattens_by_paths(nested):
    flat = flatten_any(nested, ["id"])
    paths = [("a.b", "Secret"), ("a.b", "n"), ("a.b", "deep", "k"), ("a.b", "deep", "SECRET"), ("m", "secret", "v"), ("m", "z", "v"), ("secret",)]
    assert flat.columns == ["id", *(".".join(p) for p in paths)]
    for row, record in zip(flat.orderBy("id").collect(), RECORDS):
        assert list(row)[1:] == [", ".join(collect(record, p)) for p in paths]


def test_flattens_variants_of_unlike_shapes(spark):
    texts = ['{"a":1,"b":{"c":"x"}}', '{"a":[2,3],"b":{"c":["y",null,"z"]}}', "{}", None]
    frame = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string").select("n", F.parse_json("t").alias("v"))
    flat = flatten_any(frame, ["n"])
    assert flat.columns[0] == "n" and set(flat.columns[1:]) == {"v.a", "v.b.c"}
    assert [r["v.a"] for r in flat.orderBy("n").collect()] == ["1", "[2,3]", "", ""]


def test_equal_names_and_empty_frames(spark):
    clash = spark.createDataFrame([], "`a.b` string, a struct<b:string>")
    with pytest.raises(DefinitionError):
        flatten_any(clash)
    empty = spark.createDataFrame([], "m map<string,int>, v variant")
    assert flatten_any(empty).collect() == [] and strip_any(empty, ["x"]).collect() == []


def test_a_package_without_records(spark, tmp_path):
    with pytest.raises(PackageError):
        package_records(spark, str(tmp_path))
