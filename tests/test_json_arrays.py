"""Arrays read by ranges: whatever is in the strings, wherever the ranges end, the order is kept."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from briefwerk.plans import queries
from briefwerk.sources import files
from briefwerk.sources.json_arrays import JsonArray


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def value(rng, depth=0):
    kinds = [lambda: rng.choice(["}", "a } b", '"', '\\', '\\"', "{[", "]", 'x": [', "é\n", ""]) * rng.randrange(1, 3), lambda: rng.randrange(99), lambda: None, lambda: True]
    if depth < 3:
        kinds += [lambda: [value(rng, depth + 1) for _ in range(rng.randrange(3))], lambda: {str(k): value(rng, depth + 1) for k in range(rng.randrange(3))}]
    return rng.choice(kinds)()


def read(array):
    return [None if r.j is None else json.loads(r.j) for r in array.elements().orderBy("pos").select(F.to_json("element").alias("j")).collect()]


@pytest.mark.parametrize("indent", [None, 1])
def test_arrays_of_anything(small_ranges, tmp_path, indent):
    rng = random.Random(4)
    wanted = [{"n": k, "v": value(rng)} if rng.random() < 0.8 else rng.choice([k, "}", [k, {"x": 1}], "],"]) for k in range(40)]
    path = tmp_path / "list.json"
    path.write_text(json.dumps(wanted, indent=indent))
    assert read(JsonArray(small_ranges, str(path))) == wanted
    whole = {"a": {"cases": [1, {"x": 2}]}, "t": "cases", "safe": False, "cases": wanted, "z": [{"b": 1}], "cloud_safe": True}
    path.write_text(json.dumps(whole, indent=indent))
    array = JsonArray(small_ranges, str(path), "cases")
    assert read(array) == wanted
    assert {(r.key, r.value) for r in array.scalars().collect()} == {("safe", "false"), ("cloud_safe", "true")}


def test_empty_and_single_arrays(spark, tmp_path):
    path = tmp_path / "list.json"
    for text, wanted in (("[]", []), (" [ ] \n", []), ("[{}]", [{}]), ("[1]", [1]), ('{"cases": []}', []), ('{"x": 1}', [])):
        path.write_text(text)
        assert read(JsonArray(spark, str(path), "cases")) == wanted, text


def test_rules_keep_their_order_and_are_read_by_many_tasks(small_ranges, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps([{"key": f"{k:03d} }}", "keywords": [f"Wort{k}", "Ü"]} for k in range(80)]))
    rules = files.read_rules(small_ranges, str(path))
    got = [(r.priority, r.category, r.keywords) for r in rules.orderBy("priority").collect()]
    assert got == [(k + 1, f"{k:03d} }}", [f"wort{k}", "ü"]) for k in range(80)]
    assert small_ranges.read.text(str(path), lineSep="}").rdd.getNumPartitions() > 4


def test_a_long_list_is_written_as_several_files_and_read_as_one(spark, tmp_path):
    n, rows, folder = 16, 7, str(tmp_path / "cases")
    value = F.to_json(F.struct(F.concat(F.lit("brief"), F.col("id"), F.lit(".txt")).alias("file"), F.lit(["a"]).alias("sender_any")))
    cases = spark.range(n).select("id", value.alias("value")).repartition(4)
    queries._json_list(cases, "id", folder, '{"cloud_safe": true, "cases": [', '], "end": {}}', file_rows=rows)
    lines = [p.read_text().splitlines() for p in sorted(Path(folder).glob("part-*")) if p.stat().st_size]
    assert [len(x) for x in lines] == [7, 7, 2]
    assert all(json.loads("".join(x))["cloud_safe"] for x in lines)
    usable, _ = files.read_expectations(spark, folder)
    got = [(r.case_no, r.file, r.cloud_safe) for r in usable.orderBy("case_no").collect()]
    assert got == [(k + 1, f"brief{k}.txt", True) for k in range(n)]
