"""Result trees: what is written is read, filters choose folders, malformed and misplaced files are rows."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from quarry.sources import tree


def put(root, path, data):
    at = Path(root, path)
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_bytes(data if isinstance(data, bytes) else json.dumps(data).encode())


def read(spark, root, name="r.json", **options):
    return tree.register(spark).read.format("result_tree").options(name=name, **options).load(str(root))


def test_read(spark, tmp_path):
    put(tmp_path, "m1/p1/r.json", {"model": "m1", "paper": "p1", "n": 1})
    put(tmp_path, "m1/p2/r.json", b"\xef\xbb\xbf" + json.dumps({"model": "m2", "paper": "p2", "n": 2}).encode())
    put(tmp_path, "m2/p1/r.json", {"model": "m2", "paper": "p9", "n": "x"})
    put(tmp_path, "m2/p3/r.json", b'{"n": ')
    put(tmp_path, "m2/p4/r.json", [1])
    put(tmp_path, "m2/p5/r.json", b"\xff\xfe")
    put(tmp_path, "m2/p6/other.json", {"n": 1})
    put(tmp_path, "m2/.hidden/r.json", {"n": 1})
    put(tmp_path, "m2/p7/r.json", b"")
    (tmp_path / "m3").mkdir()
    rows = read(spark, tmp_path)
    found = {(r.model, r.paper): r for r in rows.collect()}
    assert set(found) == {("m1", "p1"), ("m1", "p2"), ("m2", "p1"), ("m2", "p3"), ("m2", "p4"), ("m2", "p5"), ("m2", "p7")}
    assert {k for k, r in found.items() if r.error} == {("m2", "p3"), ("m2", "p4"), ("m2", "p5"), ("m2", "p7")}
    assert found["m1", "p1"].length == len((tmp_path / "m1/p1/r.json").read_bytes()) and found["m2", "p4"].error == "no JSON object"
    fields = tree.parsed(rows, "model string, paper string, n int")
    bad = {(r.model, r.paper): r.problem for r in tree.checked(fields, F.col("fields.model"), F.col("fields.paper")).collect()}
    assert bad["m1", "p2"] == "another model" and bad["m2", "p1"] == "does not fit the schema" and len(bad) == 6
    assert {(r.model, r.n) for r in fields.filter("error is null").select("model", "fields.n").collect()} == {("m1", 1), ("m1", 2)}


def test_filters_choose_folders_before_files_are_opened(spark, tmp_path):
    for m in ("a", "b"):
        for p in range(10):
            put(tmp_path, f"{m}/p{p}/r.json", {"n": p})
    rows = read(spark, tmp_path, folders=1)
    assert rows.rdd.getNumPartitions() == 20
    some = rows.filter("model = 'a' AND paper IN ('p1', 'p2', 'zz') AND length > 0")
    assert {(r.model, r.paper) for r in some.collect()} == {("a", "p1"), ("a", "p2")} and some.rdd.getNumPartitions() == 2
    assert rows.filter("paper = 'p1' AND paper = 'p2'").count() == 0
    reader = tree.TreeReader(str(tmp_path), "r.json", 4)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("paper",), "p3"), GreaterThan(("length",), 1)]))
    assert left == [GreaterThan(("length",), 1)] and [x.found for x in reader.partitions()] == [[("a", "p3"), ("b", "p3")]]


def test_write_again_and_nulls(spark, tmp_path):
    own, root = tree.register(spark), str(tmp_path / "t")
    rows = [("m/1", "p 1", '{"n": 1}'), (None, None, '{"n": 2}'), ("m/1", "..", None)]
    for _ in range(2):
        own.createDataFrame(rows, "model string, paper string, body string").write.format("result_tree").option("name", "r.json").mode("append").save(root)
    got = {(r.model, r.paper): (r.body, r.error is None) for r in read(spark, root).collect()}
    assert got == {("m_1", "p_1"): ('{"n": 1}', True), ("unknown_model", "unknown_paper"): ('{"n": 2}', True), ("m_1", "unknown_paper"): (None, False)}
    assert not [x for x in Path(root).rglob(".*")]  # no part is left


def test_no_tree(spark, tmp_path):
    assert read(spark, tmp_path / "nothing").count() == 0
