import json

import pytest

from quarry.sources import readers, writers


def test_reports_pages_and_files(spark, tmp_path):
    for model, paper, own in (("m1", "p1", "p1"), ("m1", "p2", "other")):
        at = tmp_path / "r" / model / paper
        at.mkdir(parents=True)
        (at / "dialogue_trajectory.json").write_text(json.dumps({"paper_id": own, "target_model": model, "turns": [{"turn_id": "T1"}]}, indent=1))
    rows = readers.trajectories(spark, str(tmp_path / "r"))
    assert rows.count() == 2 and [r.paper_id for r in readers.misplaced(rows).collect()] == ["other"]
    pages = tmp_path / "raw" / "paper"
    pages.mkdir(parents=True)
    for n in (1, 2, 10):
        (pages / f"doc_{n}.md").write_text(f"# head {n}\n\n\n\nbody  {n}")
    (tmp_path / "raw" / "cache").mkdir()
    (tmp_path / "raw" / "cache" / "x.bin").write_text("x")
    found = readers.markdown_pages(spark, str(tmp_path / "raw"))
    assert [(r.page, r.file) for r in found.orderBy("page").collect()] == [(1, "doc_1.md"), (2, "doc_10.md"), (3, "doc_2.md")]
    assert readers.paper_texts(found).first().text.startswith("<!-- page 1: doc_1.md -->\n\n# head 1\n\nbody 1\n\n<!-- page 2")
    assert readers.files(spark, str(tmp_path / "raw")).count() == 3
    (tmp_path / "r" / "bad.json").write_text("[oops")
    with pytest.raises(Exception, match="(?i)malformed|corrupt"):
        readers.json_objects(spark, str(tmp_path / "r"), "bad.json", "a int").collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("=1", 2, None), ('a"b', -3, "x")], "a string, n int, s string")
    writers.csv(df, str(tmp_path / "c"), ["n", "a"], one_file=True)
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c"))
    assert sorted(tuple(r) for r in back.collect()) == [("-3", 'a"b'), ("2", "'=1")]
    assert writers.union_of_columns(df.select("a"), df.select("n")).columns == ["a", "n"]
    writers.lines(spark.createDataFrame([(2, "b"), (1, "a")], "i int, line string"), str(tmp_path / "l"), ["i"])
    assert [r.value for r in spark.read.text(str(tmp_path / "l")).collect()] == ["a", "b"]
    nested = spark.sql("SELECT 1 AS id, named_struct('x', 2, 'm', map('a', 1)) AS g")
    assert readers.flattened(nested, "g").columns == ["id", "g.x"]
