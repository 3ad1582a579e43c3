"""Trees of result files, one folder per model and paper, as a Spark data source: root/model/paper/name.

    quarry.sources.tree.register(spark)
    spark.read.format("result_tree").option("name", "evaluation_report.json").load(root).filter("paper = 'p1'")
    rows.write.format("result_tree").option("name", "evaluation_report.json").mode("append").save(root)

Reading plans partitions of some paper folders each; filters on model and paper (equality and lists) are answered from the folders'
names before any file is opened. A file that holds no JSON object is a row with an error, not a failure; `parsed` gives the others a
schema, and `checked` tells which rows do not belong where they lie. Writing puts each row's body into its own file, under a
temporary name until it is whole, so a repeated task replaces what it wrote before.

Defined results: folders without the file are left out, as are other files and hidden folders; a root that is not there is an empty tree;
null names are written as `unknown_model` and `unknown_paper`, characters that paths do not take as `_`; a null body is an empty
file, which reads as malformed.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "model string, paper string, path string, length long, sha256 string, body string, error string"
#: Paper folders of one partition.
FOLDERS = 64
PUSHED = "spark.sql.python.filterPushdown.enabled"


def safe(name: str | None, missing: str) -> str:
    """A folder's name."""
    return re.sub(r"[^\w.\-]+", "_", name or "").strip("._") or missing


@dataclass
class Folders(InputPartition):
    found: list[tuple[str, str]] = field(default_factory=list)


@dataclass
class Written(WriterCommitMessage):
    files: int


def _subfolders(system: fs.FileSystem, path: str) -> list[str]:
    if system.get_file_info(path).type != fs.FileType.Directory:
        return []
    found = system.get_file_info(fs.FileSelector(path))
    return sorted(x.base_name for x in found if x.type == fs.FileType.Directory and not x.base_name.startswith((".", "_")))


class TreeReader(DataSourceReader):
    def __init__(self, root: str, name: str, folders: int) -> None:
        self.root, self.name, self.folders, self.wanted = root, name, folders, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute in (("model",), ("paper",)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], values) & values
            else:
                yield f

    def _keeps(self, column: str, name: str) -> bool:
        return column not in self.wanted or name in self.wanted[column]

    def partitions(self) -> list[Folders]:
        system, root = fs.FileSystem.from_uri(self.root)
        found = [(m, p) for m in _subfolders(system, root) if self._keeps("model", m) for p in _subfolders(system, f"{root}/{m}") if self._keeps("paper", p)]
        return [Folders(found[i : i + self.folders]) for i in range(0, len(found), self.folders)] or [Folders()]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(self.root)
        schema = pa.schema([(c, pa.int64() if c == "length" else pa.string()) for c in "model paper path length sha256 body error".split()])
        for model, paper in partition.found:
            path = f"{root}/{model}/{paper}/{self.name}"
            if system.get_file_info(path).type != fs.FileType.File:
                continue
            with system.open_input_stream(path) as f:
                data = f.read()
            body, error = None, None
            try:
                body = data.decode("utf-8-sig")
                if not isinstance(json.loads(body), dict):
                    body, error = None, "no JSON object"
            except ValueError as e:  # also what is no UTF-8
                body, error = None, f"{type(e).__name__}: {e}"[:200]
            row = {"model": model, "paper": paper, "path": path, "length": len(data), "sha256": hashlib.sha256(data).hexdigest(), "body": body, "error": error}
            yield pa.RecordBatch.from_pylist([row], schema=schema)


class TreeWriter(DataSourceArrowWriter):
    def __init__(self, root: str, name: str) -> None:
        self.root, self.name = root, name

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = fs.FileSystem.from_uri(self.root)
        n = 0
        for b in iterator:
            for model, paper, body in zip(*(b.column(c).to_pylist() for c in ("model", "paper", "body")), strict=True):
                folder = f"{root}/{safe(model, 'unknown_model')}/{safe(paper, 'unknown_paper')}"
                system.create_dir(folder, recursive=True)
                part = f"{folder}/.{self.name}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as f:
                    f.write((body or "").encode())
                system.move(part, f"{folder}/{self.name}")
                n += 1
        return Written(n)


class ResultTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "result_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(self.options["path"], self.options["name"], int(self.options.get("folders", FOLDERS)))

    def writer(self, schema: StructType, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options["path"], self.options["name"])


def register(spark: SparkSession) -> SparkSession:
    """spark, with the source known and filters sent to it."""
    spark.dataSource.register(ResultTree)
    spark.conf.set(PUSHED, "true")
    return spark


def parsed(rows: DataFrame, schema: str) -> DataFrame:
    """rows with the fields of their bodies in `fields`; what does not fit the schema is an error of the row."""
    fields = F.from_json("body", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = rows.withColumn("fields", fields)
    return rows.withColumn("error", F.coalesce("error", F.when(F.col("fields._corrupt").isNotNull(), "does not fit the schema"))).withColumn("fields", F.col("fields").dropFields("_corrupt"))


def checked(rows: DataFrame, model: Column, paper: Column) -> DataFrame:
    """(model, paper, problem) of what should not be there: malformed files, and those whose own identity is not that of their folders."""
    problem = F.when(F.col("error").isNotNull(), F.col("error")).when(~model.eqNullSafe(F.col("model")), "another model").when(~paper.eqNullSafe(F.col("paper")), "another paper")
    return rows.select("model", "paper", problem.alias("problem")).filter("problem is not null")
