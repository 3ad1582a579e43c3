"""Tables written to the folder that driver and executors share; lineage ends at them, and lost executors cost no recomputation."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OPEN: list[list[DataFrame]] = []  # the scratch lists of blocks that are being run, innermost last


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where that is unset in local mode, as in tests.

    On a cluster executors would each write to a disk of their own, and tables would come back incomplete, so there it must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def written(df: DataFrame, name: str, row_group: int | None = None) -> DataFrame:
    """df, stored as Parquet in the shared folder and read again. row_group: bytes of a row group, which a reader of large values holds in memory."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry-{name}-{uuid.uuid4().hex}"
    (df.write.option("parquet.block.size", row_group) if row_group else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    if _OPEN:
        _OPEN[-1].append(out)
    return out


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """A block whose stored tables are removed at its end, but for those taken off the list it gives (kept); what is kept must not read the others."""
    made: list[DataFrame] = []
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN.pop()
        discard(*made)


def kept(made: list[DataFrame], df: DataFrame) -> DataFrame:
    """df, a stored table, taken off the list of its scratch block; a block around that one may still remove it."""
    made[:] = [x for x in made if x is not df]
    if len(_OPEN) > 1 and _OPEN[-1] is made:
        _OPEN[-2].append(df)
    return df


def discard(*frames: DataFrame) -> None:
    """Remove tables that written() stored, once nothing that is still to run reads them; other frames are left as they are."""
    for df in frames:
        if found := getattr(df, "_quarry_path", None):
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(found)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
