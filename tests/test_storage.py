import os
from types import SimpleNamespace

import pytest

from quarry import storage


def test_clusters_need_a_shared_folder():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://somewhere:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        storage.shared_dir(session)
    session.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        storage.shared_dir(session)


def test_scratch_removes_what_is_not_kept(spark):
    before = set(os.listdir(storage.shared_dir(spark)))
    with storage.scratch() as outer:
        with storage.scratch() as made:
            storage.written(spark.range(3), "a")
            kept = storage.kept(made, storage.written(spark.range(5), "b"))
        assert kept.count() == 5
        last = storage.kept(outer, storage.written(kept, "c"))
    assert last.count() == 5
    assert [x.split("-")[1] for x in set(os.listdir(storage.shared_dir(spark))) - before] == ["c"]
