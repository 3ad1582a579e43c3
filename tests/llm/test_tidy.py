"""Workers give memory back between tasks."""

import ctypes
import os

import pyarrow as pa
import pytest

from quarry.llm.common import tidy


def held_mb():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6


@pytest.mark.skipif(not os.path.exists("/proc/self/statm") or not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="needs Linux with glibc")
def test_free_memory_goes_back_after_the_last_batch():
    last = []

    def run(batches):
        for b in batches:
            texts = [bytes(4000) for _ in range(50_000)]
            last.append(bytes(4000))  # lies above the texts, so that freeing them alone gives nothing back
            del texts
            yield b

    batches = [pa.RecordBatch.from_pydict({"a": [i]}) for i in range(2)]
    before = held_mb()
    assert list(run(iter(batches))) == batches
    plain = held_mb() - before
    assert list(tidy(run)(iter(batches))) == batches
    assert plain > 100 > 60 > held_mb() - before
