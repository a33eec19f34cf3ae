"""What the steps of the similarity join hold and give back in a Python worker, which lives on after its tasks."""
import re
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tickloom.llm import common as C, ngram_join as J


def own_mb():
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


class Tables:
    """Runs what it is given on the spot."""

    def __init__(self, *parts):
        self.parts = parts

    def mapInArrow(self, run, schema):
        return list(run(iter(self.parts)))

    def applyInArrow(self, run, schema):
        return [run(part) for part in self.parts]


def holes(batch):
    """Leaves 100 MB of freed blocks, with one that is still used above them."""
    blocks = [np.ones(8000) for _ in range(1700)]
    holes.kept = blocks[-1]
    return batch


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc and trims the heap of glibc")
@pytest.mark.parametrize("run", [lambda rows: C.map_batches(Tables(rows.to_batches()[0]), holes, "x long"),
                                 lambda rows: C.map_groups(Tables(rows), holes, "x long")])
def test_a_task_gives_its_memory_back(run):
    C.give_back()
    before = own_mb()
    assert [t.num_rows for t in run(pa.table({"x": [1, 2]}))] == [2]
    assert own_mb() - before < 30


def test_batches_without_rows_are_skipped_and_failures_are_told():
    batch, none = pa.table({"x": [1, 2]}).to_batches()[0], pa.RecordBatch.from_pydict({"x": pa.array([], pa.int64())})
    assert C.map_batches(Tables(none, batch, none), lambda b: b, "x long") == [batch]
    assert C.map_batches(Tables(batch), lambda b: None, "x long") == []
    with pytest.raises(ZeroDivisionError):
        C.map_batches(Tables(batch), lambda b: 1 / 0, "x long")


def test_the_sets_of_a_batch_take_little_more_than_the_batch():
    texts = pa.array([" ".join(f"w{i * j % 997}" for j in range(700)) for i in range(2500)])
    assert texts.nbytes > 8_000_000
    J.shingle_sets(texts.slice(0, 400), 5)
    tracemalloc.start()
    sets = J.shingle_sets(texts, 5)
    most = tracemalloc.get_traced_memory()[1] - sum(s.nbytes for s in sets)
    tracemalloc.stop()
    assert most < 30_000_000


@pytest.mark.parametrize("split", [1, 9, 100])
def test_sets_do_not_depend_on_the_split(monkeypatch, split):
    texts = pa.array(["a b c d e f", None, "", " x ", "y" * 100 + " q", *(f"w{i} é b c d e g" for i in range(30)), "漢 " * 40]).slice(1)
    want = [s.tolist() for t in range(len(texts)) for s in J.shingle_sets(texts.slice(t, 1), 5)]
    monkeypatch.setattr(J, "SPLIT", split)
    assert [s.tolist() for s in J.shingle_sets(texts, 5)] == want
    monkeypatch.setattr(C, "HASH_STEP", split)
    assert [s.tolist() for s in J.shingle_sets(texts, 5)] == want
