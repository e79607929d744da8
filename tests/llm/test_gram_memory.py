"""Counting the grams of a task needs little memory beyond the grams, and gives the counts of every value."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from bizdocs.llm import ngram_join as J


class Direct:
    """Stands for a DataFrame: hands back the function that a task would run."""

    def mapInArrow(self, fn, schema):
        return fn


def batches(n: int, size: int):
    rng = np.random.default_rng(1)
    for i in range(n):
        words = [b"w%d" % w for w in rng.integers(0, 10**7, size)]
        yield pa.RecordBatch.from_arrays([pa.array([2 * i, 2 * i + 1]), pa.array([b" ".join(words), b"x " + b" ".join(words)])], ["doc_id", "text"])


def test_task_memory_is_bounded():
    tracemalloc.start()
    rows = sum(b.num_rows for b in J.describe(Direct(), 5)(batches(20, 100_000)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 40  # grams of the repeated texts follow the documents
    assert peak < 150 << 20


def test_repeated_counts():
    grams = np.random.default_rng(2).integers(0, 500, 1000).astype(np.uint64)
    tokens, df = np.unique(grams, return_counts=True)
    for least in (1, 2, 3, 50):
        found, n = J.repeated(grams.copy(), least)
        assert found.tolist() == tokens[df >= least].tolist() and n.tolist() == df[df >= least].tolist()
    assert [len(x) for x in J.repeated(np.zeros(0, np.uint64), 2)] == [0, 0]
