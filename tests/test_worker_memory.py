"""What a worker holds at once does not follow the size of a batch or a table."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tablewright.functions import distincts as D
from tablewright.operators import text as G


def peak_of(work):
    tracemalloc.start()
    try:
        out = work()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_pages_of_a_batch_are_read_a_few_at_a_time():
    pages = ["<p>é one</p><script>" + "x" * 200_000 + "</script>", None, "", "<h1>A</h1>b"] * 100
    column = pa.array(["<p>before</p>", *pages]).slice(1)
    texts, peak = peak_of(lambda: G.page_texts(column))
    assert texts.to_pylist() == [None if p is None else G.page_text(p) for p in pages]
    assert peak < 6 << 20  # of 20 MB
    assert G.page_texts(pa.array([], pa.string())).to_pylist() == []


def test_members_of_a_range_are_copied_once():
    r = np.random.default_rng(1)
    parts = [np.unique(r.integers(0, 2_000_000, 500_000).astype(np.uint64)) for _ in range(8)]
    rows = pa.table({"key": pa.array([3] * 9, pa.int32()), "range": pa.array([0] * 8 + [None], pa.int64()), "bits": pa.array([*[p.tobytes() for p in parts], None], pa.binary()),
                     "present": pa.array([None] * 8 + [7], pa.int64()), "rows": pa.array([None] * 8 + [9], pa.int64())})
    out, peak = peak_of(lambda: D._one_set(rows))
    assert out.to_pylist() == [{"key": 3, "distinct": len(np.unique(np.concatenate(parts))), "present": 7, "rows": 9}]
    assert peak < 48 << 20  # of members of 28 MB
    assert D._one_set(rows.slice(8)).to_pylist() == [{"key": 3, "distinct": 0, "present": 7, "rows": 9}]
    assert D._one_set(rows.slice(7)).column("distinct").to_pylist() == [len(parts[7])]


def test_a_range_has_a_few_million_members(spark, tmp_path):
    spark.range(12_000_000).write.parquet(str(tmp_path / "keys"))
    assert D.ranges_of(spark.read.parquet(str(tmp_path / "keys"))) >= 4
