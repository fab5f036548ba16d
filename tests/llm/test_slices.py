import pyarrow as pa

from palimpsest.llm import _common


def cut(lengths, **bounds):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lengths)), pa.int64()), pa.array(["x" * n for n in lengths])], names=["i", "text"])
    return list(_common.slices(iter([batch]), **bounds))


def test_slices_keep_all_rows_in_order_within_both_bounds():
    lengths = [10, 5000, 3, 0, 90_000, 7, 7, 7, 2000, 1] * 40
    parts = cut(lengths, rows=16, size=8192)
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(lengths)))
    assert [len(t) for p in parts for t in p.column(1).to_pylist()] == lengths
    assert all(p.num_rows <= 16 and (p.num_rows == 1 or p.nbytes <= 8192) for p in parts)


def test_slices_of_nothing_and_of_one_long_row():
    assert cut([]) == []
    assert [p.num_rows for p in cut([1 << 20], size=10)] == [1]
