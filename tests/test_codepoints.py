import numpy as np
import pyarrow as pa

from lectern.functions import codepoints as C


def test_slices(monkeypatch):
    monkeypatch.setattr(C, "SLICE_BYTES", 10)
    lists = pa.array([["abcd", None], None, [], ["汉字", "x"], ["y" * 50], ["z"]], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([lists, pa.array(["", None, "t", "", "", "u"])], ["content", "title"])
    parts = list(C.sliced(iter([batch, batch.slice(0, 0)]), "content", "title"))
    assert [len(p) for p in parts[:-1]] == [3, 1, 1, 1] and len(parts[-1]) == 0
    assert sum((p.column("content").to_pylist() for p in parts), []) == lists.to_pylist()
    texts, rows, index = C.flatten(parts[1].column("content"))
    assert texts.to_pylist() == ["汉字", "x"] and rows.tolist() == [0, 0] and index.tolist() == [0, 1]
    points, offsets = C.codepoints(texts)
    assert "".join(map(chr, points)) == "汉字x" and offsets.tolist() == [0, 2, 3]


def test_sliding_min():
    x = np.random.default_rng(2).integers(0, 99, 200)
    for w in (1, 2, 7, 16, 42):
        assert C.sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(200 - w + 1)]
    assert len(C.sliding_min(x, 500)) == 0
