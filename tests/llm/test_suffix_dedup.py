import random

import numpy as np
import pyarrow as pa
import pytest

from galleon.llm import _words as W
from galleon.llm import suffix_dedup as op

from .samples import documents, frame


def brute(rows, k=100):
    inf = float("inf")
    at = lambda i, j: (inf if i is None else i, j)
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - k + 1):
            x = b[j : j + k]
            first[x] = min(first.get(x, at(None, inf)), at(i, j))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - k + 1):
            if first[b[j : j + k]] < at(i, j):
                gone[j : j + k] = b"\1" * k
        runs = len([r for r in bytes(gone).split(b"\0") if r])
        out.append((i, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [0, 1])
def test_against_brute_force(spark, seed):
    rows = documents(seed)
    rows += random.Random(seed).sample(rows, 2)
    found = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in op.deduplicate(frame(spark, rows)).collect()]
    assert sorted(found, key=str) == brute(rows)


def test_bytes_decide_where_digests_collide(monkeypatch):
    r = random.Random(1)
    base = ["".join(r.choices("abc", k=400)) for _ in range(6)]
    t = W.texts(pa.array([x + y for x in base for y in base], pa.string()))
    s = op.segments(t, 100, 32)
    keys = np.unique(s.key)
    want = op._distinct(t, s, keys, 7, 100)
    monkeypatch.setattr(op, "_digest", lambda t, start, size: np.zeros(len(start), np.uint64))
    found = op._distinct(t, s, keys, 7, 100)
    text = lambda d, i: (int(d.to[d.kind[i]]), t.data[s.start[i] : s.start[i] + s.count[i] + 99].tobytes())
    head = lambda d, k: t.data[s.start[d.head[k]] : s.start[d.head[k]] + s.count[d.head[k]] + 99].tobytes()
    for d in (want, found):
        assert len({head(d, k) for k in range(len(d.head))}) == len(d.head) and (np.diff(d.to) >= 0).all()
        assert all(text(d, i)[1] == head(d, d.kind[i]) for i in range(len(d.places)))
    assert {head(want, k) for k in range(len(want.head))} == {head(found, k) for k in range(len(found.head))}


def test_a_document_larger_than_a_slice(spark):
    r = random.Random(4)
    long = "".join(r.choice("abcdefghij") for _ in range(2_300_000))
    rows = [(2, long), (1, long[:5000]), (3, long[1_500_000:1_600_000]), (4, "x" + long[:700_000])]
    found = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans)) for r in op.deduplicate(frame(spark, rows)).collect()]
    n = len(long)
    assert sorted(found) == [(1, 5000, 0, 0), (2, n, 5000, 1), (3, 100_000, 100_000, 1), (4, 700_001, 700_000, 1)]


def test_empty_table(spark):
    assert op.deduplicate(frame(spark, [])).collect() == []
