import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from galleon.llm import _words as W
from galleon.llm import sstable as op

from .samples import documents, frame, thue_morse

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [thue_morse(11), thue_morse(11, True), "don't STOP <|endoftext|>x", "a b c", "İ ́x é ΑΣ", "12 345!?", "x" * 300, "\x0b\x0c", "日本語 テキスト", "'s 'S it's"]


def rows_of(seed):
    rows = documents(seed, n=40)
    rows += [(70_000 + i, t) for i, t in enumerate(ODD)] + [(-5, "minus"), (-5, "minus"), (-5, "again")]
    rows += random.Random(seed).sample(rows, 2)
    return rows


def whole(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("seed", [0, 1])
def test_round_trip(spark, seed, tmp_path):
    rows = rows_of(seed)
    out = op.write(frame(spark, rows), PATH, 2, f"file://{tmp_path}/t")
    found = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in op.read_back(out).collect())
    assert len(found) == len(rows)
    at = 0
    for start, _, n, _ in found:
        assert start == at
        at += n
    ids = [i for _, i, _, _ in found]
    assert [i for i in ids if i is not None] == sorted(i for i, _ in rows if i is not None)
    assert all(i is None for i in ids[len([i for i in ids if i is not None]) :])
    want = sorted((str(i), len(e), zlib.crc32(np.array(e, "<u4").tobytes())) for i, t in rows for e in [whole(t)])
    assert sorted((str(i), n, c) for _, i, n, c in found) == want


def test_lookup(spark, tmp_path):
    rows = rows_of(2)
    out = op.write(frame(spark, rows), PATH, 2, f"file://{tmp_path}/t", shard_mb=1)
    shards = [op.Shard(r.path) for r in out.manifest.collect()]
    for i in {i for i, _ in rows}:
        got = sorted(tuple(map(int, x)) for s in shards for x in s.get(i))
        assert got == sorted(tuple(whole(t)) for j, t in rows if j == i)
    assert [s.get(123_456_789) for s in shards] == [[] for _ in shards]


def test_empty_table(spark, tmp_path):
    assert op.read_back(op.write(frame(spark, []), PATH, 2, f"file://{tmp_path}/t")).collect() == []


def test_many_blocks_and_small_cache(tmp_path, monkeypatch):
    monkeypatch.setattr(op, "CACHE_WORDS", 50)
    enc = op.Encoder(PATH)
    import pyarrow as pa

    for seed in range(4):
        texts = [t for _, t in documents(seed, n=20)]
        flat, first = enc.encode(W.texts(pa.array(texts, pa.string())))
        for i, t in enumerate(texts):
            assert list(flat[first[i] : first[i + 1]]) + [2] == whole(t)
    w = op.Writer(open(tmp_path / "s", "wb"), 2)
    for i in range(3000):
        w.add(op.key_of(i * 2, 0), np.arange(i % 200, dtype="<u2"))
    w.close()
    s = op.Shard(f"file://{tmp_path}/s")
    assert len(s.index) > 3 and [len(x) for x in s.get(1234 * 2)] == [1234 % 200] and s.get(3) == []


def test_bytes_decide_where_hashes_collide(monkeypatch):
    """Words that share a hash, in one slice and with cached ones, keep ids of their own."""
    import pyarrow as pa

    whole_hash = W._hash
    monkeypatch.setattr(W, "_hash", lambda *a: whole_hash(*a) % np.uint64(5))
    enc = op.Encoder(PATH)
    for seed in range(3):
        texts = [t for _, t in documents(seed, n=15)] + ODD
        flat, first = enc.encode(W.texts(pa.array(texts, pa.string())))
        for i, t in enumerate(texts):
            assert list(flat[first[i] : first[i + 1]]) + [2] == whole(t)
