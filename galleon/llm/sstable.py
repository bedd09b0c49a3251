"""Token-id output as sorted-string-table shards.

A shard holds documents in ascending key order:

    blocks   entries of (shared key bytes, new key bytes, value bytes; varints), the new
             key bytes and the value: token ids, little-endian, two bytes wide where the
             vocabulary allows, else four.  The first key of a block is whole.
    index    one entry a block: first key, offset, length
    bloom    bit array over the keys
    footer   offsets and lengths of index and bloom, hashes, width, documents, tokens, magic

A key is a null flag, the big-endian ``doc_id`` with its sign bit flipped, and a hash of
the text that orders rows which repeat an id.  A lookup asks the Bloom filter, searches
the index, and decodes one block.

Writing ranges rows over shards by key, sorts within shards, and streams; only one
block is held.  Each task writes under a name of its own, and the manifest (written
last) names the files of the tasks that counted, so a lost executor leaves no harm.
Words are encoded once a worker: the tokenizer drops white space, so a text's ids are
those of its words in order; the cache of words, which compares their bytes, is bounded.

Defined cases: null and empty texts have the end id alone; null ids come last; rows that
repeat an id are all kept; an empty table gives no shard; other columns are not read.
"""

from __future__ import annotations

import math
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _cuts
from . import _words as W

MAGIC = b"GSSTABL1"
FOOTER = struct.Struct("<QQQQIIQQ8s")
BLOCK = 64 << 10
BITS_PER_KEY, HASHES = 10, 7
CACHE_WORDS, CACHE_BYTES, AT_ONCE = 2_000_000, 64 << 20, 1000
KEY = W.new_key()  # of this process


class Encoder:
    """Token ids of texts, word by word, with a bounded cache of words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")
        self.forget()

    def forget(self) -> None:
        self.runs: list[Words] = []
        self.bytes, self.pool = np.zeros(0, np.uint8), np.zeros(0, self.kind)

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids in a row, and how many each has."""
        ids = []
        for i in range(0, len(words), AT_ONCE):  # an encoding holds far more than its ids
            some = [w.decode("utf-8", "replace") for w in words[i : i + AT_ONCE]]
            ids += [x.ids for x in self.tokenizer.encode_batch(some, add_special_tokens=False)]
        count = np.fromiter(map(len, ids), np.int32, len(ids))
        return np.fromiter((i for x in ids for i in x), self.kind, int(count.sum())), count

    def _known(self, u: np.ndarray, x: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of ids of known words: the hash finds a word, its bytes decide."""
        place, count = np.full(len(u), -1, np.int64), np.zeros(len(u), np.int64)
        for run in self.runs:
            at = np.minimum(np.searchsorted(run.hash, u), len(run.hash) - 1)
            hit = np.flatnonzero((run.hash[at] == u) & (run.size[at] == size))
            at = at[hit]
            hit_ok = equal_ranges(x, start[hit], self.bytes, run.word[at].astype(np.int64), size[hit])
            place[hit[hit_ok]], count[hit[hit_ok]] = run.place[at[hit_ok]], run.count[at[hit_ok]]
        return place, count

    def _learn(self, u: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Encodes words and keeps them; their places and numbers of ids."""
        ids, count = self._encoded(words)
        place = len(self.pool) + np.cumsum(count) - count
        size = np.fromiter(map(len, words), np.int32, len(words))
        word = len(self.bytes) + np.cumsum(size) - size
        self.pool = np.concatenate([self.pool, ids])
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(words), np.uint8)])
        self.runs.append(Words(u, word.astype(np.int32), size, place.astype(np.int32), count))
        if len(self.runs) > 8:
            whole = Words(*(np.concatenate(c) for c in zip(*self.runs, strict=True)))
            order = np.argsort(whole.hash, kind="stable")
            self.runs = [Words(*(c[order] for c in whole))]
        return place, count

    def encode(self, t: W.Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin."""
        w = W.words(t, key=KEY)
        size = w.end - w.start
        u, at, kind = np.unique(w.hash, return_index=True, return_inverse=True)
        if sum(len(r.hash) for r in self.runs) + len(u) > CACHE_WORDS or max(len(self.bytes), len(self.pool)) + len(t.data) > CACHE_BYTES:
            self.forget()
        place, count = self._known(u, t.data, w.start[at], size[at])
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new], count[new] = self._learn(u[new], [t.data[w.start[i] : w.end[i]].tobytes() for i in at[new]])
        place, n = place[kind], count[kind]
        head = at[kind]
        same = np.zeros(len(size), bool)
        fits = np.flatnonzero(size == size[head])
        same[fits] = equal_ranges(t.data, w.start[fits], t.data, w.start[head[fits]], size[fits])
        pool, odd = self.pool, np.flatnonzero(~same)
        if len(odd):  # words whose hash another word has
            ids, n[odd] = self._encoded([t.data[w.start[i] : w.end[i]].tobytes() for i in odd])
            place[odd] = len(pool) + np.cumsum(n[odd]) - n[odd]
            pool = np.concatenate([pool, ids])
        ends = np.concatenate(([0], np.cumsum(n)))
        flat = pool[np.arange(ends[-1]) + np.repeat(place - ends[:-1], n)]
        return flat, ends[w.first]


class Words(NamedTuple):
    """Known words by hash: where their bytes lie and how many, where their ids lie and how many."""

    hash: np.ndarray
    word: np.ndarray
    size: np.ndarray
    place: np.ndarray
    count: np.ndarray


def equal_ranges(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Mask of the pairs of ranges, ``x`` at ``a`` and ``y`` at ``b``, with the same bytes; no size is 0."""
    if not len(size):
        return np.zeros(0, bool)
    ends = np.cumsum(size)
    step = np.arange(ends[-1]) - np.repeat(ends - size, size)
    differ = x[step + np.repeat(a, size)] != y[step + np.repeat(b, size)]
    return ~np.logical_or.reduceat(differ, ends - size)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def key_of(doc_id: int | None, order: int) -> bytes:
    return (b"\1" + bytes(8) if doc_id is None else b"\0" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))) + struct.pack(">Q", (order + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key[0] else struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        n |= (x & 127) << shift
        at, shift = at + 1, shift + 7
        if x < 128:
            return n, at


def _hashes(id_part: bytes) -> tuple[int, int]:
    a = zlib.crc32(id_part) | zlib.crc32(id_part, 0x9E3779B9) << 32
    b = (zlib.crc32(id_part, 0x85EBCA6B) | zlib.crc32(id_part, 0xC2B2AE35) << 32) | 1
    return a, b


class Writer:
    """Writes one shard from keys in ascending order."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.block, self.last, self.first = bytearray(), b"", b""
        self.index: list[tuple[bytes, int, int]] = []
        self.ids: list[bytes] = []
        self.docs = self.tokens = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.block:
            shared = len(os.path.commonprefix([key, self.last]))
        else:
            self.first = key
        value = ids.tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        if not self.ids or self.ids[-1] != key[:9]:
            self.ids.append(key[:9])
        self.docs += 1
        self.tokens += len(ids)
        if len(self.block) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.index.append((self.first, self.at, len(self.block)))
            self._put(bytes(self.block))
            self.block = bytearray()

    def _put(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def close(self) -> None:
        self._flush()
        index = self._put(b"".join(_varint(len(k)) + k + _varint(o) + _varint(n) for k, o, n in self.index))
        bits = np.zeros(max(64, -(-BITS_PER_KEY * len(self.ids) // 8) * 8), bool)
        for x in self.ids:
            a, b = _hashes(x)
            for i in range(HASHES):
                bits[(a + i * b) % len(bits)] = True
        bloom = self._put(np.packbits(bits).tobytes())
        self._put(FOOTER.pack(*index, *bloom, HASHES, self.width, self.docs, self.tokens, MAGIC))
        self.out.close()


class Shard:
    """Reads one shard: whole in order, or by id."""

    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        io, il, bo, bl, self.hashes, self.width, self.docs, self.tokens, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a shard")
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")
        self.bloom = np.unpackbits(np.frombuffer(self.file.read_at(bl, bo), np.uint8))
        raw, at, self.index = self.file.read_at(il, io), 0, []
        while at < len(raw):
            n, at = _read_varint(raw, at)
            key, at = raw[at : at + n], at + n
            offset, at = _read_varint(raw, at)
            length, at = _read_varint(raw, at)
            self.index.append((key, offset, length))

    def _entries(self, block: tuple[bytes, int, int]) -> Iterator[tuple[bytes, np.ndarray]]:
        raw, at, key = self.file.read_at(block[2], block[1]), 0, b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            new, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + new]
            at += new
            yield key, np.frombuffer(raw, self.kind, size // self.width, at)
            at += size

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for block in self.index:
            for key, ids in self._entries(block):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The token ids of every row with this id, found by binary search."""
        want = key_of(doc_id, 0)[:9]
        a, b = _hashes(want)
        if not all(self.bloom[(a + i * b) % len(self.bloom)] for i in range(self.hashes)):
            return []
        lo, hi = 0, len(self.index)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.index[mid][0][:9] < want else (lo, mid)
        found = []
        for block in self.index[max(0, lo - 1) :]:
            if block[0][:9] > want:
                break
            found += [ids for key, ids in self._entries(block) if key[:9] == want]
        return found


class Output(NamedTuple):
    """A written table: its manifest has shard, path, docs, tokens and start (tokens before it)."""

    folder: str
    manifest: DataFrame


def _write(folder: str, tokenizer: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, enc, out = TaskContext.get().partitionId(), encoder(tokenizer), None
        for batch in batches:
            rows = pa.table(batch)
            for a, b in W.texts(rows["text"]).slices():
                part = rows.slice(a, b - a)
                flat, first = enc.encode(W.texts(part["text"]))
                for i, (d, h) in enumerate(zip(part["doc_id"].to_pylist(), part["_h"].to_pylist(), strict=True)):
                    if out is None:
                        system, path = fs.FileSystem.from_uri(folder)
                        system.create_dir(path, recursive=True)
                        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.sst"
                        out = Writer(system.open_output_stream(f"{path}/{name}"), enc.width)
                    out.add(key_of(d, h), np.append(flat[first[i] : first[i + 1]], enc.kind.type(end)))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{folder}/{name}"], "docs": [out.docs], "tokens": [out.tokens]})

    return run


def write(docs: DataFrame, tokenizer: str, end: int, folder: str | None = None, shard_mb: int = 32) -> Output:
    """Writes the documents' token ids; ``folder`` is a URI that all executors share."""
    spark = docs.sparkSession
    folder = (folder or f"{_cuts.folder(spark)}/sstable-{uuid.uuid4().hex}").rstrip("/")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shards = max(1, min(_cuts.text_blocks(rows, block_mb=shard_mb), 1 << 20))
    rows = rows.withColumn("_h", F.coalesce(F.xxhash64("text"), F.lit(0)))
    order = (F.col("doc_id").asc_nulls_last(), F.col("_h"))
    rows = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    made = _cuts.written(rows.mapInArrow(_write(folder, tokenizer, end), "shard long, path string, docs long, tokens long"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    manifest = made.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    return Output(folder, _cuts.written(manifest))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            at, out = row["start"], []
            for doc_id, ids in Shard(row["path"]).scan():
                out.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                at += len(ids)
                if len(out) == 10_000:
                    yield _rows(out)
                    out = []
            yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in out], pa.int64()) for i, c in enumerate(("doc_id", "start", "n_tokens", "ids_crc32"))})


def read_back(output: Output) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    manifest = output.manifest
    n = max(1, math.ceil(manifest.count()))
    return manifest.select("shard", "path", "start").repartition(n, "shard").mapInArrow(_scan, "doc_id long, start long, n_tokens long, ids_crc32 long")
