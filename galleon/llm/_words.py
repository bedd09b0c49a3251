"""Vectorised text primitives over Arrow batches: bytes, words and rolling hashes.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``.  A word's hash sums
its bytes, each times a coefficient of its place that the key draws at random (modulo
2**64): two different words collide with a probability below 2**-56 whatever they are,
as long as the key was not known when the text was written, so keys that decide results
are drawn for each run (``new_key``).  Byte ranges of running text have polynomial
prefix sums instead (``prefix``); these can collide by construction, so they only sort
candidates and never decide.  Equal strings always have equal hashes.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
STEP = np.uint64(0xD6E8FEB86659FD93)
NO_ID = np.iinfo(np.int64).max
INWORD = np.ones(256, bool)
INWORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SLICE = 2 << 20
KEPT = 4096  # places of words whose coefficients are kept
_powers = {BASE: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finisher; works in place on a fresh array."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        steps = np.full(max(n, SLICE + 1), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


class Texts(NamedTuple):
    """Concatenated bytes; text ``i`` is ``data[offsets[i]:offsets[i + 1]]``."""

    data: np.ndarray
    offsets: np.ndarray

    def slices(self, limit: int = SLICE) -> Iterator[tuple[int, int]]:
        """Runs of texts of about ``limit`` bytes, at least one text each."""
        n, a = len(self.offsets) - 1, 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(self.offsets, self.offsets[a] + limit, "right")) - 1)
            yield a, b
            a = b

    def bytes(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def texts(column: pa.ChunkedArray | pa.Array, order: np.ndarray | None = None) -> Texts:
    """The UTF-8 bytes of a string column; null is empty."""
    column = column.cast(pa.large_binary())
    if order is not None:
        column = column.take(pa.array(order))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.fill_null(b"")
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(data[at[0] : at[-1]], at - at[0])


def ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Integer ids; null comes after every id."""
    return column.cast(pa.int64()).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.cast(pa.int64()).fill_null(int(NO_ID)).to_numpy()


class Words(NamedTuple):
    """Words of many texts: byte ranges, hashes and each text's first word."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def stop(self) -> np.ndarray:
        """For each word, the number of the word after its text's last."""
        return np.repeat(self.first[1:], np.diff(self.first))


_coefficients: dict[int, np.ndarray] = {}


def new_key() -> int:
    """A key for one run, drawn on the driver and sent to all its tasks."""
    return secrets.randbits(62)


def coefficients(key: int, n: int) -> np.ndarray:
    """The key's random coefficients of the first ``n`` places of a word."""
    def made(n: int) -> np.ndarray:
        places = np.arange(n, dtype=np.uint64) * STEP + np.uint64(key)
        return mix(mix(places) + np.uint64(BASE))

    if n > KEPT:
        return made(n)
    if key not in _coefficients:
        if len(_coefficients) >= 8:
            _coefficients.clear()
        _coefficients[key] = made(KEPT)
    return _coefficients[key][:n]


def spans(x: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of bytes in which texts begin at ``edge``."""
    w = INWORD[x]
    s = w.copy()
    s[1:] &= ~w[:-1]
    edge = edge[edge < len(x)]
    s[edge] = w[edge]
    e = w
    e[:-1] &= ~INWORD[x[1:]] | s[1:]
    return np.flatnonzero(s), np.flatnonzero(e) + 1


def _hash(x: np.ndarray, start: np.ndarray, end: np.ndarray, key: int) -> np.ndarray:
    if not len(start):
        return np.zeros(0, np.uint64)
    longest = int((end - start).max())
    first = int(start[0])
    place = np.arange(len(x) - first)
    place -= np.repeat(start - first, np.diff(np.append(start, len(x))))
    np.minimum(place, longest - 1, out=place)
    v = coefficients(key, longest)[place]
    del place
    byte = x[first:].astype(np.uint64)
    byte += np.uint64(1)
    v *= byte
    sums = np.zeros(len(v) + 1, np.uint64)
    np.cumsum(v, out=sums[1:])
    return mix(sums[end - first] - sums[start - first])


def words(t: Texts, lower: bool = False, key: int = 0) -> Words:
    starts, ends, hashes = [], [], []
    for a, b in t.slices():
        lo, hi = int(t.offsets[a]), int(t.offsets[b])
        if lo == hi:
            continue
        x = t.data[lo:hi]
        if lower:
            x = LOWER[x]
        st, en = spans(x, t.offsets[a:b] - lo)
        hashes.append(_hash(x, st, en, key))
        starts.append(st + lo)
        ends.append(en + lo)
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    start = join(starts, np.int64)
    return Words(start, join(ends, np.int64), join(hashes, np.uint64), np.searchsorted(start, t.offsets))


def rehash(t: Texts, w: Words, lower: bool = False, key: int = 1) -> np.ndarray:
    """The words' hashes under another key."""
    found = []
    for a, b in t.slices():
        lo, hi = int(t.offsets[a]), int(t.offsets[b])
        p, q = int(w.first[a]), int(w.first[b])
        if p < q:
            x = t.data[lo:hi]
            found.append(_hash(LOWER[x] if lower else x, w.start[p:q] - lo, w.end[p:q] - lo, key))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def order2(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the pairs (h, g), stable, and where runs of equal pairs begin in it."""
    order = np.argsort(h, kind="stable")
    for again in (False, True):
        if again:
            order = np.lexsort((g, h))
        x, y = h[order], g[order]
        same, other = x[1:] == x[:-1], y[1:] != y[:-1]
        if again or not (same & other).any():
            break
    new = np.ones(len(h), bool)
    new[1:] = ~same | other
    return order, np.flatnonzero(new)


def find2(h: np.ndarray, g: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the pairs (x, y), all of which are there, among ordered pairs (h, g)."""
    at = np.searchsorted(h, x)
    while (late := g[at] != y).any():
        at[late] += 1
    return at


def prefix(x: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over bytes: the hash of ``x[a:b]`` is
    ``(sums[b] - sums[a]) * powers(INVERSE)[a]``."""
    v = x.astype(np.uint64)
    v += np.uint64(1)
    v *= powers(BASE, len(x))
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(v, out=sums[1:])
    return sums


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of ``k`` consecutive word hashes at every start."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    r = h[:n].copy()
    for j in range(1, k):
        r *= STEP
        r += h[j : j + n]
    return mix(r)


def whole(w: Words, k: int) -> np.ndarray:
    """Starts of the windows of ``k`` words that lie in one text."""
    n = max(0, len(w.hash) - k + 1)
    return np.flatnonzero(np.arange(n) + k <= w.stop()[:n])


def covered(starts: np.ndarray, length: np.ndarray | int, n: int) -> np.ndarray:
    """Mask of ``n`` places: those within ``length`` of a start."""
    d = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(starts + length, minlength=n + 1)[: n + 1]
    return np.cumsum(d)[:n] > 0


def heads(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in a sorted array."""
    if not len(x):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))


def member(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Mask of ``x`` by a sorted array."""
    if not len(among):
        return np.zeros(len(x), bool)
    at = np.searchsorted(among, x)
    at[at == len(among)] = 0
    return among[at] == x


def u64(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The rows of a binary column as arrays of unsigned 64-bit integers."""
    return [np.frombuffer(x.as_py() or b"", np.uint64) for x in column]


def planes(x: np.ndarray) -> bytes:
    """64-bit integers as their first bytes, then their second ones, ...: sorted or small ones compress well so."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(column: pa.ChunkedArray, kind: type = np.uint64) -> list[np.ndarray]:
    """The rows of a binary column written by ``planes``."""
    raw = (np.frombuffer(x.as_py() or b"", np.uint8) for x in column)
    return [np.ascontiguousarray(x.reshape(8, -1).T).view(kind).ravel() for x in raw]
