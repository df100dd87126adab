"""Array helpers that run inside tasks: chunks of whole texts and hashes of words and windows.

Texts are handled as UTF-8 bytes in chunks of a bounded size, so a task holds a few arrays over one
chunk and never over its whole partition. A text longer than a chunk is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
WORDS = 5
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def as_bytes(column: pa.Array) -> list[bytes]:
    """The values of a string or binary column as bytes; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [b"" if v is None else v for v in column.cast(kind).to_pylist()]


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of whole texts with at most ``limit`` bytes each (or one longer text)."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser; ``salt`` picks one of many independent functions."""
    z = x + _U((salt * 0xD1B54A32D192ED03 + _BASE) & (2**64 - 1))
    z ^= z >> _U(30)
    z *= _U(0xBF58476D1CE4E5B9)
    z ^= z >> _U(27)
    z *= _U(0x94D049BB133111EB)
    z ^= z >> _U(31)
    return z


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int = 0x5851F42D4C957F2D):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(0, dtype=_U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES + 4096)
            up, down = np.full(size, self.base, dtype=_U), np.full(size, self.inverse, dtype=_U)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
        return self.up[:n], self.down[:n]


POWERS, MORE_POWERS = Powers(), Powers(0x2545F4914F6CDD1D)


def prefix_hash(data: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    """Running polynomial sums; ``span_hash`` takes the hash of any span from them."""
    up, _ = powers.get(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum((data.astype(_U) + _U(1)) * up[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    _, down = powers.get(len(prefix))
    return (prefix[stop] - prefix[start]) * down[start]


def next_hash(prefix: np.ndarray, size: int, powers: Powers = POWERS) -> np.ndarray:
    """The hash of the ``size`` bytes from every place on that has as many."""
    n = len(prefix) - size
    _, down = powers.get(len(prefix))
    return (prefix[size:] - prefix[:n]) * down[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every word of the chunk; words are runs of bytes other than ASCII white space."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = _SPACE[joined]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, stops = edge[0::2], edge[1::2]
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
    return owner, mix(span_hash(prefix_hash(joined), starts, stops) + (stops - starts).astype(_U))


def shingle_hashes(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct ``words``-word shingles of each text, sorted.

    ASCII capitals are folded. A text with fewer words has its whole sequence as its one shingle.
    """
    owner, h = word_hashes([t.lower() for t in texts])
    n = len(h)
    count = np.bincount(owner, minlength=len(texts))
    many = max(n - words + 1, 0)
    value = np.zeros(many, dtype=_U)
    for j in range(words):
        value += mix(h[j : j + many], j + 1)
    whole = owner[:many] == owner[words - 1 :] if many else np.zeros(0, dtype=bool)
    ids, vals = owner[:many][whole], mix(value[whole], 101)
    few = np.flatnonzero((count > 0) & (count < words))
    if len(few):
        first = np.searchsorted(owner, few)
        extra = np.zeros(len(few), dtype=_U)
        for j in range(words - 1):
            has = count[few] > j
            extra[has] += mix(h[first[has] + j], j + 1)
        ids, vals = np.concatenate([ids, few]), np.concatenate([vals, mix(extra + count[few].astype(_U), 103)])
    order = np.lexsort((vals, ids))
    ids, vals = ids[order], vals[order]
    fresh = np.ones(len(ids), dtype=bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (vals[1:] != vals[:-1])
    return ids[fresh], vals[fresh]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
