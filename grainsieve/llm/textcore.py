"""Texts of an Arrow batch as bytes; words, their hashes and shingles, all in numpy.

Arrays are made for a few MB of text at a time (SLICE), whatever the size of the batch, so memory stays bounded by the
longest single text and not by the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20

_U = np.uint64
_MUL1, _MUL2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_R = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_RINV = pow(_R, -1, 1 << 64)
_pow: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> _U(30))
    x = x * _MUL1
    x ^= x >> _U(27)
    x *= _MUL2
    x ^= x >> _U(31)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    return mix(a * _U(0xD6E8FEB86659FD93) + (b ^ (b >> _U(29))) + _U(0x2545F4914F6CDD1D))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow.get("r", ())) < n:
        size = max(n, SLICE + 1)
        for key, base in (("r", _R), ("i", _RINV)):
            x = np.full(size, base, _U)
            x[0] = 1
            _pow[key] = np.multiply.accumulate(x)
    return _pow["r"][:n], _pow["i"][:n]


BYTE_HASH = mix(np.arange(1, 257, dtype=_U) * _U(0x632BE59BD9B4E019))


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows in a row, and the n+1 offsets; null: empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):  # no chunk at all
            col = pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most so many bytes; a longer row is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def pieces(batches, column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that a column's texts or lists have about `most` bytes or members in each; a longer row is a piece of its own."""
    for b in batches:
        c = b[column]
        size = pc.list_value_length(c) if pa.types.is_list(c.type) else pc.binary_length(c)
        off = np.concatenate(([0], np.cumsum(size.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))))
        for i, j in slices(off, most):
            yield b.slice(i, j - i)


def release() -> None:
    """Give what has been freed back to the machine: Python workers live on, and what one operator's largest task has needed would stay under the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_held: list = [None, None]


def held(key, make):
    """What a Python worker keeps from task to task: the last key's object only. Workers serve one operator after another, and what the others kept would stay."""
    if _held[0] != key:
        _held[:] = [None, None]
        _held[:] = [key, make()]
    return _held[1]


def forget() -> None:
    """Let go of what the worker keeps for another operator, for tasks that need the room."""
    _held[:] = [None, None]
    release()


def words(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes, never over the end of a row, and the n+1 offsets into them."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = is_word[buf]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes."""
    if not len(starts):
        return np.zeros(0, _U)
    up, down = _powers(len(buf))
    total = np.cumsum(BYTE_HASH[buf] * up)
    h = total[ends - 1]
    h = h - np.where(starts > 0, total[np.maximum(starts, 1) - 1], _U(0))
    return mix(h * down[starts] + (ends - starts).astype(_U))


def quoted(name: str) -> str:
    """A column name as it stands in expressions and schemas, whatever signs it has."""
    return "`" + name.replace("`", "``") + "`"


def map_batches(df, work, fields: list[tuple[str, str]]):
    """df.mapInArrow for columns of any names: Spark gets plain ones, as it cannot take a dot in a name here; `work` sees and makes the real ones."""
    names, made = df.columns, [n for n, _ in fields]

    def renamed(batches):
        try:
            for b in work(pa.RecordBatch.from_arrays(b.columns, names) for b in batches):
                yield pa.RecordBatch.from_arrays(b.columns, [f"c{k}" for k in range(len(made))])
        finally:
            release()

    plain = df.toDF(*(f"c{k}" for k in range(len(names))))
    return plain.mapInArrow(renamed, ", ".join(f"c{k} {kind}" for k, (_, kind) in enumerate(fields))).toDF(*made)


def fields_of(fields) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in fields]


def unused(name: str, names) -> str:
    """The name, or one like it that no column has; names are compared as Spark does, without regard to case."""
    had = {n.lower() for n in names}
    while name.lower() in had:
        name += "_"
    return name


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
