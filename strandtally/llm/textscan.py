"""Vectorised word scanning of Arrow string columns.

Words are found and hashed on the UTF-8 bytes of many texts at once, half a MB at a time, so that memory stays bounded by the largest single text.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SCAN_BYTES = 1 << 19
SPACE = 32
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[str, np.ndarray] = {}


def pieces(batch, rows: int = 256):
    """A record batch or array in slices of so many rows: Python objects of one slice at a time exist."""
    for at in range(0, len(batch), rows):
        yield batch.slice(at, rows)


def give_back() -> None:
    """Return freed memory to the system; a worker that waits for its next task then holds little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


_remembered: dict[str, Callable[[], None]] = {}


def take_turn(name: str, forget: Callable[[], None] | None = None) -> None:
    """Let go of what other operators have remembered in this worker; ``forget`` does that for the caller later."""
    for other in [k for k in _remembered if k != name]:
        _remembered.pop(other)()
    if forget:
        _remembered[name] = forget
    give_back()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_map(separators: bytes) -> np.ndarray:
    """Byte to byte: A-Z lower-cased, separators (of which the space is one) to the space, all others themselves."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    out[np.frombuffer(separators, np.uint8)] = SPACE
    return out


#: Words are runs of anything but these: ``[^\x20\x09-\x0D]+``.
SPACE_WORDS = byte_map(b" \t\n\x0b\x0c\r")
#: Words are runs of ASCII letters and digits and of all characters beyond ASCII.
ALNUM_WORDS = byte_map(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = np.full(max(n, SCAN_BYTES + 1), _R if kind == "up" else _R_INV, dtype=np.uint64)
        base[0] = 1
        have = np.multiply.accumulate(base)
        if n <= 4 * SCAN_BYTES:
            _powers[kind] = have
    return have


@dataclass
class Words:
    """Words of consecutive texts ``first..first+n-1`` of a column."""

    first: int
    n_texts: int
    data: np.ndarray  #: mapped bytes
    start: np.ndarray  #: of each word, in ``data``
    end: np.ndarray
    text: np.ndarray  #: index of each word's text, from 0
    bounds: np.ndarray  #: word range of each text, n_texts + 1 values
    raw: np.ndarray  #: the bytes as they are in the column
    _hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            up, down = _power("up", len(self.data) + 1), _power("down", len(self.data) + 1)
            total = np.zeros(len(self.data) + 1, dtype=np.uint64)
            np.cumsum(_BYTE_VALUES[self.data] * up[: len(self.data)], out=total[1:])
            self._hash = mix((total[self.end] - total[self.start]) * down[self.start])
        return self._hash

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def scan(column: pa.Array, table: np.ndarray) -> Iterator[Words]:
    """Word ranges of every text, in order; null counts as empty."""
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SCAN_BYTES, side="right")) - 1)
        bounds = offsets[at : to + 1] - offsets[at]
        data = table[raw[offsets[at] : offsets[to]]]
        inside = data != SPACE
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[bounds] = True
        before, after = np.ones(len(data), dtype=bool), np.ones(len(data), dtype=bool)
        if len(data):
            before[1:] = ~inside[:-1]
            after[:-1] = ~inside[1:]
        start = np.flatnonzero(inside & (before | cut[:-1]))
        end = np.flatnonzero(inside & (after | cut[1:])) + 1
        ranges = np.searchsorted(start, bounds)
        text = np.repeat(np.arange(to - at), np.diff(ranges))
        yield Words(at, to - at, data, start, end, text, ranges, raw[offsets[at] : offsets[to]])
        at = to
