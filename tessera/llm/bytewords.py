"""Words of many texts at once, in numpy over their UTF-8 bytes: for use inside Arrow batches of a Spark task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd, so that its powers have inverses modulo 2**64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: Bytes of texts that are handled in one numpy pass.
BLOCK_BYTES = 1 << 19

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

#: Digits, letters a to z and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, starts) of runs of texts of about most bytes; a null counts as empty.

    Each text is followed by one line feed in bytes; starts has one entry more than there are texts. A long text has a
    run of its own and is never cut.
    """
    column = pc.fill_null(column.cast(pa.large_string()), "")
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    at, n = 0, len(sizes)
    while at < n:
        end, total = at, 0
        while end < n and (end == at or total + sizes[end] <= most):
            total += int(sizes[end])
            end += 1
        part = column.slice(at, end - at)
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        raw = np.frombuffer(part.buffers()[2] or b"", np.uint8)
        starts = np.zeros(len(part) + 1, np.int64)
        np.cumsum(sizes[at:end] + 1, out=starts[1:])
        buf = np.full(int(starts[-1]), 10, np.uint8)
        for k in range(len(part)):
            buf[starts[k] : starts[k] + sizes[at + k]] = raw[offsets[k] : offsets[k + 1]]
        yield at, end, buf, starts
        at = end


def spans(buf: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that kind marks."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = kind[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        out = np.full(max(n, BLOCK_BYTES + (1 << 16)), _BASE if kind == "up" else _BACK, np.uint64)
        out[0] = 1
        _powers[kind] = np.multiply.accumulate(out)
    return _powers[kind]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, from one running sum over the buffer."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    run = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(buf.astype(np.uint64) * _power("up", len(buf))[: len(buf)], out=run[1:])
    return mix((run[ends] - run[starts]) * _power("down", len(buf))[starts])


def owners(positions: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The text of each position: starts as blocks() gives them, positions ascending."""
    return np.searchsorted(starts, positions, "right") - 1
