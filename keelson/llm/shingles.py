"""Distinct word shingles of whole texts as 64-bit hashes, computed over arrays of bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Texts are worked on in runs of so many bytes (or one longer text at a time).
RUN_BYTES = 1 << 19
ROOT = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(root: int, n: int) -> np.ndarray:
    steps = np.full(n, root, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


class Hasher:
    """Word hashes are sums over bytes, so that one pass over a run serves all its texts."""

    def __init__(self, gaps: np.ndarray | None = None) -> None:
        """``gaps`` marks the bytes that separate words; white space if not given."""
        self.bytes = mixed(np.arange(1, 257, dtype=np.uint64) * ROOT)
        code = np.arange(256)
        self.gaps = (code == 32) | ((code >= 9) & (code <= 13)) if gaps is None else gaps
        self.size = 0

    def words(self, data: np.ndarray, bounds: np.ndarray, first_bytes: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word (or of its first bytes only) and the number of words per text. A-Z count as a-z."""
        if len(data) > self.size:
            self.size = max(len(data), RUN_BYTES)
            self.up = _powers(int(ROOT), self.size)
            self.down = _powers(pow(int(ROOT), -1, 1 << 64), self.size)
        gap = self.gaps[data]
        first = ~gap
        edge = gap.copy()
        edge[-1:] = False
        first[1:] &= edge[:-1]
        at = bounds[:-1][(bounds[:-1] < bounds[1:])]
        first[at] |= ~gap[at]
        starts = np.flatnonzero(first)
        if not len(starts):
            return np.empty(0, np.uint64), np.zeros(len(bounds) - 1, np.int64)
        low = data + np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
        value = self.bytes[low] * self.up[: len(data)]
        value[gap] = 0
        if first_bytes:
            place = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(starts, append=len(data)))
            value[starts[0]:][place >= first_bytes] = 0
        hashes = mixed(np.add.reduceat(value, starts) * self.down[starts])
        return hashes, np.diff(np.searchsorted(starts, bounds))


def sets_of(hasher: Hasher, data: np.ndarray, bounds: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each text; a text with fewer than ``n`` words has its whole sequence as one."""
    words, counts = hasher.words(data, bounds)
    total = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
    for k in range(n):
        total += words[k:k + len(total)] * (mixed(np.array([k + 1], np.uint64))[0] | np.uint64(1))
    total = mixed(total)
    out, at = [], 0
    for c in counts.tolist():
        if c >= n:
            out.append(np.unique(total[at:at + c - n + 1]))
        elif c:
            odd = mixed(np.arange(1, c + 1, dtype=np.uint64)) | np.uint64(1)
            out.append(mixed((words[at:at + c] * odd).sum(keepdims=True) + np.uint64(c)))
        else:
            out.append(words[:0])
        at += c
    return out


def text_runs(text: pa.Array):
    """Position of the first text, bytes and bounds of every run of texts. NULL counts as empty."""
    text = text.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset:text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], dtype=np.uint8) if text.buffers()[2] else np.empty(0, np.uint8)
    at = 0
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + RUN_BYTES, "right")) - 1)
        end = min(end, len(text))
        low, high = int(offsets[at]), int(offsets[end])
        yield at, data[low:high], offsets[at:end + 1] - low
        at = end


def batch_sets(hasher: Hasher, text: pa.Array, n: int):
    """Position of the first text and the sets of the texts, per run of the batch."""
    for at, data, bounds in text_runs(text):
        yield at, sets_of(hasher, data, bounds, n)
