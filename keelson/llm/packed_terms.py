"""Terms of texts counted in numpy by length: short ones packed into one or two 64-bit words, long ones as byte strings.

A run of documents is looked at as one array of bytes. Terms of up to eight bytes are one unsigned word, those of up to
sixteen two; each bucket of lengths is ordered by least-significant-digit radix sort over 16-bit digits and its runs are
counted. Longer terms are sorted as byte strings in buckets of the powers of two, so padding at most doubles them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are counted at once; a longer text is cut between terms and its pieces are added up.
RUN_BYTES = 6 << 20
PACKED = 16
# Term bytes are letters and everything beyond ASCII; A-Z are lower-cased, other bytes part terms (0).
TERM_BYTE = np.zeros(256, np.uint8)
TERM_BYTE[0x41:0x5B] = np.arange(0x61, 0x7B)
TERM_BYTE[0x61:0x7B] = np.arange(0x61, 0x7B)
TERM_BYTE[0x80:] = np.arange(0x80, 0x100)


def term_places(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and document number of every term; documents are the given stretches and terms stay within one."""
    inside = data != 0
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    held = ends > starts
    opens[starts[held]] = inside[starts[held]]
    closes[ends[held] - 1] = inside[ends[held] - 1]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    return first, last + 1 - first, np.searchsorted(starts, first, "right") - 1


def packed(data: np.ndarray, first: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """A row of ``width`` bytes per term, filled up with zeros."""
    reach = first[:, None] + np.arange(width)
    cells = data[np.minimum(reach, len(data) - 1)]
    cells[np.arange(width) >= length[:, None]] = 0
    return cells


def radix_order(words: list[np.ndarray], digits: int, order: np.ndarray) -> np.ndarray:
    """Stable order by unsigned words, the most significant first; only their ``digits`` leading 16-bit digits count."""
    for number in range(digits - 1, -1, -1):
        word, shift = words[number // 4], np.uint64(48 - 16 * (number % 4))
        digit = ((word >> shift) & np.uint64(0xFFFF)).astype(np.uint16)
        if digit.size and digit.min() != digit.max():
            order = order[np.argsort(digit[order], kind="stable")]
    return order


def counted(data: np.ndarray, first: np.ndarray, length: np.ndarray, doc: np.ndarray, group: np.ndarray) -> Iterator[tuple]:
    """Per bucket: place and length of a term, its group, how often it stands there, and in how many documents.

    ``group`` is the group number of each document; documents come in order, so equal terms keep that order.
    """
    bounds = [(low, low + 2) for low in range(0, PACKED, 2)]
    longest = int(length.max(initial=0))
    while bounds[-1][1] < longest:
        bounds.append((bounds[-1][1], bounds[-1][1] * 2))
    for low, high in bounds:
        held = np.flatnonzero((length > low) & (length <= high))
        if not held.size:
            continue
        at, size, docs = first[held], length[held], doc[held]
        groups = group[docs]
        if high <= PACKED:
            cells = packed(data, at, size, 8 if high <= 8 else 16)
            words = list(cells.view(">u8").astype(np.uint64).T)
            order = radix_order(words, high // 2, np.arange(held.size))
            keys = [w[order] for w in words]
        else:
            cells = packed(data, at, size, high).view(f"S{high}").ravel()
            order = np.argsort(cells, kind="stable")
            keys = [cells[order]]
        for shift in range(0, max(int(groups.max()).bit_length(), 1), 16):
            digit = ((groups[order] >> shift) & 0xFFFF).astype(np.uint16)
            by_group = np.argsort(digit, kind="stable")
            order, keys = order[by_group], [k[by_group] for k in keys]
        groups, docs = groups[order], docs[order]
        new = np.ones(order.size, bool)
        new[1:] = groups[1:] != groups[:-1]
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
        new_doc = new.copy()
        new_doc[1:] |= docs[1:] != docs[:-1]
        runs = np.flatnonzero(new)
        yield (at[order[runs]], size[order[runs]], groups[runs], np.diff(np.append(runs, order.size)),
               np.add.reduceat(new_doc.astype(np.int64), runs))


def gathered(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array:
    """The terms at some places, as Arrow binaries."""
    ends = np.cumsum(size)
    every = np.repeat(at - (ends - size), size) + np.arange(ends[-1] if ends.size else 0)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[every]))])


def tables(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, group: np.ndarray) -> Iterator[tuple]:
    """``(group, term, n, docs)`` arrays of a run of documents."""
    first, length, doc = term_places(data, starts, ends)
    for at, size, groups, n, docs in counted(data, first, length, doc, group):
        yield groups, gathered(data, at, size), n, docs


def long_text(data: np.ndarray, group: int, piece: int) -> Iterator[tuple]:
    """The same for one text cut between terms; its terms are added up, as the text is a single document."""
    total, low = {}, 0
    while low < len(data):
        high = min(low + piece, len(data))
        while high < len(data) and data[high]:
            parting = np.flatnonzero(data[high:high + piece] == 0)
            high += int(parting[0]) if parting.size else min(piece, len(data) - high)
        part = data[low:high]
        for _, terms, n, _ in tables(part, np.array([0]), np.array([len(part)]), np.array([0])):
            for term, times in zip(terms.to_pylist(), n.tolist()):
                total[term] = total.get(term, 0) + times
        low = high
    if total:
        yield (np.full(len(total), group), pa.array(list(total), pa.binary()), np.fromiter(total.values(), np.int64),
               np.ones(len(total), np.int64))


def batch_tables(texts: pa.Array, group: np.ndarray, run_bytes: int = RUN_BYTES) -> Iterator[tuple]:
    """``(group, term, n, docs)`` arrays of a batch of texts (binaries without NULL) in runs of bounded size."""
    _, offsets, values = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    held = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(texts):
        high = max(int(np.searchsorted(offsets, offsets[low] + run_bytes, "right")) - 1, low + 1)
        data = TERM_BYTE[held[offsets[low]:offsets[high]]]
        if high == low + 1 and len(data) > run_bytes:
            yield from long_text(data, int(group[low]), run_bytes)
        elif len(data):
            edges = offsets[low:high + 1] - offsets[low]
            # Empty texts hold no term; left out, as two documents must not begin at one place.
            full = np.flatnonzero(edges[1:] > edges[:-1])
            yield from tables(data, edges[:-1][full], edges[1:][full], group[low:high][full])
        low = high
