"""Unigram lattices over the pieces of a public vocabulary, shared in a trie of pre-tokens.

The score of a piece falls with the logarithm of its rank. A pre-token is a run without white space together with the
space before it, or one white-space character; ``▁`` stands for a space, and characters that the vocabulary lacks
(``▁`` itself among them) are spelt as byte pieces, so decoding gives back every text as it was.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from keelson.llm.shingles import mixed

SPACE, MARK = "▁", "\ud800"
#: A longer run without white space is segmented in stretches of so many characters.
LONGEST = 128
UNITS = re.compile(r"\x20?[^\x20\x09-\x0D]{1,%d}|[\x20\x09-\x0D]" % LONGEST)
#: Characters of a part of a trie that is worked on at once; pre-tokens whose counts and nodes whose choices are remembered.
#: Beyond these a task starts anew: they bound memory and change no result.
CELLS, MOST_KNOWN, MOST_NODES = 400_000, 600_000, 300_000


class Vocabulary:
    """Pieces with scores. ``path`` names a SentencePiece model with byte pieces."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.texts = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        plain = [i for i in range(len(self.texts)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.bytes = {int(self.texts[i][1:-1], 16): i for i in range(len(self.texts)) if model.is_byte(i)}
        self.scores = {self.texts[i]: (i, -math.log(rank + 2)) for rank, i in enumerate(plain)}
        self.byte_score = -math.log(len(self.texts)) - 10
        # Built once and sent to the tasks as arrays.
        self.endings = Endings(list(self.scores))


class Endings:
    """Which pieces end at a place, as an automaton over the characters read so far; all lookups are on arrays."""

    def __init__(self, pieces: list[str]) -> None:
        tree: dict[int, int] = {}
        ends: list[list[int]] = [[]]
        edges: list[list[tuple[int, int]]] = [[]]
        for number, piece in enumerate(pieces):
            at = 0
            for char in map(ord, piece):
                after = tree.get(at << 21 | char)
                if after is None:
                    after = tree[at << 21 | char] = len(ends)
                    ends.append([])
                    edges[at].append((char, after))
                    edges.append([])
                at = after
            ends[at].append(number)
        shorter, queue = [0] * len(ends), [after for _, after in edges[0]]
        for at in queue:
            for char, after in edges[at]:
                back = shorter[at]
                while back and back << 21 | char not in tree:
                    back = shorter[back]
                shorter[after] = tree.get(back << 21 | char, 0)
                queue.append(after)
            ends[at] = ends[at] + ends[shorter[at]]
        keys = np.array(list(tree), dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.after = keys[order], np.array(list(tree.values()), dtype=np.int64)[order]
        self.shorter = np.array(shorter)
        self.many = np.array([len(e) for e in ends])
        self.first = np.cumsum(self.many) - self.many
        self.numbers = np.array([n for e in ends for n in e], dtype=np.int64)
        self.lengths = np.array([len(p) for p in pieces], dtype=np.int64)[self.numbers]

    def step(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(states), dtype=np.int64), np.arange(len(states))
        while len(todo):
            key = states << 21 | chars
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[place] == key
            out[todo[hit]] = self.after[place[hit]]
            on = ~hit & (states > 0)
            todo, chars, states = todo[on], chars[on], self.shorter[states[on]]
        return out


def piece_form(unit: str) -> str:
    """The pre-token as pieces spell it; a ``▁`` of the text becomes a character that no piece has."""
    return unit.replace(SPACE, MARK).replace(" ", SPACE) if SPACE in unit else unit.replace(" ", SPACE)


class Trie:
    """Distinct pre-tokens in a trie, worked on level by level: each prefix that several share is scored once.

    In sorted order a pre-token adds the nodes beyond what it shares with the one before it. ``known`` keeps what each
    pre-token came to.
    """

    def __init__(self, endings: Endings) -> None:
        self.endings = endings
        self.known: dict[str, int] = {}

    def grow(self, units) -> None:
        """Adds the pre-tokens, which must be new, in parts of bounded size."""
        by_form = sorted((piece_form(u), u) for u in units)
        width = max((len(f) for f, _ in by_form), default=1)
        part = max(1, CELLS // width)
        for at in range(0, len(by_form), part):
            forms, names = zip(*by_form[at:at + part], strict=True)
            self.known.update(zip(names, self.part(list(forms)), strict=True))

    def part(self, forms: list[str]) -> list[int]:
        sizes = np.array(list(map(len, forms)))
        width = int(sizes.max())
        chars = np.array(forms, dtype=f"<U{width}").view(np.uint32).reshape(len(forms), width).astype(np.int64)
        same = np.zeros(len(forms), dtype=np.int64)
        if len(forms) > 1:
            differ = chars[1:] != chars[:-1]
            same[1:] = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), width), np.minimum(sizes[1:], sizes[:-1]))
        nodes = np.zeros((len(forms), width + 1), dtype=np.int32)
        states = np.zeros(1 + int((sizes - same).sum()), dtype=np.int64)
        self.begin(len(states))
        made = 1
        for depth in range(width):
            new = np.flatnonzero((same <= depth) & (sizes > depth))
            if len(new):
                ids, parents, char = np.arange(made, made + len(new)), nodes[new, depth], chars[new, depth]
                made += len(new)
                now = states[ids] = self.endings.step(states[parents], char)
                many = self.endings.many[now]
                which = np.repeat(np.arange(len(new)), many)
                flat = np.repeat(self.endings.first[now] - (np.cumsum(many) - many), many) + np.arange(len(which))
                before = nodes[new[which], depth + 1 - self.endings.lengths[flat]]
                self.level(ids, parents, char, many, which, before, self.endings.numbers[flat])
                last = np.zeros(len(forms), dtype=np.int64)
                last[new] = new
                nodes[new, depth + 1] = ids
                nodes[:, depth + 1] = nodes[np.maximum.accumulate(last), depth + 1]
        return self.done(nodes[np.arange(len(forms)), sizes])


class Viterbi(Trie):
    """Number of pieces of the best segmentation. Of equally good ones that with fewer pieces counts."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__(vocabulary.endings)
        # Score and number of pieces in one whole number: sums and ties are exact.
        self.value = np.array([(round(s * (1 << 20)) << 12) - 1 for _, s in vocabulary.scores.values()], dtype=np.int64)
        self.byte = (round(vocabulary.byte_score * (1 << 20)) << 12) - 1

    def begin(self, n: int) -> None:
        self.best = np.zeros(n, dtype=np.int64)

    def level(self, ids, parents, char, many, which, before, numbers) -> None:
        total, some = self.best[before] + self.value[numbers], many > 0
        if len(total):
            self.best[ids[some]] = np.maximum.reduceat(total, (np.cumsum(many) - many)[some])
        # All characters of pieces are pieces, so one that ends none can only be spelt.
        lost = ~some
        self.best[ids[lost]] = self.best[parents[lost]] + spelt_sizes(char[lost]) * self.byte

    def done(self, nodes: np.ndarray) -> list[int]:
        return (-self.best[nodes] & 0xFFF).tolist()

    def counts(self, units: list[list[str]]) -> list[int]:
        """Pieces of each list of pre-tokens."""
        if len(self.known) > MOST_KNOWN:
            self.known = {}
        self.grow(set().union(*units).difference(self.known))
        return [sum(map(self.known.__getitem__, own)) for own in units]


class Sampler(Trie):
    """Forward filtering on the trie, backward sampling over arrays.

    A node is a prefix: its choices are the pieces that may end there, each with the node before it and its probability
    given all ways to the prefix. Weights are scaled by a constant per character, which all ways to a prefix share;
    spelling has weight 1, as a character is spelt on every way or on none.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__(vocabulary.endings)
        self.weight = np.array([math.exp(s + 6 * len(p)) for p, (_, s) in vocabulary.scores.items()])
        self.ids = np.array([i for i, _ in vocabulary.scores.values()], dtype=np.int32)
        self.clear()

    def clear(self) -> None:
        self.known, self.size, self.parts = {}, 1, []
        self.bounds, self.before, self.piece = np.empty(0), np.empty(0, np.int32), np.empty(0, np.int32)

    def begin(self, n: int) -> None:
        self.forward = np.zeros(n)
        self.forward[0] = 1.0

    def level(self, ids, parents, char, many, which, before, numbers) -> None:
        weight, some = self.forward[before] * self.weight[numbers], many > 0
        lost = ~some
        self.forward[ids[lost]] = self.forward[parents[lost]]
        if len(weight):
            firsts = (np.cumsum(many) - many)[some]
            total = np.add.reduceat(weight, firsts)
            self.forward[ids[some]] = total
            share = np.cumsum(weight / np.repeat(total, many[some]))
            bound = share - np.repeat(np.concatenate([[0.0], share])[firsts], many[some])
            bound[firsts + many[some] - 1] = 1.0
            self.keep(ids[which], before, self.ids[numbers], bound)
        code = np.where(char[lost] == ord(MARK), ord(SPACE), char[lost])
        self.keep(ids[lost], parents[lost], -1 - code, np.ones(int(lost.sum())))

    def keep(self, node, before, piece, bound) -> None:
        shift = self.size - 1
        # Half the width is enough for nodes, of which there are few millions, and for pieces.
        self.parts.append(((node + shift).astype(np.int32), np.where(before > 0, before + shift, 0).astype(np.int32), piece.astype(np.int32), bound))

    def done(self, nodes: np.ndarray) -> list[int]:
        node, before, piece, bound = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(node, kind="stable")
        self.bounds = np.concatenate([self.bounds, node[order] + np.minimum(bound[order], 1.0)])
        self.before, self.piece = np.concatenate([self.before, before[order]]), np.concatenate([self.piece, piece[order]])
        out = (nodes + self.size - 1).tolist()
        self.size, self.parts = self.size + len(self.forward) - 1, []
        return out

    def sample(self, nodes: np.ndarray, seeds: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece of every step of every pre-token, in order, and the number of pieces of each.

        The number drawn depends on the row's seed, the pre-token's place and the step alone. A negative piece is a
        character that has to be spelt in bytes.
        """
        live, now, steps, step = np.arange(len(nodes)), nodes, [], 0
        length = np.zeros(len(nodes), dtype=np.int64)
        while len(live):
            draw = uniform(seeds[live], places[live], step) * (1 - 1e-9)
            pick = np.searchsorted(self.bounds, now + draw, "right")
            steps.append((live, self.piece[pick]))
            length[live] += 1
            now = self.before[pick]
            on = now > 0
            live, now, step = live[on], now[on], step + 1
        ends = np.cumsum(length)
        out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
        for step, (who, what) in enumerate(steps):
            out[ends[who] - 1 - step] = what
        return out, length


def spelt_sizes(codes: np.ndarray) -> np.ndarray:
    """Bytes of characters; the stand-in for ``▁`` has three, as that has."""
    return 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)


def uniform(seeds: np.ndarray, places: np.ndarray, step: int) -> np.ndarray:
    x = mixed(seeds + mixed(places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step + 1)))
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def spell(pieces: np.ndarray, bytes_of: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids with spelt characters written out, and how many ids each entry became."""
    odd = np.flatnonzero(pieces < 0)
    sizes = np.ones(len(pieces), dtype=np.int64)
    if not len(odd):
        return pieces, sizes
    codes, which = np.unique(-1 - pieces[odd], return_inverse=True)
    raw = [chr(c).encode("utf-8", "surrogatepass") for c in codes.tolist()]
    lengths = np.array([len(r) for r in raw])
    grid = np.array([[bytes_of[r[k]] if k < len(r) else 0 for k in range(4)] for r in raw])
    sizes[odd] = lengths[which]
    out = np.repeat(pieces, sizes)
    first = np.cumsum(sizes) - sizes
    for k in range(4):
        has = lengths[which] > k
        out[first[odd[has]] + k] = grid[which[has], k]
    return out, sizes


class Decoder:
    """Texts of lists of piece ids: the bytes of the pieces are taken for all lists at once and stand in order."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        own = [t.replace(SPACE, " ").encode() for t in vocabulary.texts]
        for value, i in vocabulary.bytes.items():
            own[i] = bytes([value])
        self.bytes = pa.array(own, pa.large_binary())

    def texts(self, ids: pa.ListArray) -> pa.Array:
        """One text for each list; a NULL list gives an empty one, NULL ids give nothing."""
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        taken = self.bytes.take(ids.flatten())
        _, offsets, data = taken.buffers()
        ends = np.frombuffer(offsets, dtype=np.int64)[:len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
        bounds = ends[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
        return pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(np.ascontiguousarray(bounds)), data or pa.py_buffer(b"")).cast(pa.string())
