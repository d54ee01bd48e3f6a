"""Weighted acyclic automata over words: sets of equally long paths, each with a count.

States lie in depths; the arcs of a state are ordered by label, and equal states (the same labels leading to
the same states) are one state. Each arc carries the number of paths that come before it in its state, so a
path's numbers add up to its place among all paths, where its count stands. Sharing states costs no count.

An automaton is built from sorted paths, a depth at a time from the last: all states of a depth are finished
together, once those below them are. Labels of depth 0 index ``heads``, all others ``words``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from hazardframe.llm import textbytes as tb


def _one_of_each(sizes: np.ndarray, first: np.ndarray, label: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each state its class: states of equal arcs share one, classes are numbered by their first state."""
    within = np.arange(len(label)) - np.repeat(first, sizes)
    factors = tb.randoms(int(sizes.max()), 11)[within]
    arcs = tb.mix(label.astype(np.uint64) * tb.U64(0x9E3779B97F4A7C15) + target.astype(np.uint64))
    hashes = np.add.reduceat(arcs * factors, first) + sizes.astype(np.uint64)
    _, one, of = np.unique(hashes, return_index=True, return_inverse=True)
    one = one[of]
    # compared arc by arc with the state it stands for; where a hash misleads, the state stays by itself
    alike = sizes == sizes[one]
    beside = np.repeat(np.where(alike, first[one], first), sizes) + within
    alike &= np.logical_and.reduceat((label == label[beside]) & (target == target[beside]), first)
    one = np.where(alike, one, np.arange(len(sizes)))
    kept = np.zeros(len(sizes), bool)
    kept[one] = True
    return (np.cumsum(kept) - 1)[one]


def narrow(x: np.ndarray) -> bytes:
    """Numbers from 0 on as unsigned ones of the fewest bytes, after a byte that says how many."""
    kind = np.min_scalar_type(int(x.max(initial=0)))
    return bytes([kind.itemsize]) + x.astype(kind).tobytes()


def widened(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{data[0]}", offset=1).astype(np.int64)


@dataclass
class CountAutomaton:
    """``first[d]`` has where each state's arcs begin at depth d (and their end), ``label[d]`` and ``target[d]`` the arcs."""

    heads: list[str]
    words: pa.Array
    first: list[np.ndarray]
    label: list[np.ndarray]
    target: list[np.ndarray]
    counts: np.ndarray

    @classmethod
    def build(cls, heads: list[str], words: pa.Array, paths: np.ndarray, counts: np.ndarray) -> CountAutomaton:
        """From distinct sorted paths (a row each, labels in the columns) and their counts."""
        depth = paths.shape[1]
        first, label, target = [None] * depth, [None] * depth, [None] * depth
        changed = np.ones((len(paths), depth), bool)
        changed[1:] = np.logical_or.accumulate(paths[1:] != paths[:-1], axis=1)
        below = np.zeros(len(paths), np.int64)  # the state that each arc of this depth leads to
        for d in range(depth - 1, -1, -1):
            arcs = np.flatnonzero(changed[:, d])
            opens = changed[arcs, d - 1] if d else np.arange(len(arcs)) == 0
            begin = np.flatnonzero(opens)
            sizes = np.diff(np.append(begin, len(arcs)))
            labels = paths[arcs, d]
            of = _one_of_each(sizes, begin, labels, below)
            _, keep = np.unique(of, return_index=True)
            within = np.arange(sizes[keep].sum()) - np.repeat(np.cumsum(sizes[keep]) - sizes[keep], sizes[keep])
            at = within + np.repeat(begin[keep], sizes[keep])
            first[d] = np.append(0, np.cumsum(sizes[keep]))
            label[d], target[d] = labels[at], below[at]
            below = of
        return cls(heads, words, first, label, target, counts)

    @property
    def depth(self) -> int:
        return len(self.label)

    def paths(self) -> np.ndarray:
        """All paths in order, a row each; their counts are ``counts``."""
        state, rows = np.zeros(1, np.int64), np.empty((1, 0), np.int64)
        for d in range(self.depth):
            sizes = np.diff(self.first[d])[state]
            within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            arc = within + np.repeat(self.first[d][state], sizes)
            rows = np.column_stack([np.repeat(rows, sizes, axis=0), self.label[d][arc]])
            state = self.target[d][arc]
        return rows

    def before(self) -> list[np.ndarray]:
        """For each arc the number of paths that precede it in its state."""
        out: list[np.ndarray] = [None] * self.depth
        under = np.ones(1, np.int64)
        for d in range(self.depth - 1, -1, -1):
            running = np.append(0, np.cumsum(under[self.target[d]]))
            begin = self.first[d][:-1]
            out[d] = running[:-1] - np.repeat(running[begin], np.diff(self.first[d]))
            under = running[self.first[d][1:]] - running[begin]
        return out

    def compose(self, other: CountAutomaton) -> np.ndarray:
        """The other's count of each of this automaton's paths, in order; 0 where it has no such path.

        Both are walked together, an arc of this one once for each pair of states that share a prefix.
        """
        same_head = {h: i for i, h in enumerate(other.heads)}
        heads = np.array([same_head.get(h, -1) for h in self.heads], np.int64)
        words = pc.fill_null(pc.index_in(self.words, value_set=other.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        before, own = other.before(), self.before()
        place, found = np.zeros(1, np.int64), np.zeros(1, np.int64)
        state, there = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for d in range(self.depth):
            sizes = np.diff(self.first[d])[state]
            within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            arc = within + np.repeat(self.first[d][state], sizes)
            place, found, there = np.repeat(place, sizes), np.repeat(found, sizes), np.repeat(there, sizes)
            wanted = (heads if d == 0 else words)[self.label[d][arc]]
            width = int(other.label[d].max()) + 1
            keys = np.repeat(np.arange(len(other.first[d]) - 1), np.diff(other.first[d])) * width + other.label[d]
            asked = there * width + wanted
            at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            known = (wanted >= 0) & (wanted < width) & (keys[at] == asked)
            arc, at = arc[known], at[known]
            place, found = place[known] + own[d][arc], found[known] + before[d][at]
            state, there = self.target[d][arc], other.target[d][at]
        out = np.zeros(len(self.counts), np.int64)
        out[place] = other.counts[found]
        return out

    def pack(self) -> tuple[list, ...]:
        """Languages, words (which hold no space) and arrays as bytes; of where arcs begin the sizes of states, all in as few bytes as hold them."""
        parts = [np.diff(x) for x in self.first], self.label, self.target
        return self.heads, b" ".join(self.words.to_pylist()), *[[narrow(x) for x in part] for part in parts], narrow(self.counts)

    @classmethod
    def unpack(cls, heads: list[str], words: bytes, first: list[bytes], label: list[bytes], target: list[bytes], counts: bytes) -> CountAutomaton:
        begins = [np.append(0, np.cumsum(widened(x))) for x in first]
        return cls(heads, pa.array(words.split(b" "), pa.binary()), begins, [widened(x) for x in label], [widened(x) for x in target], widened(counts))


def union(automata: list[CountAutomaton]) -> CountAutomaton:
    """The automaton of all paths, counts of equal paths summed; labels in byte order of the words."""
    words = pa.concat_arrays([x.words for x in automata]).dictionary_encode()
    rank = np.empty(len(words.dictionary), np.int64)
    order = pc.array_sort_indices(words.dictionary)
    rank[order.to_numpy()] = np.arange(len(rank))
    codes = rank[words.indices.to_numpy()] if len(words) else np.empty(0, np.int64)
    heads = sorted({h for x in automata for h in x.heads})
    parts, at = [], 0
    for x in automata:
        rows = x.paths()
        parts.append(np.column_stack([np.searchsorted(heads, x.heads)[rows[:, 0]], codes[at + rows[:, 1:]]]))
        at += len(x.words)
    rows, counts = summed(np.concatenate(parts), np.concatenate([x.counts for x in automata]))
    return CountAutomaton.build(heads, words.dictionary.take(order), rows, counts)


def summed(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, sorted from the first column on, with their counts added."""
    if not len(rows):
        return rows, counts
    spans = rows.max(axis=0).astype(np.int64) + 1
    if math.prod(int(x) for x in spans) < 2**62:  # as one number each
        key = rows[:, 0].astype(np.int64)
        for column, span in zip(rows.T[1:], spans[1:], strict=True):
            key = key * span + column
        order = np.argsort(key)
        changed = np.diff(key[order]) != 0
        rows = rows[order]
    else:
        order = np.lexsort(rows.T[::-1])
        rows = rows[order]
        changed = (rows[1:] != rows[:-1]).any(axis=1)
    new = np.flatnonzero(np.append(True, changed))
    return rows[new], np.add.reduceat(counts[order], new)
