"""Unigram scores of words over a fixed public vocabulary of byte pieces.

Words are put in a trie, and a prefix that several words share is scored once: level by level, a
node's forward score is the sum over the pieces that end there of the piece's probability times the
score of the node where it begins. All nodes of a level are computed together in numpy. Expected counts
go back up the same trie from its terminals, which hold how often their word occurs.

Long words are cut where no piece of the vocabulary crosses: every segmentation breaks there, so the parts
are scored by themselves, in a trie of their own, and nothing is lost. Parts that are still long, where
pieces overlap without end, are scored each by itself over the pieces that occur in it.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np

from hazardframe.llm import textbytes as tb

#: Longest word of the trie; longer ones are scored by themselves.
WORD_BYTES = 32
#: Bytes of long words that are scored together, unless a single word is longer.
LONG_BYTES = 100_000
_PREFIX_BITS = 22
_BASE = tb.U64(0x9E3779B97F4A7C15 | 1)


class PieceTable:
    """Hash table from pieces to their numbers; every single byte is a piece."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.pieces = pieces
        hashes = np.array([self.hash_of(p) for p in pieces], np.uint64)
        if len(np.unique(hashes)) != len(pieces):
            raise ValueError("two pieces have one hash")
        self.bits = max(4, (4 * len(pieces)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.numbers = np.full(1 << self.bits, len(pieces), np.int32)
        slots = self._slots(hashes)
        self.probes = 1
        for number, (slot, key) in enumerate(zip(slots.tolist(), hashes.tolist(), strict=True)):
            n = 1
            while self.numbers[slot] != len(pieces):
                slot = (slot + 1) & ((1 << self.bits) - 1)
                n += 1
            self.keys[slot], self.numbers[slot] = key, number
            self.probes = max(self.probes, n)
        self.sizes = {len(p) for p in pieces}
        self.prefixes = np.zeros(1 << _PREFIX_BITS, bool)  # of pieces, by hash
        prefixes = {p[:n] for p in pieces for n in range(1, len(p))}
        self.prefixes[self._prefix(np.array([self.hash_of(x) for x in prefixes], np.uint64))] = True

    @staticmethod
    def _prefix(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> tb.U64(29))) * tb.U64(0xBF58476D1CE4E5B9) >> tb.U64(64 - _PREFIX_BITS)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.pieces)

    @staticmethod
    def hash_of(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(_BASE) + b + 1) & ((1 << 64) - 1)
        return h

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> tb.U64(29))) * tb.U64(0xBF58476D1CE4E5B9) >> tb.U64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of the piece with each hash; ``len(self)`` where there is none."""
        shape, h = h.shape, h.ravel()
        slot = self._slots(h)
        out = np.where(self.keys[slot] == h, self.numbers[slot], len(self.pieces))
        left = np.flatnonzero((self.keys[slot] != h) & (self.numbers[slot] != len(self.pieces)))
        for _ in range(self.probes - 1):
            if not len(left):
                break
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            keys, numbers = self.keys[slot[left]], self.numbers[slot[left]]
            same = keys == h[left]
            out[left[same]] = numbers[same]
            left = left[~same & (numbers != len(self.pieces))]
        return out.reshape(shape)


@lru_cache(maxsize=4)
def byte_pieces(name: str = "byte_bpe_50k.tiktoken", fold: bool = False) -> PieceTable:
    """Pieces of a public rank file, in rank order and without a leading blank.

    ``fold`` lower-cases ASCII letters. Pieces with other white space are left out.
    """
    import public_tokenizers

    seen: dict[bytes, None] = {}
    with open(public_tokenizers.path(name), "rb") as f:
        for line in f:
            piece = base64.b64decode(line.split()[0])
            piece = piece[1:] if len(piece) > 1 and piece[:1] == b" " else piece
            piece = piece.lower() if fold else piece
            if piece and (len(piece) == 1 or not set(piece) & set(b" \t\n\r\x0b\x0c")):
                seen.setdefault(piece)
    for b in range(256):
        seen.setdefault(bytes([b]))
    return PieceTable(list(seen))


@dataclass
class Words:
    """Distinct words of some texts, in byte order, then the long ones, and which of them each text's tokens are."""

    matrix: np.ndarray  # bytes plus one, 0 beyond the end
    lengths: np.ndarray
    token_word: np.ndarray  # word of each token
    token_text: np.ndarray  # text of each token
    long: list[np.ndarray] = field(default_factory=list)  # bytes of words over WORD_BYTES

    @cached_property
    def trie(self) -> Trie:
        return Trie(self)

    def __len__(self) -> int:
        return len(self.lengths) + len(self.long)

    def only(self, used: np.ndarray) -> Words:
        """The words of these numbers (ascending), without tokens."""
        short, n = used[used < len(self.lengths)], len(self.lengths)
        return Words(self.matrix[short], self.lengths[short], self.token_word[:0], self.token_text[:0], [self.long[k - n] for k in used[len(short) :].tolist()])


def distinct_words(data: np.ndarray, bounds: np.ndarray, member: np.ndarray) -> Words:
    """The words (runs of member bytes) of a slice of texts."""
    starts, ends = tb.runs(data, bounds, member)
    text = tb.owner_of(bounds, starts)
    _, first, word = np.unique(tb.span_hashes(data, starts, ends, 5), return_index=True, return_inverse=True)
    words, place = _words_at(data, starts[first], ends[first])
    words.token_word, words.token_text = place[word.ravel()], text
    return words


def words_of(column, counts: np.ndarray) -> tuple[Words, np.ndarray]:
    """Different words (a binary column) and their counts, as one float each."""
    data, bounds = tb.texts(column)
    words, place = _words_at(data, bounds[:-1], bounds[1:])
    moved = np.empty(len(counts))
    moved[place] = counts
    return words, moved


def _words_at(data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words at some places, and each one's number among them."""
    count, lengths = len(at), ends - at
    short, over = np.flatnonzero(lengths <= WORD_BYTES), np.flatnonzero(lengths > WORD_BYTES)
    long = [data[a : a + n] for a, n in zip(at[over].tolist(), lengths[over].tolist(), strict=True)]
    at, lengths = at[short], lengths[short]
    width = int(lengths.max(initial=1))
    cell = at[:, None] + np.arange(width)
    inside = np.arange(width) < lengths[:, None]
    matrix = np.where(inside, data[np.minimum(cell, max(len(data) - 1, 0))] + np.uint8(1), np.uint8(0)) if len(data) else np.zeros((0, width), np.uint8)
    order = np.argsort(np.ascontiguousarray(matrix).view(f"S{width}").ravel(), kind="stable")
    place = np.empty(count, np.int64)
    place[short[order]] = np.arange(len(order))
    place[over] = len(order) + np.arange(len(over))
    none = np.empty(0, np.int64)
    return Words(matrix[order], lengths[order], none, none, long), place


@dataclass
class Lattice:
    """The pieces in some long words, by where they end: nodes are the places between bytes, word after word."""

    words: np.ndarray  # numbers of the words among the long ones
    last: np.ndarray  # last node of each word
    source: np.ndarray
    target: np.ndarray
    piece: np.ndarray
    word: np.ndarray  # which of the words each piece is in

    def sums(self, weights: np.ndarray, reach: int, backward: bool = False) -> np.ndarray:
        """Log of the summed products of weights over the ways from its word's begin (or end) to each node.

        ``reach`` is the longest piece: sums are scaled up, together with those within reach, before they underflow.
        """
        source, target, top = self.source, self.target, int(self.last[-1])
        if backward:
            source, target = top - target, top - source
            order = np.argsort(target, kind="stable")
            source, target, weights = source[order], target[order], weights[order]
        ends = np.searchsorted(target, np.arange(top + 2)).tolist()
        source, weights = source.tolist(), weights.tolist()
        out, scales, scale, now = [1.0] * (top + 1), [0] * (top + 1), 0, [1.0] * (top + 1)
        for e in range(top + 1):
            lo, hi = ends[e], ends[e + 1]
            if lo == hi:  # where a word begins
                scale = 0
                continue
            total = 0.0
            for i in range(lo, hi):
                total += now[source[i]] * weights[i]
            out[e], scales[e] = total, scale
            if total < 1e-150:
                for j in range(max(0, e - reach), e):
                    now[j] *= 1e150
                total *= 1e150
                scale += 1
            now[e] = total
        with np.errstate(divide="ignore"):
            logs = np.log(np.array(out)) - np.array(scales) * math.log(1e150)
        return logs[::-1] if backward else logs

    def tops(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest sum of weights to each node, and the fewest pieces of such a way."""
        n = int(self.last[-1]) + 1
        ends = np.searchsorted(self.target, np.arange(n + 1)).tolist()
        source, weights, out, count = self.source.tolist(), weights.tolist(), [0.0] * n, [0] * n
        for e in range(n):
            lo, hi = ends[e], ends[e + 1]
            if hi > lo:
                ways = [out[source[i]] + weights[i] for i in range(lo, hi)]
                out[e] = most = max(ways)
                count[e] = 1 + min(count[source[lo + i]] for i, w in enumerate(ways) if w >= most - 1e-12)
        return np.array(out), np.array(count, np.int64)


def lattices(long: list[np.ndarray], table: PieceTable) -> Iterator[Lattice]:
    """Lattices of long words, some words at a time."""
    sizes, at = np.array([len(w) for w in long], np.int64), 0
    total = np.cumsum(sizes)
    while at < len(long):
        to = max(at + 1, int(np.searchsorted(total, total[at] - sizes[at] + LONG_BYTES, "right")))
        data = np.concatenate(long[at:to]).astype(np.uint64) + tb.U64(1)
        n = sizes[at:to]
        owner, stop = np.repeat(np.arange(to - at), n), np.repeat(np.cumsum(n), n)
        place, h, found = np.arange(len(data)), np.zeros(len(data), np.uint64), []
        for size in range(1, max(table.sizes) + 1):
            h = h * _BASE + data[place + size - 1]
            if size in table.sizes:
                piece = table.find(h)
                hit = piece < len(table)
                found.append((place[hit], place[hit] + size, piece[hit]))
            on = table.prefixes[table._prefix(h)] & (place + size < stop[place])
            place, h = place[on], h[on]
        begin, end, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((begin, end))
        begin, end, piece = begin[order], end[order], piece[order]
        word = owner[begin]
        yield Lattice(np.arange(at, to), np.cumsum(n) + np.arange(to - at), begin + word, end + word, piece, word)
        at = to


def segments(long: list[np.ndarray], table: PieceTable) -> tuple[Words, np.ndarray, np.ndarray]:
    """The different parts of long words between places that no piece crosses, and each part's number and word."""
    spans, owner = [], []
    for part in lattices(long, table):
        n = int(part.last[-1]) + 1
        over = np.cumsum(np.bincount(part.source + 1, minlength=n + 1)[:n] - np.bincount(part.target, minlength=n + 1)[:n])
        cuts = np.flatnonzero(over == 0)  # a word's first and last place too
        first = np.append(0, part.last[:-1] + 1)
        word = np.searchsorted(part.last, cuts)
        for k, (a, b) in enumerate(zip(np.searchsorted(word, np.arange(len(part.words))), np.searchsorted(word, np.arange(len(part.words)), "right"))):
            at = cuts[a:b] - first[k]
            spans.extend(long[part.words[k]][x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist()))
            owner.append(np.full(b - a - 1, part.words[k]))
    sizes = np.array([len(x) for x in spans], np.int64)
    data = np.concatenate(spans)
    ends = np.cumsum(sizes)
    _, one, which = np.unique(tb.span_hashes(data, ends - sizes, ends, 5), return_index=True, return_inverse=True)
    words, place = _words_at(data, (ends - sizes)[one], ends[one])
    return words, place[which.ravel()], np.concatenate(owner)


class Trie:
    """Levels of the trie of sorted words: per level the nodes' first words, parents, and the words' nodes."""

    def __init__(self, words: Words) -> None:
        m, n = words.matrix, len(words.lengths)
        differ = np.ones((n, m.shape[1] + 1), bool)
        if n:
            differ[1:, :-1] = m[1:] != m[:-1]
        shared = differ.argmax(1)  # bytes shared with the word before
        if n:
            shared[0] = 0
        self.levels = []
        before = np.zeros(n, np.int64)
        for depth in range(1, int(words.lengths.max(initial=0)) + 1):
            active = words.lengths >= depth
            new = active & (shared < depth)
            if n and active[0]:
                new[0] = True
            first = np.flatnonzero(new)
            node = np.cumsum(new) - 1
            self.levels.append((first, before[first], node, np.flatnonzero(words.lengths == depth)))
            before = node


def forward(words: Words, table: PieceTable, probs: np.ndarray) -> np.ndarray:
    """Log of each word's probability, all segmentations summed; one column for each column of ``probs``.

    ``probs`` has a row for each piece, and a last row of zeros for what is no piece.
    """
    out = np.zeros((len(words.lengths), probs.shape[1]))
    hashes = np.zeros((1, 0), np.uint64)
    scores = np.ones((1, 1, probs.shape[1]))
    for depth, (first, parent, node, ended) in enumerate(words.trie.levels, 1):
        byte = words.matrix[first, depth - 1].astype(np.uint64)
        hashes = np.concatenate([hashes[parent] * _BASE, np.zeros((len(first), 1), np.uint64)], 1) + byte[:, None]
        scores = scores[parent]
        now = np.einsum("nsl,nsl->nl", scores, probs[table.find(hashes)])
        out[ended] = now[node[ended]]
        scores = np.concatenate([scores, now[:, None, :]], 1)
    with np.errstate(divide="ignore"):
        out = np.log(out)
    return np.concatenate([out, _forward_long(words.long, table, probs)])


def _forward_long(long: list[np.ndarray], table: PieceTable, probs: np.ndarray) -> np.ndarray:
    out = np.zeros((len(long), probs.shape[1]))
    if not long:
        return out
    parts, which, owner = segments(long, table)
    scores = np.concatenate([forward(Words(parts.matrix, parts.lengths, which[:0], which[:0]), table, probs), np.zeros((len(parts.long), probs.shape[1]))])
    for part in lattices(parts.long, table):
        for k in range(probs.shape[1]):
            scores[len(parts.lengths) + part.words, k] = part.sums(probs[part.piece, k], max(table.sizes))[part.last]
    for k in range(probs.shape[1]):
        out[:, k] = np.bincount(owner, weights=scores[which, k], minlength=len(long))
    return out


def best(words: Words, table: PieceTable, log_probs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probability and number of pieces of each word's best segmentation; of equal ones the fewest pieces."""
    score, count = np.zeros(len(words.lengths)), np.zeros(len(words.lengths), np.int64)
    hashes, scores, counts = np.zeros((1, 0), np.uint64), np.zeros((1, 1)), np.zeros((1, 1), np.int64)
    logs = np.append(log_probs, -np.inf)
    for depth, (first, parent, node, ended) in enumerate(words.trie.levels, 1):
        byte = words.matrix[first, depth - 1].astype(np.uint64)
        hashes = np.concatenate([hashes[parent] * _BASE, np.zeros((len(first), 1), np.uint64)], 1) + byte[:, None]
        scores, counts = scores[parent], counts[parent]
        reach = scores + logs[table.find(hashes)]
        top = reach.max(1)
        fewest = np.where(reach >= top[:, None] - 1e-12, counts, np.int64(1 << 40)).min(1) + 1
        score[ended], count[ended] = top[node[ended]], fewest[node[ended]]
        scores, counts = np.concatenate([scores, top[:, None]], 1), np.concatenate([counts, fewest[:, None]], 1)
    long_score, long_count = np.zeros(len(words.long)), np.zeros(len(words.long), np.int64)
    if words.long:
        parts, which, owner = segments(words.long, table)
        s, c = best(Words(parts.matrix, parts.lengths, which[:0], which[:0]), table, log_probs)
        s, c = np.concatenate([s, np.zeros(len(parts.long))]), np.concatenate([c, np.zeros(len(parts.long), np.int64)])
        for part in lattices(parts.long, table):
            top, fewest = part.tops(log_probs[part.piece])
            s[len(parts.lengths) + part.words], c[len(parts.lengths) + part.words] = top[part.last], fewest[part.last]
        long_score = np.bincount(owner, weights=s[which], minlength=len(words.long))
        long_count = np.bincount(owner, weights=c[which], minlength=len(words.long)).astype(np.int64)
    return np.concatenate([score, long_score]), np.concatenate([count, long_count])


def expected_counts(words: Words, weights: np.ndarray, table: PieceTable, probs: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over words with weights, for one column of probabilities: forward and back on the trie.

    Down the trie each node has its forward score once, whatever the words below it. Terminals hold their word's weight,
    over its score; what lies below a node is summed on the way back up, so a shared prefix is counted once too.
    """
    out = np.zeros(len(table) + 1)
    levels, n_short = words.trie.levels, len(words.lengths)
    n_nodes = 1 + sum(len(first) for first, *_ in levels)
    alpha, below = np.zeros(n_nodes), np.zeros(n_nodes)
    alpha[0] = 1.0
    hashes, above = np.zeros((1, 0), np.uint64), np.zeros((1, 1), np.int64)  # of each node of a level: pieces to it, nodes above
    steps, begin = [], 1
    for depth, (first, parent, node, ended) in enumerate(levels, 1):
        byte = words.matrix[first, depth - 1].astype(np.uint64)
        hashes = np.concatenate([hashes[parent] * _BASE, np.zeros((len(first), 1), np.uint64)], 1) + byte[:, None]
        above = above[parent]
        piece = table.find(hashes)
        row, column = np.nonzero(piece < len(table))
        source, piece = above[row, column], piece[row, column]
        share = probs[piece]
        alpha[begin : begin + len(first)] = np.bincount(row, weights=alpha[source] * share, minlength=len(first))
        steps.append((source, begin + row, piece, share))
        terminal = begin + node[ended]
        below[terminal] += weights[:n_short][ended] / np.maximum(alpha[terminal], 1e-300)
        above = np.concatenate([above, np.arange(begin, begin + len(first))[:, None]], 1)
        begin += len(first)
    for source, target, piece, share in reversed(steps):
        onward = share * below[target]
        out += np.bincount(piece, weights=alpha[source] * onward, minlength=len(out))
        np.add.at(below, source, onward)
    if words.long:
        parts, which, owner = segments(words.long, table)
        own = np.bincount(which, weights=weights[n_short:][owner], minlength=len(parts))
        out += expected_counts(Words(parts.matrix, parts.lengths, which[:0], which[:0]), own[: len(parts.lengths)], table, probs)
        for part in lattices(parts.long, table):
            weight = probs[part.piece]
            to, onward = part.sums(weight, max(table.sizes)), part.sums(weight, max(table.sizes), backward=True)
            use = np.exp(to[part.source] + np.log(weight) + onward[part.target] - to[part.last][part.word])
            out += np.bincount(part.piece, weights=use * own[len(parts.lengths) + part.words[part.word]], minlength=len(out))
    return out
