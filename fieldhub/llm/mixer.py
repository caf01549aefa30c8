"""Logistic context mixing over the bits of texts, in numpy.

A text is spelled byte by byte, each byte by the bits of a Huffman code of the training texts'
bytes.  Each bit is predicted in several hashed contexts: the last one to five bytes of the
word, the position in it, all of it so far, and for its first ``HEAD`` bytes also the class of the word before.
A context's two counts give a log odds.  A gate, made of the longest context seen, how often, and the depth in
the code, selects the weights that mix the log odds; an adaptive table per gate then refines the mixed probability.

Bits in equal contexts are equally likely, so each is worked out once: heads (class of the word before, first bytes)
and the rests of words are spelled apart, each with the number of its uses.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

ORDERS = (1, 2, 3, 4, 5)
PREFIX, CLASS = len(ORDERS) + 1, len(ORDERS) + 2  # places of these contexts; heads alone have a class
CONTEXTS = len(ORDERS) + 3
INPUTS = CONTEXTS + 1  # and a bias
HEAD = 2  # bytes of a word that are spelled with the class of the word before
CLASSES = 256  # of these, 0 where a text begins
SLOTS = 22  # bits of a slot's number: the tables' size whatever the corpus holds
DEPTHS = 8  # depths of the code with gates of their own
OFTEN = (4, 64)  # uses from which a context is another gate's
KINDS = len(ORDERS) + 1 + 2 * (len(OFTEN) + 1)
GATES = KINDS * DEPTHS
BINS = 33  # of the refining table, over log odds from -8 to 8
END = b"\n"  # spells the end of a text; words hold no white space
CLOSE = 32  # the byte that ends a word
PRIOR = 0.1
STEP = 60_000  # bytes that are spelled at once
RATE = 0.4
TURN = 1 << 14  # bits after which weights move

_PAD = max(ORDERS)


@dataclass(frozen=True)
class Code:
    """Nodes and bits on the way to each byte, end to end."""

    first: np.ndarray
    length: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray
    depth: np.ndarray


def huffman(counts: np.ndarray) -> Code:
    """A code of all 256 bytes; bytes never counted get long words, none gets none."""
    heap = [(int(count) + 1, byte, byte) for byte, count in enumerate(counts)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    made = 256
    while len(heap) > 1:
        (a, _, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
        parent[left], parent[right] = (made, 0), (made, 1)
        heapq.heappush(heap, (a + b, made, made))
        made += 1
    paths = []
    for byte in range(256):
        path, at = [], byte
        while at in parent:
            at, bit = parent[at]
            path.append((at, bit))
        paths.append(path[::-1])
    length = np.array([len(p) for p in paths])
    return Code(
        np.concatenate(([0], np.cumsum(length)[:-1])), length,
        np.array([node for p in paths for node, _ in p], np.uint64),
        np.array([bit for p in paths for _, bit in p], np.float32),
        np.array([min(d, DEPTHS - 1) for p in paths for d in range(len(p))], np.int64),
    )


@dataclass(frozen=True)
class Bits:
    word: np.ndarray  # number of the bit's word
    slots: np.ndarray  # (context, bit)
    value: np.ndarray
    depth: np.ndarray


def byte_counts(words: list[bytes], times: np.ndarray | None = None) -> np.ndarray:
    spelled = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    if times is None:
        return np.bincount(spelled, minlength=256)
    return np.bincount(spelled, np.repeat(times, [len(word) + 1 for word in words]), 256).astype(np.int64)


def head(word: bytes) -> bytes:
    return word if word == END else (word + b" ")[:HEAD]


def class_of(word: bytes) -> int:
    """Class of a word for the next one, by its last two bytes; 0 is the end's, and so that of a text's begin."""
    return 0 if word == END else (int.from_bytes(word[-2:]) * 40503 >> 4) % (CLASSES - 1) + 1


def marks(words: list[bytes]) -> np.ndarray:
    """Head and class of each word in one number: the head's two bytes, then the class."""
    if not words:
        return np.zeros(0, np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    last = starts + sizes - 1
    ending = flat[last] + np.where(sizes > 1, flat[last - 1] << 8, 0)
    end = flat[starts] == END[0]  # words hold no white space
    heads = (flat[starts] << 8) + np.where(end, 0, flat[starts + 1])
    return heads * CLASSES + np.where(end, 0, (ending * 40503 >> 4) % (CLASSES - 1) + 1)


def head_of(mark: int) -> bytes:
    own = int(mark // CLASSES).to_bytes(HEAD)
    return END if own[:1] == END else own


def _prefixes(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of a polynomial hash, and the factors that shift it back to its start."""
    powers = np.full(len(flat), 0x9E3779B97F4A7C15, np.uint64)
    back = np.full(len(flat), pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64)
    powers[0] = back[0] = 1
    sums = np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * np.cumprod(powers), dtype=np.uint64)
    return sums, np.cumprod(back)


def spell(words: list[bytes], code: Code, classes: np.ndarray | None = None, skip: int = 0) -> Iterator[Bits]:
    """The bits of words, about ``STEP`` bytes at a time; a long word spans several steps.

    The first ``skip`` bytes are context only.  With ``classes`` the words are heads, which aren't closed.
    """
    if not words:
        return
    pad = b"\0" * _PAD
    closed = words if classes is not None else [w if w == END else w + b" " for w in words]
    flat = np.frombuffer(pad + pad.join(closed), np.uint8)
    sizes = np.fromiter(map(len, closed), np.int64, len(closed))
    starts = np.cumsum(sizes + _PAD) - sizes
    left = np.maximum(sizes - skip, 0)
    ends = np.cumsum(left)
    sums, back = _prefixes(flat)
    for lo, hi in _runs(left):
        # bytes lo to hi of the spelled words, without the padding
        word = np.searchsorted(ends, np.arange(lo, hi), side="right")
        inside = np.arange(lo, hi) - (ends - left)[word] + skip
        start = starts[word]
        at = start + inside
        own = flat[at].astype(np.int64)
        context = np.zeros(len(at), np.uint64)
        hashed = [(np.minimum(inside, 12).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)]
        for k in ORDERS:
            context = context * np.uint64(257) + flat[at - k] + np.uint64(1)
            hashed.append((context + np.uint64(k << 56)) * np.uint64(0xC2B2AE3D27D4EB4F))
        prefix = (sums[at - 1] - sums[start - 1]) * back[start] + np.uint64(PREFIX << 56)
        hashed.append((prefix ^ prefix >> np.uint64(31)) * np.uint64(0x94D049BB133111EB))
        if classes is not None:
            before = np.where(inside > 0, flat[at - 1].astype(np.int64) + 1, 0) + 257 * classes[word]
            hashed.append((before.astype(np.uint64) + np.uint64(CLASS << 56)) * np.uint64(0xD6E8FEB86659FD93))
        length = code.length[own]
        of = np.repeat(np.arange(len(own)), length)
        turn = np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length)
        place = code.first[own][of] + turn
        node = (code.nodes[place] + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
        slots = np.empty((len(hashed), len(of)), np.int64)
        for row, h in enumerate(hashed):
            mixed = h[of] ^ node
            mixed ^= mixed >> np.uint64(29)
            slots[row] = (mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - SLOTS)
        yield Bits(word[of], slots, code.bits[place], code.depth[place])


def _runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    total = int(sizes.sum())
    for lo in range(0, total, STEP):
        yield lo, min(total, lo + STEP)


def count(words: list[bytes], code: Code, table: np.ndarray, times: np.ndarray | None = None,
          classes: np.ndarray | None = None) -> None:
    """Add the words to ``table``: (slot, bit) counts, ``times`` per word and bit.

    Heads add to their class's contexts only, as the words themselves add to the others.
    """
    flat = table.reshape(-1)
    for bits in spell(words, code, classes):
        many = np.ones(len(bits.word), flat.dtype) if times is None else times[bits.word].astype(flat.dtype)
        value = bits.value.astype(np.int64)
        for row in bits.slots if classes is None else bits.slots[CLASS:]:
            np.add.at(flat, row * 2 + value, many)


def _levels(uses: np.ndarray) -> np.ndarray:
    """0 where a context was never seen, then more the more often it was."""
    level = (uses > 0).astype(np.uint8)
    for least in OFTEN:
        level += uses >= least
    return level


def _gates(seen: np.ndarray, levels: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """seen: (order, bit), true where a context has counts; levels: of the prefix and the class.  The longest one decides."""
    kind = np.zeros(len(depth), np.int64)
    for order in range(len(ORDERS)):
        kind[seen[order]] = order + 1
    for i, level in enumerate(levels):
        kind = np.where(level > 0, len(ORDERS) + i * (len(OFTEN) + 1) + level, kind)
    return kind * DEPTHS + depth


def _squash(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -12, 12)))


def _bins(odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = (np.clip(odds, -7.999, 7.999) + 8) * ((BINS - 1) / 16)
    low = at.astype(np.int64)
    return low, at - low


def start_weights() -> np.ndarray:
    """The longest context seen weighs most, each shorter one half as much."""
    weights = np.zeros((KINDS, DEPTHS, INPUTS))
    for kind in range(KINDS):
        last = kind if kind <= len(ORDERS) else PREFIX + (kind > len(ORDERS) + len(OFTEN) + 1)
        share = 0.5 ** (last - np.arange(last + 1))
        weights[kind, :, : last + 1] = share / share.sum()
    return weights.reshape(GATES, INPUTS)


def learn(words: list[bytes], code: Code, table: np.ndarray, weights: np.ndarray, refine: np.ndarray,
          times: np.ndarray | None = None, classes: np.ndarray | None = None, skip: int = 0) -> None:
    """One online pass: each turn predicts, fills the refining table and moves the weights.

    A word that was counted is left out once of its own counts, so it is predicted as its next use.
    """
    for bits in spell(words, code, classes, skip):
        many = np.ones(len(bits.word)) if times is None else times[bits.word].astype(np.float64)
        pair = table[bits.slots].astype(np.float32)
        zeros, ones = pair[..., 0] - (1 - bits.value), pair[..., 1] - bits.value
        np.maximum(zeros, 0, out=zeros), np.maximum(ones, 0, out=ones)
        uses = zeros + ones
        inputs = np.zeros((INPUTS, len(bits.word)), np.float32)
        inputs[: len(uses)] = np.log((ones + np.float32(PRIOR)) / (zeros + np.float32(PRIOR)))
        inputs[-1] = 0.3
        gates = _gates(uses[1:PREFIX] > 0, _levels(uses[PREFIX:]), bits.depth)
        for lo in range(0, len(gates), TURN):
            here = slice(lo, lo + TURN)
            gate, value, own, x = gates[here], bits.value[here], many[here], inputs[:, here]
            odds = (weights[gate].T * x).sum(axis=0)
            error = (value - _squash(odds)) * own
            low, part = _bins(odds)
            for key, share in ((low, 1 - part), (low + 1, part)):
                cell = gate * BINS + key
                refine[:, 0] += np.bincount(cell, own * share * (1 - value), minlength=len(refine))
                refine[:, 1] += np.bincount(cell, own * share * value, minlength=len(refine))
            total = np.maximum(np.bincount(gate, own, GATES), 1e-9)
            rate = RATE * np.minimum(1, np.bincount(gate, minlength=GATES) / 50) / total
            for i in range(INPUTS):
                weights[:, i] += rate * np.bincount(gate, error * x[i], GATES)


@dataclass(frozen=True)
class Mixer:
    code: Code
    odds: np.ndarray  # log odds of each slot, 0 where nothing was counted
    levels: np.ndarray  # of each slot
    weights: np.ndarray
    refined: np.ndarray  # (gate, bin) log odds

    @staticmethod
    def of(code: Code, table: np.ndarray, weights: np.ndarray, refine: np.ndarray) -> Mixer:
        odds = np.log((table[:, 1] + PRIOR) / (table[:, 0] + PRIOR))
        uses = table.sum(axis=1)
        odds[(uses > 0) & (odds == 0)] = 1e-6
        centre = np.linspace(-8, 8, BINS)
        prior = 4 * _squash(centre)
        ones = refine[:, 1].reshape(GATES, BINS) + prior
        zeros = refine[:, 0].reshape(GATES, BINS) + 4 - prior
        return Mixer(code, odds.astype(np.float32), _levels(uses), weights, np.log(ones / zeros))

    def log2(self, words: list[bytes], classes: np.ndarray | None = None, skip: int = 0) -> np.ndarray:
        """log2 of each word's probability, its end included; of heads, or without the first bytes, as ``spell`` has it."""
        total = np.zeros(len(words))
        for bits in spell(words, self.code, classes, skip):
            found = self.odds[bits.slots]
            gates = _gates(found[1:PREFIX] != 0, self.levels[bits.slots[PREFIX:]], bits.depth)
            odds = self.weights[gates, -1] * 0.3
            for i, own in enumerate(found):
                odds += self.weights[gates, i] * own
            low, part = _bins(odds)
            better = self.refined[gates, low] * (1 - part) + self.refined[gates, low + 1] * part
            p = (_squash(odds) + 3 * _squash(better)) / 4
            p = np.where(bits.value > 0, p, 1 - p)
            total += np.bincount(bits.word, np.log2(p), minlength=len(words))
        return total
