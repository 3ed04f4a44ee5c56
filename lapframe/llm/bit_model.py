"""The codes, contexts and the mixing of :mod:`lapframe.llm.context_mixing`, over the texts of one lot in NumPy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np

from lapframe.llm.jaccard_join import mix64
from lapframe.llm.packing import ordered

WIDTH = 48  # bits that hold a code, left-justified
LEAST_SHARE = 1 << 24  # counts below the total divided by this are raised to it, which bounds the codes' lengths
UPPER = 8  # bits of the code that the previous word's context predicts
CLASSES = 9  # a text's class: the bucket of its commonest two-byte letter, or none
END_OF_WORD = 256  # closes a spelled word
PREDICTORS, STEP = 3, 64
#: Weights that each text starts with: for words, then for spelled bytes, with the longest context unknown and known.
FIRST_WEIGHTS = ((0.85, 0.2, 0.0), (0.5, 0.1, 0.6), (0.35, 0.6, 0.0), (0.1, 0.3, 0.7))
RATE = 0.01
SCALE, MOST = 4.0, 31  # a prediction is sent as the stretched probability times this, as int8
PRIOR = 0.2
#: Families of contexts that are looked up: those of words, then those of spelled bytes.
WORD_FAMILIES, BYTE_FAMILIES = 2, 3
FAMILIES = WORD_FAMILIES + BYTE_FAMILIES
RANK_BITS = (9, 18, 9, 9, 9)  # of a symbol's number, by family


class Code:
    """A Huffman code whose symbols are numbered from left to right in its tree, so a subtree is a range of numbers."""

    def __init__(self, length: np.ndarray, left: np.ndarray):
        self.length, self.left = length.astype(np.int64), left
        self.start = np.cumsum(self.length) - self.length

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> tuple[Code, np.ndarray]:
        """The code (shorter codes first), and the number of each symbol."""
        length = _lengths(counts)
        order = np.lexsort((np.arange(len(counts)), -counts, length))
        number = np.empty(len(counts), np.int64)
        number[order] = np.arange(len(counts))
        return cls.of_lengths(length[order]), number

    @classmethod
    def of_lengths(cls, length: np.ndarray) -> Code:
        share = np.uint64(1) << (np.uint64(WIDTH) - length.astype(np.uint64))
        return cls(length, np.cumsum(share) - share)

    def upper(self, bits: int) -> tuple[Code, np.ndarray]:
        """The tree cut off at a depth, and the number that each symbol has in it."""
        cut = self.left >> np.uint64(WIDTH - bits) << np.uint64(WIDTH - bits)
        first = np.r_[True, cut[1:] != cut[:-1]]
        return Code(np.minimum(self.length[first], bits), cut[first]), np.cumsum(first) - 1


def _lengths(counts: np.ndarray) -> np.ndarray:
    """Code lengths by merging the two smallest weights, from two queues that are both in order."""
    weight = np.maximum(counts, int(counts.sum()) // LEAST_SHARE + 1)
    order = np.argsort(weight, kind="stable")
    leaves, n = weight[order].tolist(), len(weight)
    merged: list[int] = []
    up = [0] * (2 * n - 1)
    i = j = 0
    for node in range(n, 2 * n - 1):
        total = 0
        for _ in range(2):
            if i < n and (j >= len(merged) or leaves[i] <= merged[j]):
                total += leaves[i]
                up[i] = node
                i += 1
            else:
                total += merged[j]
                up[n + j] = node
                j += 1
        merged.append(total)
    depth = [0] * (2 * n - 1)
    for node in range(2 * n - 3, -1, -1):
        depth[node] = depth[up[node]] + 1
    out = np.empty(n, np.int64)
    out[order] = depth[:n]
    return out


# --- what is learned: predictions along the code of pairs of a context and a symbol ------------------


def _stretched(here: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(np.log((here + PRIOR) / (other + PRIOR)) * SCALE, -MOST, MOST)).astype(np.int8)


def predictions(code: Code, context: np.ndarray, rank: np.ndarray, uses: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted, distinct pairs of a context and a symbol's number, with their uses in training: the stretched
    probabilities of the turns that the symbol takes, along its code; and where each pair's start.

    The uses under a node are those of neighbouring pairs, as far as their context and the code up to the node agree.
    """
    length = code.length[rank]
    start = np.cumsum(length) - length
    if not len(rank):
        return np.empty(0, np.int8), start
    new = np.r_[True, context[1:] != context[:-1]]
    alone = new & np.r_[new[1:], True]
    out = np.repeat(np.where(alone, _stretched(uses.astype(np.float64), np.zeros(1)), 0).astype(np.int8), length)
    live = np.flatnonzero(~alone)
    if not len(live):
        return out, start
    left = code.left[rank[live]]
    apart = np.frexp((left[1:] ^ left[:-1]).astype(np.float64))[1]  # bits from the first that differs
    common = np.r_[-1, np.where(new[live][1:], -1, WIDTH - apart)]  # turns that a pair shares with the one before it
    n, level = uses[live].astype(np.float64), 0
    here = _run_sums(common < 0, n)
    while len(live):  # a pair whose code has ended leaves; its neighbours share fewer turns than that with it
        below = _run_sums(common <= level, n)
        out[start[live] + level] = _stretched(below, here - below)
        level += 1
        stays = length[live] > level
        if not stays.all():
            # what a pair shares with the one before it is the least along the pairs that leave between them
            common = _kept_common(common, stays)
            live, n, below = live[stays], n[stays], below[stays]
        here = below
    return out, start


def _kept_common(common: np.ndarray, stays: np.ndarray) -> np.ndarray:
    """``common`` of the pairs that stay, against the one before them that stays."""
    at = np.flatnonzero(stays)
    if not len(at):
        return common[:0]
    return np.minimum.reduceat(common[: at[-1] + 1], np.r_[0, at[:-1] + 1])


def _run_sums(opens: np.ndarray, n: np.ndarray) -> np.ndarray:
    starts = np.flatnonzero(opens)
    return np.repeat(np.add.reduceat(n, starts), np.diff(np.r_[starts, len(n)]))


@dataclass
class Model:
    """What every task knows: at most ``HEAD`` frequent words with their numbers, both codes, and what each class predicts."""

    tokens: np.ndarray  # identities of the coded words, sorted
    numbers: np.ndarray  # and the number of each
    lengths: np.ndarray  # of the words' codes, by number
    escape: int
    end: int
    byte_lengths: np.ndarray  # of the bytes' codes, by number
    byte_numbers: np.ndarray
    by_class: np.ndarray  # (classes, sum of lengths): predictions along each word's code
    bits: int  # of a context's hash

    def __post_init__(self):
        self.word_code = Code.of_lengths(self.lengths)
        self.byte_code = Code.of_lengths(self.byte_lengths)
        self.upper_code, self.upper_number = self.word_code.upper(UPPER)
        self.codes = (self.upper_code, self.word_code, self.byte_code, self.byte_code, self.byte_code)

    def number_of(self, identity: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.full(len(identity), self.escape, np.int64)
        at = np.minimum(np.searchsorted(self.tokens, identity), len(self.tokens) - 1)
        return np.where(self.tokens[at] == identity, self.numbers[at], self.escape)


# --- the texts of a lot as symbols -------------------------------------------------------------------


def classes_of(texts: list[bytes]) -> np.ndarray:
    """The class of each text: 1 + the bucket of two-byte letters that occurs most (the first of equals); 0 without any."""
    size = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    at = np.flatnonzero((raw[1:] >= 128) & (raw[1:] < 192) & (raw[:-1] >= 192) & (raw[:-1] < 224)) + 1 if len(raw) else np.empty(0, np.int64)
    of_text = np.searchsorted(np.cumsum(size), at, side="right")
    bucket = (raw[at].astype(np.int64) * 7 + raw[at - 1].astype(np.int64) * 13) % (CLASSES - 1)
    counts = np.bincount(of_text * (CLASSES - 1) + bucket, minlength=len(texts) * (CLASSES - 1)).reshape(len(texts), -1)
    return np.where(counts.any(axis=1), counts.argmax(axis=1) + 1, 0) if len(texts) else np.empty(0, np.int64)


@dataclass
class Symbols:
    """The symbols of a lot: per text its class and number of words (the end is one), the words' numbers, and the spelled ones' bytes."""

    text_class: np.ndarray
    words: np.ndarray
    number: np.ndarray
    spelled: np.ndarray  # bytes of the words that have no number, one after the other
    spelled_size: np.ndarray

    def __post_init__(self):
        self.opens = np.cumsum(self.words) - self.words
        self.of_word = np.repeat(self.text_class, self.words).astype(np.uint64)


_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _before(values: np.ndarray, opens: np.ndarray, back: int) -> np.ndarray:
    """The value ``back`` places before each; 0 before a part's opening."""
    out = np.zeros_like(values)
    out[back:] = values[:-back] if len(values) > back else values[:0]
    for k in range(back):
        at = opens + k
        out[at[at < len(values)]] = 0
    return out


def spelled_symbols(s: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spelled words with an end after each, and where each word opens."""
    size = s.spelled_size + 1
    opens = np.cumsum(size) - size
    out = np.full(int(size.sum()), END_OF_WORD, np.uint16)
    inside = np.ones(len(out), bool)
    inside[opens + s.spelled_size] = False
    out[inside] = s.spelled
    return out, opens


class Contexts(NamedTuple):
    """A family's context of each symbol, and the symbol's number in the family's code. The hash that all lots know a
    context by is ``mix64(plain * factor + term)``; without a factor, ``plain`` is it."""

    plain: np.ndarray
    number: np.ndarray
    width: int  # bits of ``plain``
    factor: np.uint64 | None = None
    term: np.uint64 = np.uint64(0)


def contexts(model: Model, s: Symbols) -> Iterator[Contexts]:
    """Per family the contexts of the symbols; hashes have ``bits`` bits."""
    drop = np.uint64(64 - model.bits)
    spelled, opens = spelled_symbols(s)
    last = np.repeat(opens, s.spelled_size + 1)
    escaped = np.flatnonzero(s.number == model.escape)
    identity = mix64(s.number.astype(np.uint64) + _A)
    if len(escaped):  # a spelled word is known by a hash of its bytes and their places
        place = np.arange(len(spelled)) - last
        identity[escaped] = mix64(np.bitwise_xor.reduceat(mix64((spelled.astype(np.uint64) + np.uint64(1)) ^ (place.astype(np.uint64) << np.uint64(16))), opens))
    upper = model.upper_number[s.number]
    near = _before(upper.astype(np.uint64) + np.uint64(1), s.opens, 1)
    yield Contexts(near * np.uint64(CLASSES) + s.of_word, upper, 12, np.uint64(1), _B)
    one, two = _before(identity, s.opens, 1), _before(identity, s.opens, 2)
    yield Contexts(mix64(mix64(two + _C) * _A + one) >> drop, s.number, model.bits)
    number = model.byte_numbers[spelled]
    value = spelled.astype(np.uint64) + np.uint64(1)
    if not len(value):
        for _ in range(BYTE_FAMILIES):
            yield Contexts(np.empty(0, np.uint64), number, model.bits)
        return
    back = [_before(value, opens, k) for k in range(1, 6)]
    of_byte = np.repeat(s.of_word[escaped], s.spelled_size + 1)
    yield Contexts(back[0] * np.uint64(CLASSES) + of_byte, number, 12, _B, np.uint64(3))
    three = back[0] | back[1] << np.uint64(9) | back[2] << np.uint64(18)
    yield Contexts(three, number, 27, _B, np.uint64(5))
    yield Contexts(mix64((three | back[3] << np.uint64(27) | back[4] << np.uint64(36)) * _B + np.uint64(7)) >> drop, number, model.bits)


def distinct_pairs(c: Contexts, rank_bits: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the distinct pairs of a context's hash, of ``bits`` bits, and a symbol; and each symbol's pair.

    Short contexts are told apart before they are hashed: by a table if it is not much larger than the symbols, or by one sort.
    """
    shift, low = np.uint64(rank_bits), np.uint64((1 << rank_bits) - 1)
    key = c.plain << shift | c.number.astype(np.uint64)
    cells = 1 << (c.width + rank_bits)
    table = cells <= 4 * len(key)
    if table:
        key = key.astype(np.int64)
        used = np.flatnonzero(np.bincount(key, minlength=cells)).astype(np.uint64)
    else:
        order, key = ordered(key)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        used, times = key[starts], np.diff(np.r_[starts, len(key)])
    if c.factor is None:
        keys, pair = used, np.arange(len(used))
    else:
        again, keys = ordered(mix64((used >> shift) * c.factor + c.term) >> np.uint64(64 - bits) << shift | used & low)
        fresh = np.r_[True, keys[1:] != keys[:-1]][: len(keys)]
        pair = np.empty(len(keys), np.int64)
        pair[again] = np.cumsum(fresh) - 1
        keys = keys[fresh]
    if table:
        of_cell = np.empty(cells, np.int64)
        of_cell[used.astype(np.int64)] = pair
        return keys, of_cell[key]
    which = np.empty(len(order), np.int64)
    which[order] = np.repeat(pair, times)
    return keys, which


# --- mixing ------------------------------------------------------------------------------------------


def mix_scores(model: Model, s: Symbols, answers: list[np.ndarray]) -> np.ndarray:
    """log10 of the probability of each text, given each family's predictions for the lot's distinct pairs (:func:`shortened`)."""
    at, sources = [], []
    for k, (code, family) in enumerate(zip(model.codes, contexts(model, s), strict=True)):
        key, which = distinct_pairs(family, RANK_BITS[k], model.bits)
        length = code.length[(key & np.uint64((1 << RANK_BITS[k]) - 1)).astype(np.int64)]
        at.append((np.cumsum(length) - length)[which])
        sources.append(lengthened(answers[2 * k], answers[2 * k + 1], length))
    spelled, _ = spelled_symbols(s)
    byte_length = model.byte_code.length[model.byte_numbers[spelled]]
    word_length = model.word_code.length[s.number]
    # a word that has no number is followed by its bytes
    follow = np.zeros(len(s.number), np.int64)
    follow[s.number == model.escape] = s.spelled_size + 1
    event = np.cumsum(follow + 1) - (follow + 1)
    is_word = np.zeros(len(s.number) + len(spelled), bool)
    is_word[event] = True
    spell = np.flatnonzero(~is_word)

    def in_line(words: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        out = np.empty(len(is_word), np.int64)
        out[event], out[spell] = words, spelled
        return out

    length = in_line(word_length, byte_length)
    first = np.cumsum(length) - length
    decisions = int(length.sum())
    inputs = np.zeros((PREDICTORS, decisions + STEP), np.int8)
    in_class = s.of_word.astype(np.int64) * model.by_class.shape[1] + model.word_code.start[s.number]
    words = ((0, model.by_class.ravel(), in_class), (2, sources[1], at[1]))
    _line_up(
        [inputs[k] for k, *_ in words],
        [np.concatenate([found, sources[WORD_FAMILIES + k]]) for k, found, _ in words],
        [in_line(start, at[WORD_FAMILIES + k] + len(found)) for k, found, start in words],
        length,
    )
    upper = model.upper_code.length[model.upper_number[s.number]]
    _spread(inputs[1], sources[0], at[0], upper, first[event])
    _spread(inputs[1], sources[WORD_FAMILIES + 1], at[WORD_FAMILIES + 1], byte_length, first[spell])
    of_byte = np.zeros(decisions + STEP, np.int8)
    of_byte[:decisions] = np.repeat(np.where(is_word, 0, 2).astype(np.int8), length)
    opens = first[event[s.opens]] if len(s.number) else np.empty(0, np.int64)
    size = np.diff(np.r_[opens, decisions])
    order = np.argsort(-size, kind="stable")
    got = np.zeros(len(order))
    got[order] = advance(opens[order], size[order], of_byte, inputs)
    return got - np.log10(CLASSES)  # the class is told first


VARIED = -128


def shortened(found: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Per run of ``found`` the one value it holds, or ``VARIED``."""
    if not len(start):
        return np.empty(0, np.int8)
    low = np.minimum.reduceat(found, start)
    return np.where(low == np.maximum.reduceat(found, start), low, np.int8(VARIED))


def lengthened(value: np.ndarray, varied: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs again, from their values and the varied ones' entries."""
    out = np.repeat(value, length)
    out[np.repeat(value == VARIED, length)] = varied
    return out


def _line_up(outs: list[np.ndarray], sources: list[np.ndarray], starts: list[np.ndarray], length: np.ndarray, many: int = 8_192) -> None:
    """For each of several sources its runs ``source[start : start + length]`` one after the other; some runs at a time."""
    done = 0
    for i in range(0, len(length), many):
        own = length[i : i + many]
        before = np.cumsum(own) - own
        at = np.arange(int(own.sum()))
        for out, source, start in zip(outs, sources, starts, strict=True):
            spot = np.repeat(start[i : i + many] - before, own)
            spot += at
            source.take(spot, out=out[done : done + len(at)], mode="clip")
        done += len(at)


def _spread(out: np.ndarray, source: np.ndarray, start: np.ndarray, length: np.ndarray, to: np.ndarray, many: int = 8_192) -> None:
    """The runs ``source[start : start + length]``, each from its place ``to`` on."""
    for i in range(0, len(length), many):
        own = length[i : i + many]
        before = np.cumsum(own) - own
        at = np.arange(int(own.sum()))
        place, spot = (np.repeat(x[i : i + many] - before, own) for x in (to, start))
        place += at
        spot += at
        out[place] = source.take(spot, mode="clip")


def advance(start: np.ndarray, count: np.ndarray, kind: np.ndarray, inputs: np.ndarray, first=FIRST_WEIGHTS, ahead: int = 16_384) -> np.ndarray:
    """log10 probabilities of texts sorted by falling length; they step side by side, each with its own weights.

    The predictions favour the turn that is taken, so its probability is the squashed sum, and a weight moves by what is missing to 1.
    ``kind`` and ``inputs`` go on for ``STEP`` entries behind the last text's. What does not depend on the weights is
    made ready for several steps at once, about ``ahead`` decisions.
    """
    lanes, gates = len(start), len(first)
    # per text, gate and predictor, so that the texts still going are the first rows
    weights = np.tile(np.array(first, np.float32).reshape(1, -1), (lanes, 1))
    total = np.zeros(lanes)
    within, last = np.arange(STEP), len(kind) - STEP
    lives = np.searchsorted(-count, -np.arange(0, int(count[0]) if lanes else 0, STEP), side="left")
    row = (np.arange(lanes) * (gates * PREDICTORS))[:, None]
    # from any place on, the entries of a step as one value
    parts = [np.ndarray(last + 1, f"V{STEP}", a, strides=(1,)) for a in (*inputs, kind)]
    low, high, one, rate = np.float32(-10), np.float32(10), np.float32(1), np.float32(RATE)
    nth = 0
    while nth < len(lives):
        live = int(lives[nth])
        # as long as most of these texts go on
        n = min(max(1, ahead // (live * STEP)), int(np.searchsorted(-lives, -0.85 * live, side="right")) - nth)
        done = (nth + np.arange(n))[:, None] * STEP
        spot = np.minimum(start[:live] + done, last)
        found = [a[spot].view(np.int8).reshape(n, live, STEP) for a in parts]
        x = np.empty((n, PREDICTORS, live, STEP), np.float32)
        for k in range(PREDICTORS):
            np.multiply(found[k], np.float32(-1 / SCALE), out=x[:, k])
        gate = found[-1] + (found[-2] != 0)
        gate *= PREDICTORS
        cell = np.empty((n, PREDICTORS, live, STEP), np.int64)
        np.add(gate, row[:live], out=cell[:, 0])
        for k in range(1, PREDICTORS):
            np.add(cell[:, 0], k, out=cell[:, k])
        gone = (done[:, :, None] + within) >= count[:live, None] if count[live - 1] < (nth + n) * STEP else None
        if gone is not None:  # nothing is learned there
            for k in range(PREDICTORS):
                x[:, k][gone] = 0
        hits = np.empty((n, live * STEP), np.float32)
        own = weights[:live].reshape(-1)
        for hit, now, to in zip(hits, x.reshape(n, PREDICTORS, -1), cell.reshape(n, PREDICTORS, -1), strict=True):
            np.einsum("kn,kn->n", now, own.take(to, mode="clip"), out=hit)
            np.minimum(np.maximum(hit, low, out=hit), high, out=hit)
            np.exp(hit, out=hit)
            hit += one
            np.reciprocal(hit, out=hit)
            missing = one - hit
            missing *= rate
            now *= missing
            own -= np.bincount(to.reshape(-1), weights=now.reshape(-1), minlength=len(own))
        hits = hits.reshape(n, live, STEP)
        if gone is not None:
            hits[gone] = 1
        for part in np.log10(hits.prod(axis=2, dtype=np.float64)):
            total[:live] += part
        nth += n
    return total
