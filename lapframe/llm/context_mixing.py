"""Language-model scoring by online logistic context mixing.

A text is a sequence of words; one space between words goes without saying, other
white space is a word of its own, and an end closes the text. The frequent words
of the training documents (``HEAD`` at most) have a Huffman code by their counts. Any
other word is an escape in that code and then its bytes, by a second Huffman code,
closed by an end. So a text is a sequence of binary decisions from which it can be
read back, and the score is the model's probability of the whole text.

Three predictors look up hashed contexts of each decision, each with the node of
the code. For words: the text's class; the class and the first eight bits of
the last word's code (for the first eight bits of this one's); the last two words. For
spelled bytes: the last byte with the class; the last three; the last five bytes
of the word. The class of a text is the bucket of its commonest two-byte letter,
told first at the cost of one of nine: it tells apart languages that share a
script. The stretched probabilities are combined by weights from one of four sets
(the gate): by word or byte, and whether the longest context is known. The
weights are refined online, after every ``STEP`` decisions, by the gradient of
the coding cost, and carried through the whole text however long it is. Each text
starts with the same weights, so the score of a document depends on its text and the
counts alone, not on what it is batched with. Inside a task, all texts of a lot
advance side by side in NumPy.

Counts are exact, kept for every pair of a context and its next symbol and over
all training documents, so they grow with the corpus (as do the bits of a
context's hash). Each lot sends its distinct pairs, with their uses in training,
to their hash range; that sums them over all lots and sends each lot the
predictions along the code of each of its pairs. A lot has a pair once, and the
symbols of a context are few (256 where it is short), so a frequent context is no hot group.

The base score needs exact counts of all training tokens: they are grouped by hash
range. Frequent tokens (``BASE_HEAD`` at most) are broadcast; the other tokens
of each document go to their hash range and come back as sums. Tokens are known by 64-bit hashes.

Defined cases: a null text is empty and scores its class and end alone; a null doc_id
counts as the empty text in the hold-out rule; repeated rows are scored each,
and count each in training; without training documents all counts are 0; other
columns are not read; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapframe.llm.bit_model import CLASSES, END_OF_WORD, FAMILIES, RANK_BITS, VARIED, Code, Model, Symbols, classes_of, contexts, distinct_pairs, mix_scores, predictions, shortened
from lapframe.llm.common import id_crc, shuffle_width, text_of
from lapframe.llm.jaccard_join import mix64
from lapframe.llm.packing import gather_runs, order_of, ordered, pack, split_points, steps, unpack, unpack_all
from lapframe.llm.suffix_dedup import blob_groups
from lapframe.session import materialize

HEAD, BASE_HEAD = 1 << 17, 1 << 18  # words that have a code, and tokens whose counts all tasks know
_LOT = 5_000_000  # bytes; larger lots send fewer pairs
_KNOWN_WORDS, _COUNTED_WORDS = 400_000, 400_000  # kept by a worker
_LONG_WORD = 256  # bytes; longer words are hashed one by one
_END_TOKEN = b" "  # no word can be this: the key of the end token
_SPACE, _BASE_ONLY = 0xFFFF, 0xFFFE  # tags: white space, which the base score does not count; the end token, which the model has apart
_BLOB = "grp long, kind int, blob binary"
#: Kinds of rows: a lot's own, its rare tokens, its pairs, counts of tokens; this plus a hash range, what the range answers.
_OWN, _TAIL_KIND, _PAIR_KIND, _COUNTS, _ANSWER = 0, 1, 2, 3, 16
_BASE_KIND, _WORD_KIND, _BYTE_KIND = 0, 1, 2  # of merged counts
_PAIR = [np.uint64, np.uint32, np.uint32, np.uint32]  # steps of the contexts, symbols of each, their numbers, uses
_BINS = 8  # of counts, to an octave


def lots(batch: pa.RecordBatch, size: int = 2_000_000) -> Iterator[tuple[list, list[bytes]]]:
    """doc_ids and texts of about ``size`` bytes at a time."""
    ids, texts, held = [], [], 0
    for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
        raw = text.as_py()
        ids.append(doc), texts.append(raw)
        held += len(raw) + 1
        if held >= size:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def learns(doc_id: int | None) -> bool:
    return id_crc(doc_id) % 7 != 2


def words_of_text(raw: bytes) -> list[bytes]:
    """Words and white space; single spaces between words are left out, other ones stand for themselves."""
    start, size, _ = split_words(np.frombuffer(raw, np.uint8), np.array([len(raw)]))
    return _cut(raw, start, size)


def split_words(raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of several texts, one after the other, start; their sizes; and the number of words of each text."""
    ends = np.cumsum(sizes)
    opens = (ends - sizes)[sizes > 0]
    space = (raw == 32) | (raw - np.uint8(9) < 5)
    fresh = np.ones(len(raw), bool)
    np.not_equal(space[1:], space[:-1], out=fresh[1:])
    fresh[opens] = True
    start = np.flatnonzero(fresh)
    size = np.diff(np.r_[start, len(raw)])
    bare = (size == 1) & (raw[start] == 32)
    first = np.searchsorted(start, opens)
    bare[first] = False
    bare[np.r_[first[1:], len(start)][: len(first)] - 1] = False  # the last of each text
    start, size = start[~bare], size[~bare]
    return start, size, np.diff(np.r_[0, np.searchsorted(start, ends)])


def _cut(raw: bytes, start: np.ndarray, size: np.ndarray) -> list[bytes]:
    return [raw[a:b] for a, b in zip(start.tolist(), (start + size).tolist(), strict=True)]


def _distinct_words(raw: bytes, start: np.ndarray, size: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes of the distinct pairs of a word and its number ``of``; one place of each, how often it occurs, and the pair of each word."""
    eights = np.ndarray(len(raw), "V8", raw + bytes(8), strides=(1,))  # from any place on
    key = mix64(size.astype(np.uint64) + (of.astype(np.uint64) << np.uint64(40)))
    live, at, left = np.arange(len(start)), start, size
    for _ in range(0, _LONG_WORD, 8):
        if not len(live):
            break
        part = eights[at].view(np.uint64) << (np.uint64(8) * (np.uint64(8) - np.minimum(left, 8).astype(np.uint64)))
        key[live] = mix64(key[live] ^ part) + np.uint64(1)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    if len(live):
        rest = _hashes(_cut(raw, at, left))
        key[live] = mix64(key[live] ^ rest)
    order, key = ordered(key)
    distinct, bounds = split_points(key)
    which = np.empty(len(key), np.int64)
    which[order] = np.repeat(np.arange(len(distinct)), np.diff(bounds))
    return distinct, order[bounds[:-1]], np.diff(bounds), which


class _Table:
    """Columns of distinct words by the words' hashes, sorted. A worker's keeps what its lots have in common."""

    def __init__(self, dtypes: list[type]):
        self.dtypes = dtypes
        self.forget()

    def __len__(self) -> int:
        return len(self.key)

    def forget(self) -> None:
        self.key, self.columns = np.empty(0, np.uint64), [np.empty(0, d) for d in self.dtypes]

    def places(self, key: np.ndarray, made: Callable[[np.ndarray], tuple[np.ndarray, ...]]) -> np.ndarray:
        """The places of sorted, distinct hashes; those that are not there are put in, with what ``made`` returns for their places among ``key``."""
        at = np.searchsorted(self.key, key)
        known = np.zeros(len(key), bool)
        inside = at < len(self.key)
        known[inside] = self.key[at[inside]] == key[inside]
        fresh = np.flatnonzero(~known)
        if not len(fresh):
            return at
        # each goes before the entries that are greater, and after the fresh ones before it
        to, kept = at[fresh] + np.arange(len(fresh)), np.ones(len(self.key) + len(fresh), bool)
        kept[to] = False
        for k, (old, new) in enumerate(zip([self.key, *self.columns], [key[fresh], *made(fresh)], strict=True)):
            whole = np.empty(len(kept), old.dtype)
            whole[kept], whole[to] = old, new
            if k:
                self.columns[k - 1] = whole
            else:
                self.key = whole
        return at + np.cumsum(~known) - ~known


# --- keys of words ---------------------------------------------------------------------------------


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word in lower case, and a tag that tells its capitals: 0 if it has none."""
    lower = [w.lower() for w in words]
    tag = [_SPACE if w[0] <= 32 and (w[0] == 32 or 9 <= w[0] <= 13) else 0 if w == x else 1 + xxhash.xxh32_intdigest(w) % 65_000 for w, x in zip(words, lower, strict=True)]
    return _hashes(lower), np.array(tag, np.uint16)


def _identity(lower: np.ndarray, tag: np.ndarray) -> np.ndarray:
    return mix64(lower ^ mix64(tag.astype(np.uint64) + np.uint64(1)))


# --- what is gathered from the corpus ---------------------------------------------------------------


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    g, kind, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], ["grp", "kind", "blob"])


def _grouped(key: np.ndarray, groups: int, arrays: list[np.ndarray], kind: int) -> list[tuple[int, int, bytes]]:
    """The arrays by the hash range of ``key``, in its order; the first one, the key itself, as differences."""
    order = order_of(key)
    ranges, bounds = split_points(_range_of(key[order], 64, groups))
    sent = [a[order] for a in arrays]
    return [(int(g), kind, pack([steps(key[order[i:j]]), *[a[i:j] for a in sent]])) for g, i, j in zip(ranges, bounds[:-1], bounds[1:], strict=True)]


def _range_of(key: np.ndarray, bits: int, groups: int) -> np.ndarray:
    """The hash range of each key of ``bits`` bits: its topmost 28 bits, scaled."""
    return (((key >> np.uint64(bits - 28)) * np.uint64(groups)) >> np.uint64(28)).astype(np.int64)


def _unsteps(blobs: list[bytes], dtypes: list[type]) -> list[np.ndarray]:
    """The arrays of several blobs, of which the first holds differences."""
    parts = [unpack(b, dtypes) for b in blobs]
    parts = [[np.cumsum(p[0], dtype=np.uint64), *p[1:]] for p in parts]
    return [np.concatenate([p[k] for p in parts]) if parts else np.empty(0, d) for k, d in enumerate(dtypes)]


def _count_words(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Table([np.uint64, np.uint16, np.uint8, np.int64])  # the lower word's hash, the tag, the class, the uses
        texts_of, of_bytes = np.zeros(CLASSES, np.int64), np.zeros(257, np.int64)

        def flush() -> pa.RecordBatch:
            lower, *rest = seen.columns
            seen.forget()
            return _rows(_grouped(lower, groups, rest, 0))

        for batch in batches:
            for ids, texts in lots(batch, _LOT):
                texts = [t for i, t in zip(ids, texts, strict=True) if learns(i)]
                if not texts:
                    continue
                of_text, raw = classes_of(texts), b"".join(texts)
                start, size, n_words = split_words(np.frombuffer(raw, np.uint8), np.array([len(t) for t in texts], np.int64))
                of_class = np.repeat(of_text, n_words)
                key, one, n, _ = _distinct_words(raw, start, size, of_class)
                start, size, of_class = start[one], size[one], of_class[one]
                place = seen.places(key, lambda k: (*_keys(_cut(raw, start[k], size[k])), of_class[k], 0))  # noqa: B023
                seen.columns[-1][place] += n
                texts_of += np.bincount(of_text, minlength=CLASSES)
                of_bytes[:256] += np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
                of_bytes[END_OF_WORD] += int(n.sum())
                if len(seen) > _COUNTED_WORDS:
                    yield flush()
        yield flush()
        ends = pack([steps(_hashes([_END_TOKEN])), np.array([_BASE_ONLY], np.uint16), np.zeros(1, np.uint8), texts_of.sum(keepdims=True)])
        yield _rows([(int(_range_of(_hashes([_END_TOKEN]), 64, groups)[0]), 0, ends), (-1, 0, pack([of_bytes, texts_of]))])

    return run


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = order_of(key)
    keys, bounds = split_points(key[order])
    return keys, np.add.reduceat(n[order], bounds[:-1]) if len(keys) else n[:0]


def _merge_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per hash range: the tokens' counts, sorted by hash, and the words' by identity and class; range -1: counts of bytes, and of texts by class."""
    for group, blobs in blob_groups(batches):
        if group < 0:
            parts = [unpack(b, [np.int64, np.int64]) for b in blobs[0]]
            out = [(-1, _BYTE_KIND, pack([sum(p[0] for p in parts), sum(p[1] for p in parts)]), 0, 0)]
        else:
            lower, tag, of_class, n = _unsteps(blobs[0], [np.uint64, np.uint16, np.uint8, np.int64])
            token = (tag != _SPACE) & (n > 0)
            keys, total = _summed(lower[token], n[token])
            out = [(group, _BASE_KIND, pack([steps(keys), total]), len(keys), int(total.sum()))]
            word = tag != _BASE_ONLY
            identity = _identity(lower[word], tag[word])
            order = np.lexsort((of_class[word], identity))
            identity, of_class, n = identity[order], of_class[word][order], n[word][order]
            starts = np.flatnonzero(np.r_[True, (identity[1:] != identity[:-1]) | (of_class[1:] != of_class[:-1])]) if len(identity) else np.empty(0, np.int64)
            out.append((group, _WORD_KIND, pack([steps(identity[starts]), of_class[starts], np.add.reduceat(n, starts) if len(starts) else n]), 0, 0))
        g, kind, blob, types, count = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary()), pa.array(types, pa.int64()), pa.array(count, pa.int64())], ["grp", "kind", "blob", "types", "count"])


_TOKEN_COUNTS, _WORD_COUNTS = [np.uint64, np.int64], [np.uint64, np.uint8, np.int64]


def _totals(kind: int, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    if kind == _BASE_KIND:
        return tuple(_unsteps([blob], _TOKEN_COUNTS))
    identity, _, n = _unsteps([blob], _WORD_COUNTS)
    return _summed(identity, n)


def _bin(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(n, 1)) * _BINS).astype(np.int64)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, bin, n): how many tokens and words have counts of each size; under kind 2, the uses of words in each class."""
    for batch in batches:
        out = []
        for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            found = np.bincount(_bin(_totals(kind, blob)[1]))
            out += [(kind, b, int(found[b])) for b in np.flatnonzero(found).tolist()]
            if kind == _WORD_KIND:
                _, of_class, n = _unsteps([blob], _WORD_COUNTS)
                uses = np.bincount(of_class, weights=n, minlength=CLASSES)
                out += [(2, c, int(uses[c])) for c in range(CLASSES)]
        kind, b, n = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["kind", "bin", "n"])


def _frequent(least: dict[int, int]):
    """The tokens and words whose counts lie in the bin ``least`` of their kind or above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                keys, total = _totals(kind, blob)
                keys = keys[(_bin(total) >= least[kind]) & (total > 1)]
                arrays = _unsteps([blob], _TOKEN_COUNTS if kind == _BASE_KIND else _WORD_COUNTS)
                kept = np.isin(arrays[0], keys)
                if kept.any():
                    out.append((-1, kind, pack([a[kept] for a in arrays])))
            yield _rows(out)

    return run


def _least_bins(sizes: list[tuple[int, int, int]]) -> dict[int, int]:
    """Per kind the smallest bin from which on no more entries lie than may be broadcast."""
    out = {}
    for kind, most in ((_BASE_KIND, BASE_HEAD), (_WORD_KIND, HEAD)):
        held, out[kind] = 0, 1 << 30
        for _, b, n in sorted((x for x in sizes if x[0] == kind), reverse=True):
            held += n
            if held > most:
                break
            out[kind] = b
    return out


def _model(words: list[np.ndarray], uses: np.ndarray, of_bytes: np.ndarray, texts: np.ndarray, bits: int) -> Model:
    """``words``: identity, class and count of frequent words; ``uses``: of all words by class; ``texts``: by class."""
    identity, of_class, n = words
    keys, place = np.unique(identity, return_inverse=True)
    by_class = np.zeros((CLASSES, len(keys) + 2), np.int64)
    np.add.at(by_class, (of_class, place), n)
    by_class[:, -2] = uses - by_class[:, :-2].sum(axis=1)  # escapes
    by_class[:, -1] = texts  # ends
    code, number = Code.of_counts(by_class.sum(axis=0))
    ordered = np.empty_like(by_class)
    ordered[:, number] = by_class
    size = by_class.shape[1]
    along, _ = predictions(code, np.repeat(np.arange(CLASSES), size), np.tile(np.arange(size), CLASSES), ordered.ravel())
    byte_code, byte_number = Code.of_counts(of_bytes)
    return Model(keys, number[:-2], code.length.astype(np.uint8), int(number[-2]), int(number[-1]), byte_code.length.astype(np.uint8), byte_number, along.reshape(CLASSES, -1), bits)


# --- scoring ------------------------------------------------------------------------------------------


_DOC = [np.int64, np.uint8, np.int64, np.int64, np.float64, np.uint8, np.int64, np.uint32, np.uint8, np.int32]  # doc_id, null, tokens, known, base; class, words; numbers, spelled bytes, their sizes
_TAIL = [np.uint64, np.int64, np.int32, np.int32]  # token, lot, row in the lot, times
_SUM = [np.int32, np.float64, np.int64]  # row in the lot, sum of logarithms, known


class _Words:
    """What is known of words: the number in the code, the token's hash, and what it adds to the base score (-1 if rare, NaN if white space). Begun anew when full."""

    def __init__(self, model: Model, head: tuple[np.ndarray, np.ndarray]):
        self.model, self.head = model, head
        self.table = _Table([np.int64, np.uint64, np.float64])

    def look_up(self, key: np.ndarray, words_at: Callable[[np.ndarray], list[bytes]]) -> list[np.ndarray]:
        """The three for sorted, distinct hashes of words; ``words_at`` gives the words at places among them."""
        if len(self.table) > _KNOWN_WORDS:
            self.table.forget()
        place = self.table.places(key, lambda k: self._made(words_at(k)))
        return [c[place] for c in self.table.columns]

    def _made(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lower, tag = _keys(words)
        token, count = self.head
        at = np.minimum(np.searchsorted(token, lower), max(len(token) - 1, 0))
        known = token[at] == lower if len(token) else np.zeros(len(lower), bool)
        value = np.where(known, np.log10((count[at] if len(token) else np.zeros(len(lower))) + 1.0), -1.0)
        value[tag == _SPACE] = np.nan
        return self.model.number_of(_identity(lower, tag)), lower, value


def _counted(token: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs and how often each occurs. Pairs are sorted by one mixed number, which is faster than by both."""
    order = order_of(token ^ ((row.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))
    token, row = token[order], row[order]
    starts = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (row[1:] != row[:-1])]) if len(token) else np.empty(0, np.int64)
    return token[starts], row[starts], np.diff(np.r_[starts, len(token)]).astype(np.int32)


def _requests(model: Model, s: Symbols, learned: np.ndarray, groups: int) -> list[tuple[int, int, bytes]]:
    """The distinct pairs of a lot by hash range: per family the contexts, the symbols of each, and how often each pair is used in training."""
    of_word = np.repeat(learned, s.words).astype(np.float64)
    of_byte = np.repeat(of_word[s.number == model.escape], s.spelled_size + 1)
    arrays: list[list[np.ndarray]] = [[] for _ in range(groups)]
    for family, found in enumerate(contexts(model, s)):
        keys, which = distinct_pairs(found, rank_bits := RANK_BITS[family], model.bits)
        n = np.bincount(which, weights=of_byte if family > 1 else of_word, minlength=len(keys)).astype(np.uint32)
        context, number = keys >> np.uint64(rank_bits), (keys & np.uint64((1 << rank_bits) - 1)).astype(np.uint32)
        ends = np.searchsorted(_range_of(context, model.bits, groups), np.arange(groups + 1))
        for g in range(groups):
            a, b = ends[g], ends[g + 1]
            distinct, bounds = split_points(context[a:b])
            arrays[g] += [steps(distinct), np.diff(bounds).astype(np.uint32), number[a:b], n[a:b]]
    return [(g, _PAIR_KIND, pack(a)) for g, a in enumerate(arrays) if any(map(len, a))]


def _answers(model: Model, group: int, lots_of: list[int], blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Sums of the uses of each pair of a hash range, and for each lot the predictions for its pairs."""
    asked = [unpack(b, _PAIR * FAMILIES) for b in blobs]
    answers: list[list[np.ndarray]] = [[] for _ in asked]
    for family, (code, rank_bits) in enumerate(zip(model.codes, RANK_BITS, strict=True)):
        own = [a[4 * family : 4 * family + 4] for a in asked]
        keys = np.concatenate([np.repeat(np.cumsum(c, dtype=np.uint64), m) << np.uint64(rank_bits) | r for c, m, r, _ in own])
        n = np.concatenate([x[3] for x in own])
        order, keys = ordered(keys)
        fresh = np.r_[True, keys[1:] != keys[:-1]][: len(keys)]
        starts = np.flatnonzero(fresh)
        which = np.empty(len(keys), np.int64)
        which[order] = np.cumsum(fresh) - 1
        distinct = keys[starts]
        number = (distinct & np.uint64((1 << rank_bits) - 1)).astype(np.int64)
        found, start = predictions(code, distinct >> np.uint64(rank_bits), number, np.add.reduceat(n[order].astype(np.int64), starts) if len(starts) else n)
        length, at = code.length[number], 0
        value = shortened(found, start, length)
        for a, (*_, r, _) in zip(answers, own, strict=True):
            mine = which[at : at + len(r)]
            at += len(r)
            varied = mine[value[mine] == VARIED]
            a += [value[mine], gather_runs(found, start[varied], length[varied])]
    for k in range(0, len(answers), 64):
        yield _rows([(to, _ANSWER + group, pack(a)) for to, a in zip(lots_of[k : k + 64], answers[k : k + 64], strict=True)])


def _gather(model, head, groups: int):
    """Per lot: its symbols with what frequent tokens add (kind 0), its rare tokens (1) and its pairs (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, known, number = TaskContext.get().partitionId(), _Words(model.value, head.value), 0
        end, escape = model.value.end, model.value.escape
        for batch in batches:
            for ids, texts in lots(batch, _LOT):
                lot = (task << 24) + number
                number += 1
                raw = b"".join(texts)
                start, length, size = split_words(np.frombuffer(raw, np.uint8), np.array([len(t) for t in texts], np.int64))
                key, one, _, which = _distinct_words(raw, start, length, np.zeros(len(start), np.int64))
                number_of, token_of, value_of = known.look_up(key, lambda k: _cut(raw, start[one[k]], length[one[k]]))  # noqa: B023
                row = np.repeat(np.arange(len(texts)), size)
                value = value_of[which]
                token = ~np.isnan(value)
                rare = token & (value < 0)
                # the end is a token as frequent as training texts, so all lots know it or none does
                last = known.head[1][known.head[0] == _hashes([_END_TOKEN])[0]]
                base = np.bincount(row, weights=np.where(token & ~rare, value, 0), minlength=len(texts)) + (math.log10(last[0] + 1) if len(last) else 0)
                n_tokens = np.bincount(row[token], minlength=len(texts)) + 1
                n_known = np.bincount(row[token & ~rare], minlength=len(texts)) + len(last)
                h, r = token_of[which[rare]], row[rare]
                if not len(last):
                    h, r = np.r_[h, np.repeat(_hashes([_END_TOKEN]), len(texts))], np.r_[r, np.arange(len(texts))]
                of_word = number_of[which]
                coded = np.full(len(of_word) + len(texts), end, np.int64)
                is_word = np.ones(len(coded), bool)
                is_word[np.cumsum(size + 1) - 1] = False
                coded[is_word] = of_word
                escaped = of_word == escape
                spelled = gather_runs(np.frombuffer(raw, np.uint8), start[escaped], length[escaped])
                symbols = Symbols(classes_of(texts), size + 1, coded, spelled, length[escaped].astype(np.int32))
                doc = np.array([0 if i is None else i for i in ids], np.int64)
                null = np.array([i is None for i in ids], np.uint8)
                rows = [(-2 - lot, _OWN, pack([doc, null, n_tokens.astype(np.int64), n_known.astype(np.int64), base, symbols.text_class.astype(np.uint8), symbols.words, coded.astype(np.uint32), symbols.spelled, symbols.spelled_size]))]
                h, r, times = _counted(h, r.astype(np.int32))
                rows += _grouped(h, groups, [np.full(len(h), lot, np.int64), r, times], _TAIL_KIND)
                rows += _requests(model.value, symbols, np.array([learns(i) for i in ids]), groups)
                yield _rows(rows).append_column("lot", pa.array(np.full(len(rows), lot, np.int64)))

    return run


def _tail_sums(counted: list[bytes], asked: list[bytes]) -> Iterator[pa.RecordBatch]:
    """For each lot the sums of what its rows' rare tokens of a hash range add."""
    keys, counts = _unsteps(counted, _TOKEN_COUNTS)
    h, lot, row, times = _unsteps(asked, _TAIL)
    if not len(h):
        return
    n = np.zeros(len(h), np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        n = np.where(keys[at] == h, counts[at], 0)
    order = np.lexsort((row, lot))
    lot, row, n, times = lot[order], row[order], n[order], times[order]
    starts = np.flatnonzero(np.r_[True, (lot[1:] != lot[:-1]) | (row[1:] != row[:-1])])
    sums, seen = np.add.reduceat(np.log10(n + 1) * times, starts), np.add.reduceat((n > 0) * times, starts).astype(np.int64)
    which, ends = split_points(lot[starts])
    yield _rows([(int(g), 1, pack([row[starts[a:b]], sums[a:b], seen[a:b]])) for g, a, b in zip(which, ends[:-1], ends[1:], strict=True)])


def _serve(model):
    """What each hash range adds to the lots. The lots' own rows, under negative numbers, pass."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
        now, held = None, []
        for batch in batches:
            for g, kind, lot, blob in zip(*[batch.column(c).to_pylist() for c in ("grp", "kind", "lot")], batch.column("blob"), strict=True):
                if g != now:
                    if held:
                        yield now, held
                    now, held = g, []
                held.append((kind, lot, blob.as_py()))
        if held:
            yield now, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, rows in groups(batches):
            if g < 0:
                yield _rows([(lot, kind, blob) for kind, lot, blob in rows])
                continue
            counted, tail, asked = ([x for x in rows if x[0] == kind] for kind in (_COUNTS, _TAIL_KIND, _PAIR_KIND))
            yield from _tail_sums([x[2] for x in counted], [x[2] for x in tail])
            if asked:
                yield from _answers(model.value, g, [x[1] for x in asked], [x[2] for x in asked])

    return run


def _finish(model, train_tokens: int, types: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = math.log10(train_tokens + types + 1)
        for _, blobs in blob_groups(batches):
            doc, null, n_tokens, n_known, base, of_class, words, coded, spelled, sizes = (a.copy() for a in unpack(blobs[_OWN][0], _DOC))
            row, sums, seen = unpack_all(blobs.get(_TAIL_KIND, []), _SUM)
            answers = unpack_all([b for kind in sorted(blobs) if kind >= _ANSWER for b in blobs[kind]], [np.int8] * (2 * FAMILIES))
            score = mix_scores(model.value, Symbols(of_class.astype(np.int64), words, coded.astype(np.int64), spelled, sizes), answers)
            order = np.lexsort((sums, row))  # a fixed order of addition
            np.add.at(base, row[order], sums[order])
            np.add.at(n_known, row, seen)
            ids = [None if gone else int(d) for d, gone in zip(doc, null, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([not learns(d) for d in ids], pa.bool_()), pa.array(n_tokens), pa.array(n_known), pa.array(np.full(len(doc), train_tokens, np.int64)), pa.array(base - n_tokens * unit), pa.array(score)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def score_documents(docs: DataFrame, group_bytes: int = 8_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    n_bytes = texts.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    groups, bits = max(1, n_bytes // group_bytes), min(44, max(32, n_bytes.bit_length() + 5))
    gathered = texts.mapInArrow(_count_words(groups), _BLOB).repartition("grp").sortWithinPartitions("grp")
    counts = materialize(gathered.mapInArrow(_merge_counts, f"{_BLOB}, types long, count long"), "lm-tokens")
    size = counts.agg(F.coalesce(F.sum("types"), F.lit(0)).alias("v"), F.coalesce(F.sum("count"), F.lit(0)).alias("n")).first()
    merged = counts.where(F.col("kind") != _BYTE_KIND).select("kind", "blob")
    # some hundreds of bins, whatever the input
    sizes = [tuple(r) for r in merged.mapInArrow(_sizes, "kind int, bin long, n long").groupBy("kind", "bin").agg(F.sum("n").alias("n")).collect()]
    # BASE_HEAD tokens and HEAD words at most
    often = merged.mapInArrow(_frequent(_least_bins(sizes)), _BLOB).select("kind", "blob").collect()
    of = {kind: [bytes(r["blob"]) for r in often if r["kind"] == kind] for kind in (_BASE_KIND, _WORD_KIND)}
    uses = np.zeros(CLASSES, np.int64)
    for _, c, n in (x for x in sizes if x[0] == 2):
        uses[c] = n
    rest = counts.where(F.col("kind") == _BYTE_KIND).select("blob").first()
    of_bytes, of_texts = unpack(bytes(rest["blob"]), [np.int64, np.int64]) if rest else (np.zeros(257, np.int64), np.zeros(CLASSES, np.int64))
    model = context.broadcast(_model(unpack_all(of[_WORD_KIND], _WORD_COUNTS), uses, of_bytes, of_texts, bits))
    tokens, count = unpack_all(of[_BASE_KIND], [np.uint64, np.int64])
    order = np.argsort(tokens)
    head = context.broadcast((tokens[order], count[order]))
    # a lot is known by its place in its partition of the scan, so a task that runs again gives it the same number
    gathered = texts.mapInArrow(_gather(model, head, groups), f"{_BLOB}, lot long")
    known = counts.where(F.col("kind") == _BASE_KIND).select("grp", F.lit(_COUNTS).alias("kind"), "blob", F.lit(-1).cast("long").alias("lot"))
    parts = max(shuffle_width(docs.sparkSession), groups // 4)
    served = gathered.unionByName(known).repartition(parts, "grp").sortWithinPartitions("grp").mapInArrow(_serve(model), _BLOB)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return served.repartition(parts, "grp").sortWithinPartitions("grp").mapInArrow(_finish(model, size["n"], size["v"]), schema)
