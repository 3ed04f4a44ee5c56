"""Removal of repeated 50-byte strings by bucket-pointer refinement of suffixes.

A byte goes if some 50-byte string that covers it also starts in a document
with a smaller doc_id. The suffixes (starts of 50-byte windows) are never all
compared with each other:

1. Initial buckets. Each window belongs to the smallest 10-byte gram in it (by a
   hash); neighbouring windows with the same one stay together as a run of bytes.
   Equal windows have equal grams, so they meet in one bucket. Runs are sent,
   compressed, to the group of buckets that their gram hashes to. A batch sends
   equal runs once, for the smallest document, and marks the others itself: a
   passage that a third of all documents hold leaves each batch once. The runs of
   a gram that a sample finds in very many documents, each among other
   surroundings, would still fill one bucket: they go window by window, each by the
   hash of all its bytes. The sample decides only where windows meet.
2. Refinement. In a group, runs whose gram no other document has are dropped, and
   equal runs are settled as in a batch. The windows left are sorted by the grams of
   8 bytes at two offsets, twice; then they get bucket pointers by sorting: the
   bucket of 16 bytes from the pointers of 8 bytes at offsets 0 and
   8, that of 32 bytes from the updated pointers at 0 and 16, that of 50 from
   those at 0 and 18. After each step, buckets of one document are left out.
3. A window whose bucket holds a smaller document is repeated. Intervals of
   repeated windows meet the texts again by document, and the bytes are removed.

Groups of buckets and groups of documents hold about ``group_bytes`` of text
each, so their number grows with the input and a task's memory does not. Large
groups of equal texts (more than 1 / 2000 of the rows and more than 100) are
settled by their digest: the first document stays in the search for all.

Defined cases: a null text is empty. Rows repeated with one doc_id and the same
or another text are one document: they don't repeat each other. A null doc_id
ranks after all others. Texts of under 50 bytes stay. Other columns are not
read; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapframe.llm.common import text_of
from lapframe.llm.jaccard_join import mix64
from lapframe.llm.packing import gather_runs, pack, split_points, steps, unpack, unpack_all, walk

LENGTH = 50
GRAM = 10
NO_ID = np.int64(2**63 - 1)
_BASE = 0x9E3779B97F4A7C15
LEVEL = 5  # of compression, for what is sent in bulk
_SLICE = 2_000_000  # bytes of text handled at once in a task
_PART = 2_000_000  # bytes of runs refined at once in a task
_SAMPLE, _MOST_HOT = 5_000, 10_000  # documents in which hot grams are looked for; and how many are told apart
_RUN = [np.uint8, np.uint16, np.uint8, np.int64, np.uint32, np.int32]  # bytes, length, place of the gram, step of doc, text key, start
_MARK = [np.int64, np.uint32, np.int32, np.int32]  # doc, text key, first window, last window


def eight_bytes(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one integer; 0 stands past the end."""
    x = np.zeros(len(text) + 8, np.uint64)
    x[: len(text)] = text
    for k in (1, 2, 4):
        x[:-k] |= x[k:] << np.uint64(8 * k)
    return x[: len(text)]


def _gram_hash(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of a gram, given as the 8 at their beginning and the 8 at their end."""
    return mix64(first ^ mix64(last + np.uint64(_BASE)))


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """The hash of the gram at each position of ``text`` (one byte string)."""
    x = eight_bytes(text)
    n = len(text) - GRAM + 1
    return _gram_hash(x[:n], x[GRAM - 8 : GRAM - 8 + n])


def smallest_grams(h: np.ndarray) -> np.ndarray:
    """For each window start the smallest of the gram hashes ``h`` in the window."""
    span, wide = 1, LENGTH - GRAM + 1
    while span * 2 <= wide:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (wide - span)], h[wide - span :]) if wide > span else h


def grams_at(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The hashes of the grams at some places."""
    words = [np.zeros(len(places), np.uint64) for _ in range(2)]
    for k in range(8):
        for word, ahead in zip(words, (0, GRAM - 8), strict=True):
            word |= text[places + (k + ahead)].astype(np.uint64) << np.uint64(8 * k)
    return _gram_hash(*words)


def _powers(n: int, base: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)], dtype=np.uint64)


_UP, _DOWN = np.empty(0, np.uint64), np.empty(0, np.uint64)


def run_hashes(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each run's bytes, from one running polynomial sum."""
    global _UP, _DOWN
    if len(_UP) < len(text) + 1:
        _UP, _DOWN = _powers(len(text), _BASE), _powers(len(text), pow(_BASE, -1, 2**64))
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * _UP[: len(text)], out=sums[1:])
    return mix64((sums[starts + lengths] - sums[starts]) * _DOWN[starts] ^ mix64(lengths.astype(np.uint64)))


def settle_equal(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """True for each run of which an equal run lies in a smaller document."""
    h = run_hashes(text, starts, lengths)
    order = np.lexsort((doc, h))
    first = np.r_[True, h[order][1:] != h[order][:-1]]
    lead = np.empty(len(order), np.int64)
    lead[order] = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    later = np.flatnonzero((doc > doc[lead]) & (lengths == lengths[lead]))
    same = np.zeros(len(order), bool)
    if len(later):  # compare the bytes themselves
        size = lengths[later]
        equal = gather_runs(text, starts[later], size) == gather_runs(text, starts[lead[later]], size)
        same[later] = np.logical_and.reduceat(equal, np.r_[0, np.cumsum(size)[:-1]])
    return same


def _order(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal pairs are neighbours, and where each pair begins in it."""
    order = np.argsort(mix64(a ^ mix64(b + np.uint64(0xD1B54A32D192ED03))))
    a, b = a[order], b[order]
    return order, np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]


def pointers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bucket pointers of pairs: equal pairs, and only they, get the same number."""
    order, begins = _order(a, b)
    out = np.empty(len(a), np.uint64)
    out[order] = np.cumsum(begins).astype(np.uint64)
    return out


def documents_of(order: np.ndarray, begins: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: the smallest and the largest document of its bucket."""
    starts = np.flatnonzero(begins)
    sizes = np.diff(np.r_[starts, len(order)])
    low, high = np.empty_like(doc), np.empty_like(doc)
    low[order] = np.repeat(np.minimum.reduceat(doc[order], starts), sizes)
    high[order] = np.repeat(np.maximum.reduceat(doc[order], starts), sizes)
    return low, high


def smallest_doc(bucket: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(bucket)
    sorted_bucket = bucket[order]
    return documents_of(order, np.r_[True, sorted_bucket[1:] != sorted_bucket[:-1]], doc)


def refine(text: np.ndarray, windows: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which of the ``windows`` (starts in ``text``) equal a window of a smaller document.

    8-byte grams are their own bucket numbers. Buckets of the grams at two offsets of the
    window itself come first, since they leave most windows with one document; then
    the pointers of each step serve the next one at later offsets.
    """
    repeated, alive = np.zeros(len(windows), bool), np.arange(len(windows))
    gram = eight_bytes(text)
    for near, far in ((0, LENGTH - 8), (17, 29)):
        at = windows[alive]
        low, high = documents_of(*_order(gram[at + near], gram[at + far]), doc[alive])
        alive = alive[low != high]
        if not len(alive):
            return repeated
    bucket = gram
    for reach, ahead in ((8, (0, 16, 18, 34)), (16, (0, 18)), (18, (0,))):
        at = windows[alive]
        spots = np.unique(np.concatenate([at + k for k in ahead])) if len(ahead) > 1 else at
        found = pointers(bucket[spots], bucket[spots + reach])
        if len(ahead) > 1:
            bucket = np.zeros(len(text), np.uint64)
            bucket[spots] = found
            found = bucket[at]
        low, high = smallest_doc(found, doc[alive])
        if len(ahead) == 1:
            repeated[alive[doc[alive] > low]] = True
            return repeated
        alive = alive[low != high]
        if not len(alive):
            return repeated
    return repeated


def _text_key(raw: bytes) -> int:
    """Tells different texts of one doc_id apart."""
    return xxhash.xxh32_intdigest(raw)


def _runs_of(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows, gram and its place of each run; ``bounds``: the documents' starts in ``text``, and its end."""
    if len(text) < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint8)
    h = gram_hashes(text)
    gram = smallest_grams(h)
    inside = np.zeros(len(gram) + 1, np.int8)  # windows must not cross documents
    size = np.diff(bounds)
    for a, b in ((bounds[:-1], 1), (bounds[:-1] + np.maximum(size - LENGTH + 1, 0), -1)):
        np.add.at(inside, np.minimum(a, len(gram)), b)
    inside = np.cumsum(inside[:-1]) > 0
    begins = inside.copy()
    begins[1:] &= (gram[1:] != gram[:-1]) | ~inside[:-1]
    opening = bounds[:-1][bounds[:-1] < len(gram)]
    begins[opening[inside[opening]]] = True
    starts = np.flatnonzero(begins)
    ends = np.r_[starts[1:], len(gram)]
    if (~inside).any():
        outside = np.flatnonzero(~inside)
        nearest = np.searchsorted(outside, starts)
        ends = np.minimum(ends, np.where(nearest < len(outside), outside[np.minimum(nearest, len(outside) - 1)], len(gram)))
    place = np.empty(len(starts), np.uint8)
    for i in range(0, len(starts), 20_000):
        own = starts[i : i + 20_000, None] + np.arange(LENGTH - GRAM + 1)
        place[i : i + 20_000] = h[own].argmin(axis=1)
    return starts, ends - starts, gram[starts], place


def _first_gram(text: np.ndarray, window: int, gram: np.uint64) -> int:
    """Where ``gram`` first stands in a window."""
    return window + int(np.flatnonzero(gram_hashes(text[window : window + LENGTH]) == gram)[0])


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in lots of about _SLICE bytes with doc, text key and offset; a longer text is cut with 49 bytes of overlap."""
    ids = batch.column("doc_id").fill_null(NO_ID).to_pylist()
    lot: list[tuple[bytes, int, int, int]] = []
    held = 0
    for doc, text in zip(ids, batch.column("text").cast(pa.binary()), strict=True):
        raw = text.as_py()
        if len(raw) < LENGTH:
            continue
        key = _text_key(raw)
        for at in range(0, len(raw) - LENGTH + 1, _SLICE):
            lot.append((raw[at : at + _SLICE + LENGTH - 1], doc, key, at))
            held += len(lot[-1][0])
            if held >= _SLICE:
                yield _lot(lot)
                lot, held = [], 0
    if lot:
        yield _lot(lot)


def _lot(lot: list[tuple[bytes, int, int, int]]):
    parts, doc, key, at = zip(*lot, strict=True)
    return list(parts), np.array(doc, np.int64), np.array(key, np.uint32), np.array(at, np.int64)


def _sampled_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n): the grams of runs, with the documents of the batch that have them."""
    for batch in batches:
        found = []
        for parts, *_ in _slices(batch):
            text = np.frombuffer(b"".join(parts), np.uint8)
            bounds = np.r_[0, np.cumsum([len(p) for p in parts])]
            starts, _, gram, _ = _runs_of(text, bounds)
            own = np.searchsorted(bounds, starts, side="right") - 1
            order = np.lexsort((own, gram))
            gram, own = gram[order], own[order]
            found.append(gram[np.r_[True, (gram[1:] != gram[:-1]) | (own[1:] != own[:-1])]] if len(gram) else gram)
        grams, n = np.unique(np.concatenate(found) if found else np.empty(0, np.uint64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])


def hot_grams(texts: DataFrame, rows: int, hot_runs: int) -> np.ndarray:
    """Grams that by a sample of about ``_SAMPLE`` documents lie in more than ``hot_runs`` of all; ``_MOST_HOT`` at most, the commonest."""
    if rows <= hot_runs:
        return np.empty(0, np.uint64)
    every = max(1, rows // _SAMPLE)
    sample = texts.where(F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(every)) == 0)
    counted = sample.mapInArrow(_sampled_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    hot = counted.where(F.col("n") * every > hot_runs).orderBy(F.desc("n"), "gram").limit(_MOST_HOT)
    return np.sort(np.array([r["gram"] for r in hot.collect()], np.int64).view(np.uint64))


def _in_windows(text: np.ndarray, starts: np.ndarray, windows: np.ndarray, gram: np.ndarray, place: np.ndarray, hot: np.ndarray):
    """The runs, with those of ``hot`` grams cut into their windows."""
    k = np.flatnonzero(np.isin(gram, hot))
    rest = np.setdiff1d(np.arange(len(gram)), k)
    n = windows[k]
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at, own = np.repeat(starts[k], n) + inside, np.repeat(gram[k], n)
    spot = np.repeat(place[k].astype(np.int64), n) - inside
    for i in np.flatnonzero(spot < 0).tolist():  # the gram stands again further on
        spot[i] = _first_gram(text, int(at[i]), own[i]) - int(at[i])
    return np.r_[starts[rest], at], np.r_[windows[rest], np.ones(len(at), windows.dtype)], np.r_[gram[rest], own], np.r_[place[rest], spot.astype(np.uint8)], len(rest)


def _send_runs(groups: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parts, doc, key, at in _slices(batch):
                text = np.frombuffer(b"".join(parts), np.uint8)
                bounds = np.r_[0, np.cumsum([len(p) for p in parts])]
                starts, windows, gram, place = _runs_of(text, bounds)
                # a run of few distinct bytes can be long: its length must fit two bytes
                while len(windows) and windows.max() > 60_000:
                    k = np.flatnonzero(windows > 60_000)
                    rest = starts[k] + 60_000
                    where_in = [h - s for s, h in zip(rest.tolist(), (_first_gram(text, x, g) for x, g in zip(rest.tolist(), gram[k], strict=True)), strict=True)]
                    starts, windows, gram, place = np.r_[starts, rest], np.r_[windows, windows[k] - 60_000], np.r_[gram, gram[k]], np.r_[place, np.array(where_in, np.uint8)]
                    windows[k] = 60_000
                starts, windows, gram, place, whole = _in_windows(text, starts, windows, gram, place, hot)
                own = np.searchsorted(bounds, starts, side="right") - 1
                lengths = windows + LENGTH - 1
                known = settle_equal(text, starts, lengths, doc[own])
                where = (starts - bounds[own] + at[own]).astype(np.int32)
                dealt_by = gram.copy()
                if whole < len(gram):
                    dealt_by[whole:] = run_hashes(text, starts[whole:], lengths[whole:])
                group = (mix64(dealt_by) % np.uint64(groups)).astype(np.int64)
                rows = []
                order = np.argsort(group, kind="stable")
                fresh, settled = order[~known[order]], order[known[order]]
                for g, i, j in zip(*_pairs(group[fresh]), strict=True):
                    k = fresh[i:j]
                    rows.append((g, 0, pack([gather_runs(text, starts[k], lengths[k]), lengths[k].astype(np.uint16), place[k], steps(doc[own[k]]), key[own[k]], where[k]], LEVEL)))
                for g, i, j in zip(*_pairs(group[settled]), strict=True):
                    k = settled[i:j]
                    rows.append((g, 1, pack([doc[own[k]], key[own[k]], where[k], (where[k] + windows[k] - 1).astype(np.int32)])))
                yield _blob_rows(rows)

    return run


def _pairs(sorted_keys: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    keys, bounds = split_points(sorted_keys)
    return keys.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()


def _blob_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    g, kind, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], ["grp", "kind", "blob"])


def _doc_group(doc: np.ndarray, groups: int) -> np.ndarray:
    return (mix64(doc.view(np.uint64)) % np.uint64(groups)).astype(np.int64)


def blob_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[bytes]]]]:
    """(grp, blobs by kind) of rows sorted by grp: a task holds one batch and one group, in compressed form."""
    now, held = None, {}
    for batch in batches:
        for grp, kind, blob in zip(batch.column("grp").to_pylist(), batch.column("kind").to_pylist(), batch.column("blob"), strict=True):
            if grp != now:
                if held:
                    yield now, held
                now, held = grp, {}
            held.setdefault(kind, []).append(blob.as_py())
    if held:
        yield now, held


def _refine_groups(groups: int):
    """Marks of each bucket group, sent on by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in blob_groups(batches):
            marks = [unpack_all(blobs.get(1, []), _MARK)]
            if own := blobs.pop(0, None):
                parts = [unpack(b, _RUN) for b in own]
                text, length, place, step, key, where = (np.concatenate([p[c] for p in parts]) for c in range(len(_RUN)))
                sizes = np.array([len(p[1]) for p in parts])
                del parts
                marks += _marks_of(text, length, place, walk(step, sizes), key, where)
            doc, key, a, b = (np.concatenate([m[c] for m in marks]) for c in range(4))
            group = _doc_group(doc, groups)
            order = np.argsort(group, kind="stable")
            yield _blob_rows([(g, 1, pack([doc[order[x:y]], key[order[x:y]], a[order[x:y]], b[order[x:y]]])) for g, x, y in zip(*_pairs(group[order]), strict=True)])

    return run


def _marks_of(text: np.ndarray, lengths: np.ndarray, place: np.ndarray, doc: np.ndarray, key: np.ndarray, where: np.ndarray) -> list[list[np.ndarray]]:
    """Marks of a group of initial buckets; some buckets at a time, so that about ``_PART`` bytes are refined at once."""
    lengths = lengths.astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    gram = grams_at(text, starts + place)
    # runs of a gram that only one document has are settled
    low, high = smallest_doc(gram, doc)
    shared = np.flatnonzero(low != high)
    parts = int(lengths[shared].sum()) // _PART + 1
    share = ((gram[shared] >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
    out = []
    for p in range(parts):
        live = shared[share == p]
        if not len(live):
            continue
        known = settle_equal(*_gathered(text, starts[live], lengths[live]), lengths[live], doc[live])
        done, live = live[known], live[~known]
        out.append([doc[done], key[done], where[done], (where[done] + lengths[done] - LENGTH).astype(np.int32)])
        if len(live):
            out.append(_refined(text, starts[live], lengths[live], doc[live], key[live], where[live]))
    return out


def _gathered(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some runs one after the other, and where each then starts."""
    return gather_runs(text, starts, lengths), np.cumsum(lengths) - lengths


def _refined(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, doc: np.ndarray, key: np.ndarray, where: np.ndarray) -> list[np.ndarray]:
    part, base = _gathered(text, starts, lengths)
    size = lengths - LENGTH + 1
    run = np.repeat(np.arange(len(size), dtype=np.int32), size)
    inside = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
    hit = np.flatnonzero(refine(part, base[run] + inside, doc[run]))
    if not len(hit):
        return [doc[:0], key[:0], where[:0], where[:0]]
    begin = np.r_[True, (run[hit][1:] != run[hit][:-1]) | (inside[hit][1:] != inside[hit][:-1] + 1)]
    first, last = hit[begin], hit[np.r_[np.flatnonzero(begin)[1:] - 1, len(hit) - 1]]
    k = run[first]
    return [doc[k], key[k], (where[k] + inside[first]).astype(np.int32), (where[k] + inside[last]).astype(np.int32)]


def _send_texts(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.as_py() for t in batch.column("text").cast(pa.binary())]
            doc = batch.column("doc_id").fill_null(NO_ID).to_numpy()
            group = _doc_group(doc, groups)
            order = np.argsort(group, kind="stable")
            rows = []
            for g, i, j in zip(*_pairs(group[order]), strict=True):
                k = order[i:j]
                texts = [raw[x] for x in k]
                rows.append((g, 0, pack([np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int32), doc[k]], LEVEL)))
            yield _blob_rows(rows)

    return run


def removed_spans(n: int, first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the windows first..last (inclusive) cover."""
    order = np.argsort(first, kind="stable")
    a, b = first[order].astype(np.int64), np.maximum.accumulate(last[order].astype(np.int64) + LENGTH)
    new = np.r_[True, a[1:] > b[:-1]]
    return list(zip(a[new].tolist(), b[np.r_[np.flatnonzero(new)[1:] - 1, len(b) - 1]].tolist(), strict=True)) if n and len(a) else []


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: what is removed and the bytes that are left."""
    for _, blobs in blob_groups(batches):
        doc, key, first, last = unpack_all(blobs.get(1, []), _MARK)
        order = np.lexsort((key, doc))
        doc, key, first, last = doc[order], key[order], first[order], last[order]
        change = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]) if len(doc) else np.empty(0, np.int64)
        ends = np.r_[change[1:], len(doc)][: len(change)]
        place = {(int(doc[x]), int(key[x])): (int(x), int(y)) for x, y in zip(change, ends, strict=True)}
        for blob in blobs.get(0, []):
            text, lengths, ids = unpack(blob, [np.uint8, np.int32, np.int64])
            raw, at, out = text.tobytes(), 0, []
            for n, own in zip(lengths.tolist(), ids.tolist(), strict=True):
                one = raw[at : at + n]
                at += n
                x, y = place.get((own, _text_key(one)), (0, 0))
                spans = removed_spans(n, first[x:y], last[x:y])
                kept = b"".join(one[a:b] for a, b in zip([0, *[b for _, b in spans]], [*[a for a, _ in spans], n], strict=True))
                out.append((None if own == NO_ID else own, n, n - len(kept), len(spans), kept, [{"start": a, "end": b} for a, b in spans]))
            c = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(v, pa.int64()) for v in c[:4]), pa.array([hashlib.sha256(v).hexdigest() for v in c[4]], pa.string()), pa.array(c[4], pa.binary()), pa.array(c[5], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"],
            )


def remove_repeats(docs: DataFrame, group_bytes: int = 4_000_000, hot_runs: int = 40_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes) and spans for every row.

    ``hot_runs``: documents with one gram, estimated, from which on its windows are dealt out one by one.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    groups = max(1, (size["bytes"] or 0) // group_bytes)
    # at most 2000 rows by their definition, so they may be broadcast
    sums = texts.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce("doc_id", F.lit(int(NO_ID)))).alias("first_id"))
    hot = sums.where(F.col("n") > max(100, size["rows"] // 2000)).select("digest", "first_id")
    marked = texts.withColumn("digest", F.sha2("text", 256)).join(F.broadcast(hot), "digest", "left")
    later = F.coalesce(F.coalesce("doc_id", F.lit(int(NO_ID))) > F.col("first_id"), F.lit(False)) & (F.octet_length("text") >= LENGTH)
    marked = marked.select("doc_id", "text", later.alias("copy"))
    blob = "grp long, kind int, blob binary"
    fresh = marked.where(~F.col("copy")).select("doc_id", "text")
    runs = fresh.mapInArrow(_send_runs(groups, hot_grams(texts, size["rows"], hot_runs)), blob)
    marks = runs.repartition("grp").sortWithinPartitions("grp").mapInArrow(_refine_groups(groups), blob)
    both = marks.unionByName(fresh.mapInArrow(_send_texts(groups), blob))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:long,end:long>>"
    cut = both.repartition("grp").sortWithinPartitions("grp").mapInArrow(_cut, schema)
    n = F.octet_length("text").cast("long")
    gone = marked.where("copy").select(
        "doc_id", n.alias("n_bytes"), n.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(b""), 256).alias("kept_sha256"), F.lit(b"").alias("kept"),
        F.array(F.struct(F.lit(0).cast("long").alias("start"), n.alias("end"))).alias("spans"),
    )
    return cut.unionByName(gone)
