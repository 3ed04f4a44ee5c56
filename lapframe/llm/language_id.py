"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. The
probability of a word (a run of letters, lower-cased, with a word-start mark
before it) is the sum over all ways to cut it into pieces, by the forward
algorithm; a text's is the product over its words. Letters that are no piece of
the vocabulary are each one unknown piece. The answer is the language with the
largest posterior under equal priors, and the score is that posterior.

Training is expectation-maximisation on word counts of at most about
``rows_per_lang`` labelled documents per language, chosen by a hash of doc_id:
expected piece counts come from forward and backward sums. Word counts are
grouped in a shuffle; what is collected has one row per piece range.

In a task, the distinct words of a lot are segmented side by side in NumPy, by
length, and kept for the next lots; texts are whole, and only letters count.

Sums over long runs of letters are scaled, per word and language, every ``BLOCK``
letters. Pieces are as long as the vocabulary has them.

Defined cases: ``und`` with score 0 if the text is null or has no letter; ties go to the language first
in code-point order; repeated rows and null doc_ids are predicted like any
other (a null doc_id counts as the empty text in the hold-out rule); with no
labelled row in training every answer is ``und``; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapframe.llm.common import id_crc, text_of, uniform
from lapframe.llm.context_mixing import lots
from lapframe.llm.grouping import whole_groups
from lapframe.llm.jaccard_join import mix64
from lapframe.llm.packing import pack, unpack
from lapframe.session import materialize

MARK = "▁"
BLOCK = 16  # letters between scalings; more if pieces are longer
CELLS = 400_000  # letters of words segmented at once
FILTER_BITS, SLICES = 22, 16
LETTERS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x100000001B3)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")), F.lit(5)) == 0


def words_in(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


class Pieces:
    """The vocabulary: hashes of pieces, sorted; a piece's number is its place, and one more stands for unknown letters."""

    def __init__(self, keys: np.ndarray, longest: int):
        self.keys, self.longest = keys, longest
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[keys >> np.uint64(64 - FILTER_BITS)] = True
        self.unknown = len(keys)

    @classmethod
    def load(cls, path: str) -> Pieces:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        lower = {p for p in (p.lower() for p in usable) if LETTERS.fullmatch(p.lstrip(MARK) or "x")}
        return cls(np.unique(np.array([cls.key(p) for p in lower], np.uint64)), max(map(len, lower)))

    @staticmethod
    def key(piece: str) -> int:
        h = np.zeros(1, np.uint64)
        for c in piece:
            h = h * _BASE + np.uint64(ord(c) + 1)
        return int(mix64(h)[0])

    def edges(self, words: list[str]) -> Edges:
        """The pieces of words of one length."""
        n = len(words[0]) + 1
        code = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), n).T.astype(np.uint64) + np.uint64(1)
        h = np.zeros_like(code)
        found = []
        for size in range(1, min(n, self.longest) + 1):
            h = h[: n - size + 1] * _BASE + code[size - 1 :]
            key = mix64(h.ravel())
            hits = np.flatnonzero(self.maybe[key >> np.uint64(64 - FILTER_BITS)])
            piece = np.full(len(key), self.unknown if size == 1 else -1, np.int32)
            if len(hits):
                at = np.minimum(np.searchsorted(self.keys, key[hits]), len(self.keys) - 1)
                good = self.keys[at] == key[hits]
                piece[hits[good]] = at[good]
            found.append(piece.reshape(h.shape))
        return Edges(found, max(BLOCK, self.longest))


class Edges:
    """(start, end, piece of each word or -1, whether the end lies in a later block), in order of the end."""

    def __init__(self, found: list[np.ndarray], block: int):
        self.found, self.block, self.words = found, block, found[0].shape[1]
        spots = [np.flatnonzero((piece >= 0).any(axis=1)) for piece in found]
        start = np.concatenate(spots)
        end = start + np.repeat(np.arange(1, len(found) + 1), [len(x) for x in spots])
        order = np.lexsort((start, end))
        self.start, self.end = start[order], end[order]

    def _at(self, k: int) -> tuple[int, int, np.ndarray, bool]:
        i, j = int(self.start[k]), int(self.end[k])
        return i, j, self.found[j - i - 1][i], i // self.block != j // self.block

    def __iter__(self):
        return (self._at(k) for k in range(len(self.end)))

    def __reversed__(self):
        return (self._at(k) for k in range(len(self.end) - 1, -1, -1))


def forward(edges: Edges, n: int, probs: np.ndarray, keep: bool = True) -> tuple[dict[int, np.ndarray], list[np.ndarray], np.ndarray]:
    """Sums over all segmentations of each prefix, one (words, languages) array per position; the factor at which each block
    of positions is scaled up against the block before; and the logarithm of the sums over whole words. ``probs`` ends in a
    row of zeros. Without ``keep`` only the positions that pieces still reach back to are held."""
    shape = (edges.words, probs.shape[1])
    alpha, factors, log_scale = {0: np.ones(shape)}, [np.ones(shape)], np.zeros(shape)
    for i, j, piece, crosses in edges:
        if j not in alpha:
            alpha[j] = np.zeros(shape)
            if j % edges.block == 0:  # all that reaches over this place starts in the block before
                factors.append(1 / np.maximum(np.max([alpha[k] for k in range(j - edges.block, j)], axis=0), 1e-300))
                log_scale -= np.log(factors[-1])
            if not keep:
                alpha.pop(j - 2 * edges.block, None)
        step = alpha[i] * probs[piece]
        alpha[j] += step * factors[j // edges.block] if crosses else step
    return alpha, factors, np.log(np.maximum(alpha[n], 1e-300)) + log_scale


def expected_counts(edges: Edges, n: int, probs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece, given how often each word occurs in each language."""
    alpha, factors, _ = forward(edges, n, probs)
    beta: dict[int, np.ndarray] = defaultdict(lambda: np.zeros_like(alpha[0]))
    beta[n] += counts / np.maximum(alpha[n], 1e-300)
    out = np.zeros_like(probs)
    for i, j, piece, crosses in reversed(edges):
        step = probs[piece] * beta[j]
        if crosses:
            step *= factors[j // edges.block]
        beta[i] += step
        used = alpha[i] * step
        for k in range(probs.shape[1]):
            out[:, k] += np.bincount(np.where(piece < 0, len(probs) - 1, piece), weights=used[:, k], minlength=len(probs))
    out[-1] = 0
    return out


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    groups: dict[int, list[int]] = defaultdict(list)
    for k, w in enumerate(words):
        groups[len(w)].append(k)
    for n, rows in groups.items():
        for a in range(0, len(rows), many := max(1, CELLS // (n + 1))):
            part = rows[a : a + many]
            yield n + 1, np.array(part), [words[k] for k in part]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            seen[lang].update(words_in(text.as_py()))
        rows = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
        lang, word, n = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])


def _expect(pieces, table, langs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probs = table.value
        vocabulary, total = Pieces(*pieces.value), np.zeros_like(probs)
        place = {lang: k for k, lang in enumerate(langs)}
        for batch in batches:
            number: dict[str, int] = {}
            rows = np.array([number.setdefault(w, len(number)) for w in batch.column("word").to_pylist()], np.int64)
            counts = np.zeros((len(number), len(langs)))
            np.add.at(counts, (rows, np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)), batch.column("n").to_numpy())
            for n, at, words in by_length(list(number)):
                total += expected_counts(vocabulary.edges(words), n, probs, counts[at])
        parts = np.array_split(total, SLICES)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([pack([p.ravel()]) for p in parts], pa.binary())], ["slice", "blob"])

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, bounds in whole_groups(batches, ["slice"]):
        ids, blobs = rows.column("slice").to_numpy(), rows.column("blob")
        for i, j in zip(bounds, [*bounds[1:], rows.num_rows], strict=True):
            total = sum(unpack(blobs[int(k)].as_py(), [np.float64])[0] for k in range(int(i), int(j)))
            yield pa.RecordBatch.from_arrays([pa.array([int(ids[i])], pa.int32()), pa.array([pack([total])], pa.binary())], ["slice", "blob"])


def normalised(counts: np.ndarray) -> np.ndarray:
    """Probabilities with a little mass for pieces not seen; the row of zeros at the end stays."""
    out = counts + 0.02
    out[-1] = 0
    return out / out.sum(axis=0)


class LanguageModel:
    def __init__(self, langs: list[str], pieces: Pieces, probs: np.ndarray):
        self.langs, self.pieces, self.probs = langs, (pieces.keys, pieces.longest), probs


def train(docs: DataFrame, vocabulary_path: str, rows_per_lang: int = 5_000, rounds: int = 3) -> LanguageModel:
    """Learn from ``text`` and non-null ``lang`` of the rows that are not held out."""
    spark = docs.sparkSession
    pieces = Pieces.load(vocabulary_path)
    keys = pieces.keys
    rows = docs.where(~held_out() & F.col("lang").isNotNull()).select("doc_id", text_of().alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], pieces, np.zeros((len(keys) + 2, 0)))
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, rows_per_lang / n))) for x, n in sizes.items()])
    sample = rows.where(uniform(F.col("doc_id")) < share)
    counted = sample.select("lang", "text").mapInArrow(_count_words, "lang string, word string, n long")
    counted = materialize(counted.groupBy("word", "lang").agg(F.sum("n").alias("n")).repartition("word"), "langid-words")
    sent = spark.sparkContext.broadcast((keys, pieces.longest))
    probs = normalised(np.zeros((len(keys) + 2, len(langs))))
    for _ in range(rounds):
        summed = counted.mapInArrow(_expect(sent, spark.sparkContext.broadcast(probs), langs), "slice int, blob binary").repartition("slice").sortWithinPartitions("slice").mapInArrow(_add_up, "slice int, blob binary")
        parts = {r["slice"]: unpack(bytes(r["blob"]), [np.float64])[0] for r in summed.collect()}  # SLICES rows
        if parts:
            probs = normalised(np.concatenate([parts[k].reshape(-1, len(langs)) for k in range(SLICES)]))
    return LanguageModel(langs, pieces, probs)


def _predict(pieces, probs, langs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, table = Pieces(*pieces.value), probs.value
        number: dict[str, int] = {}
        known = np.empty((0, len(langs)))
        for batch in batches:
            for ids, texts in lots(batch):
                per_text = [words_in(t.decode()) for t in texts]
                if len(number) > 150_000:
                    number, known = {}, known[:0]
                place = [number.setdefault(w, len(number)) for words in per_text for w in words]
                fresh = list(number)[len(known) :]
                if fresh:
                    got = np.empty((len(fresh), len(langs)))
                    for n, at, words in by_length(fresh):
                        got[at] = forward(vocabulary.edges(words), n, table, keep=False)[2]
                    known = np.concatenate([known, got])
                sizes = np.array([len(w) for w in per_text])
                logp = np.zeros((len(texts), len(langs)))
                full = np.flatnonzero(sizes)
                if len(full) and langs:
                    logp[full] = np.add.reduceat(known[np.array(place)], np.r_[0, np.cumsum(sizes[full])[:-1]])
                    best = logp.argmax(axis=1)
                    post = np.exp(logp - logp.max(axis=1, keepdims=True))
                    score = post.max(axis=1) / post.sum(axis=1)
                pred = [langs[best[k]] if n and langs else "und" for k, n in enumerate(sizes)]
                scores = [float(score[k]) if n and langs else 0.0 for k, n in enumerate(sizes)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([id_crc(i) % 5 == 0 for i in ids], pa.bool_()), pa.array(pred, pa.string()), pa.array(scores, pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    return run


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; only doc_id (for held_out) and text are read."""
    context = docs.sparkSession.sparkContext
    pieces, probs = context.broadcast(model.pieces), context.broadcast(model.probs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return texts.mapInArrow(_predict(pieces, probs, model.langs), "doc_id long, held_out boolean, lang_pred string, score double")
