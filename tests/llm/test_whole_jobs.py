"""Where an operator once did less than the whole job."""

from __future__ import annotations

import math
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from pyspark.sql import functions as F

from lapframe.llm import bit_model, context_mixing, language_id, quality_rules
from lapframe.llm.packing import ordered
from lapframe.llm.queries import QUERIES


def _class(raw: bytes) -> int:
    seen = Counter((raw[i] * 7 + raw[i - 1] * 13) % 8 for i in range(1, len(raw)) if 128 <= raw[i] < 192 <= raw[i - 1] < 224)
    return max(seen, key=lambda k: (seen[k], -k)) + 1 if seen else 0


def _words(raw: bytes) -> list[bytes]:
    """Words and white space, but for single spaces between words."""
    found = re.findall(rb"[^ \t-\r]+|[ \t-\r]+", raw)
    return [w for k, w in enumerate(found) if w != b" " or k in (0, len(found) - 1)]


class _Plain:
    """The model by dictionaries of exact counts, one text after the other. ``turns`` are the codes; both come from the operator."""

    def __init__(self, texts: dict[int, bytes]):
        learned = [raw for d, raw in texts.items() if context_mixing.learns(d)]
        by_class = Counter((_class(raw), w) for raw in learned for w in _words(raw))
        total = Counter()
        for (_, w), n in by_class.items():
            total[w] += n
        self.coded = sorted((w for w, n in total.items() if n > 1), key=lambda w: int(self._identity(w)))
        uses = Counter()
        for (k, w), n in by_class.items():
            uses[w if total[w] > 1 else "escape"] += n
        symbols = [*self.coded, "escape", "end"]
        uses["end"] = len(learned)
        code, number = bit_model.Code.of_counts(np.array([uses[x] for x in symbols]))
        bits = lambda c, r: [int(c.left[r]) >> (bit_model.WIDTH - 1 - k) & 1 for k in range(int(c.length[r]))]
        self.path = {x: bits(code, number[i]) for i, x in enumerate(symbols)}
        of_bytes = np.zeros(257, np.int64)
        for raw in learned:
            of_bytes[:256] += np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
            of_bytes[256] += len(_words(raw))
        byte_code, byte_number = bit_model.Code.of_counts(of_bytes)
        self.byte_path = [bits(byte_code, r) for r in byte_number]
        self.counts = Counter()
        for raw in learned:
            for _, path, own in self.events(raw):
                for c, reach in own:
                    self.counts.update((c, *path[: k + 1]) for k in range(min(reach, len(path))))

    @staticmethod
    def _identity(w: bytes) -> int:
        return context_mixing._identity(*context_mixing._keys([w]))[0]

    def events(self, raw: bytes):
        """(0 for a word or 2 for a spelled byte, the turns, the contexts with the number of turns they predict)."""
        of_class, before = _class(raw), [None, None]
        for w in [*_words(raw), "end"]:
            symbol = w if w in self.path else "escape"
            last = before[-1] if before[-1] in self.path else before[-1] and "escape"
            short = tuple(self.path[last][: bit_model.UPPER]) if last else None
            yield 0, self.path[symbol], (((0, of_class), 99), ((1, of_class, short), bit_model.UPPER), ((2, *before[-2:]), 99))
            before.append(w)
            if symbol == "escape":
                for i in range(len(w) + 1):
                    path = self.byte_path[w[i] if i < len(w) else 256]
                    yield 2, path, (((3, of_class, w[max(0, i - 1) : i]), 99), ((4, w[max(0, i - 3) : i]), 99), ((5, w[max(0, i - 5) : i]), 99))

    def score(self, raw: bytes) -> float:
        x, gates = [], []
        for kind, path, own in self.events(raw):
            for k, turn in enumerate(path):
                row = []
                for c, reach in own:
                    here, other = (self.counts[(c, *path[:k], t)] for t in (turn, 1 - turn))
                    s = math.log((here + bit_model.PRIOR) / (other + bit_model.PRIOR)) * bit_model.SCALE
                    row.append(round(min(bit_model.MOST, max(-bit_model.MOST, s))) / bit_model.SCALE if k < reach else 0.0)
                x.append(row), gates.append(kind)
        x, total = np.array(x), -math.log10(bit_model.CLASSES)
        gates = np.array(gates) + (x[:, 2] != 0)
        w = np.array(bit_model.FIRST_WEIGHTS)
        for t in range(0, len(x), bit_model.STEP):
            part, gate = x[t : t + bit_model.STEP], gates[t : t + bit_model.STEP]
            p = 1 / (1 + np.exp(-np.clip((w[gate] * part).sum(axis=1), -10, 10)))
            total += np.log10(p).sum()
            np.add.at(w, gate, (bit_model.RATE * (1 - p))[:, None] * part)
        return total


def _texts(n: int, words: int) -> dict[int, bytes]:
    r = random.Random(11)
    some = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzéñß") for _ in range(r.randrange(2, 9))) for _ in range(9000)]
    return {d: " ".join(r.choice(some) for _ in range(words)).encode() for d in range(n)}


def _scored(spark, texts: dict[int, bytes], parts: int, **options) -> dict[int, float]:
    docs = spark.createDataFrame([(d, t.decode()) for d, t in texts.items()], "doc_id long, text string").repartition(parts)
    return {r["doc_id"]: r["score"] for r in context_mixing.score_documents(docs, **options).collect()}


def test_op10_counts_are_exact(spark):
    """Hundreds of thousands of pairs, over many hash ranges: the scores are those of a dictionary."""
    texts = _texts(600, 100) | {1000: b"", 1001: b" ", 1002: b"  two  spaces\n\nand lines \n", 1003: "naïve ünïcode 漢字	".encode(), 1004: b"word"}
    got, plain = _scored(spark, texts, 5, group_bytes=50_000), _Plain(texts)
    for d in [*range(12), *range(1000, 1005)]:
        assert got[d] == pytest.approx(plain.score(texts[d]), rel=1e-4)


def test_op10_carries_weights_through_a_long_text(spark):
    """A text of over 100,000 decisions learns all the way: its score is the plain model's."""
    texts = _texts(40, 60) | {100: b" ".join(_texts(1, 4000).values())}
    got, plain = _scored(spark, texts, 3), _Plain(texts)
    for d in (100, 1, 2):
        assert got[d] == pytest.approx(plain.score(texts[d]), rel=1e-4)


def test_op10_probabilities_add_up(spark):
    """Over all that may follow, the model's probabilities add up to 1: at a node the two turns' predictions are opposite."""
    texts = _texts(60, 30)
    plain = _Plain(texts)
    for paths in (list(plain.path.values()), plain.byte_path):
        assert sum(0.5 ** len(p) for p in paths) == pytest.approx(1)
        assert len({tuple(p) for p in paths}) == len(paths)
    # one word after a fixed beginning: all words that have a code, and the escape
    w, own = np.array(bit_model.FIRST_WEIGHTS), [(0, 0), (1, 0, None), (2, None, None)]
    total = 0.0
    for path in plain.path.values():
        p = 1.0
        for k, turn in enumerate(path):
            row = []
            for c, reach in zip(own, (99, bit_model.UPPER, 99), strict=True):
                here, other = (plain.counts[(c, *path[:k], t)] for t in (turn, 1 - turn))
                row.append(math.log((here + 0.2) / (other + 0.2)) if k < reach else 0.0)
            p /= 1 + math.exp(-float(w[int(row[2] != 0)] @ np.array(row)))
        total += p
    assert total == pytest.approx(1)


def test_op10_beats_its_base_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = context_mixing.score_documents(docs).where("held_out").agg(F.sum("score").alias("model"), F.sum("base_score").alias("base")).first()
    assert got["model"] > got["base"]  # though the model also spells unknown words, capitals and white space


def test_op10_words_read_back():
    """A text is its words, single spaces apart."""
    r = random.Random(4)
    for _ in range(500):
        raw = bytes(r.choice(b"ab  \n\t") for _ in range(r.randrange(12)))
        found = context_mixing.words_of_text(raw)
        assert found == _words(raw)
        space = [w.isspace() for w in found]
        assert b"".join(b" " * (k > 0 and not space[k] and not space[k - 1]) + w for k, w in enumerate(found)) == raw


def test_op10_makes_ready_several_steps_at_once():
    """What does not depend on the weights is not done step by step; the scores are those of a plain loop."""
    r = np.random.default_rng(8)
    count, step = np.array([9000, 8999, 700, 64, 1, 0]), bit_model.STEP
    start = np.cumsum(count) - count
    kind = np.repeat(r.integers(0, 2, 4000) * 2, 5).astype(np.int8)[: count.sum() + step]
    inputs = r.integers(-31, 32, (3, len(kind))).astype(np.int8)
    inputs[2] *= r.integers(0, 2, len(kind)).astype(np.int8)
    calls = Counter()

    def seen(_, event, of):
        calls[event == "c_call" and of.__name__] += 1

    sys.setprofile(seen)
    try:
        got = bit_model.advance(start, count, kind, inputs)
    finally:
        sys.setprofile(None)
    steps = -(-count[0] // step)
    assert calls["take"] + calls["astype"] + calls["reduce"] < 2 * steps
    for a, n, score in zip(start, count, got, strict=True):
        w, total = np.array(bit_model.FIRST_WEIGHTS), 0.0
        for t in range(a, a + n, step):
            at = slice(t, min(t + step, a + n))
            x, gate = inputs[:, at].T / bit_model.SCALE, kind[at] + (inputs[2, at] != 0)
            p = 1 / (1 + np.exp(-np.clip((w[gate] * x).sum(axis=1), -10, 10)))
            total += np.log10(p).sum()
            np.add.at(w, gate, (bit_model.RATE * (1 - p))[:, None] * x)
        assert score == pytest.approx(total, rel=1e-4, abs=1e-12)


def test_op10_words_of_many_texts_at_once():
    """Words never cross texts; words are told apart by all their bytes, however long; a table of known words grows in order."""
    r = random.Random(6)
    long = b"x" * 300
    some = [b"a", b"a\0", b"\0a", b"ab", b"abcdefgh", b"abcdefghi", b"abcdefgh\0", long, long + b"y", long + b"z", b"y" + long, "ñ漢".encode()]
    texts = [b"".join(r.choice(some + [b" ", b" ", b" ", b"\n", b"\t "]) for _ in range(r.randrange(0, 12))) for _ in range(400)] + [b"", b" ", b""]
    raw = b"".join(texts)
    start, size, n_words = context_mixing.split_words(np.frombuffer(raw, np.uint8), np.array([len(t) for t in texts]))
    found = [raw[a : a + n] for a, n in zip(start, size, strict=True)]
    assert found == [w for t in texts for w in _words(t)] and n_words.tolist() == [len(_words(t)) for t in texts]
    of = np.arange(len(found)) % 3
    want = Counter(zip(found, of.tolist(), strict=True))
    key, one, n, which = context_mixing._distinct_words(raw, start, size, of)
    pairs = [(found[k], int(of[k])) for k in one]
    assert (np.diff(key) > 0).all() and dict(zip(pairs, n.tolist(), strict=True)) == dict(want)
    assert [pairs[k] for k in which] == list(zip(found, of.tolist(), strict=True))
    table, known = context_mixing._Table([np.int64]), {}
    for _ in range(20):
        asked = np.array(sorted(r.sample(range(300), r.randrange(0, 60))), np.uint64)
        fresh = [int(k) for k in asked if int(k) not in known]
        known |= {k: k * k for k in fresh}
        place = table.places(asked, lambda k, a=asked, f=fresh: (a[k] * a[k],) if a[k].tolist() == f else None)
        assert table.columns[0][place].tolist() == [known[int(k)] for k in asked] and table.key.tolist() == sorted(known)


@pytest.mark.parametrize("n", [0, 1, 50, 40_000])
def test_op10_pairs_by_table_and_by_sort(n):
    """A table, one sort of short contexts and one of hashes give the same pairs; sorted keys are in order where their first bits tie."""
    r = np.random.default_rng(n)
    plain, number = r.integers(0, 60, n).astype(np.uint64), r.integers(0, 257, n)
    factor, term, bits = np.uint64(0x9E3779B97F4A7C15), np.uint64(5), 44
    hashed = bit_model.mix64(plain * factor + term) >> np.uint64(64 - bits)
    want, which = np.unique(hashed << np.uint64(9) | number.astype(np.uint64), return_inverse=True)
    for c in (bit_model.Contexts(plain, number, 6, factor, term), bit_model.Contexts(plain, number, 27, factor, term), bit_model.Contexts(hashed, number, bits)):
        keys, own = bit_model.distinct_pairs(c, 9, bits)
        assert keys.tolist() == want.tolist() and own.tolist() == which.tolist()
    key = r.integers(0, 1 << 40, n).astype(np.uint64) << np.uint64(23) | r.integers(0, 300, n).astype(np.uint64)
    key[n // 2 :] = key[: n - n // 2] ^ (np.arange(n - n // 2) % 3).astype(np.uint64)
    order, found = ordered(key)
    assert order.tolist() == np.argsort(key, kind="stable").tolist() and found.tolist() == np.sort(key).tolist()


def test_op1_sums_over_all_segmentations():
    """Long pieces count, and a long run of letters is one word: sums are those of a plain forward pass in logarithms."""
    vocabulary = language_id.Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    number = {int(k): i for i, k in enumerate(vocabulary.keys)}
    probs = np.random.default_rng(5).random((len(vocabulary.keys) + 2, 3)) ** 9
    probs[-1] = 0
    probs /= probs.sum(axis=0)
    for word in ("consumption", "septembre", "x", "verantwortung" * 9, "漢字仮名交じり文" * 60):
        marked = language_id.MARK + word
        log = [np.zeros(3)]
        for j in range(1, len(marked) + 1):
            ways = []
            for i in range(max(0, j - 40), j):
                piece = number.get(language_id.Pieces.key(marked[i:j]), vocabulary.unknown if j == i + 1 else None)
                if piece is not None:
                    ways.append(log[i] + np.log(probs[piece]))
            log.append(np.logaddexp.reduce(ways))
        assert language_id.words_in(word) == [word]
        edges = vocabulary.edges([word, word])
        assert language_id.forward(edges, len(marked), probs)[2] == pytest.approx(np.array([log[-1]] * 2), rel=1e-9)
        assert language_id.forward(edges, len(marked), probs, keep=False)[2] == pytest.approx(np.array([log[-1]] * 2), rel=1e-9)
        used = language_id.expected_counts(edges, len(marked), probs, np.ones((2, 3)))
        size = {i: n for n in range(1, len(edges.found) + 1) for i in edges.found[n - 1][edges.found[n - 1] >= 0].ravel().tolist()}
        assert sum(used[i] * n for i, n in size.items()) == pytest.approx(np.full(3, 2 * len(marked)), rel=1e-6)


def test_op5_small_strata_share_cutoffs(spark):
    """Strata with too few labels each get the cutoffs of their pool; a large one keeps its own, one without labels has none."""
    words = " ".join(f"word{k}" for k in range(25))
    rows = [(k, words, "aa" if k % 2 else "bb") for k in range(360)] + [(2000 + k, words, "big") for k in range(600)]
    rows += [(9000 + k, words.replace("d1", "d1 #### ####"), lang) for k, lang in enumerate(["aa", "bb", "cc", "big"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, 1) for d, *_ in rows if d < 9000], "doc_id long, quality int")
    assert {r["doc_id"] for r in quality_rules.judge(docs, labels).where("not kept").collect()} == {9000, 9001, 9003}


def test_op5_no_stratum_is_judged_against_its_own_labels(spark):
    """Good documents of a small stratum that look bad elsewhere stay, beside a large stratum and a pool that would reject them."""
    words = " ".join(f"word{k}" for k in range(25))
    code = words.replace("d1", "d1 #### ####")
    rows = [(k, words, "en") for k in range(7000)] + [(8000 + k, words, "aa" if k % 2 else "bb") for k in range(500)] + [(9000 + k, code, "code") for k in range(100)]
    docs = spark.createDataFrame(rows + [(9900, code, "aa"), (9901, code, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, 1) for d, *_ in rows], "doc_id long, quality int")
    rejected = {r["doc_id"] for r in quality_rules.judge(docs, labels).where("not kept").collect()}
    assert 9901 in rejected and not rejected & set(range(9000, 9100))


def _segmentations(symbols: str, pieces: set[str]):
    """All ways to cut a marked word into pieces, one by one; a symbol that is no piece is '?'."""
    if not symbols:
        yield ()
    for k in range(1, len(symbols) + 1):
        piece = symbols[:k] if symbols[:k] in pieces else "?" if k == 1 else None
        for rest in _segmentations(symbols[k:], pieces) if piece else ():
            yield (piece, *rest)


def test_op1_whole_query_by_enumeration(spark, tmp_path):
    """Training and prediction again, from every segmentation of every word, with pieces as texts."""
    rng = np.random.default_rng(9)
    own = {"en": "the house of a small bird was seen in time", "de": "das haus von einem vogel war nicht zu sehen", "el": "το σπίτι war a time"}
    rows = []
    for k in range(60):
        lang = sorted(own)[k % 3]
        text = " ".join(rng.choice(own[lang].split(), 1 + k % 9).tolist() + rng.choice(own["en"].split(), k % 3).tolist())
        rows.append((k, text.upper() if k % 7 == 0 else text + ", 12!", None if k % 11 == 0 else lang))
    rows += [(60, None, "en"), (61, "", "de"), (62, "42 - 7", None), (None, "das haus", "de"), (5, rows[5][1], rows[5][2]), (63, "zebra qq", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = set()
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).lower()
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and all(re.fullmatch(r"[^\W\d_]", c) for c in piece.lstrip("▁")):
            pieces.add(piece)

    def words(text):
        return "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()

    def held(doc_id):
        return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0

    counts = Counter((lang, w) for k, text, lang in rows if lang and not held(k) for w in words(text))
    langs = sorted({lang for k, _, lang in rows if lang and not held(k)})
    ways = {w: list(_segmentations("▁" + w, pieces)) for _, text, _ in rows for w in words(text)}
    chances = lambda p, w: [math.prod(p.get(x, p[None]) for x in way) for way in ways[w]]

    def share(used):  # the pieces of the vocabulary and the unknown one; None: one that was not used
        total = sum(used.values()) + 0.02 * (len(pieces) + 1)
        return {x: (n + 0.02) / total for x, n in used.items()} | {None: 0.02 / total}

    probs = {lang: share({}) for lang in langs}
    for _ in range(3):
        used = {lang: Counter() for lang in langs}
        for (lang, w), n in counts.items():
            p = chances(probs[lang], w)
            for way, chance in zip(ways[w], p, strict=True):
                for x in way:
                    used[lang][x] += n * chance / sum(p)
        probs = {lang: share(used[lang]) for lang in langs}
    wanted = []
    for k, text, _ in rows:
        logs = [sum(math.log(sum(chances(probs[lang], w))) for w in words(text)) for lang in langs]
        best = max(logs)
        wanted.append((k, held(k), langs[logs.index(best)], 1 / sum(math.exp(x - best) for x in logs)) if words(text) else (k, held(k), "und", 0.0))
    got = [tuple(r) for r in QUERIES["op1_language_id"](spark, str(tmp_path)).select("doc_id", "held_out", "lang_pred", "score").collect()]
    key = lambda r: (r[0] is None, r[0], r[2])
    assert len(got) == len(wanted) == 66 and {r[2] for r in got} == {"en", "de", "el", "und"}
    for a, b in zip(sorted(got, key=key), sorted(wanted, key=key), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-9)
