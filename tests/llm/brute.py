"""Plain versions of the operators, over a few rows (doc_id, text, lang, source)."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

ASCII_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _rank(doc_id) -> int:
    return 2**63 - 1 if doc_id is None else doc_id


def repeats(rows) -> list[tuple]:
    first: dict[bytes, int] = {}
    for d, t, *_ in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], 2**63), _rank(d))
    out = []
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < _rank(d):
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def exact(rows) -> list[tuple]:
    """For rows without repeats of both doc_id and text."""
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[(t or "").translate(ASCII_UPPER)].append(d)
    out = []
    for d, t, *_ in rows:
        own = groups[(t or "").translate(ASCII_UPPER)]
        keep = max((x for x in own if x is not None), default=None)
        out.append((d, keep, len(own), d == keep, hashlib.sha256((t or "").translate(ASCII_UPPER).encode()).hexdigest()))
    return out


def quality_counts(text: str | None) -> tuple:
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed


def binomial_tail(k: int, n: int, p: float) -> float:
    return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))


def within_one_edit(a: str, b: str) -> bool:
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def dropped_lines(rows, least: int = 1) -> list[tuple]:
    """For rows with one text per doc_id."""
    seen: list[str] = []
    out = []
    for d, t, *_ in sorted(rows, key=lambda r: _rank(r[0])):
        gone = []
        lines = (t or "").split("\n")
        for no, line in enumerate(lines):
            if not words(line):
                continue
            if any(x == line or min(len(x), len(line)) >= least and within_one_edit(x, line) for x in seen):
                gone.append(no)
            seen.append(line)
        out.append((d, len(lines), len(gone), gone))
    return out


def jaccard_classes(rows, n: int = 5, threshold: float = 0.8) -> list[tuple]:
    texts = defaultdict(list)
    for d, t, *_ in rows:
        texts[t or ""].append(_rank(d))
    sets = {}
    for t in texts:
        w = words(t)
        k = min(n, len(w))
        sets[t] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    up = {t: t for t in texts}

    def root(t):
        while up[t] != t:
            t = up[t]
        return t

    links = Counter()
    names = list(texts)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                up[root(a)] = root(b)
    least: dict[str, int] = {}
    for t, ids in texts.items():
        least[root(t)] = min(least.get(root(t), 2**63), *ids)
    none = lambda x: None if x == 2**63 - 1 else x
    return [(d, none(least[root(t or "")]), none(min(texts[t or ""])), len(texts[t or ""]), links[t or ""]) for d, t, *_ in rows]


def id_crc(d) -> int:
    return zlib.crc32(str(d).encode() if d is not None else b"")


def base_scores(rows) -> list[tuple]:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score; the end is the token None."""
    of = {k: [x.translate(ASCII_UPPER) for x in words(t)] + [None] for k, (_, t, *_r) in enumerate(rows)}
    counts = Counter(x for k, (d, *_r) in enumerate(rows) if id_crc(d) % 7 != 2 for x in of[k])
    n, v = sum(counts.values()), len(counts)
    return [(d, id_crc(d) % 7 == 2, len(of[k]), sum(counts[x] > 0 for x in of[k]), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in of[k])) for k, (d, *_r) in enumerate(rows)]


def source_targets(rows, cap: float = 3.0) -> dict:
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (1.0, 2.0, 3.0)[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    rest = float(sum(size.values()))
    while open_:
        unit = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > cap * size[s]}
        if not full:
            return target | {s: unit * weight[s] for s in open_}
        for s in full:
            target[s] = cap * size[s]
            rest -= target[s]
        open_ -= full
    return target
