"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are split at safe boundaries, places where the tokeniser splits whatever
stands around them: before ASCII white space that follows no white space. A
byte-level pre-token never runs from a character that is no white space into
white space, and none looks back, so the parts of a text give the tokens of the
whole. Parts repeat, so an Arrow batch is reduced to the parts that its worker
has not met yet; these go to the library in batches of about equal bytes, and
what stays is each part's length. A text of over ``part`` bytes is first cut at
such boundaries into rows of about that size, which Spark deals out over tasks
and sums up again, so a very long text is not one task's work.

A tokeniser file that does more than byte-level splitting (a normaliser, another
pre-tokeniser, added tokens with white space or that swallow it) has no such
boundaries; its texts are encoded whole.

Defined cases: a null text is the empty text, with no tokens. Rows repeated give
a result each. Special strings in texts are tokens, as is the library's default.
A text without safe boundaries is one part. Columns besides doc_id and text are not read; no
rows give no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lapframe.llm.common import text_of
from lapframe.session import materialize

#: White space by any reading of it: no boundary follows one of these.
_ANY_SPACE = r"\s\x1c-\x1f\x85\u180e\u200b\u2060\ufeff"
SAFE = re.compile(rf"(?<=[^{_ANY_SPACE}])(?=[ \t-\r])")
BATCH_BYTES = 1 << 18
LOT_BYTES = 1 << 21
_KEPT_CHARS = 12_000_000


class Lengths:
    """Numbers of tokens of texts by one tokeniser file."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.splits = _splits_safely(json.loads(self.library.to_str()))
        self.known: dict[str, int] = {}
        self.chars = 0

    def of(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return [n for lot in _by_bytes(texts) for n in self._encode(lot)]
        if self.chars > _KEPT_CHARS:
            self.known.clear()
            self.chars = 0
        parts = [SAFE.split(t) for t in texts]
        new = list({p for own in parts for p in own}.difference(self.known))
        for lot in _by_bytes(new):
            self.known.update(zip(lot, self._encode(lot), strict=True))
        self.chars += sum(map(len, new))
        return [sum(map(self.known.__getitem__, own)) for own in parts]

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]


def _splits_safely(config: dict) -> bool:
    pre, added = config.get("pre_tokenizer") or {}, config.get("added_tokens") or []
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and config.get("normalizer") is None
    swallows = any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added)
    return bool(plain and not swallows and config.get("post_processor") is None)


def _by_bytes(texts: Iterable[str], most: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Texts in batches of about equal bytes; one that is larger is a batch of its own."""
    lot, size = [], 0
    for text in texts:
        own = len(text.encode())
        if lot and size + own > most:
            yield lot
            lot, size = [], 0
        lot.append(text)
        size += own
    if lot:
        yield lot


_loaded: dict[str, Lengths] = {}


def lengths_of(path: str) -> Lengths:
    """One instance per Python worker."""
    if path not in _loaded:
        _loaded[path] = Lengths(path)
    return _loaded[path]


def _lots(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``LOT_BYTES``, by the bytes of its rows."""
    ends, a, size = batch.column("n_bytes").to_pylist(), 0, 0
    for b, own in enumerate(ends):
        if b > a and size + own > LOT_BYTES:
            yield batch.slice(a, b - a)
            a, size = b, 0
        size += own
    if len(ends) > a:
        yield batch.slice(a)


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = lengths_of(path)
        for batch in batches:
            for some in _lots(batch):
                n = pa.array(lengths.of(some.column("text").to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([some.column("id"), some.column("n_bytes"), n], ["id", "n_bytes", "n_tokens"])

    return run


def cut_safely(text: str, part: int) -> Iterator[str]:
    """A text in parts of at least ``part`` characters (the last one apart), cut at safe boundaries only."""
    start = 0
    while start < len(text):
        found = SAFE.search(text, start + part) if start + part < len(text) else None
        end = found.start() if found else len(text)
        yield text[start:end]
        start = end


def _cut(part: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, text in zip(batch.column("row"), batch.column("text"), strict=True):
                for no, own in enumerate(cut_safely(text.as_py(), part)):
                    yield pa.RecordBatch.from_arrays([pa.array([number.as_py()], pa.int64()), pa.array([no], pa.int32()), pa.array([own])], ["row", "no", "text"])

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = 512, part: int = 1 << 18) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) for every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = "id long, n_bytes long, n_tokens long"
    is_long = F.col("n_bytes") > part if Lengths(path).splits else F.lit(False)
    short = texts.where(~is_long).select(F.col("doc_id").alias("id"), "n_bytes", "text").mapInArrow(_count(path), counted)
    long = materialize(texts.where(is_long).withColumn("row", F.monotonically_increasing_id()), "long-texts")
    parts = long.select("row", "text").mapInArrow(_cut(part), "row long, no int, text string").repartition("row", "no")
    parts = parts.select(F.col("row").alias("id"), F.octet_length("text").cast("long").alias("n_bytes"), "text").mapInArrow(_count(path), counted)
    sums = parts.groupBy(F.col("id").alias("row")).agg(F.sum("n_tokens").alias("n_tokens"))
    whole = short.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens").unionByName(long.join(sums, "row").select("doc_id", "n_bytes", "n_tokens"))
    return whole.withColumn("over_limit", F.col("n_tokens") > limit)
