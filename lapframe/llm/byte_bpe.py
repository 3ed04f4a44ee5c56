"""Byte-level BPE encoding and decoding with overlapping chunks.

A text longer than ``chunk`` characters is cut into chunks that overlap by
``overlap`` characters. Each chunk is pre-tokenised on its own, in parallel. A
pre-token starts where the one before it ends and depends only on what follows,
so once two chunks share a boundary inside their overlap they agree from there
on: the first shared boundary that is not disturbed by the left chunk's end is
where they are stitched. Each chunk then encodes the pieces between its two
stitches, again in parallel, and the parts of a text are put in order. A text
where some overlap holds no shared boundary (a run longer than the overlap) is
cut again with overlaps of half a chunk; one with a run longer than that, which
is a single piece to encode, is pre-tokenised whole. Shorter texts are one chunk and need no shuffle.

Decoding looks up each id's raw bytes and concatenates them. :func:`encode_decode`
gives ids and decoded bytes of every row; :func:`decode` takes ids from anywhere.

Defined cases: a null text is the empty text: no ids, no bytes. Rows
repeated give a result each; other columns are not read; no rows give no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapframe.llm.common import text_of
from lapframe.session import materialize

OUT = "doc_id long, ids array<int>, decoded binary"
CACHED_PIECES = 150_000


class ByteBPE:
    """Pieces to ids and back by the ranks of a tiktoken file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: raw for raw, i in ranks.items()}
        self.split = regex.compile(pattern)
        # pieces are split off before: this encoding takes each one as it is
        self.merge = tiktoken.Encoding("ranks", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cache = _Pieces(self)

    def pieces(self, text: str) -> list[str]:
        return self.split.findall(text)

    def bounds(self, text: str) -> list[int]:
        """Where the pre-tokens of ``text`` start, and its end."""
        return [m.start() for m in self.split.finditer(text)] + [len(text)]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def encode(self, pieces: list[str]) -> tuple[list[int], bytes]:
        """The ids of some pieces, and the bytes that these ids decode to."""
        found = list(map(self.cache.__getitem__, pieces))
        if len(self.cache) > CACHED_PIECES:
            self.cache.clear()
        return list(chain.from_iterable([f[0] for f in found])), b"".join([f[1] for f in found])


class _Pieces(dict):
    """Per piece: its ids and their bytes. Emptied when full; words repeat, so most look-ups hit."""

    def __init__(self, bpe: ByteBPE):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> tuple[list[int], bytes]:
        ids = self.bpe.merge(piece)
        self[piece] = got = (ids, self.bpe.decode(ids))
        return got


_loaded: dict[tuple[str, str], ByteBPE] = {}


def tokenizer(path: str, pattern: str) -> ByteBPE:
    """One instance per Python worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBPE(path, pattern)
    return _loaded[path, pattern]


def _lists(ids: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _encode_whole(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            for some in _lots(batch):
                ids, raw = _columns([bpe.encode(bpe.pieces(text.as_py())) for text in some.column("text")])
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), ids, raw], ["doc_id", "ids", "decoded"])

    return run


def _columns(coded: list[tuple[list[int], bytes]]) -> tuple[pa.Array, pa.Array]:
    ids, raw = zip(*coded, strict=True) if coded else ((), ())
    return _lists(list(ids)), pa.array(raw, pa.binary())


def _lots(batch: pa.RecordBatch, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most`` bytes, so that what is built from one stays small."""
    n = max(1, batch.nbytes // most)
    step = max(1, -(-batch.num_rows // n))
    for a in range(0, batch.num_rows, step):
        yield batch.slice(a, step)


def _bounds_of_chunks(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            starts = batch.column("start").to_pylist()
            found = [[s + b for b in bpe.bounds(t.as_py())] for s, t in zip(starts, batch.column("part"), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], [*batch.schema.names, "bounds"])

    return run


def _encode_parts(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            coded = []
            for start, text, bounds, a, b in zip(*[batch.column(c).to_pylist() for c in ("start", "part", "bounds", "own_from", "own_to")], strict=True):
                own = [x - start for x in bounds if a <= x <= b]
                coded.append(bpe.encode([text[i:j] for i, j in zip(own, own[1:], strict=False)]))
            ids, raw = _columns(coded)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("no"), ids, raw], ["row", "doc_id", "no", "ids", "raw"])

    return run


def _decode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            raw = [None if ids is None else bpe.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "decoded"])

    return run


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, decoded (bytes) of rows with doc_id and ids."""
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_decode(path, pattern), "doc_id long, decoded binary")


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by commas), decoded_sha256."""
    text = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def encode_decode(docs: DataFrame, path: str, pattern: str, chunk: int = 32_768, overlap: int = 1_024) -> DataFrame:
    """doc_id, ids, decoded for every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    whole = _encode_whole(path, pattern)
    out = texts.where(F.length("text") <= chunk).mapInArrow(whole, OUT)
    long = materialize(texts.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id()), "bpe-long")
    # a text torn at one overlap is cut anew with a wider one; only a run as long as half a chunk stays whole
    for wide in (overlap, max(overlap, chunk // 2)):
        joined, torn = _stitched(long, path, pattern, chunk, wide)
        out = out.unionByName(joined)
        long = long.join(torn, "row", "left_semi")
        if torn.isEmpty():
            break
    return out.unionByName(long.select("doc_id", "text").mapInArrow(whole, OUT))


def _stitched(long: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, ids, decoded of the texts whose chunks all meet, ``row`` of the others)."""
    last = F.ceil((F.length("text") - overlap) / F.lit(chunk)).cast("int") - 1
    parts = (
        long.withColumn("no", F.explode(F.sequence(F.lit(0), F.greatest(last, F.lit(0)))))
        .select("row", "doc_id", "no", (F.col("no") * chunk).alias("start"), F.length("text").alias("length"), F.expr(f"substring(text, no * {chunk} + 1, {chunk + overlap})").alias("part"))
        .repartition("row", "no")
    )
    bounds = parts.mapInArrow(_bounds_of_chunks(path, pattern), "row long, doc_id long, no int, start int, length int, part string, bounds array<int>")
    bounds = materialize(bounds, "bpe-bounds")
    in_order = Window.partitionBy("row").orderBy("no")
    ends = bounds.select("row", "no", "start", "length", F.size("bounds").alias("n"), F.filter("bounds", lambda b: b <= F.col("start") + overlap).alias("head"), F.filter("bounds", lambda b: b >= F.col("start") + chunk).alias("tail"))
    # of the left chunk's boundaries the last is its cut end, and the one before may lean on it
    sure = F.slice("tail", 1, F.greatest(F.size("tail") - 2, F.lit(0)))
    shared = F.array_min(F.array_intersect(sure, F.lead("head").over(in_order)))
    is_last = F.lead("no").over(in_order).isNull()
    ends = ends.withColumn("own_to", F.when(is_last, F.col("length")).otherwise(shared))
    ends = ends.withColumn("own_from", F.when(F.col("no") == 0, 0).otherwise(F.lag("own_to").over(in_order)))
    torn = F.max((F.col("own_to").isNull()).cast("int")).over(Window.partitionBy("row"))
    ends = materialize(ends.withColumn("torn", torn).select("row", "no", "own_from", "own_to", "torn"), "bpe-ends")
    stitched = bounds.join(ends.where("torn = 0").drop("torn"), ["row", "no"])
    coded = stitched.mapInArrow(_encode_parts(path, pattern), "row long, doc_id long, no int, ids array<int>, raw binary")
    in_line = coded.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("no", "ids", "raw"))).alias("p"))
    joined = in_line.select(
        "doc_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["raw"])), "")).alias("decoded"),
    )
    return joined, ends.where("torn = 1").select("row").distinct()
