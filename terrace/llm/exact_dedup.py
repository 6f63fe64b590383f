"""Exact duplicates by composable polynomial fingerprints.

A text is the number that its normalised bytes spell to the base 256; its fingerprint is that number modulo two 61-bit primes, with
its length. A chunk's residue, shifted by the bytes that follow it, is a summand of the whole text's: chunks of a huge text are
rows of their own, hashed apart and added up in any order.

1. All texts are fingerprinted and equal fingerprints counted. Only hashes of repeated ones matter further; a bitmap of bounded
   size says which texts may have one, so that no others are written or shuffled.
2. Texts of one fingerprint are compared chunk by chunk: at each place the least and the greatest chunk must be equal. These are
   combined within tasks before the shuffle and stream through a sort, so neither a group of copies nor a huge text is ever held whole.
3. Groups that turn out to hold different texts are fingerprinted anew under other primes until none is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.bitmap import Bitmap
from terrace.llm.common import LOWER, staged, text_of

#: Bytes of a chunk. Longer texts are huge: their chunks are rows.
CHUNK = 1 << 16
_KEY = ("n_bytes", "turn", "f0", "f1")


def _is_prime(n: int) -> bool:
    """Miller-Rabin, certain for 64-bit numbers with these bases."""
    bases = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)
    if n < 41 or any(n % b == 0 for b in bases):
        return n in bases
    twos = ((n - 1) & -(n - 1)).bit_length() - 1
    for b in bases:
        x = pow(b, n - 1 >> twos, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes(turn: int) -> tuple[int, int]:
    """Two 61-bit primes for each turn: the next ones after numbers drawn by hashing."""
    out = []
    for k in range(2):
        n = int.from_bytes(hashlib.blake2b(f"{turn}:{k}".encode(), digest_size=8).digest()) >> 4 | 1 << 60 | 1
        while not _is_prime(n):
            n += 2
        out.append(n)
    return out[0], out[1]


def residues(chunk: bytes, after: int, by: tuple[int, int]) -> tuple[int, int]:
    """What a chunk with ``after`` bytes behind it adds to the fingerprint of its text."""
    number = int.from_bytes(chunk)
    return tuple(number % p * pow(256, after, p) % p for p in by) if after else tuple(number % p for p in by)


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", chunk: int = CHUNK,
                     by: Callable[[int], tuple[int, int]] = primes) -> DataFrame:
    """``doc_id``, keep_id, group_size, kept, text_sha256, n_bytes and fingerprint for each row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so null and empty texts form one group. Of equal
    texts the row with the largest id stays, a null id being the least; of repeated rows with that id one stays. Huge texts are read
    whole, in chunks. Other columns are left out, so their names don't matter. An empty table gives an empty one.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    texts = docs.select(docs[doc_id].alias("_id"), text_of(docs, text).alias("_text"))
    huge = F.octet_length("_text") > chunk
    short, first = texts.filter(~huge), by(0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, value in enumerate(batch.column(2).to_pylist()):
                data = value.encode().translate(LOWER)
                digest, count = hashlib.sha256(data).hexdigest(), -(-len(data) // chunk)
                for at in range(0, count, 64):
                    spans = [(s, data[s * chunk:(s + 1) * chunk]) for s in range(at, min(at + 64, count))]
                    yield pa.record_batch([
                        pa.array([batch.column(k)[i].as_py()] * len(spans), batch.schema.field(k).type) for k in range(2)] + [
                        pa.array([len(data)] * len(spans), pa.int64()), pa.array([digest] * len(spans)), pa.array([s for s, _ in spans], pa.int32()),
                        pa.array([len(data) - s * chunk - len(b) for s, b in spans], pa.int64()), pa.array([b for _, b in spans], pa.binary())],
                        names=["row", "_id", "n_bytes", "text_sha256", "seq", "after", "chunk"])

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(data), *residues(data, 0, first)) for data in (v.encode().translate(LOWER) for v in batch.column(0).to_pylist())]
            yield pa.record_batch([pa.array(x, pa.int64()) for x in _columns(found, 3)], names=["n_bytes", "f0", "f1"])

    # Rows of huge texts have negative numbers. Written once, numbers and chunks agree for all later uses.
    parts = staged(texts.filter(huge).select((-1 - F.monotonically_increasing_id()).alias("row"), "_id", "_text").mapInArrow(
        cut, f"row long, _id {id_type}, n_bytes long, text_sha256 string, seq int, after long, chunk binary"))
    long_keys = _hashed(parts, first, 0)
    seen = short.select("_text").mapInArrow(fingerprints, "n_bytes long, f0 long, f1 long").unionAll(long_keys.select("n_bytes", "f0", "f1"))
    repeated = staged(seen.groupBy("n_bytes", "f0", "f1").agg(F.count("*").alias("c")).filter("c > 1").select(_spread("f0").alias("h")))
    crowded = Bitmap.of(repeated)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts_ = [v.encode().translate(LOWER) for v in batch.column(1).to_pylist()]
            found = [(len(data), *residues(data, 0, first)) for data in texts_]
            marked = crowded.holds(np.array([f << 3 for _, f, _ in found], np.uint64))
            yield pa.record_batch(
                [batch.column(0)] + [pa.array(x, pa.int64()) for x in _columns(found, 3)]
                + [pa.array([hashlib.sha256(data).hexdigest() for data in texts_], pa.string()), pa.array([d if m else None for d, m in zip(texts_, marked)], pa.binary())],
                names=["_id", "n_bytes", "f0", "f1", "text_sha256", "chunk"])

    rows = staged(short.mapInArrow(whole, f"_id {id_type}, n_bytes long, f0 long, f1 long, text_sha256 string, chunk binary").select(
        F.monotonically_increasing_id().alias("row"), "*", F.lit(0).alias("turn")))
    long_rows = parts.filter("seq = 0").select("row", "_id", "text_sha256").join(long_keys, "row")
    chunks = rows.filter("chunk is not null").select("row", *_KEY, F.lit(0).alias("seq"), F.lit(0).cast("long").alias("after"), "chunk").unionAll(
        parts.select("row", "seq", "after", "chunk").join(long_keys, "row").select("row", *_KEY, "seq", "after", "chunk"))
    maybe = rows.filter("chunk is not null").select("row", "_id", "text_sha256", *_KEY).unionAll(long_rows.select("row", "_id", "text_sha256", *_KEY))
    changed = _told_apart(chunks, by)
    if changed is not None:
        fresh = changed.select("row", *(F.col(k).alias(f"new_{k}") for k in _KEY[1:]))
        maybe = maybe.join(fresh, "row", "left").select("row", "_id", "text_sha256", "n_bytes", *(F.coalesce(f"new_{k}", k).alias(k) for k in _KEY[1:]))
    # Written, so that the join below has shuffles of its own: adaptive execution then splits a key with a large part of all rows.
    groups = staged(maybe.groupBy(*_KEY).agg(F.max(F.struct("_id", "row")).alias("keep"), F.count("*").alias("group_size")))
    member = maybe.join(groups, list(_KEY)).select("_id", F.col("keep._id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"),
                                                   "text_sha256", "n_bytes", "f0", "f1")
    single = rows.filter("chunk is null").select("_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
                                                 "text_sha256", "n_bytes", "f0", "f1")
    return member.unionAll(single).select(F.col("_id").alias(doc_id), "keep_id", "group_size", "kept", "text_sha256", "n_bytes",
                                          F.format_string("%016x%016x", "f0", "f1").alias("fingerprint"))


def _columns(rows: list[tuple], width: int) -> list[list]:
    return [list(x) for x in zip(*rows)] if rows else [[] for _ in range(width)]


def _spread(column: str) -> Column:
    """A 61-bit residue with its leading bits in the leading bits of 64."""
    return F.shiftleft(F.col(column), 3)


def _hashed(chunks: DataFrame, by: tuple[int, int], turn: int) -> DataFrame:
    """Fingerprints of texts by row, from their chunks in any order."""

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [residues(data, after, by) for after, data in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in _columns(found, 2))], names=["row", "n_bytes", "f0", "f1"])

    total = lambda k: F.expr(f"cast(sum(cast(f{k} AS decimal(38, 0))) % {by[k]} AS bigint)").alias(f"f{k}")
    return (chunks.select("row", "n_bytes", "after", "chunk").mapInArrow(shifted, "row long, n_bytes long, f0 long, f1 long")
            .groupBy("row").agg(F.max("n_bytes").alias("n_bytes"), total(0), total(1)).withColumn("turn", F.lit(turn)))


def _told_apart(chunks: DataFrame, by: Callable[[int], tuple[int, int]]) -> DataFrame | None:
    """New keys of the rows whose fingerprint stands for different texts; None where there are none."""
    changed, turn = None, 0
    while True:
        places = chunks.groupBy(*_KEY, "seq").agg(F.min("chunk").alias("least"), F.max("chunk").alias("most"))
        # Texts of one fingerprint are equally long, so they have the same places.
        mixed = staged(places.groupBy(*_KEY).agg(F.bool_and(F.col("least") == F.col("most")).alias("same")).filter("not same").select(*_KEY))
        if mixed.isEmpty():
            return changed
        turn += 1
        unlike = staged(chunks.join(mixed, list(_KEY), "left_semi").select("row", "n_bytes", "seq", "after", "chunk"))
        keys = staged(_hashed(unlike, by(turn), turn))
        changed = keys if changed is None else changed.join(keys, "row", "left_anti").unionAll(keys.select(*changed.columns))
        chunks = unlike.join(keys.drop("n_bytes"), "row").select("row", *_KEY, "seq", "after", "chunk")
