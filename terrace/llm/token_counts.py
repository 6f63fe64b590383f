"""Token counts without materialised ids: pieces are counted once per distinct pre-token.

1. Every task lists the distinct pre-tokens of its texts; a grouped sum gives the dictionary.
2. Each distinct pre-token is encoded once, for the number of its pieces.
3. Each document's pre-token frequencies are joined to the dictionary and summed.

Short runs between white space hold few pre-tokens and are counted as one unit; longer ones, texts without spaces among them, are cut into
the pre-tokens of the tokenizer's own pattern. Units longer than ``LONG`` characters go by a 128-bit digest, so keys are short.

Units in at least one of ``head`` document entries are frequent. By counting, there are at most
``head`` of them, so their piece counts are broadcast; all others take part in a shuffled join. No key of that
join can be hot, since the frequent ones have been left out, whatever their length.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import CHUNK, Encoder, json_vocabulary, staged, text_of

#: Bound on the broadcast units, and the characters from which on they are cut and go by a digest.
HEAD, LONG = 1 << 20, 64
#: A task hands on its pre-tokens when it holds so many.
FLUSH = 400_000
ROWS = 50_000


def _units(pattern: str, special: tuple[tuple[str, int], ...]) -> Callable[[str], list[str]]:
    """How to cut a text into units that may be encoded apart."""
    marks = re.compile("(" + "|".join(re.escape(name) for name, _ in special) + ")") if special else None
    names, pre_tokens, runs = {name for name, _ in special}, regex.compile(pattern), CHUNK.findall

    def cut(chunk: str) -> Iterator[str]:
        for part in marks.split(chunk) if marks else (chunk,):
            if part in names:
                yield part
            else:
                yield from pre_tokens.findall(part)

    def units(text: str) -> list[str]:
        found = runs(text)
        if max(map(len, found), default=0) <= LONG:
            return found
        return [x for chunk in found for x in ((chunk,) if len(chunk) <= LONG else cut(chunk))]

    return units


def _key(unit: str) -> str:
    """A unit, or the digest of a long one. No unit has white space behind another character, as a digest's key has."""
    return unit if len(unit) <= LONG else hashlib.blake2b(unit.encode(), digest_size=16).hexdigest() + " long"


def count_tokens(docs: DataFrame, text: str = "text", ids: tuple[str, ...] = ("doc_id",),
                 limit: int = 512, head: int = HEAD, vocabulary: dict | None = None) -> DataFrame:
    """Columns ``ids``, ``n_bytes``, ``n_tokens`` and ``over_limit`` for each row of ``docs``.

    Null and empty texts have 0 bytes and tokens. Repeated rows and null ids are kept as they are;
    other columns are left out, so their names don't matter. Long texts are read whole. The special
    string of the vocabulary counts as one token. An empty table gives an empty one.
    """
    vocabulary = vocabulary or json_vocabulary()
    texts = docs.select(*ids, text_of(docs, text).alias("_text"))
    pattern, special = vocabulary["pattern"], vocabulary.get("special", ())

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, units = Counter(), _units(pattern, special)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                seen.update(set(units(value)))
                if len(seen) >= FLUSH:
                    yield from _counts(seen)
                    seen = Counter()
        yield from _counts(seen)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.of(**vocabulary).ids
        for batch in batches:
            units = batch.column(0).to_pylist()
            yield pa.record_batch(
                [pa.array(map(_key, units), pa.string()), batch.column(1), pa.array([len(encode(x)) for x in units], pa.int64())],
                names=["chunk", "n", "pieces"])

    dictionary = staged(
        texts.select("_text").mapInArrow(distinct, "chunk string, n long")
        .groupBy("chunk").agg(F.sum("n").alias("n"))
        .mapInArrow(pieces, "chunk string, n long, pieces long"))
    total = dictionary.agg(F.sum("n")).first()[0] or 0
    frequent = F.col("n") * head >= total
    # At most ``head`` rows of bounded size: each stands for total / head entries or more.
    known = docs.sparkSession.sparkContext.broadcast(
        {r.chunk: r.pieces for r in dictionary.filter(frequent).select("chunk", "pieces").toLocalIterator()})

    id_types = [docs.schema[c] for c in ids]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ids),
                        "_row long, _bytes long, _sum long, chunk string, _times long"])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, lookup, units = TaskContext.get().partitionId() << 33, known.value.get, _units(pattern, special)
        for batch in batches:
            at, rows, n_bytes, sums, chunks, times = [], [], [], [], [], []
            for i, value in enumerate(batch.column(len(id_types)).to_pylist()):
                own = len(rows)
                at.append(i), rows.append(row), n_bytes.append(len(value.encode()))
                # This key is in no dictionary, and no two rows have it.
                sums.append(0), chunks.append(f"{row} row"), times.append(0)
                count = 0
                for unit, k in Counter(units(value)).items():
                    got = lookup(chunk := _key(unit))
                    if got is None:
                        at.append(i), rows.append(row), n_bytes.append(0)
                        sums.append(0), chunks.append(chunk), times.append(k)
                    else:
                        count += k * got
                sums[own] = count
                row += 1
                if len(rows) >= ROWS:
                    yield _frequencies(batch, len(id_types), at, rows, n_bytes, sums, chunks, times)
                    at, rows, n_bytes, sums, chunks, times = [], [], [], [], [], []
            yield _frequencies(batch, len(id_types), at, rows, n_bytes, sums, chunks, times)

    rare = dictionary.filter(~frequent).select("chunk", "pieces")
    counted = (
        texts.mapInArrow(frequencies, schema).join(rare, "chunk", "left")
        .groupBy("_row").agg(*(F.max(c).alias(c) for c in ids), F.max("_bytes").alias("n_bytes"),
                             F.sum(F.col("_sum") + F.col("_times") * F.coalesce("pieces", F.lit(0))).alias("n_tokens"))
    )
    return counted.select(*ids, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _counts(seen: Counter) -> Iterator[pa.RecordBatch]:
    keys, values = list(seen), list(seen.values())
    for i in range(0, len(keys), ROWS):
        yield pa.record_batch([pa.array(keys[i:i + ROWS], pa.string()), pa.array(values[i:i + ROWS], pa.int64())], names=["chunk", "n"])


def _frequencies(batch: pa.RecordBatch, n_ids: int, at, rows, n_bytes, sums, chunks, times) -> pa.RecordBatch:
    index = pa.array(at, pa.int64())
    return pa.record_batch(
        [*(batch.column(k).take(index) for k in range(n_ids)), pa.array(rows, pa.int64()), pa.array(n_bytes, pa.int64()),
         pa.array(sums, pa.int64()), pa.array(chunks, pa.string()), pa.array(times, pa.int64())],
        names=[*(batch.schema.names[:n_ids]), "_row", "_bytes", "_sum", "chunk", "_times"])
