"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of ``SIDE`` half-keys, each of ``ROWS`` minhashes, are computed per text. Table keys are all pairs of a
first and a second half-key: 144 tables of 6 minhashes from 72 minhashes instead of 864. Two texts at the
threshold 0.8 meet in some table with probability 0.9996, more similar ones more surely.

Equal sets are one class before anything else. A half-key that no other class has cannot be part of a shared
table key, so pairs are formed only of shared ones. Within a bucket not all pairs are compared: every
class is compared with the bucket's hub first, the class whose buckets are fullest, then with a leader of each bucket's own.
Classes already known to be connected are not compared again. What is left, classes of different components that share a
table, is compared pair by pair, each pair once, so no link that could join two components is lost. The members of the component
that has most of a half-key are not paired among themselves. Two exact bounds keep
texts that merely resemble a large group out of that: shingles that no other class left over has cannot be shared, so a class
with too many of them is left out before pairs are formed; and a shingle is not shared if the other set has none with the same
place in a sketch of ``SKETCH`` bits. All links are confirmed on the full sets of 64-bit shingle hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import staged, text_of, words_of
from terrace.llm.components import components

SIDE, ROWS, LEADER_ROUNDS, WORDS, SIMILAR = 12, 3, 2, 5, 80
_HASHES = 2 * SIDE * ROWS
#: Odd factors of the minhash functions, from a fixed seed.
_FACTORS = np.random.default_rng(20240607).integers(0, 1 << 63, _HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK = 1 << 15
SKETCH = 1024


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; of the whole sequence where it is shorter."""
    found = words_of(text)
    if not found:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    each = np.fromiter(map(digest, found), np.uint64, len(found))
    span = min(words, len(each))
    out = np.full(len(each) - span + 1, span, np.uint64)
    for k in range(span):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + each[k:len(each) - span + 1 + k])
    return np.unique(out)


def _minima(values: np.ndarray) -> np.ndarray:
    out = np.full(_HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), _BLOCK):
        np.minimum(out, (values[at:at + _BLOCK, None] * _FACTORS).min(0), out)
    return out


def _half_keys(minima: np.ndarray) -> np.ndarray:
    """Documents x 2 * SIDE keys; the place of a key is part of it."""
    parts = minima.reshape(len(minima), 2 * SIDE, ROWS)
    keys = np.broadcast_to(np.arange(2 * SIDE, dtype=np.uint64), parts.shape[:2])
    for k in range(ROWS):
        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return keys.view(np.int64)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS,
                    similar: int = SIMILAR) -> DataFrame:
    """``doc_id``, n_shingles, component_id and kept for each row of ``docs``.

    Texts are linked if 100 * shared >= ``similar`` * all of their distinct shingles of ``words`` words. Null and
    empty texts are linked with nothing and kept. Repeated rows are equal texts and have equal results; unlike texts under one id
    are compared each by itself. Rows without an id take part under no name: their component_id is that of the rows they are connected
    with, or null where none of these has an id; in the latter case they count as kept. Other columns are left out; an empty table gives an empty one.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    # A hash of the text beside the id tells rows of one id, or of none, apart when texts are fetched again.
    texts = docs.select(docs[doc_id].alias("_id"), text_of(docs, text).alias("_text")).withColumn("_hash", F.xxhash64("_text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sets, minima = [], [], []
            for value in batch.column(1).to_pylist():
                own = shingles(value, words)
                sizes.append(len(own))
                sets.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                minima.append(_minima(own))
            keys = _half_keys(np.array(minima, np.uint64).reshape(len(sizes), _HASHES))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), 2 * SIDE).cast(pa.list_(pa.int64()))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), lists],
                                  names=["_id", "_hash", "n", "set_id", "keys"])

    signed = staged(texts.mapInArrow(sign, f"_id {id_type}, _hash long, n long, set_id binary, keys array<bigint>"))
    # Classes have numbers of their own; ids name them in the end. The least id stands for a class, a missing one only where there is no other.
    one = F.min(F.struct(F.col("_id").isNull().alias("unnamed"), "_id", "_hash")).alias("one")
    classes = staged(signed.filter("set_id is not null").groupBy("set_id").agg(one, F.max("n").alias("n"), F.first("keys").alias("keys")).select(
        F.monotonically_increasing_id().alias("node"), "set_id", F.col("one._id").alias("name"), F.col("one._hash").alias("hash"), "n", "keys"))
    component = _components(texts, classes, words, similar)
    labelled = classes.select("set_id", "node", "name").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = staged(labelled.groupBy("component").agg(F.min("name").alias("component_id")))
    named = labelled.join(names, "component").select("set_id", "component_id")
    bare = signed.select("_id", "n", "set_id")
    out = bare.filter("set_id is not null").join(named, "set_id").select("_id", "n", "component_id").unionAll(
        bare.filter("set_id is null").select("_id", "n", F.col("_id").alias("component_id")))
    return out.select(F.col("_id").alias(doc_id), F.col("n").alias("n_shingles"), "component_id",
                      F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _components(texts: DataFrame, classes: DataFrame, words: int, similar: int) -> DataFrame:
    """Components of classes, from confirmed links: enough of them to connect what is connected."""
    halves = classes.select("node", "n", F.posexplode("keys").alias("at", "key"))
    shared = halves.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    first = F.col("at") < SIDE
    # At most SIDE half-keys on either side.
    halved = staged(halves.join(shared, "key").groupBy("node", "n").agg(
        F.sort_array(F.collect_list(F.when(first, F.col("key")))).alias("a"), F.sort_array(F.collect_list(F.when(~first, F.col("key")))).alias("b")))
    tables = (halved.select("node", "n", F.explode("a").alias("a"), "b").select("node", "n", "a", F.explode("b").alias("b"))
              .select("node", "n", F.xxhash64("a", "b").alias("table_key")))
    crowded = tables.groupBy("table_key").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = tables.join(crowded, "table_key")
    weights = buckets.groupBy("node").agg(F.sum("size").alias("weight"))
    buckets = staged(buckets.drop("size").join(weights, "node"))
    wanted = buckets.select("node").distinct().join(classes.select("node", "set_id", "name", "hash"), "node")
    sets = staged(_sets(texts, wanted, words))
    close = (100 * F.least("n", "n2") >= similar * F.greatest("n", "n2"))
    links = component = None
    for turn in range(LEADER_ROUNDS + 1):
        if component is None:
            known = buckets.withColumn("c", F.col("node"))
        else:
            known = buckets.join(component.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
            known = staged(known)
        # Tables all of whose classes are connected already have nothing left to link.
        mixed = (F.min("c").alias("c0"), F.max("c").alias("c1"))
        if turn < LEADER_ROUNDS:
            order = F.col("weight") if turn == 0 else F.xxhash64("node", "table_key", F.lit(turn))
            leaders = known.groupBy("table_key").agg(*mixed, F.max(F.struct(order.alias("o"), "node", "n", "c")).alias("l")).filter("c0 <> c1").select(
                "table_key", F.col("l.node").alias("node2"), F.col("l.n").alias("n2"), F.col("l.c").alias("c2"))
            pairs = known.join(leaders, "table_key").filter((F.col("c") != F.col("c2")) & close).select("node", "node2")
        else:
            left = known.groupBy("table_key").agg(*mixed).filter("c0 <> c1").select("table_key")
            left = staged(known.join(left, "table_key").select("node", "c").distinct())
            if left.isEmpty():
                break
            pairs = _apart(_linkable(left, sets, similar).join(halved, "node"), similar)
        pairs = pairs.select(F.least("node", "node2").alias("u"), F.greatest("node", "node2").alias("v")).distinct()
        new = staged(_confirmed(pairs, sets, similar)).filter("linked").select("u", "v")
        if component is None or not new.isEmpty():
            links = new if links is None else links.unionAll(new)
            component = components(links)
    return component


def _within(shared: Column, similar: int) -> Column:
    """Whether sets of n and n2 shingles can be similar with ``shared`` common ones at most."""
    return (100 + similar) * shared >= similar * (F.col("n") + F.col("n2"))


def _apart(rest: DataFrame, similar: int) -> DataFrame:
    """Pairs of classes of different components that share a table and can be similar by size, shared shingles and sketches. Of a half-key's
    rows only those outside of its largest component are joined with all, so the pairs within one large component are never formed."""
    words = range(SKETCH // 64)
    one = rest.select(F.explode("a").alias("key"), *(c for c in rest.columns if c != "sketch"), *(F.col("sketch")[i].alias(f"s{i}") for i in words))
    major = staged(one.groupBy("key", "c").agg(F.count("*").alias("k")).groupBy("key").agg(F.max(F.struct("k", "c")).alias("most")).select("key", F.col("most.c").alias("major")))
    # Both staged, so that adaptive execution can split the joins at a frequent key.
    minor = staged(one.join(major, "key").filter("c <> major"))
    two = one.select("key", *(F.col(x).alias(f"{x}2") for x in ("node", "n", "a", "b", "c", "usable")), *(F.col(f"s{i}").alias(f"t{i}") for i in words))
    # Each bit that only one of two sketches has stands for a shingle at least that the other set lacks.
    lacking = lambda x, y: reduce(add, (F.bit_count(F.col(f"{x}{i}").bitwiseAND(F.bitwise_not(f"{y}{i}"))) for i in words))
    # Each pair once: at the first of the half-keys that both have, if they share one of the other side, too.
    return minor.join(two, "key").filter(
        F.expr("c <> c2 and (c2 = major or c < c2)") & _within(F.least("usable", "usable2"), similar)
        & _within(F.col("n") - lacking("s", "t"), similar) & _within(F.col("n2") - lacking("t", "s"), similar)
        & F.arrays_overlap("b", "b2") & (F.array_min(F.array_intersect("a", "a2")) == F.col("key"))).select("node", "node2")


def _sketch(own: np.ndarray) -> np.ndarray:
    bits = np.zeros(SKETCH, bool)
    bits[(own % np.uint64(SKETCH)).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64)


def _linkable(rest: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Classes that can be linked with another one of ``rest``, with the number of shingles that another one has, too, and the sketch."""
    own = rest.join(sets, "node")
    alone = (own.select("node", F.explode("members").alias("m")).groupBy("m").agg(F.count("*").alias("k"), F.min("node").alias("node"))
             .filter("k = 1").groupBy("node").agg(F.count("*").alias("alone")))
    size = F.size("members")
    return staged(own.join(alone, "node", "left").withColumn("usable", size - F.coalesce("alone", F.lit(0)))
                  .filter(100 * F.col("usable") >= similar * size).select("node", "c", "usable", "sketch"))


def _sets(texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """The full sets of some classes, taken from the documents anew."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                nodes, found, sketches = [], [], []
                part = batch.slice(at, 64)
                for node, value, set_id in zip(*(part.column(k).to_pylist() for k in range(3))):
                    own = shingles(value, words)
                    if hashlib.blake2b(own.tobytes(), digest_size=16).digest() == set_id:
                        nodes.append(node), found.append(own.view(np.int64))
                        sketches.append(_sketch(own))
                yield pa.record_batch([pa.array(nodes, part.schema.field(0).type), pa.array(found, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                                      names=["node", "members", "sketch"])

    needed = texts.join(wanted, (F.col("_hash") == F.col("hash")) & F.col("_id").eqNullSafe(F.col("name"))).select("node", "_text", "set_id")
    return needed.mapInArrow(collect, "node long, members array<bigint>, sketch array<bigint>").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    both = (pairs.join(sets.select(F.col("node").alias("u"), F.col("members").alias("mu")), "u")
            .join(sets.select(F.col("node").alias("v"), F.col("members").alias("mv")), "v"))
    shared = F.size(F.array_intersect("mu", "mv"))
    return both.select("u", "v", (100 * shared >= similar * (F.size("mu") + F.size("mv") - shared)).alias("linked"))
