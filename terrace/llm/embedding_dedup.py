"""Near-duplicate embeddings by inverted lists with product quantisation.

The index (coarse centres and residual codebooks) is fitted on a bounded sample; every vector is indexed. A
vector probes each list that can hold a neighbour: one whose bisecting plane to the vector's own list lies within the
link distance. In a list, asymmetric table distances to the codes, less each entry's own quantisation error, are lower bounds
of the true distance, so entries beyond the link distance are left out without loss. The rest is
reranked by exact cosine in double precision. Probes and table distances are therefore sufficient: nothing is missed by them.

Equal vectors are one class before anything else. A list is split into blocks of bounded size, and queries meet it block
by block; each block reports counts and the edges of a spanning forest, never all of its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import staged
from terrace.llm.components import components

#: Documented bounds of the fit: vectors in the sample, codes by subspace, subspaces.
SAMPLE, CODES, SUBSPACES = 16_384, 64, 8
#: Rows of a block, numbers of lists to choose from, and the cost of sending a vector to a list in comparisons.
BLOCK, LISTS, SENDING = 2048, (1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024), 300
SIMILAR, _SLACK = 0.93, 1e-9


@dataclass(frozen=True)
class Index:
    width: int
    centres: np.ndarray
    books: np.ndarray  # subspaces x codes x part

    def parts(self, x: np.ndarray) -> np.ndarray:
        """Rows cut into subspaces, padded with zeros."""
        books, _, part = self.books.shape
        out = np.zeros((len(x), books * part))
        out[:, :x.shape[1]] = x
        return out.reshape(len(x), books, part)

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the distance of each residual to what its codes stand for."""
        parts = self.parts(residual)
        codes = np.stack([_nearest(parts[:, m], self.books[m]) for m in range(len(self.books))], 1)
        back = np.stack([self.books[m][codes[:, m]] for m in range(len(self.books))], 1)
        return codes.astype(np.uint8), np.sqrt(((parts - back) ** 2).sum((1, 2)))


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_distances(x[a:a + 8192], centres).argmin(1) for a in range(0, len(x), 8192)]) if len(x) else np.empty(0, int)


def _means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced rows; empty clusters keep their centre."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        count = np.bincount(own, minlength=len(centres))
        for j in np.flatnonzero(count):
            centres[j] = x[own == j].mean(0)
    return np.unique(centres, axis=0)


def _probes(x: np.ndarray, centres: np.ndarray, reach: float) -> np.ndarray:
    """Which lists may hold a vector within ``reach`` of each row (rows x lists)."""
    d = _distances(x, centres)
    own = d.argmin(1)
    gaps = np.sqrt(_distances(centres, centres))[own]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = (d - d[np.arange(len(x)), own][:, None]) / (2 * gaps)
    out = plane <= reach + _SLACK
    out[np.arange(len(x)), own] = True
    return out


def fit(sample: np.ndarray, by_label: float, reach: float) -> Index:
    """Fit on unit vectors. The number of lists is the one with the least work expected for ``by_label`` vectors of a label."""
    width = sample.shape[1]
    best = None
    for k in LISTS:
        if k > 1 and (k * 16 > len(sample) or k * 8 > by_label):
            break
        centres = _means(sample[:: max(1, len(sample) // (64 * k))], k)
        mean = _probes(sample[:: max(1, len(sample) // 512)], centres, reach).sum(1).mean()
        work = mean * (SENDING + by_label / len(centres))
        if best is None or work < best[0]:
            best = (work, centres)
    centres = best[1]
    residual = sample - centres[_nearest(sample, centres)]
    books = min(SUBSPACES, width)
    part = -(-width // books)
    padded = np.zeros((len(residual), books * part))
    padded[:, :width] = residual
    learned = [_means(padded[:, m * part:(m + 1) * part], CODES, 5) for m in range(books)]
    full = np.stack([np.concatenate([b, np.repeat(b[-1:], CODES - len(b), 0)]) for b in learned])
    return Index(width, centres, full)


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
                    similar: float = SIMILAR) -> DataFrame:
    """``vec_id``, n_links, component_id and kept for each row of ``vectors``.

    Vectors of one label and length are linked if their cosine is at least ``similar``. Null and zero vectors, those with
    null or non-finite parts, and those without a label are linked with nothing. Repeated rows are vectors of their own,
    linked with each other; a row without an id counts as a link but has no name to give. Other columns are left out; an
    empty table gives an empty one.
    """
    id_type = vectors.schema[vec_id].dataType.simpleString()
    rows = vectors.select(vectors[vec_id].alias("_id"), vectors[embedding].cast("array<double>").alias("_v"), vectors[label].cast("string").alias("_label"))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, units, sizes = [], [], []
            for v, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                x = None if v is None or label is None or None in v else np.array(v, np.float64)
                with np.errstate(over="ignore", invalid="ignore"):
                    valid = x is not None and len(x) > 0 and np.isfinite(x).all() and 0 < np.linalg.norm(x) < np.inf
                if not valid:
                    keys.append(None), units.append(None), sizes.append(0)
                    continue
                keys.append(hashlib.blake2b(f"{label}\0".encode() + x.tobytes(), digest_size=16).digest())
                units.append(x), sizes.append(len(x))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(units, pa.list_(pa.float64()))],
                                  names=["_id", "_label", "key", "size", "x"])

    keyed = staged(rows.mapInArrow(key, f"_id {id_type}, _label string, key binary, size int, x array<double>"))
    classes = staged(keyed.filter("key is not null").groupBy("key").agg(
        F.min("_id").alias("node"), F.count("*").alias("copies"), F.first("_label").alias("_label"), F.first("size").alias("size"), F.first("x").alias("x")))
    found = _links(classes, similar)
    counts = found.filter("other is null").groupBy("key").agg(F.sum("links").alias("links"))
    named = classes.select("key", "node", "copies").join(counts, "key", "left")
    edges = (found.filter("other is not null").select("key", "other")
             .join(classes.select("key", F.col("node").alias("u")), "key").join(classes.select(F.col("key").alias("other"), F.col("node").alias("v")), "other").select("u", "v"))
    named = named.join(components(staged(edges)), "node", "left").select(
        "key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    bare = keyed.select("_id", "key")
    out = bare.filter("key is not null").join(named, "key").select("_id", "n_links", "component_id").unionAll(
        bare.filter("key is null").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id")))
    return out.select(F.col("_id").alias(vec_id), "n_links", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _links(classes: DataFrame, similar: float) -> DataFrame:
    """Rows (key, null, links) with parts of the link counts, and (key, other, 0) with edges of a spanning forest."""
    spark = classes.sparkSession
    schema = "key binary, other binary, links long"
    facts = classes.groupBy("_label", "size").agg(F.count("*").alias("n")).agg(
        F.max("size").alias("width"), (F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("by_label")).first()
    if not facts.width:
        return spark.createDataFrame([], schema)
    # A bounded sample, chosen by hash.
    picked = classes.select("x", F.xxhash64("key").alias("h"), "key").orderBy("h", "key").limit(SAMPLE).select("x").toArrow()["x"]
    sample = np.zeros((len(picked), facts.width))
    for i, v in enumerate(picked.to_pylist()):
        sample[i, :len(v)] = np.array(v) / np.linalg.norm(v)
    reach = float(np.sqrt(2 - 2 * similar)) + 1e-6
    index = spark.sparkContext.broadcast(fit(sample, float(facts.by_label), reach))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                unit = _units(part.column(part.schema.names.index("x")), own.width)
                near = _nearest(unit, own.centres)
                codes, error = own.encode(unit - own.centres[near])
                row, target = np.nonzero(_probes(unit, own.centres, reach))
                index_of = pa.array(np.concatenate([np.arange(len(unit)), row]))
                entry = np.concatenate([np.ones(len(unit), bool), np.zeros(len(row), bool)])
                fixed = [part.column(part.schema.names.index(c)).take(index_of) for c in ("key", "copies", "_label", "size", "x")]
                yield pa.record_batch(
                    [*fixed, pa.array(np.concatenate([near, target]), pa.int32()), pa.array(entry),
                     pa.array([c.tobytes() for c in codes] + [None] * len(row), pa.binary()), pa.array(np.concatenate([error, np.zeros(len(row))]))],
                    names=["key", "copies", "_label", "size", "x", "list", "entry", "codes", "error"])

    placed = staged(classes.mapInArrow(place, "key binary, copies long, _label string, size int, x array<double>, list int, entry boolean, codes binary, error double"))
    cell = ["_label", "size", "list"]
    blocks = placed.groupBy(*cell).agg(
        F.ceil(F.sum(F.col("entry").cast("long")) / BLOCK).cast("int").alias("be"), F.ceil(F.sum((~F.col("entry")).cast("long")) / BLOCK).cast("int").alias("bq"))
    sized = placed.join(blocks.filter("be > 0"), cell)
    own_block = F.pmod(F.xxhash64("key"), F.when(F.col("entry"), F.col("be")).otherwise(F.col("bq")))
    dealt = sized.withColumn("own", own_block).withColumn(
        "over", F.explode(F.sequence(F.lit(0), F.when(F.col("entry"), F.col("bq")).otherwise(F.col("be")) - 1)))
    dealt = dealt.select(*cell, F.when(F.col("entry"), F.col("own")).otherwise(F.col("over")).alias("e"),
                         F.when(F.col("entry"), F.col("over")).otherwise(F.col("own")).alias("q"), "key", "copies", "x", "entry", "codes", "error")

    def match(table: pa.Table) -> pa.Table:
        return _match(table, index.value, reach, similar)

    return staged(dealt.groupBy(*cell, "e", "q").applyInArrow(match, schema))


def _units(column, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, v in enumerate(column.to_pylist()):
        out[i, :len(v)] = v
    return out / np.linalg.norm(out, axis=1)[:, None]


def _match(table: pa.Table, index: Index, reach: float, similar: float) -> pa.Table:
    """Compare the queries of a block with its entries; each pair once, from the smaller key to the larger."""
    entries, queries = table.filter(table["entry"]), table.filter(pa.compute.invert(table["entry"]))
    none = pa.table({"key": pa.array([], pa.binary()), "other": pa.array([], pa.binary()), "links": pa.array([], pa.int64())})
    if not len(entries) or not len(queries):
        return none
    centre = index.centres[table["list"][0].as_py()]
    ekeys, qkeys = entries["key"].to_pylist(), queries["key"].to_pylist()
    ecopies, qcopies = entries["copies"].to_numpy(), queries["copies"].to_numpy()
    ex = np.array(entries["x"].to_pylist(), np.float64)
    qx = np.array(queries["x"].to_pylist(), np.float64)
    en, qn = np.linalg.norm(ex, axis=1), np.linalg.norm(qx, axis=1)
    codes = np.frombuffer(b"".join(entries["codes"].to_pylist()), np.uint8).reshape(len(ekeys), -1)
    error = entries["error"].to_numpy()
    padded = np.zeros((len(qkeys), index.width))
    padded[:, :qx.shape[1]] = qx / qn[:, None]
    parts = index.parts(padded - centre)
    tables = [_distances(parts[:, m], index.books[m]) for m in range(len(index.books))]
    rank = {k: i for i, k in enumerate(sorted({*ekeys, *qkeys}))}
    er, qr = np.array([rank[k] for k in ekeys]), np.array([rank[k] for k in qkeys])
    names = sorted(rank)
    links, parent = np.zeros(len(names), np.int64), list(range(len(names)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []
    for at in range(0, len(qkeys), 256):
        span = slice(at, at + 256)
        squared = sum(tables[m][span][:, codes[:, m]] for m in range(len(tables)))
        near = np.sqrt(squared) - error <= reach
        a, b = np.nonzero(near & (qr[span][:, None] < er))
        for lo in range(0, len(a), 1 << 16):
            i, j = a[lo:lo + (1 << 16)] + at, b[lo:lo + (1 << 16)]
            linked = np.einsum("ij,ij->i", qx[i], ex[j]) / (qn[i] * en[j]) >= similar
            i, j = i[linked], j[linked]
            np.add.at(links, qr[i], ecopies[j])
            np.add.at(links, er[j], qcopies[i])
            for u, v in zip(qr[i].tolist(), er[j].tolist()):
                ru, rv = root(u), root(v)
                if ru != rv:
                    parent[ru] = rv
                    edges.append((u, v))
    hit = np.flatnonzero(links)
    return pa.table({
        "key": pa.array([names[i] for i in hit] + [names[u] for u, _ in edges], pa.binary()),
        "other": pa.array([None] * len(hit) + [names[v] for _, v in edges], pa.binary()),
        "links": pa.array([*links[hit].tolist(), *[0] * len(edges)], pa.int64())})
