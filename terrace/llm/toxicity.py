"""Toxicity by weak supervision.

1. Labelled rows outside the held-out fold, ``TRAIN_DOCS`` of them at most, give the voters: the words and word beginnings
   that best tell the classes apart (a lexicon), and text patterns. One more voter is the annotator.
2. A generative label model estimates, by expectation-maximisation, how each voter votes under either
   class and how votes correlate beyond the class (a shared covariance). Correlated voters thus share their weight.
3. A linear classifier over words and word beginnings is trained on the posterior labels and scores every
   text in whole, row by row.

Only the training sample is bounded; the scan over documents, and scoring, cover all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import staged, text_of

#: Documented bounds: labelled documents to learn from, features of the classifier, lexicon voters.
TRAIN_DOCS, FEATURES, VOTERS = 12_000, 12_000, 60
FOLDS, BEGINNING, LEAST_DOCS = 5, 4, 4
#: Standard errors by which a feature must tell the classes apart.
LEAST_Z = 3.5
#: Votes where nothing is labelled.
LEXICON = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown")
_WORD = re.compile(r"[^\W\d_]+")
_PATTERNS = (re.compile(r"!!"), re.compile(r"\b[A-Z]{4,}\b"), re.compile(r"(?i)\byou (are|re)\b"), re.compile(r"[#@$%&*!]{3,}"))


def features_of(text: str) -> set[str]:
    """Distinct lower-case words, their beginnings (marked with *), and the patterns that occur (marked with !)."""
    words = set(_WORD.findall(text.lower()))
    out = words | {w[:BEGINNING] + "*" for w in words if len(w) > BEGINNING}
    out.update(f"!{i}" for i, p in enumerate(_PATTERNS) if p.search(text))
    return out


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float]
    #: Of the label model, for inspection: voter -> share of votes in class 0 and 1.
    voters: dict[str, tuple[float, float]]

    def score(self, text: str) -> float:
        get = self.weights.get
        return _sigmoid(self.bias + sum([get(x, 0.0) for x in features_of(text)]))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def held_out(ids):
    """Rows whose labels are never learned from; those without an id are."""
    return F.coalesce(F.crc32(ids.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", toxic: str = "toxic",
        most: int = TRAIN_DOCS) -> Model:
    """Learn from the rows of ``labels`` outside the held-out fold.

    Null ids and labels teach nothing; of several labels of a document the highest counts, of repeated
    documents one. Without any labelled row the built-in lexicon gives the weights.
    """
    chosen = (labels.select(labels[doc_id].alias("_id"), labels[toxic].alias("_y")).dropna()
              .filter(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_y").cast("double").alias("_y"))
              .orderBy(F.xxhash64("_id"), "_id").limit(most))
    sample = docs.select(docs[doc_id].alias("_id"), text_of(docs, text).alias("_text"))
    # At most ``most`` rows of two numbers are broadcast.
    sample = sample.join(F.broadcast(chosen), "_id").groupBy("_id").agg(
        F.first("_y").alias("_y"), F.min("_text").alias("_text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield pa.record_batch([part.column(0), part.column(1), pa.array([sorted(features_of(t)) for t in part.column(2).to_pylist()], pa.list_(pa.string()))],
                                      names=["_id", "_y", "_features"])

    rows = staged(sample.mapInArrow(extract, f"_id {docs.schema[doc_id].dataType.simpleString()}, _y double, _features array<string>"))
    total = rows.agg(F.count("*").alias("n"), F.sum("_y").alias("pos")).first()
    n, pos = total.n, total.pos or 0.0
    if not n or not 0 < pos < n:
        weights = {w: 5.0 for w in LEXICON} if not n else {}
        return Model(-3.0 if pos < n or not n else 3.0, weights, {})
    in1, in0 = F.sum("_y"), F.sum(1 - F.col("_y"))
    ratio = F.log((F.col("n1") + 0.5) / (pos + 1)) - F.log((F.col("n0") + 0.5) / (n - pos + 1))
    best = (rows.select("_y", F.explode("_features").alias("f")).groupBy("f").agg(in1.alias("n1"), in0.alias("n0"))
            .filter(F.col("n1") + F.col("n0") >= LEAST_DOCS).withColumn("ratio", ratio)
            .withColumn("z", F.col("ratio") / F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5)))
            .filter(F.abs("z") >= LEAST_Z).orderBy(F.desc(F.abs("z")), "f").limit(FEATURES).collect())
    if not best:
        return Model(float(np.log(pos / (n - pos))), {}, {})
    vocabulary = {r.f: i for i, r in enumerate(best)}
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for batch in batches:
            found = [sorted(i for i in map(get, fs) if i is not None) for fs in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.int32())), batch.column(2)], names=["_y", "f", "_id"])

    # The bounded sample, as numbers.
    got = rows.select("_y", "_features", "_id").mapInArrow(index, f"_y double, f array<int>, _id {docs.schema[doc_id].dataType.simpleString()}").orderBy("_id").toArrow()
    y = got["_y"].to_numpy()
    found = got["f"].combine_chunks()
    sizes = np.diff(found.offsets.to_numpy())
    columns = found.values.to_numpy()
    rows_of = np.repeat(np.arange(len(y)), sizes)
    voters = [i for i, r in enumerate(best) if r.ratio > 1.5 and not r.f.startswith("!")][:VOTERS] + [i for i, r in enumerate(best) if r.f.startswith("!")]
    posterior, shares = _label_model(y, rows_of, columns, voters, len(best))
    weights, bias = _linear(posterior, rows_of, columns, len(best))
    return Model(bias, {r.f: float(weights[i]) for i, r in enumerate(best)}, {best[v].f: s for v, s in zip(voters, shares)})


def _label_model(y, rows_of, columns, voters, n_features, rounds: int = 25, shrink: float = 0.02):
    """Posterior probability of class 1 by document, and each voter's share of votes by class."""
    place = np.full(n_features, -1)
    place[voters] = np.arange(len(voters))
    votes = np.zeros((len(y), len(voters) + 2))
    at = place[columns]
    votes[rows_of[at >= 0], at[at >= 0]] = 1
    votes[:, -2] = votes[:, :-2].sum(1) == 0  # a voter for class 0: no other one has spoken
    votes[:, -1] = y  # the annotator
    r = 0.9 * y + 0.05
    for _ in range(rounds):
        p = r.mean()
        means = np.stack([((1 - r) @ votes) / max(1e-9, (1 - r).sum()), (r @ votes) / max(1e-9, r.sum())])
        d0, d1 = votes - means[0], votes - means[1]
        spread = (d0.T @ (d0 * (1 - r)[:, None]) + d1.T @ (d1 * r[:, None])) / len(y) + shrink * np.eye(votes.shape[1])
        w = np.linalg.solve(spread, means[1] - means[0])
        new = _sigmoid((votes - means.mean(0)) @ w + np.log(p / (1 - p)))
        if np.abs(new - r).max() < 1e-6:
            break
        r = np.clip(new, 1e-6, 1 - 1e-6)
    return r, list(zip(means[0].tolist(), means[1].tolist()))


def _linear(target, rows_of, columns, n_features, rounds: int = 200, decay: float = 1e-4, rate: float = 0.3):
    """Logistic regression on soft targets over present features, by full gradients with adaptive steps."""
    w, b, n = np.zeros(n_features), float(np.log(target.mean() / (1 - target.mean()))), len(target)
    seen, seen_b = np.full(n_features, 1e-8), 1e-8
    for _ in range(rounds):
        off = _sigmoid(np.bincount(rows_of, w[columns], n) + b) - target
        g = np.bincount(columns, off[rows_of], n_features) / n + decay * w
        seen += g * g
        w -= rate * g / np.sqrt(seen)
        seen_b += off.mean() ** 2
        b -= rate * off.mean() / np.sqrt(seen_b)
    return w, float(b)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Null and empty texts get the score of a text without any feature. Columns of these names are replaced.
    Repeated rows get equal scores; an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            values = np.array([own.score(t) for t in batch.column(batch.num_columns - 1).to_pylist()], "float64")
            yield pa.record_batch([*batch.columns[:-1], pa.array(values), pa.array((values >= 0.5).astype("int32"))],
                                  names=[*batch.schema.names[:-1], "score", "predicted"])

    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "score double, predicted int"])
    return docs.select(*(docs[c] for c in kept), text_of(docs, text).alias("_text")).mapInArrow(run, schema)
