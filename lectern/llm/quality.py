"""Quality by nearest-neighbour voting in a latent-semantic space.

Labelled texts become TF-IDF vectors of hashed byte n-grams plus a few terms
for a text's shape, and a truncated SVD maps them to a few latent dimensions.
The labelled vectors (a bounded, documented number of rows) are broadcast.
Every document is mapped the same way; blocked matrix products give its exact
cosines with all labelled vectors; its nearest neighbours vote with their
labels, weighted by similarity and by how the labels occur in the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.ngrams import Counter, raw_texts, shapes
from lectern.llm.shared import map_arrow, others, quoted, schema_of, unused


@dataclass(frozen=True)
class Params:
    """``labelled_rows`` bounds the labelled vectors that are broadcast: rows x (rank + 1) x 4 bytes."""

    labelled_rows: int = 3000
    buckets: int = 2048
    order: int = 2
    rank: int = 48
    neighbours: int = 25
    #: Weight of the shape terms against the n-grams, which have length 1.
    shape_weight: float = 1.5
    #: Similarities are raised to this power.
    sharpness: float = 8.0
    block: int = 256
    seed: int = 42


SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
UPPER = np.isin(np.arange(256), np.arange(65, 91))
LOWER = np.isin(np.arange(256), np.arange(97, 123))
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>!=@_{}[]~^\\", np.uint8))
DIGITS = np.isin(np.arange(256), np.arange(48, 58))
_ODD = np.random.default_rng(7).integers(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shape(raw: np.ndarray) -> np.ndarray:
    """What a text looks like: shares of its characters, and how much of it repeats."""
    n = max(1, len(raw))
    space = SPACES[raw]
    begins = np.flatnonzero(~space & np.concatenate(([True], space[:-1]))) if len(raw) else np.empty(0, int)
    words = max(1, len(begins))
    if len(begins):
        # sums of byte codes and of neighbours tell words apart well enough to count distinct ones
        code = np.where(space, np.uint64(0), _ODD[raw])
        sums = np.add.reduceat(code * (np.uint64(3) + np.concatenate(([0], raw[:-1])).astype(np.uint64)), begins)
        distinct = len(np.unique(sums)) / words
        same_as_last = float((sums[1:] == sums[:-1]).sum()) / words
    else:
        distinct, same_as_last = 1.0, 0.0
    letters = max(1, int(UPPER[raw].sum() + LOWER[raw].sum()))
    return np.array(
        [
            min(1.0, np.log1p(len(begins)) / 10),
            distinct ** 0.5 if len(begins) < 50 else distinct,
            min(1.0, 3 * same_as_last),
            UPPER[raw].sum() / letters,
            min(1.0, 5 * SYMBOLS[raw].sum() / n),
            min(1.0, 5 * DIGITS[raw].sum() / n),
            min(1.0, len(begins) / 20),
            min(1.0, n / words / 20),
        ],
        np.float32,
    )


def vector(raw: np.ndarray, count: Counter) -> np.ndarray:
    """Log counts of the n-grams, and the shape terms behind them."""
    return np.concatenate((np.log1p(count(raw)).astype(np.float32), shape(raw)))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    centre: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    votes: np.ndarray
    prior: float
    params: Params

    def counter(self) -> Counter:
        return Counter(self.params.buckets, self.params.order, shapes(), self.params.seed)

    def latent(self, x: np.ndarray) -> np.ndarray:
        return _unit((weigh(x, self.idf, self.params) - self.centre) @ self.basis).astype(np.float32)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Weighted share of label 1 among the nearest labelled vectors."""
        k = min(self.params.neighbours, len(self.labels))
        sims = self.latent(x) @ self.vectors.T
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < len(self.labels) else np.broadcast_to(np.arange(k), (len(x), k))
        weight = np.maximum(np.take_along_axis(sims, near, 1), 1e-3) ** self.params.sharpness * self.votes[near]
        return (weight * self.labels[near]).sum(1) / weight.sum(1)


def weigh(x: np.ndarray, idf: np.ndarray, p: Params) -> np.ndarray:
    return np.concatenate((_unit(x[:, : p.buckets] * idf), p.shape_weight * x[:, p.buckets :]), axis=1)


def train(x: np.ndarray, y: np.ndarray, prior: float, p: Params) -> Model:
    """Truncated SVD of the labelled rows by subspace iteration; ``prior`` is the share of label 1."""
    idf = np.log((1 + len(x)) / (1 + (x[:, : p.buckets] > 0).sum(0))).astype(np.float32) + 1
    w = weigh(x, idf, p)
    centre = w.mean(0)
    w = w - centre
    rank = max(1, min(p.rank, len(x), w.shape[1]))
    basis = np.linalg.qr(w.T @ np.random.default_rng(p.seed).standard_normal((len(x), rank)).astype(np.float32))[0]
    for _ in range(6):
        basis = np.linalg.qr(w.T @ (w @ basis))[0]
    share = max(1e-6, min(1 - 1e-6, float(y.mean())))
    votes = np.where(y == 1, prior / share, (1 - prior) / (1 - share)) if 0 < y.mean() < 1 else np.ones(len(y))
    return Model(idf, centre, basis.astype(np.float32), _unit(w @ basis).astype(np.float32), y.astype(float), votes, prior, p)


def fit(docs: DataFrame, labels: DataFrame, params: Params | None = None, text: str = "text", label: str = "quality", doc_id: str = "doc_id") -> Model | None:
    """A model from labelled rows (label 0 or 1, others are left out); None where there are none.

    At most ``labelled_rows`` labels are used, evenly over the two, drawn by a
    hash of their id, the same in every run, so only their texts are read
    out; votes are weighed back to the labels' shares.  A repeated label
    counts once, an id of several texts with the first of them in text order,
    and a label without an id with none.
    """
    p = params or Params()
    known = labels.where(quoted(label).isin(0, 1) & quoted(doc_id).isNotNull()).select(quoted(doc_id).alias("id"), quoted(label).cast("int").alias("y"))
    sizes = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    if not sizes:
        return None
    each = p.labelled_rows // len(sizes)
    share = F.create_map(*[c for k, n in sorted(sizes.items()) for c in (F.lit(k), F.lit(min(1.0, 0.95 * each / n)))])
    place = F.pmod(F.xxhash64("id", F.lit(p.seed)), F.lit(1 << 40))
    drawn = known.withColumn("place", place).where(F.col("place") / float(1 << 40) < F.element_at(share, F.col("y")))
    drawn = drawn.distinct().orderBy("place", "id", "y").limit(p.labelled_rows).select("id", "y")
    texts = docs.select(quoted(doc_id).alias("id"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(drawn), "id").groupBy("id", "y").agg(F.min("text").alias("text")).select("y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(p.buckets, p.order, shapes(), p.seed)
        for batch in batches:
            held = [vector(raw, count).tobytes() for raw in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary())], names=["y", "x"])

    found = rows.mapInArrow(run, "y int, x binary").toArrow()
    pairs = sorted(zip(found.column("y").to_pylist(), found.column("x").to_pylist(), strict=True))
    if not pairs:
        return None
    x = np.stack([np.frombuffer(raw, np.float32) for _, raw in pairs])
    return train(x, np.array([y for y, _ in pairs]), sizes.get(1, 0) / sum(sizes.values()), p)


def score(df: DataFrame, model: Model | None, text: str = "text", least: float = 0.3) -> DataFrame:
    """df with score (0 to 1) and predicted (1 if score >= least); its text stays behind.

    A null text is scored as an empty one.  Without a model the score is 0.5.
    Repeated rows get the same; an empty table gives an empty table; columns
    named like an output are replaced.
    """
    made = {"score": "double", "predicted": "int"}
    keep = others(df, *made, text)
    base = df.select(*[quoted(c) for c in keep], quoted(text).alias(unused(df, "_text")))
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        count = m.counter() if m else None
        for batch in batches:
            out = np.full(batch.num_rows, 0.5)
            if m:
                at, x = 0, []
                for raw in raw_texts(batch.column(batch.num_columns - 1)):
                    x.append(vector(raw, count))
                    if len(x) == m.params.block:
                        out[at : at + len(x)] = m.score(np.stack(x))
                        at, x = at + len(x), []
                if x:
                    out[at:] = m.score(np.stack(x))
            out = np.clip(out, 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out), pa.array((out >= least).astype(np.int32))], names=[*keep, *made])

    return map_arrow(base, run, schema_of(df, keep, made))
