"""Language identification by error-correcting output codes.

Each language has a codeword of bits.  For each bit a binary logistic
classifier on hashed byte trigrams learns which of the two sets of languages
a text belongs to.  A text's bit scores are compared with every codeword by a
loss that weighs each bit by how reliable its classifier was on that
language; the nearest codeword wins, and a narrow win is flagged as ambiguous.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.ngrams import Counter, letters_only, raw_texts
from lectern.llm.shared import map_arrow, others, quoted, same_name, schema_of

UNKNOWN = "und"


@dataclass(frozen=True)
class Params:
    """``train_rows`` bounds the labelled rows that the classifiers are fitted on, ``languages`` the labels that are learnt: the commonest."""

    train_rows: int = 2400
    languages: int = 200
    buckets: int = 4096
    order: int = 3
    steps: int = 150
    l2: float = 1e-4
    snippet: int = 48
    #: Least lead of the best score over the second, else the text is ambiguous.
    margin: float = 0.2
    seed: int = 42


def codewords(k: int, seed: int) -> np.ndarray:
    """k rows of +1 and -1, far apart: every split of up to 7 languages, else the best of seeded draws."""
    if k < 2:
        return np.ones((k, 1))
    if k <= 7:
        rows = [[1 if not i or not (c >> (i - 1)) & 1 else -1 for c in range(1, 1 << (k - 1))] for i in range(k)]
        return np.array(rows, float)
    rng = np.random.default_rng(seed)
    length, best, found = max(31, math.ceil(10 * math.log2(k))), -1, None
    for _ in range(100):
        draw = rng.choice([-1.0, 1.0], (k, length))
        if (abs(draw.sum(0)) == k).any():
            continue
        apart = (length - draw @ draw.T) / 2 + np.eye(k) * length
        if apart.min() > best:
            best, found = apart.min(), draw
    return found


def features(counts: np.ndarray) -> np.ndarray:
    """Square roots of the shares: a text's length doesn't matter."""
    return np.sqrt(counts / np.maximum(counts.sum(-1, keepdims=True), 1)).astype(np.float32)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    params: Params

    def counter(self) -> Counter:
        return Counter(self.params.buckets, self.params.order, letters_only(), self.params.seed)

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Score of each language, adding up to 1, for rows of features."""
        z = self.code[None] * (x @ self.weights + self.bias)[:, None, :]
        loss = (self.trust[None] * np.logaddexp(0, -z)).sum(2) * self.code.shape[1]
        e = np.exp(loss.min(1, keepdims=True) - loss)
        return e / e.sum(1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], p: Params) -> Model:
    """One logistic classifier a bit, by accelerated gradient descent; its reliability by language."""
    code = codewords(len(languages), p.seed)
    target = code[y]
    share = np.bincount(y, minlength=len(languages))
    each = (1 / np.maximum(share, 1))[y][:, None] / len(languages)
    w = np.zeros((x.shape[1], code.shape[1]), np.float32)
    b = np.zeros(code.shape[1])
    last_w, last_b = w, b
    rate = 4.0 / max(1e-9, float((x * x).sum(1).mean() + 1))
    for t in range(p.steps):
        ahead = t / (t + 3)
        v, vb = w + ahead * (w - last_w), b + ahead * (b - last_b)
        z = x @ v + vb
        slope = (-target / (1 + np.exp(np.clip(target * z, -50, 50))) * each).astype(np.float32)
        last_w, last_b = w, b
        w, b = v - rate * (x.T @ slope + p.l2 * v), vb - rate * slope.sum(0)
    right = (np.sign(x @ w + b) == target).astype(float)
    trust = np.stack([(right[y == i].sum(0) + 1) / ((y == i).sum() + 2) for i in range(len(languages))])
    return Model(languages, code, w, b, trust / trust.sum(1, keepdims=True), p)


def fit(df: DataFrame, params: Params | None = None, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model | None:
    """A model from df's rows with a non-null lang; None where there are none.

    About ``train_rows`` rows, evenly over the languages, are drawn by a hash
    of id and text, so the sample is the same in every run; rows that repeat
    both count once, and null ids draw by their text.  Each gives its whole
    text and one snippet, so that short texts are known too.
    """
    p = params or Params()
    known = df.where(quoted(lang).isNotNull()).select(quoted(lang).cast("string").alias("lang"), quoted(text).alias("text"), quoted(doc_id).alias("id"))
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(p.languages).collect()}
    languages = sorted(sizes)
    if not languages:
        return None
    each = max(1, p.train_rows // len(languages))
    share = F.create_map(*[c for k in languages for c in (F.lit(k), F.lit(min(1.0, 0.95 * each / sizes[k])))])
    place = F.pmod(F.xxhash64("id", "text", F.lit(p.seed)), F.lit(1 << 40))
    drawn = known.where(F.col("text").isNotNull()).withColumn("place", place).where(F.col("place") / float(1 << 40) < F.element_at(share, F.col("lang")))
    drawn = drawn.groupBy("place", "lang").agg(F.min("text").alias("text")).orderBy("place", "lang").limit(p.train_rows)
    rows = drawn.select("lang", "text")
    snippet = p.snippet

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(p.buckets, p.order, letters_only(), p.seed)
        for batch in batches:
            names, held = [], []
            for name, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                at = (len(raw) * 2654435761 % 1000003) % max(1, len(raw) - snippet)
                for part in (raw, raw[at : at + snippet]):
                    names.append(name)
                    held.append(features(count(part)).astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(held, pa.binary())], names=["lang", "x"])

    found = rows.mapInArrow(run, "lang string, x binary").toArrow().combine_chunks()
    names, raw = np.array(found.column("lang").to_pylist()), found.column("x").cast(pa.large_binary()).combine_chunks()
    if not len(names):
        return None
    raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
    held = np.frombuffer(raw.buffers()[2], np.float16, len(names) * p.buckets).reshape(len(names), p.buckets)
    order = np.lexsort((*[held[:, j] for j in range(0, p.buckets, p.buckets // 64)], names))  # the same in whatever order rows come
    index = {k: i for i, k in enumerate(languages)}
    y = np.array([index[n] for n in names[order]], int)
    x = held[order].astype(np.float32)
    del found, raw, held
    return train(x, y, languages, p)


def _has_letter(raw: np.ndarray) -> bool:
    low = raw | 32
    if ((low >= 97) & (low <= 122)).any():
        return True
    return any(map(str.isalpha, raw.tobytes().decode("utf-8", "replace"))) if (raw >= 128).any() else False


def predict(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """df with lang_pred, score (0 to 1) and ambiguous.

    A null text, or one without a letter, is ``und`` with score 0; without a
    model (no labelled rows) every text is.  Ties go to the language first in
    text order.  Repeated rows get the same; an empty table gives an empty
    table; columns named like an output are replaced.
    """
    made = {"lang_pred": "string", "score": "double", "ambiguous": "boolean"}
    keep, same = others(df, *made), same_name(df.sparkSession)
    place = next((i for i, c in enumerate(keep) if same(c) == same(text)), len(keep))
    extra = [quoted(text).alias("_body")] if place == len(keep) else []  # a text named like an output goes along to be read
    base = df.select(*[quoted(c) for c in keep], *extra)
    held = df.sparkSession.sparkContext.broadcast(model)
    names = [*keep, *made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        count = m.counter() if m else None
        for batch in batches:
            n = batch.num_rows
            best, score, unclear = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
            todo, x = [], []

            def settle() -> None:
                s = m.decode(np.stack(x))
                for i, row in zip(todo, s, strict=True):
                    top = int(row.argmax())
                    rest = np.delete(row, top)
                    best[i], score[i] = m.languages[top], min(1.0, float(row[top]))
                    unclear[i] = len(rest) > 0 and row[top] - rest.max() < m.params.margin
                todo.clear()
                x.clear()

            for i, raw in enumerate(raw_texts(batch.column(place))):
                if m and _has_letter(raw):
                    todo.append(i)
                    x.append(features(count(raw)))
                    if len(x) == 256:
                        settle()
            if x:
                settle()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(best, pa.string()), pa.array(score), pa.array(unclear)], names=names)

    return map_arrow(base, run, schema_of(df, keep, made))
