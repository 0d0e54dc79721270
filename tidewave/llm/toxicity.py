"""Toxicity as an ordinal severity: cumulative-link logistic regression on sparse text features.

P(grade >= k | x) = sigmoid(w.x - t_k) with one weight vector for all ordered thresholds t_1 < t_2 < t_3; the result
is the expected severity, the sum of P(grade >= k) over k. Features are the distinct lower-cased words of the whole
text and their five-letter beginnings, hashed. ``labels`` says toxic or not; grades of toxic rows are set from how many
distinct telling words (those far more frequent in toxic rows of the sample) the row has: up to 2, up to 4, more.

Scale: the model is fitted on the driver from at most ``max_train`` labelled rows (those whose ids hash lowest, so the
same ones at every run) and holds at most ``max_features`` weights; near copies in the sample count once. Scoring is one
pass over the texts without a shuffle.

Defined results: null text counts as empty; empty text has the base severity of a row without features and is never toxic. Without any
toxic label every row has severity 0. Labels without an id or a grade are not used, and of labels or documents that
repeat an id the largest label and the smallest text count in training. Other columns are ignored and may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.llm.common import cut, text_of

MAX_TRAIN, MAX_FEATURES, LEAST = 20_000, 4_096, 4
GRADES, RIDGE = (2, 4), 1e-5
_WORD = re.compile(r"[^\W\d_]+")
_MASK = (1 << 21) - 1  # the bit above it marks beginnings
_BATCH = 512


def _of_word(word: str) -> tuple[int, ...]:
    whole = zlib.crc32(word.encode()) & _MASK
    return (whole, (zlib.crc32(b"^" + word[:5].encode()) & _MASK) | (1 << 21)) if len(word) >= 5 else (whole,)


def features(text: str) -> set[int]:
    return {f for w in set(_WORD.findall(text.lower())) for f in _of_word(w)}


@dataclass
class Model:
    weights: dict[int, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = ()
    cut: float = float("inf")

    def at_least(self, found: float) -> list[float]:
        """P(grade >= k) for every k."""
        return [1 / (1 + np.exp(-min(50, max(-50, found - t)))) for t in self.thresholds]

    def score(self, text: str) -> float:
        """w.x"""
        return float(sum(self.weights[f] for f in sorted(features(text) & self.weights.keys())))


def _cut(s: np.ndarray, toxic: np.ndarray, strict: float = 4.0) -> float:
    """The w.x from which on a row counts as toxic: highest (share of toxic rows found) - strict * (share of clean rows hit), in the middle of a
    gap, and above 0: a text without any telling word is never toxic."""
    at = np.unique(s)
    mids = np.maximum(np.concatenate([(at[1:] + at[:-1]) / 2, at[-1:] + 1]), 1e-9)
    found = lambda x: 1 - np.searchsorted(np.sort(x), mids, "left") / x.size
    gain = found(s[toxic > 0]) - strict * found(s[toxic == 0])
    return float(mids[np.argmax(gain)])


def bands_of(row: np.ndarray, seed: int = 5, bands: int = 12, size: int = 10) -> np.ndarray:
    """Band keys of a feature set: near copies share one; sets of fewer than five features have none."""
    if row.size < 5:
        return np.empty(0, np.int64)
    rng = np.random.Generator(np.random.PCG64(seed))
    mult = rng.integers(0, 1 << 63, size * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(size * bands, np.iinfo(np.uint64).max)
    for i in range(0, row.size, 4096):
        least = np.minimum(least, ((row[i : i + 4096].astype(np.uint64) + np.uint64(1))[:, None] * mult).min(axis=0))
    mixed = (least.reshape(bands, size) * mult[:size]).sum(axis=1, dtype=np.uint64) * mult[:bands]
    return (mixed ^ (mixed >> np.uint64(31))).view(np.int64)


def once(keys: list[np.ndarray]) -> np.ndarray:
    """Which rows to keep so that near copies count once: the first of those that share a band."""
    seen: set[int] = set()
    keep = np.ones(len(keys), bool)
    for i, k in enumerate(keys):
        k = k.tolist()
        keep[i] = seen.isdisjoint(k)
        seen.update(k)
    return keep


def telling(cells: np.ndarray, hit1: np.ndarray, hit0: np.ndarray, n1: int, n0: int, max_features: int = MAX_FEATURES) -> np.ndarray:
    """Of features with these numbers of toxic and clean rows, those far more frequent in toxic ones, most certain first."""
    odds = np.log((hit1 + 0.5) / (n1 - hit1 + 0.5)) - np.log((hit0 + 0.5) / (n0 - hit0 + 0.5))
    z = odds / np.sqrt(1 / (hit1 + 0.5) + 1 / (n1 - hit1 + 0.5) + 1 / (hit0 + 0.5) + 1 / (n0 - hit0 + 0.5))
    good = np.flatnonzero((z >= 3.5) & (hit1 >= LEAST) & (hit1 >= 4 * hit0 * n1 / n0))
    return cells[good[np.lexsort((cells[good], -z[good]))][:max_features]]


def fit_rows(rows: list[np.ndarray], toxic: np.ndarray, chosen: np.ndarray, steps: int = 1500) -> Model:
    """Fits the model to rows of chosen features and 0/1 labels."""
    if not chosen.size:
        return Model()
    place = {int(c): i for i, c in enumerate(chosen)}
    col = np.array([place[int(f)] for r in rows for f in r], np.int64)
    own = np.repeat(np.arange(len(rows)), [r.size for r in rows])
    words = np.bincount(own[chosen[col] <= _MASK], minlength=len(rows))
    grade = np.where(toxic > 0, 1 + sum((words > g).astype(int) for g in GRADES), 0)
    top = int(grade.max())

    # Full-batch Adam on w and on thresholds written as a first one and positive steps, so that they stay in order.
    w, t = np.zeros(chosen.size), np.concatenate([[1.0], np.zeros(top - 1)])
    m = [np.zeros_like(w), np.zeros_like(t)]
    v = [np.zeros_like(w), np.zeros_like(t)]
    for step in range(1, steps + 1):
        _, grads = loss(w, t, own, col, grade)
        for i, (x, g) in enumerate(zip((w, t), grads, strict=True)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            x -= 0.1 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    s = np.bincount(own, w[col], len(rows))
    return Model({int(c): float(x) for c, x in zip(chosen, w, strict=True)}, tuple(ordered(t).tolist()), _cut(s, toxic))


def ordered(t: np.ndarray) -> np.ndarray:
    """Thresholds from a first one and the logarithms of the steps between them."""
    return np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))


def loss(w: np.ndarray, t: np.ndarray, own: np.ndarray, col: np.ndarray, grade: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The mean negative log-likelihood of the grades, with a little ridge on w, and its gradients by w and t; row ``own[i]`` has feature ``col[i]``."""
    n, at, top = grade.size, np.arange(grade.size), t.size
    s = np.bincount(own, w[col], n)
    q = 1 / (1 + np.exp(-np.clip(s[:, None] - ordered(t), -50, 50)))  # P(grade >= k)
    wide = np.concatenate([np.ones((n, 1)), q, np.zeros((n, 1))], axis=1)
    p = np.maximum(wide[at, grade] - wide[at, grade + 1], 1e-12)
    slope = q * (1 - q)
    own_slope = np.where(np.arange(1, top + 1) == grade[:, None], slope, 0.0)
    next_slope = np.where(np.arange(1, top + 1) == grade[:, None] + 1, slope, 0.0)
    by_k = (own_slope - next_slope) / p[:, None]  # derivative of the log-likelihood by (s - t_k)
    g_theta = -by_k.sum(axis=0)
    g_t = np.cumsum(g_theta[::-1])[::-1] * np.concatenate([[1.0], np.exp(t[1:])])
    value = -np.log(p).mean() + 0.5 * RIDGE * float(w @ w)
    return value, [-np.bincount(col, by_k.sum(axis=1)[own], w.size) / n + RIDGE * w, -g_t / n]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES) -> Model:
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_train)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).join(F.broadcast(known), "id").groupBy("id", "y").agg(F.min("text").alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.array(sorted(features(t.as_py())), np.int32) for t in b.column(2)]
            lists = [pa.array(x, pa.list_(t)) for x, t in ((found, pa.int32()), ([bands_of(f) for f in found], pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], names=["id", "y", "f", "bands"])

    # The sample's features stay on the executors; the driver sees band keys, then counts, then chosen features.
    sample = cut(rows.select("id", "y", "text").mapInArrow(hashed, "id long, y int, f array<int>, bands array<long>"))
    found = sample.select("id", "y", "bands").toArrow().sort_by("id")
    keep = once([x.values.to_numpy(zero_copy_only=False) for x in found.column("bands")])
    ids, toxic = found.column("id").to_numpy()[keep], found.column("y").to_numpy()[keep] > 0
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    if not n1 or not n0:
        return Model()
    kept = sample.join(F.broadcast(docs.sparkSession.createDataFrame(pd.DataFrame({"id": ids}))), "id").select("id", "y", "f")  # max_train ids at most
    counts = kept.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("t"), F.count("*").alias("c")).where(F.col("t") >= LEAST).toArrow().sort_by("f")
    cells, hit1, both = (counts.column(i).to_numpy() for i in range(3))
    chosen = telling(cells, hit1.astype(float), (both - hit1).astype(float), n1, n0, max_features)
    held = frozenset(chosen.tolist())

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = pa.array([[f for f in x.as_py() if f in held] for x in b.column(2)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["id", "y", "f"])

    got = kept.mapInArrow(pick, "id long, y int, f array<int>").toArrow().sort_by("id")
    return fit_rows([x.values.to_numpy(zero_copy_only=False) for x in got.column("f")], got.column("y").to_numpy().astype(float), chosen)


def severity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, severity (expected grade), grade (0 below the fitted cut, else how many P(grade >= k) reach 0.5, at least 1), toxic (grade >= 1)."""
    weights = model.weights
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for b in batches:
            severity, grade = [], []
            for t in b.column(1):
                found, words, once = 0.0, set(_WORD.findall(t.as_py().lower())), set()
                for w in words:
                    if (x := known.get(w)) is None:
                        if len(known) > 200_000:
                            known.clear()
                        x = known[w] = any(f in weights for f in _of_word(w))
                    if x:
                        once.update(f for f in _of_word(w) if f in weights)
                for f in sorted(once):
                    found += weights[f]
                p = model.at_least(found)
                severity.append(float(sum(p)))
                grade.append(max(1, sum(x >= 0.5 for x in p)) if found >= model.cut else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(severity, pa.float64()), pa.array(grade, pa.int32())], names=[id_col, "severity", "grade"])

    scored = docs.select(F.col(id_col), text_of(text_col).alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, severity double, grade int")
    return scored.withColumn("toxic", F.col("grade") >= 1)


def drop_toxic(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text the model calls toxic, all columns as they were; one pass, no join."""

    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) < model.cut for t in text], dtype=bool)

    return docs.where(clean(text_of(text_col)))
