"""Quality classifier: random Fourier features, ridge regression by summed normal equations, isotonic calibration.

Sixteen statistics of the whole text (sizes, shares of kinds of characters, repetition of words, trigrams and lines)
are standardised and mapped to ``dim`` random Fourier features, whose inner products approximate a Gaussian kernel
(Rahimi and Recht, 2007). Every partition sums its share of the normal equations of each of ``FOLDS`` folds; the sums are added
up a tree of tasks, and the driver solves one (dim + 1)-square system of all folds, for the model, and one of all others for
each fold. A histogram by label of the scores that each row gets from the system without its fold then gives an isotonic
(pool adjacent violators) map from score to the share of good rows, so no row calibrates what it has taught.

Scale: one pass over the texts; after that 16 numbers per document. All labelled rows take part, and what reaches the
driver has the size of the system and of the histogram whatever the input. Features are rounded to multiples of 2^-12,
so that the sums are exact in double precision and do not depend on their order: equal input gives equal scores.

Defined results: null text counts as empty and gets a score like any text. Labels without id or grade are not used;
of labels that repeat an id the largest counts, and documents that repeat an id all take part. Without labels every
score is 0.5. A null id is never held out. Other columns are ignored and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewave.llm.common import cut, skew_join, text_of

STATS = ("log_words", "log_bytes", "word_length", "unique_words", "same_as_last", "repeated_trigrams", "repeated_lines", "upper", "digits", "symbols", "pipes", "bangs", "marks", "other_bytes", "line_length", "longest_word")
DIM, WIDTH, RIDGE, BINS = 256, 2.0, 1e-3, 2048
#: Sums of so many partitions are added in one task.
FOLDS, FAN = 3, 32
_SYMBOLS = np.frombuffer(b"#*$%&<>", np.uint8)
_MARKS = np.frombuffer(b".,;:?'\"-()", np.uint8)


def statistics(text: str) -> list[float]:
    raw = text.encode()
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, n_bytes = raw.split(), len(raw)
    n = len(words)
    solid = max(1, n_bytes - int(count[[9, 10, 11, 12, 13, 32]].sum()))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    triples = max(1, n - 2)
    share = lambda x: float(x) / solid
    return [
        np.log1p(n),
        np.log1p(n_bytes),
        np.log1p(solid / max(1, n)),
        len(set(words)) / max(1, n),
        sum(map(bytes.__eq__, words, words[1:])) / max(1, n - 1),
        1 - len(set(zip(words, words[1:], words[2:]))) / triples if n > 2 else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        share(count[65:91].sum()),
        share(count[48:58].sum()),
        share(count[_SYMBOLS].sum()),
        share(count[124]),
        share(count[33]),
        share(count[_MARKS].sum()),
        share(count[128:].sum()),
        np.log1p(n / max(1, len(lines))),
        np.log1p(max(map(len, words), default=0)),
    ]


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the Fourier features, then the constant
    dim: int
    width: float
    steps: np.ndarray  # scores, ascending
    values: np.ndarray  # calibrated, not descending

    def fourier(self, x: np.ndarray) -> np.ndarray:
        """Features of rows of statistics, rounded so that sums of their products are exact."""
        rng = np.random.Generator(np.random.PCG64(17))
        w, b = rng.standard_normal((len(STATS), self.dim)) / self.width, rng.uniform(0, 2 * np.pi, self.dim)
        z = np.cos(np.clip((x - self.centre) / self.scale, -8, 8) @ w / np.sqrt(len(STATS)) * 2 + b)
        return np.concatenate([np.round(z * 4096) / 4096, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.steps.size:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), self.steps, self.values), 0, 1)


def isotonic(n: np.ndarray, good: np.ndarray) -> np.ndarray:
    """For cells in order, with counts and sums, the best fit that does not descend (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for c, g in zip(n.tolist(), good.tolist(), strict=True):
        blocks.append([g, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g2, c2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + g2, blocks[-1][1] + c2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), g / c) for g, c, k in blocks]) if blocks else np.empty(0)


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x) with x the statistics, written once."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column(1)], np.float64).reshape(-1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(STATS), dtype=np.int32)), pa.array(x))], names=["id", "x"])

    return cut(docs.select(F.col(id_col), text_of(text_col).alias("__text")).mapInArrow(run, f"id {kind}, x array<double>"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATS))


def fit(rows: DataFrame, dim: int = DIM, width: float = WIDTH, ridge: float = RIDGE, bins: int = BINS) -> Model:
    """Fits to rows (x, y) with y 0 or 1; equal rows are of one fold."""
    rows = cut(rows.select("x", F.col("y").cast("int").alias("y"), F.pmod(F.xxhash64("x"), F.lit(FOLDS)).cast("int").alias("fold")))
    sums = rows.select(F.count("*").alias("n"), *(F.avg(F.round(F.col("x")[i], 9).cast("decimal(20,9)")).cast("double").alias(f"m{i}") for i in range(len(STATS)))).first()
    if not sums.n:
        return Model(np.zeros(len(STATS)), np.ones(len(STATS)), np.zeros(dim + 1), dim, width, np.empty(0), np.empty(0))
    centre = np.array([sums[f"m{i}"] for i in range(len(STATS))])
    spread = rows.select(*(F.avg(F.round((F.col("x")[i] - centre[i]) ** 2, 9).cast("decimal(24,9)")).cast("double").alias(f"v{i}") for i in range(len(STATS)))).first()
    model = Model(centre, np.sqrt(np.array(spread)) + 1e-6, np.zeros(dim + 1), dim, width, np.empty(0), np.empty(0))
    side = dim + 1

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((FOLDS, side * (side + 1)))
        for b in batches:
            z, y, fold = model.fourier(_matrix(b.column(0))), b.column(1).to_numpy(), b.column(2).to_numpy()
            for k in range(FOLDS):
                own = z[fold == k]
                sums[k] += np.concatenate([(own.T @ own).ravel(), own.T @ y[fold == k]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FOLDS), pa.int64()), pa.array(list(sums), pa.list_(pa.float64()))], names=["fold", "part"])

    def added(parts: pa.Table) -> pa.Table:
        total = parts.column("part").combine_chunks().flatten().to_numpy().reshape(parts.num_rows, -1).sum(axis=0)
        return pa.table({"fold": parts.column("fold")[:1], "part": pa.array([total], pa.list_(pa.float64()))})

    parts, n = rows.mapInArrow(normal, "fold long, part array<double>"), rows.rdd.getNumPartitions()
    while n > 1:  # a level of the tree
        n = -(-n // FAN)
        parts = parts.groupBy("fold", F.pmod(F.spark_partition_id(), F.lit(n)).alias("task")).applyInArrow(added, "fold long, part array<double>")
    folds = np.zeros((FOLDS, side * (side + 1)))
    found = parts.toArrow()
    for fold, part in zip(found.column("fold").to_pylist(), found.column("part"), strict=True):
        folds[fold] += part.values.to_numpy()

    def solved(sums: np.ndarray, count: float) -> np.ndarray:
        return np.linalg.solve(sums[: side * side].reshape(side, side) + ridge * count * np.eye(side), sums[side * side :])

    whole = folds.sum(axis=0)
    model.weights = solved(whole, sums.n)
    # the last cell, the constant's square, counts rows
    without = np.stack([solved(whole - own, max(1.0, (whole - own)[side * side - 1])) for own in folds])

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, good = np.zeros(bins, np.int64), np.zeros(bins, np.int64)
        for b in batches:
            raw = (model.fourier(_matrix(b.column(0))) * without[b.column(2).to_numpy()]).sum(axis=1)
            at = np.clip(np.floor((raw + 0.5) / 2 * bins), 0, bins - 1).astype(int)
            n += np.bincount(at, minlength=bins)
            good += np.bincount(at, b.column(1).to_numpy().astype(float), bins).astype(np.int64)
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(n[has]), pa.array(good[has])], names=["bin", "n", "good"])

    h = rows.mapInArrow(histogram, "bin long, n long, good long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).toArrow().sort_by("bin")
    at, n, good = (h.column(i).to_numpy() for i in range(3))
    model.steps, model.values = (at + 0.5) / bins * 2 - 0.5, isotonic(n, good)
    return model


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id, as text, leaves 1 when divided by 3: such rows never teach."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted."""
    known = with_statistics(docs, id_col, text_col)
    taught = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").where(~held_out("id")).groupBy("id").agg(F.max("y").alias("y"))
    model = fit(skew_join(known, taught, ["id"]).select("x", "y"), **options)
    kind = known.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(b.column(1))))], names=["id", "score"])

    scored = known.mapInArrow(run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
