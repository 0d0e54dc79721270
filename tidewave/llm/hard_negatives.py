"""Hard negatives by exact inner products: a residue-number-system GEMM, then selection in score windows.

Components are integers, so scores are exact. Matrices are reduced modulo several small primes to symmetric residues and
multiplied in float32, as many components at a time as keep every sum below 2^24, where float32 is exact; the scores
come back from their residues by Chinese remaindering in mixed radix, signed. ``primes_for`` takes as many primes as the
largest possible score asks for, so nothing rounds or wraps.

An anchor's positives are its best ``positives`` other rows of the same label; for each, the negatives are the best
``negatives`` rows of other labels with a score between ``low`` and ``high`` percent of the positive's. Higher scores come
first, ties by smaller id.

Scale: rows and anchors are dealt to blocks of about ``ROWS`` and ``ANCHORS``, and each pair of blocks is one group: a
stated set of anchors against all rows, in blocks, twice (the windows need the positives first). Within a group scores
are made a strip at a time, and only each anchor's best few leave it. So memory is bounded by a block pair whatever labels
or copies are frequent, and what is shuffled is a row per anchor block and an anchor per row block. Blocks go by
row numbers of a written table, not by id or label. The driver sees one row: counts, the longest vector, the largest component.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part, nor do rows
without an id, which nothing could name. A shorter vector counts as ended by zeros. Rows that share an id are rows of
their own, each of them an anchor or partner; an anchor is no partner of its own row only. Scores beyond 64 bits are an error.
Other columns are ignored and may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.llm.common import cut

#: Primes below 2^8, the largest first. Their product is far beyond 2^64.
PRIMES = (251, 241, 239, 233, 229, 227, 223, 211, 199, 197)
EXACT = 1 << 24
ROWS, ANCHORS, STRIP = 1 << 14, 1 << 14, 1 << 20


def primes_for(bound: int) -> tuple[int, ...]:
    """So many primes that every number from -bound to bound has residues of its own."""
    if bound >= 1 << 63:
        raise ValueError(f"scores may reach {bound}, more than 64 bits")
    for n in range(1, len(PRIMES) + 1):
        if math.prod(PRIMES[:n]) > 2 * bound:
            return PRIMES[:n]
    raise AssertionError


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p as float32, from -(p - 1) / 2 to (p - 1) / 2."""
    r = x % p
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def residue_product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p (int32, from 0 to p - 1) of float32 residues, summed over few enough components to be exact."""
    step = max(1, (EXACT - 1) // max(1, p // 2) ** 2)
    total = np.zeros((len(a), len(b)), np.int32)
    for k in range(0, a.shape[1], step):
        total += (a[:, k : k + step] @ b[:, k : k + step].T).astype(np.int32) % p
    return total % p if a.shape[1] > step else total


def recombine(parts: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """The signed numbers with these residues. Their digits in mixed radix are taken symmetric to zero, so the sign needs no
    care; they are summed modulo 2^64, which a result of 64 bits survives."""
    digits: list[np.ndarray] = []
    value, weight = np.zeros(parts[0].shape, np.uint64), 1
    for p, r in zip(primes, parts, strict=True):
        rest, radix = r, 1
        for d, q in zip(digits, primes, strict=False):
            rest, radix = rest - d * np.int32(radix), radix * q % p
        d = rest * np.int32(pow(radix, -1, p)) % np.int32(p)
        d = np.where(d > p // 2, d - np.int32(p), d)
        digits.append(d)
        value += d.astype(np.int64).view(np.uint64) * np.uint64(weight % (1 << 64))
        weight *= p
    return value.view(np.int64)


def exact_scores(a: np.ndarray, b: np.ndarray, primes: tuple[int, ...]) -> np.ndarray:
    """a @ b.T of integer matrices."""
    return recombine([residue_product(residues(a, p), residues(b, p), p) for p in primes], primes)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(row.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
    return out


def _best(scores: np.ndarray, allowed: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, column) of each row's first, second, ... allowed score; of equal ones the first column's."""
    least = np.iinfo(np.int64).min
    left, rows = np.where(allowed, scores, least), np.arange(len(scores))
    for _ in range(min(n, scores.shape[1])):
        at = left.argmax(axis=1)
        have = allowed[rows, at]
        allowed[rows, at], left[rows, at] = False, least
        yield rows[have], at[have]


def _sorted(block: pa.Table) -> pa.Table:
    return block.sort_by([("id", "ascending"), ("row", "ascending")]).combine_chunks()


def _positives(width: int, primes: tuple[int, ...], n: int):
    """Of a block pair: each anchor's best rows of its label."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        anchors, rows = _sorted(anchors), _sorted(rows)
        out: list[list[np.ndarray]] = [[], [], []]
        a_label, r_label = (t.column("label").to_numpy() for t in (anchors, rows))
        a_row, r_row, r_id = anchors.column("row").to_numpy(), rows.column("row").to_numpy(), rows.column("id").to_numpy()
        a, r = (_matrix(t.column("x").combine_chunks(), width) for t in (anchors, rows))
        for label in np.unique(a_label):
            own, there = np.flatnonzero(a_label == label), np.flatnonzero(r_label == label)
            size = max(1, STRIP // max(1, there.size))
            for k in range(0, own.size if there.size else 0, size):
                strip = own[k : k + size]
                scores = exact_scores(a[strip], r[there], primes)
                for i, j in _best(scores, a_row[strip][:, None] != r_row[there][None, :], n):
                    for o, v in zip(out, (a_row[strip[i]], r_id[there[j]], scores[i, j]), strict=True):
                        o.append(v)
        return _table(out, ["anchor", "positive_id", "positive_score"])

    return run, "anchor long, positive_id long, positive_score long"


def _negatives(width: int, primes: tuple[int, ...], n: int):
    """Of a block pair: the best rows of other labels in the window of each of an anchor's positives."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        anchors, rows = _sorted(anchors), _sorted(rows)
        out: list[list[np.ndarray]] = [[], [], [], []]
        a_label, r_label = (t.column("label").to_numpy() for t in (anchors, rows))
        a_row, r_id = anchors.column("row").to_numpy(), rows.column("id").to_numpy()
        a, r = (_matrix(t.column("x").combine_chunks(), width) for t in (anchors, rows))
        lists = anchors.column("bounds").combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        flat, first = lists.flatten(), np.cumsum(sizes) - sizes
        least, most = flat.field("least").to_numpy(), flat.field("most").to_numpy()
        size = max(1, STRIP // max(1, rows.num_rows))
        for k in range(0, anchors.num_rows, size):
            strip = np.arange(k, min(k + size, anchors.num_rows))
            scores = exact_scores(a[strip], r, primes)
            other = a_label[strip][:, None] != r_label[None, :]
            for at in range(int(sizes[strip].max(initial=0))):
                has = np.flatnonzero(sizes[strip] > at)
                bound = first[strip[has]] + at
                own = scores[has]
                inside = other[has] & (own >= least[bound][:, None]) & (own <= most[bound][:, None])
                some = np.flatnonzero(inside.any(axis=1))
                for i, j in _best(own[some], inside[some], n):
                    one = has[some[i]]
                    for o, v in zip(out, (a_row[strip[one]], np.full(i.size, at + 1), r_id[j], scores[one, j]), strict=True):
                        o.append(v)
        return _table(out, ["anchor", "place", "negative_id", "negative_score"])

    return run, "anchor long, place long, negative_id long, negative_score long"


def _table(parts: list[list[np.ndarray]], names: list[str]) -> pa.Table:
    return pa.table({n: pa.array(np.concatenate(p) if p else np.empty(0, np.int64), pa.int64()) for n, p in zip(names, parts, strict=True)})


def integer_rows(vectors: DataFrame, anchor: Column, label: Column, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, label, x, anchor): floor(scale * component) of the rows that take part."""
    whole = F.col(vector_col).cast("array<double>")
    finite = F.forall(whole, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    # components beyond 2^62 stand for ones whose scores 64 bits can't hold, which is then an error
    x = F.transform(whole, lambda v: F.least(F.lit(2.0**62), F.greatest(F.lit(-(2.0**62)), v * scale)))
    x = F.transform(x, lambda v: F.floor(v))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.when(finite, x).alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    return rows.where("id is not null and label is not null and x is not null")


def _blocks(n: int, size: int, at_least: int) -> int:
    return max(1, -(-n // size), min(at_least, n // 1024))


def _first(df: DataFrame, keys: list[str], score: str, partner: str, rank: str, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(score), partner)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(vectors: DataFrame, anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, rows: int = ROWS, anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row for which ``anchor`` holds and
    each of its positives the first negatives in the window."""
    if not 0 <= low <= high:
        raise ValueError(f"a window from {low} to {high} percent")
    spark = vectors.sparkSession
    taken = cut(integer_rows(vectors, anchor, label, id_col, vector_col, scale)).withColumn("row", F.monotonically_increasing_id())
    largest = F.array_max(F.transform("x", lambda v: F.abs(v)))
    n, n_anchors, width, most = taken.agg(F.count("*"), F.coalesce(F.sum(F.col("anchor").cast("long")), F.lit(0)), F.max(F.size("x")), F.max(largest)).first()
    if not n_anchors:
        return spark.createDataFrame([], RESULT)
    primes = primes_for(width * (most or 0) ** 2)
    tasks = spark.sparkContext.defaultParallelism
    n_rows, n_sets = _blocks(n, rows, tasks), _blocks(n_anchors, anchors, 1)
    block = lambda of: F.pmod(F.xxhash64("row"), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))

    # every block of rows once for each set of anchors, and the other way round
    dealt = taken.select("id", "label", "x", "row", block(n_rows).alias("block"), every(n_sets).alias("set"))
    asked = taken.where("anchor").select("id", "label", "x", "row", block(n_sets).alias("set"))

    def pairs(asking: DataFrame, job: tuple) -> DataFrame:
        asking = asking.select(*(F.col(c).alias(c) for c in asking.columns), every(n_rows).alias("block"))  # columns of its own: both come from one table
        return asking.groupBy("set", "block").cogroup(dealt.groupBy("set", "block")).applyInArrow(*job)

    found = pairs(asked, _positives(width, primes, positives))
    found = _first(found, ["anchor"], "positive_score", "positive_id", "place", positives)
    found = cut(found.withColumn("place", F.col("place").cast("long")))
    rest, hundreds = F.expr("pmod(positive_score, 100L)"), F.expr("(positive_score - pmod(positive_score, 100L)) div 100L")
    least = low * hundreds + F.floor((low * rest + 99) / 100)
    most = high * hundreds + F.floor(high * rest / 100)
    bounds = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", least.alias("least"), most.alias("most")))).alias("bounds"))
    others = pairs(asked.join(bounds.withColumnRenamed("anchor", "row"), "row"), _negatives(width, primes, negatives))
    others = _first(others, ["anchor", "place"], "negative_score", "negative_id", "rank", negatives)
    named = found.join(asked.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return others.join(named, ["anchor", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
