"""Signals of any length: samples are numbered and worked on in blocks, so that no task holds a whole signal.

``numbered`` gives what ``signal.indexed`` gives, by a sort over all tasks: samples are dealt by ranges of (key, order), numbered
within a task, and the tasks' counts are added up. ``spread`` puts every sample into its block and, as halo, into those
neighbours whose windows reach it; a window over (key, block) then needs nothing beyond its block. Recurrences go
through blocks twice: each block is filtered from rest, the states at the blocks' ends give, by an affine prefix scan, the
state that each block starts from, and what that state rings out to is added.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.functions import kernels, sections
from tidewave.operators.signal import checked, names
from tidewave.sources.written import written

#: Samples in a block, where the caller asks for blocks without a size.
BLOCK = 1 << 16
#: So many blocks' states are scanned in one task; the totals of such groups are scanned in the same way.
FAN = 1 << 12


def numbered(df: DataFrame, key: str, order: str | Sequence[str], values: dict[str, Column | str]) -> DataFrame:
    """(key, n, nn, values...) as ``signal.indexed``, with no signal in one task. Null values and tied orders are errors."""
    at = F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(names(order)))).alias("at")
    rows = df.select(F.col(key).alias("k"), at, *(checked(v, k) for k, v in values.items()))
    # equal (k, at) go to one range, so a tie is seen within it
    rows = written(rows.repartitionByRange("k", "at").withColumn("part", F.spark_partition_id()))
    sizes = rows.groupBy("k", "part").agg(F.count("*").alias("c"))
    whole = Window.partitionBy("k")
    ahead = F.sum("c").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("c")
    sizes = sizes.select("k", "part", ahead.alias("ahead"), F.sum("c").over(whole).alias("nn"))
    w = Window.partitionBy("k", "part").orderBy("at")
    tied = F.col("at").eqNullSafe(F.lag("at").over(w))
    n = F.when(tied, F.raise_error(F.lit("tied order")).cast("long")).otherwise(F.row_number().over(w) - 1)
    rows = rows.withColumn("own", n).join(sizes.withColumnRenamed("k", "__k").withColumnRenamed("part", "__part"), F.col("k").eqNullSafe(F.col("__k")) & (F.col("part") == F.col("__part")))
    return rows.select(F.col("k").alias(key), (F.col("ahead") + F.col("own")).alias("n"), "nn", *values)


def spread(rows: DataFrame, at: str, block: int, before: int, after: int) -> DataFrame:
    """``rows`` with ``block``: that of their place ``at``, and each whose windows (``before`` samples back, ``after`` on) reach them."""
    of = lambda x: F.floor(x / block).cast("long")
    return rows.withColumn("block", F.explode(F.sequence(of(F.col(at) - after), of(F.col(at) + before))))


def own(at: str, block: int) -> Column:
    """Whether a row of ``spread`` is one of its block's, not of the halo."""
    return F.floor(F.col(at) / block) == F.col("block")


def odd_edges(rows: DataFrame, key: str, pad: int) -> DataFrame:
    """(key, nn, at, v): the samples, and up to ``pad`` more at each end, turned about the first and the last one."""
    n, last = F.col("n"), F.col("nn") - 1
    edges = rows.where((n <= pad) | (n >= last - pad)).groupBy(key)  # so few rows of each signal
    edges = edges.agg(F.max("nn").alias("nn"), F.max(F.when(n == 0, F.col("v"))).alias("a"), F.max(F.when(n == last, F.col("v"))).alias("b"), F.collect_list(F.struct("n", "v")).alias("e"))
    edges = edges.select(key, "nn", "a", "b", F.inline("e"))
    left = edges.where((n >= 1) & (n <= pad)).select(key, "nn", (-n).alias("at"), (2 * F.col("a") - F.col("v")).alias("v"))
    right = edges.where((n < last) & (n >= last - pad)).select(key, "nn", (2 * last - n).alias("at"), (2 * F.col("b") - F.col("v")).alias("v"))
    return rows.select(key, "nn", F.col("n").alias("at"), "v").unionAll(left).unionAll(right)


def gathered_blocks(rows: DataFrame, key: str, at: str, value: str, *keep: str) -> DataFrame:
    """(k, block, keep..., x): the values of each block in order of ``at``, by the column ``block`` of ``rows``."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(at).alias("i"), F.col(value).alias("x"))))["x"]
    return rows.groupBy(F.col(key).alias("k"), F.col("block")).agg(*(F.max(c).alias(c) for c in keep), listed.alias("x"))


def _each(fn, names: list[str], given: int):
    """Row by row: ``fn`` gets the array columns after the first ``given``, which pass through, as float arrays or None, and gives arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                out: list[list[np.ndarray]] = []
                for i in range(batch.num_rows):
                    scalars = [batch.column(j)[i].as_py() for j in range(1, given)]
                    arrays = [c[i].values.to_numpy(zero_copy_only=False) if c[i].is_valid else None for c in batch.columns[given:]]
                    out.append(fn(*scalars, *arrays))
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, col)]).astype(np.int32)), pa.array(np.concatenate(col))) for col in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:given], *lists], names=names)

    return run


def _states(ends: DataFrame, kind: str, matrix: np.ndarray, count: int, fan: int) -> DataFrame:
    """(k, o, e): the state before block ``o`` of blocks 0, 1, ... that each map a state s to matrix @ s + z; at rest before block 0.

    ``ends`` is (k, o, z). ``count`` bounds the blocks of a signal: above ``fan``, groups of ``fan`` are composed first.
    """
    size = len(matrix)
    schema = f"k {kind}, g long, o array<long>, e array<double>"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From each group's first state (none: rest) to the states before its blocks, one after the other, and behind the last."""
        for batch in batches:
            found = []
            for z, first in zip(batch.column(3), batch.column(4), strict=True):
                z = z.values.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                s = first.values.to_numpy(zero_copy_only=False) if first.is_valid else np.zeros(size)
                states = np.empty((len(z) + 1, size))
                for i, row in enumerate(z):
                    states[i], s = s, matrix @ s + row
                states[-1] = s
                found.append(states.ravel())
            ends = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found)))], names=["k", "g", "o", "e"])

    groups = ends.groupBy("k", F.floor(F.col("o") / fan).cast("long").alias("g")).agg(F.sort_array(F.collect_list(F.struct("o", "z"))).alias("r"))
    groups = groups.select("k", "g", F.col("r.o").alias("o"), F.col("r.z").alias("z"))
    at_rest = F.lit(None).cast("array<double>").alias("first")
    if count > fan:
        totals = groups.select("*", at_rest).mapInArrow(walk, schema)  # the last group may be short: nothing comes after it
        totals = totals.select("k", F.col("g").alias("o"), F.slice("e", F.size("o") * size + 1, size).alias("z"))
        power = np.linalg.matrix_power(matrix, fan)
        above = _states(totals, kind, power, -(-count // fan), fan).select(F.col("k").alias("__k"), F.col("o").alias("__g"), F.col("e").alias("first"))
        groups = groups.join(above, F.col("k").eqNullSafe(F.col("__k")) & (F.col("g") == F.col("__g")), "left").select("k", "g", "o", "z", "first")
    else:
        groups = groups.select("*", at_rest)
    states = groups.mapInArrow(walk, schema)
    return states.select("k", F.posexplode("o").alias("i", "o"), "e").select("k", "o", F.slice("e", F.col("i") * size + 1, size).alias("e"))


def sections_pass(blocks: DataFrame, sos: np.ndarray, block: int, count: int, steady: bool, reverse: bool, fan: int = FAN) -> DataFrame:
    """(k, block, m, x) filtered by the sections, ``x`` the samples of a block and ``m`` all samples of its signal; backward
    if ``reverse``. A signal starts at rest, or (``steady``) as if it had had its first value for ever."""
    kind = blocks.schema["k"].dataType.simpleString()
    unit = kernels.sections_state(sos).ravel()
    size = unit.size

    def from_rest(m: int, b: int, x: np.ndarray) -> list[np.ndarray]:
        x = x[::-1] if reverse else x
        o = -(-m // block) - 1 - b if reverse else b
        y, end = sections.run(sos, x, unit * x[0] if steady and o == 0 else np.zeros(size))
        return [y, end]

    done = blocks.select("k", "m", "block", "x").mapInArrow(_each(from_rest, ["k", "m", "block", "y", "z"], 3), f"k {kind}, m long, block long, y array<double>, z array<double>")
    order = F.ceil(F.col("m") / block) - 1 - F.col("block") if reverse else F.col("block")
    done = written(done.withColumn("o", order.cast("long")))
    states = _states(done.select("k", "o", "z"), kind, np.linalg.matrix_power(sections.transition(sos), block), count, fan)
    rings = sections.ringing(sos, block)

    def rung(m: int, b: int, y: np.ndarray, entry: np.ndarray | None) -> list[np.ndarray]:
        y = y if entry is None else y + rings[: y.size] @ entry
        return [y[::-1] if reverse else y]

    entries = states.select(F.col("k").alias("__k"), F.col("o").alias("__o"), "e")
    met = done.join(entries, F.col("k").eqNullSafe(F.col("__k")) & (F.col("o") == F.col("__o")), "left")
    entry = F.when(F.col("o") > 0, F.col("e"))  # a first block has begun with its own state
    return met.select("k", "m", "block", "y", entry.alias("e")).mapInArrow(_each(rung, ["k", "m", "block", "x"], 3), f"k {kind}, m long, block long, x array<double>")


def sections_filter(df: DataFrame, key: str, order, value, sos: np.ndarray, zero_phase: bool, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(key, n, v): cascaded sections over blocks of ``block`` samples; causal from rest, or forward and backward over the oddly extended signal."""
    sos = np.asarray(sos, float)
    rows = numbered(df, key, order, {"v": value})
    pad = 3 * (2 * len(sos) + 1) if zero_phase else 0
    reach = F.least(F.lit(pad), F.col("nn") - 1)
    rows = odd_edges(rows, key, pad) if pad else rows.select(key, "nn", F.col("n").alias("at"), "v")
    i = F.col("at") + reach
    rows = rows.select(key, (F.col("nn") + 2 * reach).alias("m"), reach.alias("reach"), i.alias("i"), F.floor(i / block).cast("long").alias("block"), "v")
    whole = gathered_blocks(rows, key, "i", "v", "m")
    longest = written(whole)
    count = -(-(longest.agg(F.max("m")).first()[0] or 0) // block)
    out = sections_pass(longest, sos, block, count, zero_phase, False, fan)
    if zero_phase:
        out = sections_pass(out, sos, block, count, True, True, fan)
    # m = nn + 2 min(pad, nn - 1), so m tells the reach
    cut = F.when(F.col("m") >= 3 * pad + 1, F.lit(pad)).otherwise(((F.col("m") - 1) / 3).cast("long")) if pad else F.lit(0)
    out = out.select(F.col("k").alias(key), "m", cut.alias("cut"), "block", F.posexplode("x").alias("j", "v"))
    n = F.col("block") * block + F.col("j") - F.col("cut")
    return out.where((n >= 0) & (n < F.col("m") - 2 * F.col("cut"))).select(key, n.cast("int").alias("n"), "v")


def convolved(rows: DataFrame, key: str, taps: np.ndarray, block: int) -> DataFrame:
    """(key, n, v) of (key, at, v) with ``taps.size - 1`` samples before each signal: each sample's own and earlier ones, weighted.

    Blocks with their halo are convolved by the fast Fourier transform (overlap-save).
    """
    taps, kind = np.asarray(taps, float), rows.schema[key].dataType.simpleString()
    met = gathered_blocks(spread(rows, "at", block, taps.size - 1, 0), key, "at", "v").where((F.size("x") >= taps.size) & (F.col("block") >= 0))
    size = 1 << (block + 2 * taps.size).bit_length()
    spectrum = np.fft.rfft(taps, size)

    def valid(b: int, x: np.ndarray) -> list[np.ndarray]:
        return [np.fft.irfft(np.fft.rfft(x, size) * spectrum, size)[taps.size - 1 : x.size]]

    out = met.select("k", "block", "x").mapInArrow(_each(valid, ["k", "block", "x"], 2), f"k {kind}, block long, x array<double>")
    return out.select(F.col("k").alias(key), "block", F.posexplode("x").alias("j", "v")).select(key, (F.col("block") * block + F.col("j")).alias("n"), "v")
