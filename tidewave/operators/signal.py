"""Signals as rows: a key, an order and values. Indexing, checks, and the grouped map that the recurrences run in."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def names(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def checked(value: Column | str, name: str) -> Column:
    """The value as a double, named; a null is an error."""
    return F.coalesce((F.col(value) if isinstance(value, str) else value).cast("double"), F.raise_error(F.lit(f"null in {name}")).cast("double")).alias(name)


def indexed(df: DataFrame, key: str, order: str | Sequence[str], values: dict[str, Column | str]) -> DataFrame:
    """(key, n, nn, values...): n counts from 0 in ``order``, nn is the signal's length. Null values and tied orders are errors."""
    at = F.struct(*names(order))
    w = Window.partitionBy(key).orderBy(*names(order))
    n = F.when(at.eqNullSafe(F.lag(at).over(w)), F.raise_error(F.lit("tied order")).cast("int")).otherwise(F.row_number().over(w) - 1)
    return df.select(F.col(key), n.alias("n"), F.count("*").over(Window.partitionBy(key)).cast("int").alias("nn"), *(checked(v, k) for k, v in values.items()))


def from_arrays(df: DataFrame, key: str, value: str = "v") -> DataFrame:
    """(key, n, v) of an array column."""
    return df.select(key, F.posexplode(value).alias("n", "v")).select(key, "n", F.col("v").cast("double").alias("v"))


def gathered(df: DataFrame, key: str, order: str | Sequence[str], inputs: dict[str, Column | str]) -> DataFrame:
    """One row per signal: ``__key`` and an array of doubles per input, in order. Null values and tied orders are errors.

    Only key, order and inputs are shuffled, and all is put together, sorted and checked in the JVM.
    """
    at = F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(names(order)))).alias("__at")
    picked = df.select(F.col(key).alias("__key"), at, *(checked(v, k) for k, v in inputs.items()))
    whole = picked.groupBy("__key").agg(F.sort_array(F.collect_list(F.struct("__at", *inputs))).alias("r"))
    tied = F.exists(F.sequence(F.lit(1), F.size("r") - 1), lambda i: F.col("r")[i]["__at"].eqNullSafe(F.col("r")[i - 1]["__at"]))
    in_order = F.when((F.size("r") > 1) & tied, F.raise_error(F.lit("tied order")).cast(whole.schema["r"].dataType)).otherwise(F.col("r"))
    return whole.withColumn("r", in_order).select("__key", *(F.col(f"r.{k}").alias(k) for k in inputs))


#: Signals step together in groups of so many samples, so that memory is bounded.
TOGETHER = 500_000


def per_signal(df: DataFrame, key: str, order: str | Sequence[str], inputs: dict[str, Column | str], outputs: Sequence[str], fn: Callable[..., dict], together: bool = False) -> DataFrame:
    """(key, n, outputs...): ``fn`` gets the inputs of one signal as float arrays in order, and gives arrays of one length.

    With ``together`` it gets lists of arrays, one per signal, and gives lists. Signals cross to Python many to an Arrow
    batch, so that short ones cost little each. A signal is one task's work; different signals run in parallel.
    """
    given, kind = list(inputs), df.schema[key].dataType.simpleString()
    if key in ("n", *outputs):
        raise ValueError(f"the key column is named like a result, {key}: rename it")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(j + 1) for j in range(len(given))]
            values = [x.flatten().to_numpy(zero_copy_only=False).astype(float) for x in lists]
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False))]).astype(int)
            longest_first = np.argsort(-np.diff(ends), kind="stable").tolist()
            while longest_first:
                room = max(1, TOGETHER // max(1, ends[longest_first[0] + 1] - ends[longest_first[0]]))
                rows, longest_first = longest_first[:room], longest_first[room:]
                parts = {k: [v[ends[i] : ends[i + 1]].copy() for i in rows] for k, v in zip(given, values, strict=True)}
                if together:
                    out = fn(**parts)
                else:
                    each = [fn(**dict(zip(given, one, strict=True))) for one in zip(*parts.values(), strict=True)]
                    out = {o: [e[o] for e in each] for o in outputs}
                sizes = [np.size(x) for x in out[outputs[0]]]
                keys = batch.column(0).take(pa.array(np.repeat(rows, sizes)))
                n = np.concatenate([np.arange(s, dtype=np.int32) for s in sizes])
                yield pa.RecordBatch.from_arrays([keys, pa.array(n), *(pa.array(np.concatenate([np.asarray(x, float) for x in out[o]])) for o in outputs)], names=[key, "n", *outputs])

    return gathered(df, key, order, inputs).mapInArrow(run, f"`{key}` {kind}, n int, " + ", ".join(f"{o} double" for o in outputs))


def magnitude(x: Column | str, y: Column | str, z: Column | str) -> Column:
    """Length of a vector of three axes. A null is an error."""
    x, y, z = (checked(c, f"axis {n}") for c, n in zip((x, y, z), "xyz", strict=True))
    return F.sqrt(x * x + y * y + z * z)


def regressor(channels: Sequence[str], order: int, key: str, by: str = "n") -> Column:
    """The last ``order`` values of each channel, newest first, channel after channel; null where there are fewer. A null value and a tied order are errors."""
    w = Window.partitionBy(key).orderBy(by)
    lags = F.array(*(F.lag(c, i).over(w) if i else checked(c, c) for c in channels for i in range(order)))
    tied = F.lag(by).over(w) == F.col(by)
    return F.when(tied, F.raise_error(F.lit("tied order")).cast("array<double>")).when(F.col(by) >= order - 1, lags).otherwise(F.when(F.size(F.array(*(checked(c, c) for c in channels))) < 0, lags))
