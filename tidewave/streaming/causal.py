"""Filters over streams: one typed state per signal, updated micro-batch by micro-batch.

A signal's state is a value of named columns (the last ``order`` seen, and arrays of the filter's numbers), in the state
store under the name ``filter``: it can be read with Spark's state reader, handed to a new query as initial state
(``states_of`` makes it from a batch), and is cleared by a timer when a signal has been idle (``idle_ms``). Such states need
the RocksDB store, ``spark.sql.streaming.stateStore.providerClass`` set to ``ROCKSDB``.

Samples of a signal must come in order of ``order``; within a micro-batch they are sorted, and a sample at or before the
last one seen is late: it can't be replayed into a recurrence, so it is dropped, or an error (``late="fail"``). A null order
or value is an error.

Windows centred on a sample (moving mean and median) give its result when half a window more has come; what is pending
when a signal goes idle comes out then, with the signal's end treated as in the batch operators. A spectrum's frame comes
out with its last sample.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewave.functions import kernels
from tidewave.operators.signal import checked

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Numbers:
    """A filter whose state is the arrays named in ``STATE``, dotted names for those of a part."""

    STATE: tuple[str, ...] = ()

    def numbers(self) -> dict[str, list[float]]:
        return {name: np.ravel(self._of(name)).astype(float).tolist() for name in self.STATE}

    def _of(self, name: str):
        found = self
        for part in name.split("."):
            found = getattr(found, part)
        return found

    def restore(self, numbers: dict[str, Sequence[float]]) -> None:
        for name in self.STATE:
            now, owner = self._of(name), self._of(name.rpartition(".")[0]) if "." in name else self
            value = np.asarray(numbers[name], float)
            if isinstance(now, np.ndarray):
                value = value.reshape(*now.shape[:-1], -1) if now.ndim > 1 else value  # a past may be shorter or longer than a new one's
            else:
                value = type(now)(value[0])
            setattr(owner, name.rpartition(".")[2], value)


class SosStream(_Numbers):
    """A cascade of second-order sections."""

    STATE = ("state",)

    def __init__(self, sos: np.ndarray) -> None:
        self.sos, self.state = np.asarray(sos, float), np.zeros((len(sos), 2))

    def push(self, v: np.ndarray) -> np.ndarray:
        return kernels.sos_filter(self.sos, v, self.state)


class _Adaptive(_Numbers):
    """Keeps the last samples of the references, so that a chunk continues where the one before ended."""

    def __init__(self, channels: int, order: int) -> None:
        self.order, self.past, self.w = order, np.zeros((channels, 0)), np.zeros(channels * order)

    def rows(self, ref: np.ndarray) -> tuple[np.ndarray, int]:
        """Regressors of the chunk's samples, and how many of its first ones have none yet."""
        new = ref.shape[1]
        both = np.concatenate([self.past, ref], axis=1)
        self.past = both[:, max(0, both.shape[1] - self.order + 1) :] if self.order > 1 else both[:, :0]
        if both.shape[1] < self.order:
            return np.empty((0, self.w.size)), new
        u = kernels.lagged(both, self.order)
        return u, new - len(u)


class LmsStream(_Adaptive):
    STATE = ("w", "past")

    def __init__(self, channels: int = 3, order: int = 5, mu: float = 0.001) -> None:
        super().__init__(channels, order)
        self.mu = mu

    def push(self, raw: np.ndarray, low: np.ndarray, ref: np.ndarray) -> np.ndarray:
        out = raw.copy()
        rows, skip = self.rows(ref)
        for i, u in enumerate(rows, skip):
            y = self.w @ u
            self.w += 2 * self.mu * (low[i] - y) * u
            out[i] -= y
        return out


class RlsStream(_Adaptive):
    STATE = ("w", "p", "past")

    def __init__(self, channels: int = 3, order: int = 5, lam: float = 0.99, delta: float = 1.0) -> None:
        super().__init__(channels, order)
        kernels.check_forgetting(lam)
        self.lam, self.p = lam, np.eye(channels * order)[None] * delta

    def push(self, raw: np.ndarray, low: np.ndarray, ref: np.ndarray) -> np.ndarray:
        out = raw.copy()
        rows, skip = self.rows(ref)
        w = self.w[None]
        for i, u in enumerate(rows, skip):
            out[i] -= w[0] @ u
            w, self.p = kernels.rls_step(w, self.p, u[None], out[i : i + 1], self.lam)
        self.w = w[0]
        return out


class BlmsStream(_Adaptive):
    STATE = ("w", "sum", "seen", "past")

    def __init__(self, channels: int = 3, order: int = 32, mu: float = 0.01, block: int = 10) -> None:
        super().__init__(channels, order)
        kernels.check_block(block)
        self.mu, self.block, self.seen, self.sum = mu, block, 0, np.zeros(channels * order)

    def push(self, raw: np.ndarray, low: np.ndarray, ref: np.ndarray) -> np.ndarray:
        out = raw.copy()
        rows, skip = self.rows(ref)
        for i, u in enumerate(rows, skip):
            if self.seen and self.seen % self.block == 0:
                self.w, self.sum = self.w + self.mu / self.block * self.sum, np.zeros_like(self.sum)
            out[i] -= self.w @ u
            self.sum += u * out[i]
            self.seen += 1
        return out


_LATTICE = tuple(f"net.{x}" for x in ("reflect", "ladder", "backward", "passed", "power", "between", "joint"))


class LatticeStream(_Numbers):
    """A learning lattice on one reference; gives the error."""

    STATE = _LATTICE

    def __init__(self, order: int = 5, beta: float = 1.0, alpha: float = 0.0, eps: float = 1e-3) -> None:
        self.net = kernels.Lattice(1, order, beta, alpha, eps)

    def push(self, raw: np.ndarray, low: np.ndarray, ref: np.ndarray) -> np.ndarray:
        return np.array([self.net.step(ref[:, i], raw[i : i + 1])[0][0] for i in range(raw.size)])


class FusionStream(_Numbers):
    """A lattice per axis, fused by the Kalman filter; gives the clean signal."""

    STATE = (*_LATTICE, "fusion.w", "fusion.p")

    def __init__(self, axes: int = 3, order: int = 5, beta: float = 1.0, alpha: float = 0.0, eps: float = 1e-3, lam: float = 0.99, delta: float = 1.0) -> None:
        self.net, self.fusion = kernels.Lattice(axes, order, beta, alpha, eps), kernels.Fusion(1, axes, lam, delta)

    def push(self, raw: np.ndarray, low: np.ndarray, ref: np.ndarray) -> np.ndarray:
        return np.array([self.fusion.step(raw[i : i + 1], self.net.step(ref[:, i], np.repeat(raw[i], len(ref)))[1][None])[0][0] for i in range(raw.size)])


class MeanStream(_Numbers):
    """A centred mean over an odd window, the signal mirrored at its ends: the last values of a signal, and how many there have been."""

    STATE = ("recent", "seen")

    def __init__(self, width: int) -> None:
        self.half = width // 2  # an even width counts as one more
        self.recent, self.seen = np.zeros(0), 0

    def _ahead(self, v: np.ndarray) -> np.ndarray:
        return v[self.half : 0 : -1]

    def _behind(self, v: np.ndarray) -> np.ndarray:
        return v[-2 : -2 - self.half : -1]

    def _result(self, frames: np.ndarray) -> np.ndarray:
        return frames.mean(axis=1)

    def push(self, v: np.ndarray, end: bool = False) -> np.ndarray:
        """The results that have become known, in order: of the samples up to half a window ago, or all at the signal's end."""
        half = self.half
        both, at = np.concatenate([self.recent, v]), self.seen - self.recent.size  # of both[0]
        low, self.seen = max(0, self.seen - half), self.seen + v.size
        high = self.seen if end else max(0, self.seen - half)
        self.recent = both[max(0, both.size - 2 * half) :]
        if end and self.seen < 2 * half + 1:
            raise ValueError(f"{2 * half + 1} samples, more than the signal has")
        if high <= low:
            return np.empty(0)
        if at == 0:
            both, at = np.concatenate([self._ahead(both), both]), -half
        if end:
            both = np.concatenate([both, self._behind(both)])
        frames = np.lib.stride_tricks.sliding_window_view(both, 2 * half + 1)
        return self._result(frames[low - half - at : high - half - at])


class MedianStream(MeanStream):
    """A centred median over an odd window, zeros beyond the signal's ends."""

    def _ahead(self, v: np.ndarray) -> np.ndarray:
        return np.zeros(self.half)

    def _behind(self, v: np.ndarray) -> np.ndarray:
        return np.zeros(self.half)

    def _result(self, frames: np.ndarray) -> np.ndarray:
        return np.median(frames, axis=1)


class FrameStream(_Numbers):
    """Spectra of frames under a periodic Hann window, half a frame of zeros before the first sample; a frame comes with its last sample."""

    STATE = ("recent", "frames")

    def __init__(self, size: int, overlap: int) -> None:
        self.size, self.hop, self.frames = size, size - overlap, 0
        self.recent = np.zeros(size // 2)

    def push(self, v: np.ndarray, end: bool = False) -> np.ndarray:
        """(frames, frequencies), complex; at the end also those that half a frame of zeros, and as many as fill the last frame, complete."""
        both = np.concatenate([self.recent, v])
        if end:
            both = np.concatenate([both, np.zeros(self.size // 2)])
            both = np.concatenate([both, np.zeros(-(both.size - self.size) % self.hop)]) if both.size >= self.size else both
        if both.size < self.size:
            self.recent = both
            return np.empty((0, self.size // 2 + 1), complex)
        window = kernels.hann(self.size)
        found = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(both, self.size)[:: self.hop] * window, axis=1) / window.sum()
        self.frames, self.recent = self.frames + len(found), both[len(found) * self.hop :]
        return found


def _plain(x):
    """A value as the state store takes it."""
    return x.to_pydatetime() if isinstance(x, pd.Timestamp) else x.item() if isinstance(x, np.generic) else x


class FilterProcessor(StatefulProcessor):
    """Runs a filter for each signal; ``made`` gives a new filter, ``shown`` the rows of its results."""

    def __init__(self, key: str, order: str, kind: str, names: Sequence[str], made: Callable, shown: Callable, late: str, idle_ms: int | None) -> None:
        self.key, self.order, self.names, self.made, self.shown, self.late, self.idle_ms = key, order, list(names), made, shown, late, idle_ms
        self.schema = state_schema(made, kind)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("filter", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        filt, last, pending = self._load()
        pdf = pd.concat(list(rows)).sort_values("o", kind="stable")
        bad = pdf["o"].duplicated() | ((pdf["o"] <= last) if last is not None else False)
        if bad.any():
            if self.late == "fail":
                raise ValueError(f"late samples in signal {key[0]}")
            pdf = pdf[~bad]
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        if len(pdf):
            out = self.shown(filt, pdf, pending, [pdf[n].to_numpy(float) for n in self.names], False)
            self.state.update(state_of(filt, _plain(pdf["o"].iloc[-1]), pending))
            if len(out):
                out.insert(0, self.key, key[0])
                yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        filt, _, pending = self._load()
        self.state.clear()
        out = self.shown(filt, None, pending, [np.empty(0) for _ in self.names], True)
        if len(out):
            out.insert(0, self.key, key[0])
            yield out

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        for row in initialState.drop(columns=["k"]).itertuples(index=False):
            self.state.update(tuple(x.tolist() if isinstance(x, np.ndarray) else _plain(x) for x in row))

    def _load(self) -> tuple:
        filt = self.made()
        if not self.state.exists():
            return filt, None, []
        last, pending, *numbers = self.state.get()
        filt.restore(dict(zip(filt.STATE, numbers, strict=True)))
        return filt, last, list(pending)


def state_schema(made: Callable, kind: str) -> str:
    return f"last {kind}, pending array<{kind}>, " + ", ".join(f"{n.replace('.', '_')} array<double>" for n in made().STATE)


def state_of(filt: _Numbers, last, pending: list) -> tuple:
    return (last, [_plain(x) for x in pending], *filt.numbers().values())


def _each_sample(order: str, filt, pdf, pending: list, values: list[np.ndarray], end: bool) -> pd.DataFrame:
    """One row per result; results may come later than their samples, whose orders are pending then."""
    if pdf is not None:
        pending.extend(pdf["o"].tolist())
    out = filt.push(*values, end=end) if isinstance(filt, MeanStream) else filt.push(*values) if not end else np.empty(0)
    done, pending[:] = pending[: len(out)], pending[len(out) :]
    return pd.DataFrame({order: done, "clean": out})


def _each_frame(order: str, filt, pdf, pending: list, values: list[np.ndarray], end: bool) -> pd.DataFrame:
    at = filt.frames
    found = filt.push(*values, end=end)
    return pd.DataFrame({"t": at + np.arange(len(found)), "re": list(found.real), "im": list(found.imag)})


def _picked(df: DataFrame, key: str, order: str, inputs: dict[str, str]) -> DataFrame:
    kind = df.schema[order].dataType.simpleString()
    at = F.coalesce(F.col(order), F.raise_error(F.lit(f"null in {order}")).cast(kind))
    return df.select(F.col(key).alias("k"), at.alias("o"), *(checked(c, n) for n, c in inputs.items()))


def _stateful(df: DataFrame, key: str, order: str, inputs: dict[str, str], made: Callable, shown: Callable, schema: str, late: str, idle_ms: int | None, states: DataFrame | None) -> DataFrame:
    if late not in ("drop", "fail"):
        raise ValueError("late is drop or fail")
    if df.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    kinds = dict(df.dtypes)
    processor = FilterProcessor(key, order, kinds[order], list(inputs), made, partial(shown, order), late, idle_ms)
    given = states.groupBy("k") if states is not None else None
    out = _picked(df, key, order, inputs).groupBy("k").transformWithStateInPandas(processor, f"`{key}` {kinds[key]}, {schema}", "append", "None" if idle_ms is None else "ProcessingTime", given)
    return out


def states_of(df: DataFrame, key: str, order: str, inputs: dict[str, str], made: Callable) -> DataFrame:
    """(k, last, pending, numbers...): each signal's state after the rows of a batch, to begin a stream with (``states``).

    A signal's history is run through its filter in one task; null and tied orders are errors.
    """
    kinds, names = dict(df.dtypes), list(inputs)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o", kind="stable")
        if pdf["o"].duplicated().any():
            raise ValueError("tied order")
        filt, pending = made(), []
        (_each_frame if isinstance(filt, FrameStream) else _each_sample)("o", filt, pdf, pending, [pdf[n].to_numpy(float) for n in names], False)
        row = state_of(filt, pdf["o"].iloc[-1], pending)
        return pd.DataFrame([(pdf["k"].iloc[0], *row)], columns=["k", "last", "pending", *(n.replace(".", "_") for n in filt.STATE)])

    return _picked(df, key, order, inputs).groupBy("k").applyInPandas(run, f"k {kinds[key]}, {state_schema(made, kinds[order])}")


def _clean(df: DataFrame, order: str) -> str:
    return f"`{order}` {dict(df.dtypes)[order]}, clean double"


def iir_stream(df: DataFrame, key: str, order: str, value: str, sos: np.ndarray, late: str = "drop", idle_ms: int | None = None, states: DataFrame | None = None) -> DataFrame:
    """(key, order, clean): the causal section filter, from a zero state or a given one."""
    return _stateful(df, key, order, {"v": value}, partial(SosStream, np.asarray(sos, float)), _each_sample, _clean(df, order), late, idle_ms, states)


class _Referenced:
    """Gives the references as one array to a filter that takes them so."""

    def __init__(self, made: Callable) -> None:
        self.made = made

    def __call__(self):
        filt = self.made()
        push = filt.push
        filt.push = lambda raw, low, *refs: push(raw, low, np.stack(refs))
        return filt


def adaptive_stream(df: DataFrame, key: str, order: str, raw: str, refs: Sequence[str], make: Callable, lowpass: str | None = None, late: str = "drop", idle_ms: int | None = None, states: DataFrame | None = None) -> DataFrame:
    """(key, order, clean): ``make`` gives a LmsStream, RlsStream, BlmsStream, LatticeStream (one reference) or FusionStream for a new signal."""
    return _stateful(df, key, order, adaptive_inputs(raw, refs, lowpass), _Referenced(make), _each_sample, _clean(df, order), late, idle_ms, states)


def adaptive_inputs(raw: str, refs: Sequence[str], lowpass: str | None = None) -> dict[str, str]:
    """The inputs of an adaptive filter, as ``states_of`` takes them."""
    return {"raw": raw, "low": lowpass or raw, **{f"r{i}": c for i, c in enumerate(refs)}}


def mean_stream(df: DataFrame, key: str, order: str, value: str, width: int, late: str = "drop", idle_ms: int | None = None, states: DataFrame | None = None) -> DataFrame:
    """(key, order, clean): a centred moving mean, half a window behind."""
    return _stateful(df, key, order, {"v": value}, partial(MeanStream, width), _each_sample, _clean(df, order), late, idle_ms, states)


def median_stream(df: DataFrame, key: str, order: str, value: str, width: int, late: str = "drop", idle_ms: int | None = None, states: DataFrame | None = None) -> DataFrame:
    """(key, order, clean): a centred moving median, half a window behind."""
    return _stateful(df, key, order, {"v": value}, partial(MedianStream, width), _each_sample, _clean(df, order), late, idle_ms, states)


def stft_stream(df: DataFrame, key: str, order: str, value: str, nperseg: int = 256, noverlap: int = 224, late: str = "drop", idle_ms: int | None = None, states: DataFrame | None = None) -> DataFrame:
    """(key, t, re, im): the spectrum of each frame, by frequency."""
    return _stateful(df, key, order, {"v": value}, partial(FrameStream, nperseg, noverlap), _each_frame, "t long, re array<double>, im array<double>", late, idle_ms, states)
