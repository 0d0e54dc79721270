"""Forward inference for the denoising and classification networks, in NumPy, over arrays in rows.

A network is a function of a batch and a table of named weights; ``infer`` runs it in Arrow batches. Shapes of the
weights come from running the same function once with a recorder in place of the table, so a definition says each layer once.
Dropout is the identity at inference and is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewave.functions.design import filter_bank

Array = np.ndarray


class Weights:
    """Named arrays; one that records makes up what it is asked for."""

    def __init__(self, arrays: dict[str, Array] | None = None, seed: int | None = None) -> None:
        self.arrays, self.rng = dict(arrays or {}), None if seed is None else np.random.Generator(np.random.PCG64(seed))
        self.trained: set[str] = set(self.arrays)

    def get(self, name: str, shape: tuple[int, ...], fan: int | None = None, fill: float | None = None, trained: bool = True) -> Array:
        if name not in self.arrays:
            if self.rng is None:
                raise KeyError(name)
            bound = 1 / np.sqrt(max(1, fan or shape[0]))
            self.arrays[name] = np.full(shape, fill, np.float32) if fill is not None else self.rng.uniform(-bound, bound, shape).astype(np.float32)
            if trained:
                self.trained.add(name)
        if self.arrays[name].shape != shape:
            raise ValueError(f"{name} has shape {self.arrays[name].shape}, not {shape}")
        return self.arrays[name]


# ---- layers: x is (batch, channels, time) or (batch, channels, height, width) ----


def conv(w: Weights, name: str, x: Array, out: int, kernel: tuple[int, ...], stride: int = 1, pad: tuple[tuple[int, int], ...] | None = None, dilation: tuple[int, ...] | None = None) -> Array:
    """Cross-correlation in one or two dimensions; no ``pad`` keeps the size, with the odd cell of an even kernel on the right."""
    dilation = dilation or (1,) * len(kernel)
    reach = [(k - 1) * d for k, d in zip(kernel, dilation, strict=True)]
    pad = pad or tuple((r // 2, r - r // 2) for r in reach)
    weight = w.get(f"{name}.weight", (out, x.shape[1], *kernel), fan := x.shape[1] * int(np.prod(kernel)))
    bias = w.get(f"{name}.bias", (out,), fan)
    return correlate(x, weight, stride, pad, dilation) + bias.reshape(1, -1, *(1,) * len(kernel))


def correlate(x: Array, weight: Array, stride: int, pad, dilation) -> Array:
    x = np.pad(x, ((0, 0), (0, 0), *pad))
    kernel = weight.shape[2:]
    sizes = [(n - (k - 1) * d - 1) // stride + 1 for n, k, d in zip(x.shape[2:], kernel, dilation, strict=True)]
    total = 0
    for at in np.ndindex(*kernel):  # one matrix product per tap: no copy of the input as wide as the kernel
        part = x[(slice(None), slice(None), *(slice(i * d, i * d + stride * (n - 1) + 1, stride) for i, d, n in zip(at, dilation, sizes, strict=True)))]
        flat = part.reshape(part.shape[0], part.shape[1], -1)
        total = total + np.matmul(weight[(slice(None), slice(None), *at)], flat)
    return total.reshape(x.shape[0], weight.shape[0], *sizes)


def deconv(w: Weights, name: str, x: Array, out: int, kernel: tuple[int, ...], stride: tuple[int, ...], pad: tuple[int, ...] | None = None, extra: tuple[int, ...] | None = None) -> Array:
    weight = w.get(f"{name}.weight", (x.shape[1], out, *kernel), fan := out * int(np.prod(kernel)))
    bias = w.get(f"{name}.bias", (out,), fan)
    return scatter(x, weight, stride, pad or (0,) * len(kernel), extra or (0,) * len(kernel)) + bias.reshape(1, -1, *(1,) * len(kernel))


def scatter(x: Array, weight: Array, stride, pad, extra) -> Array:
    kernel, dims = weight.shape[2:], x.shape[2:]
    full = [(n - 1) * s + k + e for n, s, k, e in zip(dims, stride, kernel, extra, strict=True)]
    total = np.zeros((x.shape[0], weight.shape[1], *full), x.dtype)
    flat = x.reshape(x.shape[0], x.shape[1], -1)
    for at in np.ndindex(*kernel):
        where = (slice(None), slice(None), *(slice(i, i + s * (n - 1) + 1, s) for i, s, n in zip(at, stride, dims, strict=True)))
        total[where] += np.matmul(weight[(slice(None), slice(None), *at)].T, flat).reshape(x.shape[0], -1, *dims)
    return total[(slice(None), slice(None), *(slice(p, f - p) for p, f in zip(pad, full, strict=True)))]


def norm(w: Weights, name: str, x: Array, eps: float = 1e-5) -> Array:
    """Batch normalisation with stored statistics."""
    c = x.shape[1]
    gain, shift = w.get(f"{name}.weight", (c,), fill=1.0), w.get(f"{name}.bias", (c,), fill=0.0)
    mean, var = w.get(f"{name}.running_mean", (c,), fill=0.0, trained=False), w.get(f"{name}.running_var", (c,), fill=1.0, trained=False)
    scale = gain / np.sqrt(var + eps)
    form = (1, -1, *(1,) * (x.ndim - 2))
    return x * scale.reshape(form) + (shift - mean * scale).reshape(form)


def linear(w: Weights, name: str, x: Array, out: int) -> Array:
    return x @ w.get(f"{name}.weight", (out, x.shape[-1]), x.shape[-1]).T + w.get(f"{name}.bias", (out,), x.shape[-1])


def relu(x: Array) -> Array:
    return np.maximum(x, 0)


def elu(x: Array) -> Array:
    return np.where(x > 0, x, np.expm1(np.minimum(x, 0)))


def leaky(x: Array, slope: float = 0.01) -> Array:
    return np.where(x > 0, x, slope * x)


def pool(x: Array) -> Array:
    """Maximum of neighbours along the last axis."""
    n = x.shape[-1] // 2 * 2
    return np.maximum(x[..., 0:n:2], x[..., 1:n:2])


def _bank(name: str, reconstruct: bool) -> list[Array]:
    """The low and high taps, reversed, as single-precision rows."""
    lo, hi, rl, rh = filter_bank(name)
    return [h[::-1].astype(np.float32) for h in ((rl, rh) if reconstruct else (lo, hi))]


def dwt_layer(w: Weights, name: str, x: Array, out: int, wavelet: str = "db6") -> Array:
    """Each channel through the low and high filters at stride 2, a convolution of width 8 after each, side by side."""
    if out % 2:
        raise ValueError(f"half of the channels come from each branch: {out} is odd")
    parts = []
    for branch, taps in zip(("conv_lpf", "conv_hpf"), _bank(wavelet, False), strict=True):
        pad = (taps.size - 2) // 2
        one = correlate(x.reshape(-1, 1, x.shape[2]), taps.reshape(1, 1, -1), 2, ((pad, pad),), (1,))
        parts.append(conv(w, f"{name}.{branch}", one.reshape(x.shape[0], x.shape[1], -1), out // 2, (8,)))
    return np.concatenate(parts, axis=1)


def idwt_layer(w: Weights, name: str, x: Array, out: int, wavelet: str = "db6") -> Array:
    """A transposed convolution to twice the channels; halves go up through the two filters and are added.

    The filters are reversed, so this does not undo ``dwt_layer``.
    """
    x = deconv(w, f"{name}.deconv", x, 2 * out, (7,), (1,), (3,))
    total = 0
    for half, taps in zip((x[:, :out], x[:, out:]), _bank(wavelet, True), strict=True):
        up = scatter(half.reshape(-1, 1, half.shape[2]), taps.reshape(1, 1, -1), (2,), ((taps.size - 2) // 2,), (0,))
        total = total + up.reshape(half.shape[0], out, -1)
    return total


def swt_conv(w: Weights, name: str, x: Array, out: int, kernel: int = 3) -> Array:
    """One kernel as four: itself, reversed, with alternating signs, reversed with alternating signs."""
    if out % 4:
        raise AssertionError(f"four filters per kernel: {out} channels are no multiple of 4")
    base = w.get(f"{name}.weight", (out // 4, x.shape[1], kernel), x.shape[1] * kernel)
    signs = (-1.0) ** np.arange(kernel)
    four = np.concatenate([base, base[..., ::-1], base * signs, base[..., ::-1] * signs]).astype(np.float32)
    pad = kernel // 2
    return correlate(x, four, 1, ((pad, pad),), (1,)) + w.get(f"{name}.bias", (out,), fill=0.0).reshape(1, -1, 1)


def time_code(w: Weights, name: str, x: Array, seq_len: int) -> Array:
    """x is (batch, time, features): a linear and a periodic term are both added."""
    if x.shape[1] != seq_len:
        raise ValueError(f"time codes for {seq_len} places, {x.shape[1]} given")
    wl, pl, wp, pp = (w.get(f"{name}.{k}", (seq_len, x.shape[2]), fan=100) for k in ("w_linear", "phi_linear", "w_periodic", "phi_periodic"))
    t = (np.arange(seq_len, dtype=np.float32) / max(seq_len - 1, 1))[:, None]
    return x + (wl * t + pl) + np.sin(wp * t + pp)


def transformer(w: Weights, name: str, x: Array, heads: int = 16, hidden: int = 64) -> Array:
    """Attention and a two-layer network, each with a residual and batch normalisation over features."""
    b, n, d = x.shape
    packed = x @ w.get(f"{name}.attention.in_proj_weight", (3 * d, d), d).T + w.get(f"{name}.attention.in_proj_bias", (3 * d,), fill=0.0)
    q, k, v = (p.reshape(b, n, heads, d // heads).transpose(0, 2, 1, 3) for p in np.split(packed, 3, axis=2))
    s = q @ k.transpose(0, 1, 3, 2) / float(d // heads) ** 0.5
    s = np.exp(s - s.max(axis=-1, keepdims=True))
    a = (s / s.sum(axis=-1, keepdims=True) @ v).transpose(0, 2, 1, 3).reshape(b, n, d)
    by_feature = lambda k, y: norm(w, f"{name}.{k}", y.transpose(0, 2, 1)).transpose(0, 2, 1)
    x = by_feature("bn1", x + linear(w, f"{name}.attention.out_proj", a, d))
    return by_feature("bn2", x + linear(w, f"{name}.ffn.2", relu(linear(w, f"{name}.ffn.0", x, hidden)), d))


def lnc(w: Weights, name: str, x: Array, out: int) -> Array:
    """Three dilations over cycles side by side, reduced, and a residual (through a 1x1 convolution if widths differ)."""
    parts = [leaky(norm(w, f"{name}.bn{i}", conv(w, f"{name}.conv{i}", x, out, (3, 7), dilation=(d, 1)))) for i, d in ((1, 1), (2, 2), (3, 4))]
    y = conv(w, f"{name}.reduce_conv", np.concatenate(parts, axis=1), out, (1, 1))
    return y + (x if x.shape[1] == out else conv(w, f"{name}.skip_adapter", x, out, (1, 1)))


# ---- networks ----


def autoencoder(w: Weights, x: Array) -> Array:
    after = lambda name, y: norm(w, f"{name}.norm", elu(y))
    for name, out in (("enc1", 40), ("enc2", 20)):
        x = after(name, conv(w, f"{name}.conv", x, out, (16,), 2, ((7, 7),)))
    for name, out in (("enc3", 20), ("enc4", 20), ("enc5", 40)):
        x = after(name, dwt_layer(w, name, x, out))
    for name in ("enc6", "dec1"):
        x = after(name, conv(w, f"{name}.conv", x, 1, (15,)))
    for name, out in (("dec2", 40), ("dec3", 20), ("dec4", 20)):
        x = after(name, idwt_layer(w, name, x, out))
    for name, out in (("dec5", 20), ("dec6", 40)):
        x = after(name, deconv(w, f"{name}.conv", x, out, (16,), (2,), (7,)))
    return conv(w, "out_layer", x, 1, (15,))


def _block(w: Weights, name: str, x: Array, out: int) -> Array:
    return norm(w, f"{name}.norm", relu(conv(w, f"{name}.conv", x, out, (3,))))


def cstrans_denoising(w: Weights, x: Array) -> Array:
    skips = []
    for i, out in enumerate((16, 32, 64, 64), 1):
        x = _block(w, f"enc{i}", pool(x) if skips else x, out)
        skips.append(x)
    y = time_code(w, "time2vec", swt_conv(w, "cnn_swt", x, 64).transpose(0, 2, 1), 256)
    for i in range(2):
        y = transformer(w, f"transformer.{i}", y)
    x = y.transpose(0, 2, 1)
    for i, out in ((4, 64), (3, 32), (2, 16), (1, 16)):
        x = _block(w, f"dec{i}", np.concatenate([x, skips[i - 1]], axis=1), out)
        x = x if i == 1 else np.repeat(x, 2, axis=2)
    return conv(w, "out_dense", x, 1, (1,))


def beat_features(w: Weights, x: Array) -> Array:
    for i, out in enumerate((16, 32, 64)):
        x = _block(w, f"shared_conv.{i}", pool(x) if i else x, out)
    y = time_code(w, "shared_time2vec", swt_conv(w, "shared_swt", x, 64).transpose(0, 2, 1), 90)
    for i in range(2):
        y = transformer(w, f"shared_transformer.{i}", y)
    return linear(w, "dense_feat", y.reshape(len(y), -1), 64)


def cstrans_classification(w: Weights, x: Array, classes: int = 5) -> Array:
    """x is (batch, 1, 3 * 360 + 4): three beats, then four intervals."""
    beats = [beat_features(w, x[:, :, 360 * i : 360 * (i + 1)]) for i in range(3)]
    merged = np.concatenate([*beats, x[:, 0, 1080:]], axis=1)
    return linear(w, "classifier.2", relu(linear(w, "classifier.0", merged, 66)), classes)


def ecgd(w: Weights, x: Array) -> Array:
    if x.ndim != 3 or x.shape[1] != 1:
        raise ValueError(f"one channel per signal is needed, the batch is {x.shape}")
    if x.shape[2] % 4:
        raise ValueError(f"two halvings need a length that is a multiple of 4: {x.shape[2]}")
    for i, out in enumerate((16, 32, 64, 64, 32)):
        x = relu(conv(w, f"feature_extractor.{i}", x, out, (5,)))
        x = pool(x) if i < 2 else x
    for i, out in enumerate((32, 16)):
        x = relu(deconv(w, f"reconstructor.{i}", x, out, (4,), (2,), (1,)))
    return conv(w, "reconstructor.2", x, 1, (5,))


def sced(w: Weights, x: Array) -> Array:
    skips = []
    for i, out in enumerate((16, 32, 64, 128), 1):
        x = lnc(w, f"enc{i}", pool(x) if skips else x, out)
        skips.append(x)
    x = lnc(w, "bottleneck", pool(x), 256)
    for i in (4, 3, 2, 1):
        out = skips[i - 1].shape[1]
        x = lnc(w, f"dec{i}", np.concatenate([deconv(w, f"up{i}", x, out, (1, 2), (1, 2)), skips[i - 1]], axis=1), out)
    return conv(w, "out_conv", x, 1, (1, 1))


def deepced(w: Weights, x: Array) -> Array:
    block = lambda name, y, out, stride=1: norm(w, f"{name}.bn", relu(conv(w, f"{name}.conv", y, out, (3, 3), stride, ((1, 1), (1, 1)))))
    skips = []
    for i, out in enumerate((8, 8, 16, 16, 32, 32, 64, 64, 128, 128, 256), 1):
        x = block(f"enc{i}", x, out, 1 if i % 2 else 2)
        skips.append(x)
    for i, (up, out) in enumerate(((384, 128), (64, 64), (32, 32), (16, 16), (8, 8)), 1):
        y = norm(w, f"dec{i}_up.bn", relu(deconv(w, f"dec{i}_up.deconv", x, up, (3, 3), (2, 2), (1, 1), (0, 1))))
        x = block(f"dec{i}_conv", np.concatenate([y, skips[10 - 2 * i]], axis=1), out)
    return conv(w, "final_conv", x, 2, (1, 1))


@dataclass(frozen=True)
class Net:
    forward: Callable[[Weights, Array], Array]
    shape: tuple[int, ...]
    batch: int = field(default=8)


NETS = {
    "autoencoder": Net(autoencoder, (1, 1024), 32),
    "sced": Net(sced, (1, 32, 384), 2),
    "cstrans_denoising": Net(cstrans_denoising, (1, 2048), 8),
    "cstrans_classification": Net(cstrans_classification, (1, 1084), 32),
    "ecgd": Net(ecgd, (1, 1024), 32),
    "deepced": Net(deepced, (2, 129, 32), 8),
}


def seeded(name: str, seed: int = 0) -> dict[str, Array]:
    """Weights of a net as it is before training, from a seed."""
    w = Weights(seed=seed)
    NETS[name].forward(w, np.zeros((1, *NETS[name].shape), np.float32))
    return w.arrays


def count_parameters(name: str) -> int:
    w = Weights(seed=0)
    NETS[name].forward(w, np.zeros((1, *NETS[name].shape), np.float32))
    return sum(w.arrays[k].size for k in w.trained)


def weights_table(spark: SparkSession, arrays: dict[str, Array]) -> DataFrame:
    """(param, shape, data), one row per array."""
    rows = [(k, list(v.shape), v.ravel().tolist()) for k, v in sorted(arrays.items())]
    return spark.createDataFrame(rows, "param string, shape array<int>, data array<float>")


def weights_from(table: DataFrame) -> dict[str, Array]:
    return {r.param: np.array(r.data, np.float32).reshape(r.shape) for r in table.collect()}


def infer(df: DataFrame, column: str, name: str, weights: dict[str, Array]) -> DataFrame:
    """``df`` with ``y``, the flat output of the net for the flat array in ``column``. The weights are broadcast once (24 MB for the largest net).

    A null array or element is an error, and so is one that isn't a number.
    """
    net, held = NETS[name], df.sparkSession.sparkContext.broadcast(weights)
    x = F.col(column)
    whole = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v))
    checked = F.when(whole, x).otherwise(F.raise_error(F.lit(f"null in {column}")).cast(df.schema[column].dataType))
    run = F.pandas_udf(_typed(net, held), "array<float>")
    return df.withColumn("y", run(checked))


def beat_triples(beats: DataFrame, key: str, order: str, samples: str, intervals: str) -> DataFrame:
    """(key, order, x): each beat's samples between those of its neighbours, then its intervals, as ``cstrans_classification`` takes them.

    ``beats`` has one row per beat; the first and the last of a recording have no two neighbours and are left out.
    """
    w = Window.partitionBy(key).orderBy(order)
    parts = beats.select(key, order, F.struct(F.lag(samples).over(w).alias("a"), F.col(samples).alias("b"), F.lead(samples).over(w).alias("c"), F.col(intervals).alias("i")).alias("__p"))
    return parts.where("__p.a is not null and __p.c is not null").select(key, order, F.concat("__p.a", "__p.b", "__p.c", "__p.i").alias("x"))


def classify_beats(beats: DataFrame, key: str, order: str, samples: str, intervals: str, weights: dict[str, Array]) -> DataFrame:
    """(key, order, y): logits of each beat that has two neighbours."""
    return infer(beat_triples(beats, key, order, samples, intervals), "x", "cstrans_classification", weights).select(key, order, "y")


def _typed(net: Net, held):
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = Weights(held.value)
        for x in parts:
            out = []
            for i in range(0, len(x), net.batch):
                batch = np.stack([np.asarray(v, np.float32) for v in x.iloc[i : i + net.batch]])
                y = net.forward(w, batch.reshape(-1, *net.shape))
                out += list(y.reshape(len(y), -1).astype(np.float32))
            yield pd.Series(out)

    return run


# ---- layers as column expressions ----


def swt_kernels(taps: Column) -> Column:
    """The four filters that one kernel makes, as arrays."""
    signed = lambda a: F.transform(a, lambda x, i: F.when(i % 2 == 0, x).otherwise(-x))
    return F.array(taps, F.reverse(taps), signed(taps), signed(F.reverse(taps)))


def time2vec(x: Column, w_linear: float, phi_linear: float, w_periodic: float, phi_periodic: float) -> Column:
    """Time codes added to an array, with the same four weights at every place."""

    def code(v: Column, i: Column) -> Column:
        t = i / F.greatest(F.size(x) - 1, F.lit(1))
        return v + (w_linear * t + phi_linear) + F.sin(w_periodic * t + phi_periodic)

    return F.transform(x, code)


def _dot(x: Column, taps: np.ndarray, first: Column) -> Column:
    """Sum of taps times the values from ``first`` on, zeros beyond the ends."""
    total = F.lit(0.0)
    for j, t in enumerate(taps.tolist()):
        at = first + j
        total = total + t * F.when((at >= 0) & (at < F.size(x)), F.get(x, at)).otherwise(0.0)
    return total


def dwt_bands(x: Column, wavelet: str = "db6") -> Column:
    """Struct of ``low`` and ``high``: the fixed filters of ``dwt_layer`` on one channel, at half the rate."""
    lo, hi, _, _ = filter_bank(wavelet)
    pad = (lo.size - 2) // 2
    half = lambda t: F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / 2).cast("int") - 1), lambda i: _dot(x, t[::-1], 2 * i - pad))
    return F.struct(half(lo).alias("low"), half(hi).alias("high"))


def idwt_up(low: Column, high: Column, wavelet: str = "db6") -> Column:
    """The fixed filters of ``idwt_layer`` on one channel, at twice the rate. They are reversed: it does not undo ``dwt_bands``."""
    _, _, rl, rh = filter_bank(wavelet)
    pad = (rl.size - 2) // 2

    def at(c: Column, taps: np.ndarray, n: Column) -> Column:
        total = F.lit(0.0)
        for k, t in enumerate(taps[::-1].tolist()):
            twice = n + pad - k
            total = total + F.when((twice >= 0) & (twice % 2 == 0) & (twice < 2 * F.size(c)), t * F.get(c, (twice / 2).cast("int"))).otherwise(0.0)
        return total

    return F.transform(F.sequence(F.lit(0), 2 * F.size(low) - 1), lambda n: at(low, rl, n) + at(high, rh, n))
