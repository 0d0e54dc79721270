"""Wavelet transforms as windows over coefficient rows, in DataFrame functions only: one level is one window.

A level's outputs stand at every other place of the signal, which is mirrored half a sample beyond its ends: each is a
weighted sum of the ``taps`` values up to its place. The way back has two sums over neighbouring coefficients, for even and
for odd places. With ``block`` set the windows are those of blocks and their halo (``blocks.spread``), so that no task
holds a whole signal; without, a signal's window is one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.functions import design
from tidewave.operators import blocks, selection
from tidewave.operators.signal import indexed


def _window(rows: DataFrame, key: str, at: str, block: int | None, before: int, after: int):
    """The rows, their window, and whether a row is its own block's."""
    if block is None:
        return rows, Window.partitionBy(key).orderBy(at), F.lit(True)
    return blocks.spread(rows, at, block, before, after), Window.partitionBy(key, "block").orderBy(at), blocks.own(at, block)


def _mirrored(n: Column, nn: Column, reach: int) -> Column:
    """All places from -reach to nn + reach - 1 at which half-sample symmetry repeats sample n: the sample's own for most."""
    low, high, period = -reach, nn + reach - 1, 2 * nn

    def places(start: Column) -> Column:
        first, last = F.ceil((low - start) / period).cast("int"), F.floor((high - start) / period).cast("int")
        return F.when(first <= last, F.transform(F.sequence(first, last), lambda m: start + period * m)).otherwise(F.array().cast("array<bigint>"))

    n = n.cast("long")
    return F.when((n >= reach) & (n < nn - reach), F.array(n)).otherwise(F.concat(places(n), places(-1 - n)))


def analysis(rows: DataFrame, key: str, lo, hi, block: int | None = None, keep: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, n, nn, keep..., carry..., a, d): one level of (key, n, nn, keep..., carry..., v).

    The columns of ``carry`` are arrays: those of places 2n and 2n + 1 go on, joined, with coefficient n. Mirrored samples have none.
    """
    f = len(lo)
    at = F.explode(_mirrored(F.col("n"), F.col("nn"), f - 1)).alias("at")
    met = rows.select(key, "n", "nn", *keep, *carry, "v", at)
    met = met.select(key, "nn", *keep, "v", "at", *(F.when(F.col("at") == F.col("n"), F.col(c)).otherwise(F.array().cast("array<double>")).alias(c) for c in carry))
    met, w, own = _window(met, key, "at", block, f - 1, 0)
    pairs = [F.concat(F.lag(c, 1).over(w), F.col(c)).alias(c) for c in carry]
    lags = met.select(key, "nn", *keep, *pairs, "at", own.alias("own"), *(F.lag("v", k).over(w).alias(f"v{k}") if k else F.col("v").alias("v0") for k in range(f)))
    size = F.floor((F.col("nn") + f - 1) / 2).cast("long")
    odd = lags.where((F.pmod("at", F.lit(2)) == 1) & (F.col("at") >= 1) & (F.col("at") < 2 * size) & F.col("own"))
    weighted = lambda taps: _sum([float(t) * F.col(f"v{k}") for k, t in enumerate(taps)])
    return odd.select(key, F.floor(F.col("at") / 2).cast("long").alias("n"), size.alias("nn"), *keep, *carry, weighted(lo).alias("a"), weighted(hi).alias("d"))


def synthesis(rows: DataFrame, key: str, lo, hi, block: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, n, keep..., v): one level back from (key, n, keep..., a, d)."""
    half = len(lo) // 2 - 1
    met, w, own = _window(rows, key, "n", block, 0, half)
    ahead = lambda c, k: F.lead(c, k).over(w).alias(f"{c}{k}") if k else F.col(c).alias(f"{c}0")
    leads = met.select(key, "n", *keep, own.alias("own"), *(ahead(c, k) for c in "ad" for k in range(half + 1))).where(F.col("own") & F.col(f"a{half}").isNotNull())
    of = lambda r: _sum([float(t[2 * s + r]) * F.col(f"{c}{half - s}") for c, t in (("a", lo), ("d", hi)) for s in range(half + 1)])
    two = F.array(*(F.struct((2 * F.col("n") + r).alias("n"), of(r).alias("v")) for r in (0, 1)))
    return leads.select(key, *keep, F.inline(two))


def layer_analysis(rows: DataFrame, key: str, lo, hi) -> DataFrame:
    """(key, n, low, high): a network's wavelet layer, one level of (key, n, nn, v) with zeros around it and half as many outputs."""
    f = len(lo)
    behind = f // 2  # places from an output's own pair to the last of its taps
    by = F.when(F.col("n") == F.col("nn") - 1, F.sequence(F.lit(0), F.lit(behind))).otherwise(F.array(F.lit(0)))
    rows = rows.select(key, "n", "nn", "v", F.explode(by).alias("by")).select(key, "nn", (F.col("n") + F.col("by")).alias("at"), F.when(F.col("by") == 0, F.col("v")).otherwise(0.0).alias("v"))
    w = Window.partitionBy(key).orderBy("at")
    lags = rows.select(key, "nn", "at", *(F.lag("v", k, 0.0).over(w).alias(f"v{k}") if k else F.col("v").alias("v0") for k in range(f)))
    n = F.floor((F.col("at") - behind) / 2).cast("int")
    weighted = lambda taps: _sum([float(t) * F.col(f"v{k}") for k, t in enumerate(taps)])
    return lags.where((F.pmod(F.col("at") - behind, F.lit(2)) == 0) & (F.col("at") >= behind) & (n < F.floor(F.col("nn") / 2))).select(key, n.alias("n"), weighted(lo).alias("low"), weighted(hi).alias("high"))


def layer_synthesis(rows: DataFrame, key: str, lo, hi) -> DataFrame:
    """(key, n, v): a network's inverse wavelet layer, twice as many values as (key, n, nn, a, d), whose coefficients have zeros around them; the layer holds its taps reversed."""
    pad = len(lo) // 2 - 1
    zeros = (pad + 1) // 2
    reach = lambda start: F.sequence(F.lit(start), F.lit(start + zeros - 1))
    none = F.array().cast("array<int>")
    by = F.concat(F.array(F.lit(0)), F.when(F.col("n") == 0, reach(-zeros)).otherwise(none), F.when(F.col("n") == F.col("nn") - 1, reach(1)).otherwise(none)) if zeros else F.array(F.lit(0))
    wide = rows.select(key, "n", "nn", "a", "d", F.explode(by).alias("by"))
    own = lambda c: F.when(F.col("by") == 0, F.col(c)).otherwise(0.0).alias(c)
    wide = wide.select(key, "nn", (F.col("n") + F.col("by") + zeros).alias("n"), own("a"), own("d"))
    n = F.col("n") - (2 * zeros - pad)
    return synthesis(wide, key, lo[::-1], hi[::-1], keep=("nn",)).where((n >= 0) & (n < 2 * F.col("nn"))).select(key, n.cast("int").alias("n"), "v")


def _sum(terms: list[Column]) -> Column:
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _signal(df: DataFrame, key: str, order, value, block: int | None) -> DataFrame:
    rows = indexed(df, key, order, {"v": value}) if block is None else blocks.numbered(df, key, order, {"v": value})
    return rows.select(key, F.col("n").cast("long").alias("n"), F.col("nn").cast("long").alias("nn"), "v")


def coefficients(df: DataFrame, key: str, order, value, wavelet: str, level: int, block: int | None = None) -> DataFrame:
    """(key, level, band, i, c): details of every level, and the approximation (band a) of the deepest.

    A level's details go on with the approximation they stand at, in an array for each level, so every level is made once and
    none is sorted anew for the rows of another.
    """
    lo, hi, _, _ = design.filter_bank(wavelet)
    rows, done = _signal(df, key, order, value, block), ()
    for lev in range(1, level + 1):
        rows = analysis(rows, key, lo, hi, block, carry=done).select(key, "n", "nn", *done, F.array("d").alias(f"d{lev}"), F.col("a").alias("v"))
        done = (*done, f"d{lev}")
    row = lambda lev, band, i, c: F.struct(F.lit(lev).alias("level"), F.lit(band).alias("band"), i.cast("int").alias("i"), c.alias("c"))

    def listed(lev: int, c: str) -> Column:
        return F.transform(c, lambda x, at: row(lev, "d", F.col("n") * (1 << level - lev) + at, x))

    details = [listed(lev, c) for lev, c in enumerate(done, 1)]
    return rows.select(key, F.inline(F.concat(F.array(row(level, "a", F.col("n"), F.col("v"))), *details)))


def signal_of(coeffs: DataFrame, key: str, wavelet: str, levels: int, block: int | None = None) -> DataFrame:
    """(key, n, v) from rows as of ``coefficients`` with at most ``levels`` levels; each signal begins at the level of its band a."""
    _, _, lo, hi = design.filter_bank(wavelet)
    part = lambda lev, band, c: coeffs.where((F.col("level") == lev) & (F.col("band") == band)).select(key, F.col("i").cast("long").alias("n"), F.col("c").alias(c))
    rows = part(levels, "a", "a")
    for lev in range(levels, 0, -1):
        rows = synthesis(_met(rows, part(lev, "d", "d"), key), key, lo, hi, block).withColumnRenamed("v", "a")
        rows = rows.unionByName(part(lev - 1, "a", "a")) if lev > 1 else rows
    return rows.select(key, F.col("n").cast("int").alias("n"), F.col("a").alias("v"))


def _met(a: DataFrame, d: DataFrame, key: str) -> DataFrame:
    """Approximation and detail of a place; an approximation may come back one longer, and its last place then has no detail."""
    d = d.select(F.col(key).alias("__k"), F.col("n").alias("__n"), *(c for c in d.columns if c not in (key, "n")))
    return a.join(d, F.col(key).eqNullSafe(F.col("__k")) & (F.col("n") == F.col("__n"))).drop("__k", "__n")


def shrunk(c: Column, t: Column, mode: str) -> Column:
    """A coefficient under a threshold. 0 / 0 is not a number, as in a signal of zeros."""
    size, nan = F.abs(c), F.lit(float("nan"))
    ratio = lambda x: F.when(size == 0, F.when(t == 0, nan).otherwise(F.lit(float("inf")))).otherwise(x)
    if mode == "soft":
        return F.when((size == 0) & (t == 0), nan).when(size == 0, 0.0).otherwise(c * F.greatest(F.lit(0.0), 1 - t / F.when(size > 0, size)))
    if mode == "hard":
        return F.when(size < t, 0.0).otherwise(c)
    if mode == "garrote":
        return F.when(size < t, 0.0).otherwise(c - ratio(t * t / F.when(size > 0, c)))
    if mode == "greater":
        return F.when(c < t, 0.0).otherwise(c)
    if mode == "less":
        return F.when(c > t, 0.0).otherwise(c)
    raise ValueError(f"threshold mode {mode!r} is not soft, hard, garrote, greater or less")


def _cleaned(df: DataFrame, key: str, order, value, wavelet: str, level: int, block: int | None, mode: str | None) -> DataFrame:
    """(key, n, v): details thresholded by ``mode``, or (None) without the approximation.

    How deep a signal goes depends on its length: it leaves the way down at its own last level.
    """
    lo, hi, rlo, rhi = design.filter_bank(wavelet)
    f, nn = len(lo), F.col("nn")
    rows = _signal(df, key, order, value, block).withColumn("whole", nn)
    useful = F.when(nn >= f - 1, F.floor(F.log2(nn / max(1, f - 1)) + 1e-12)).otherwise(0) if f > 1 else F.lit(0)
    rows = rows.withColumn("depth", F.greatest(F.lit(1), F.least(F.lit(level), useful)).cast("int"))
    keep, details = ("whole", "depth"), []
    deepest = level
    for lev in range(1, deepest + 1):
        parts = analysis(rows.where(F.col("depth") >= lev), key, lo, hi, block, keep)
        details.append(parts)
        rows = parts.select(key, "n", "nn", *keep, F.col("a").alias("v"))
    if mode is not None:
        finest = details[0].select(key, F.abs("d").alias("x"))
        middle = selection.medians(finest, key, "x").select(F.col(key).alias("__k"), F.col("median")) if block is not None else finest.groupBy(F.col(key).alias("__k")).agg(F.percentile("x", F.lit(0.5)).alias("median"))
    back = None
    for lev in range(deepest, 0, -1):
        parts = details[lev - 1]
        d = F.col("d")
        if mode is not None:
            parts = parts.join(middle, F.col(key).eqNullSafe(F.col("__k"))).drop("__k")
            d = shrunk(d, F.col("median") / 0.6745 * F.sqrt(2 * F.log("whole")), mode)
        last = parts.where(F.col("depth") == lev).select(key, "n", *keep, (F.col("a") if mode is not None else F.lit(0.0)).alias("a"), d.alias("d"))
        if back is not None:
            deeper = _met(back, parts.where(F.col("depth") > lev).select(key, "n", d.alias("d")), key)
            last = last.unionByName(deeper)
        back = synthesis(last, key, rlo, rhi, block, keep).withColumnRenamed("v", "a")
    return back.where(F.col("n") < F.col("whole")).select(key, F.col("n").cast("int").alias("n"), F.col("a").alias("v"))


def denoised(df: DataFrame, key: str, order, value, wavelet: str, level: int, mode: str, block: int | None = None) -> DataFrame:
    """(key, n, v): details thresholded at sigma sqrt(2 ln N), sigma from the median size of the finest ones."""
    shrunk(F.lit(0.0), F.lit(0.0), mode)  # an error on the driver for an unknown mode
    return _cleaned(df, key, order, value, wavelet, level, block, mode)


def without_baseline(df: DataFrame, key: str, order, value, wavelet: str, level: int, block: int | None = None) -> DataFrame:
    """(key, n, v): the signal without its approximation band."""
    return _cleaned(df, key, order, value, wavelet, level, block, None)

