"""Stacks of cardiac cycles, and short-time spectra."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.functions import kernels
from tidewave.operators.signal import checked, indexed

TARGET, CYCLES, SHORTEST = 384, 32, 8


def segment_bounds(peaks: DataFrame, lengths: DataFrame, key: str, num_cycles: int = CYCLES, strict: bool = True) -> DataFrame:
    """(key, cycle, start, end), half open, from midpoint to midpoint of ``peaks`` (key, peak_no, r); ``lengths`` is (key, nn).

    A signal with a single peak is an error, or has no rows if not ``strict``.
    """
    w = Window.partitionBy(key).orderBy("peak_no")
    place = F.when(F.col("peak_no").eqNullSafe(F.lag("peak_no").over(w)), F.raise_error(F.lit("tied order")).cast("int")).otherwise(F.coalesce(F.col("r"), F.raise_error(F.lit("null in r")).cast("int")))
    peaks = peaks.select(key, "peak_no", place.alias("r"))
    rows = peaks.select(key, "peak_no", "r", F.lead("r").over(w).alias("next"), F.count("*").over(Window.partitionBy(key)).alias("n_peaks"))
    if strict:
        rows = rows.withColumn("r", F.when(F.col("n_peaks") < 2, F.raise_error(F.lit("a cycle needs two peaks")).cast("int")).otherwise(F.col("r")))
    rows = rows.where("next is not null")
    end = F.least(F.col("nn"), F.floor((F.col("r") + F.col("next")) / 2).cast("int"))
    first = F.greatest(F.lit(0), F.col("r") - F.floor((F.col("next") - F.col("r")) / 2).cast("int"))
    rows = rows.join(lengths.select(key, F.col("nn").cast("int").alias("nn")), key).withColumn("end", end)
    rows = rows.withColumn("start", F.coalesce(F.lag("end").over(w), first)).where("end > start")
    return rows.withColumn("cycle", F.row_number().over(w) - 1).where(F.col("cycle") < num_cycles).select(key, "cycle", "start", "end")


def bounds_of(n: int, peaks: np.ndarray, num_cycles: int = CYCLES) -> list[tuple[int, int]]:
    if len(peaks) < 2:
        raise ValueError("a cycle needs two peaks")
    ends = [min(n, int(a + b) // 2) for a, b in zip(peaks, peaks[1:], strict=False)]
    starts = [max(0, int(peaks[0]) - int(peaks[1] - peaks[0]) // 2), *ends]
    return [(s, e) for s, e in zip(starts, ends, strict=False) if e > s][:num_cycles]


def stack(x: np.ndarray, peaks: np.ndarray, stats: tuple[float, float] | None = None, target: int = TARGET, num_cycles: int = CYCLES, shortest: int = SHORTEST) -> tuple[np.ndarray, list[int], float, float]:
    """Resampled, min-max scaled cycles (num_cycles, target), their lengths (0: none), minimum and maximum."""
    rows, lengths = np.zeros((num_cycles, target)), [0] * num_cycles
    for i, (s, e) in enumerate(bounds_of(x.size, peaks, num_cycles)):
        if e - s >= shortest:
            rows[i], lengths[i] = kernels.fourier_resample(x[s:e], target), e - s
    valid = np.array(lengths) > 0
    if not valid.any():
        raise ValueError("all cycles are too short")
    low, high = stats or (float(rows[valid].min()), float(rows[valid].max()))
    rows[valid] = (rows[valid] - low) / (high - low if high > low else 1.0)
    return rows, lengths, low, high


def unstack(rows: np.ndarray, lengths: list[int], low: float, high: float) -> np.ndarray:
    """The signal back: valid cycles at their own lengths, one after the other."""
    scale = high - low if high > low else 1.0
    parts = [kernels.fourier_resample(r * scale + low, n) for r, n in zip(rows, lengths, strict=True) if n > 0]
    return np.concatenate(parts) if parts else np.empty(0)


#: Samples in a bucket of the join with cycles.
BUCKET = 1 << 12


def _weight(pos: Column, size: Column, i: Column, target: Column) -> Column:
    """What sample ``pos`` of a period of ``size`` adds to sample ``i`` of its band-limited copy of ``target``: a Dirichlet kernel,
    and at even lengths the share of the highest rate."""
    x, least = i / target - pos / size, F.least(size, target)
    turns = 2 * F.floor((least - 1) / 2) + 1
    below = F.when(F.abs(F.sin(math.pi * x)) < 1e-12, turns).otherwise(F.sin(math.pi * turns * x) / F.when(F.abs(F.sin(math.pi * x)) >= 1e-12, F.sin(math.pi * x)))
    up, down = F.cos(math.pi * least * x), 2 * F.cos(math.pi * least * pos / size) * F.when(i % 2 == 0, 1.0).otherwise(-1.0)
    half = F.when(least % 2 == 1, 0.0).when(target > size, up).otherwise(down)
    return F.when(size == target, 1.0).otherwise((below + half) / size)


def resampled(rows: DataFrame, keys: list[str], size: Column, target: Column) -> DataFrame:
    """(keys..., i, v): each period of ``size`` samples (rows keys..., pos, v) at ``target`` samples; every pair of samples is a row that
    meets its weight and is summed, on the map side first."""
    pairs = rows.select(*keys, "pos", "v", size.alias("size"), target.alias("target"))
    places = F.when(F.col("size") == F.col("target"), F.array(F.col("pos"))).otherwise(F.sequence(F.lit(0), F.col("target") - 1))
    pairs = pairs.select("*", F.explode(places).alias("i"))
    return pairs.groupBy(*keys, "i").agg(F.sum(_weight(F.col("pos"), F.col("size"), F.col("i"), F.col("target")) * F.col("v")).alias("v"))


def resample(df: DataFrame, key: str, order, value, target: int) -> DataFrame:
    """(key, n, v): each signal, as one period, at ``target`` samples."""
    rows = indexed(df, key, order, {"v": value}).withColumnRenamed("n", "pos")
    return resampled(rows, [key], F.col("nn"), F.lit(target)).select(key, F.col("i").alias("n"), "v")


def _checked_samples(signals: DataFrame, key: str) -> DataFrame:
    """(key, n, v, bucket); a null value, a null place and a tied one are errors."""
    rows = signals.select(key, F.coalesce(F.col("n"), F.raise_error(F.lit("null in n")).cast("int")).cast("int").alias("n"), checked("v", "v"))
    rows = rows.withColumn("bucket", F.floor(F.col("n") / BUCKET).cast("int"))
    w = Window.partitionBy(key, "bucket").orderBy("n")
    return rows.withColumn("v", F.when(F.lag("n").over(w) == F.col("n"), F.raise_error(F.lit("tied order")).cast("double")).otherwise(F.col("v")))


def preprocess(signals: DataFrame, peaks: DataFrame, key: str, stats: tuple[float, float] | None = None, target: int = TARGET, num_cycles: int = CYCLES, shortest: int = SHORTEST, strict: bool = True) -> DataFrame:
    """(key, cycle, orig_len, vals, g_min, g_max), one row per cycle of the stack; signals (key, n, v), peaks (key, peak_no, r).

    A signal without two peaks or a valid cycle is an error, or has no rows if not ``strict``. Samples meet their cycles in a
    join by buckets of ``BUCKET`` samples, so no signal is put together anywhere; peaks of no signal are left out.
    """
    lengths = signals.groupBy(key).agg((F.max("n") + 1).alias("nn"))
    found = segment_bounds(peaks, lengths, key, num_cycles, strict).withColumn("len", F.col("end") - F.col("start"))
    longest = found.groupBy(F.col(key).alias("__k")).agg(F.max("len").alias("longest"))
    whole = lengths.join(longest, F.col(key).eqNullSafe(F.col("__k")), "left" if strict else "inner")
    last = F.lit(num_cycles - 1)
    if strict:
        error = lambda text: F.raise_error(F.lit(text)).cast("int")
        last = F.when(F.col("longest").isNull(), error("a cycle needs two peaks")).when(F.col("longest") < shortest, error("all cycles are too short")).otherwise(last)
    else:
        whole = whole.where(F.col("longest") >= shortest)
    places = whole.select(key, F.explode(F.sequence(F.lit(0), last)).alias("cycle"))

    parts = found.where(F.col("len") >= shortest)
    buckets = F.sequence(F.floor(F.col("start") / BUCKET).cast("int"), F.floor((F.col("end") - 1) / BUCKET).cast("int"))
    parts = parts.select(F.col(key).alias("__k"), "cycle", "start", "end", "len", F.explode(buckets).alias("__b"))
    met = _checked_samples(signals, key).join(parts, F.col(key).eqNullSafe(F.col("__k")) & (F.col("bucket") == F.col("__b")) & (F.col("n") >= F.col("start")) & (F.col("n") < F.col("end")))
    met = met.select(key, "cycle", "len", (F.col("n") - F.col("start")).alias("pos"), "v")
    points = resampled(met, [key, "cycle", "len"], F.col("len"), F.lit(target))
    rows = points.groupBy(key, "cycle", "len").agg(F.sort_array(F.collect_list(F.struct("i", "v")))["v"].alias("raw"))  # of ``target`` values
    rows = rows.select(F.col(key).alias("__k"), F.col("cycle").alias("__c"), "len", "raw")
    out = places.join(rows, F.col(key).eqNullSafe(F.col("__k")) & (F.col("cycle") == F.col("__c")), "left")  # an inner join with nothing would never come to the errors above
    if stats is None:  # the extremes of a signal's cycles, of which there are ``num_cycles``, so that no cycle is resampled twice
        w = Window.partitionBy(key)
        out = out.withColumns({"g_min": F.min(F.array_min("raw")).over(w), "g_max": F.max(F.array_max("raw")).over(w)})
    else:
        out = out.withColumns({c: F.lit(float(v)) for v, c in zip(stats, ("g_min", "g_max"), strict=True)})
    scale = F.when(F.col("g_max") > F.col("g_min"), F.col("g_max") - F.col("g_min")).otherwise(1.0)
    vals = F.coalesce(F.transform("raw", lambda v: (v - F.col("g_min")) / scale), F.array_repeat(F.lit(0.0), target))
    return out.select(key, "cycle", F.coalesce("len", F.lit(0)).cast("int").alias("orig_len"), vals.alias("vals"), "g_min", "g_max")


def postprocess(scc: DataFrame, key: str) -> DataFrame:
    """(key, n, v) from the rows of ``preprocess``; each cycle is resampled on its own, its place is a running sum of lengths.

    A null among the values is an error.
    """
    w = Window.partitionBy(key).orderBy("cycle")
    placed = scc.where("orig_len > 0").withColumn("offset", F.sum("orig_len").over(w) - F.col("orig_len"))
    scale = F.when(F.col("g_max") > F.col("g_min"), F.col("g_max") - F.col("g_min")).otherwise(1.0)
    points = placed.select(key, "cycle", "offset", "orig_len", F.size("vals").alias("size"), scale.alias("scale"), "g_min", F.posexplode("vals").alias("pos", "x"))
    points = points.withColumn("v", checked("x", "v") * F.col("scale") + F.col("g_min"))
    back = resampled(points, [key, "cycle", "offset"], F.col("size"), F.col("orig_len"))
    return back.select(key, (F.col("offset") + F.col("i")).cast("int").alias("n"), "v")


NPERSEG, NOVERLAP, N_FREQ, N_FRAMES = 256, 224, 129, 32


def spectrum(x: np.ndarray, fs: float, nperseg: int = NPERSEG, noverlap: int = NOVERLAP, n_freq: int = N_FREQ, n_frames: int = N_FRAMES, stats: tuple | None = None, kind=np.float32) -> tuple[np.ndarray, dict]:
    """Standardised planes (2, n_freq, n_frames) of the real and imaginary parts (float32 unless ``kind`` says otherwise), and what is needed to go back."""
    z = kernels.stft(np.asarray(x, float).ravel(), nperseg, noverlap)
    if z.shape[0] < n_freq or z.shape[1] < n_frames:
        raise ValueError(f"{n_freq} frequencies by {n_frames} frames asked for, {z.shape[0]} by {z.shape[1]} found")
    planes = np.stack([z.real, z.imag])[:, :n_freq, :n_frames]
    loc, scale = stats or (planes.mean(axis=(1, 2), keepdims=True), planes.std(axis=(1, 2), keepdims=True) + 1e-8)
    meta = {"stats": (loc, scale), "fs": fs, "nperseg": nperseg, "noverlap": noverlap, "n": int(np.size(x)), "full_shape": z.shape}
    return ((planes - loc) / scale).astype(kind), meta


def from_spectrum(planes: np.ndarray, meta: dict) -> np.ndarray:
    """The signal back; what was cropped is zero."""
    loc, scale = meta["stats"]
    planes = np.asarray(planes, float) * scale + loc
    z = np.zeros(meta["full_shape"], complex)
    z[: planes.shape[1], : planes.shape[2]] = planes[0] + 1j * planes[1]
    x = kernels.istft(z, meta["nperseg"], meta["noverlap"])[: meta["n"]]
    return np.concatenate([x, np.zeros(meta["n"] - x.size)])


META = ("loc_re", "loc_im", "scale_re", "scale_im", "fs", "nperseg", "noverlap", "n", "full_freq", "full_frames")
#: Cells of the table of windowed waves (nperseg by frequencies), which is broadcast.
MAX_BASIS = 1 << 22


def _basis(df: DataFrame, size: int, n_freq: int) -> DataFrame:
    """(k, f, re, im): wave f at place k under the window, scaled by the window's sum."""
    if size * n_freq > MAX_BASIS:
        raise ValueError(f"{size} places by {n_freq} frequencies are more than {MAX_BASIS} cells")
    n = df.sparkSession.range(size * n_freq)
    k, f = (F.col("id") % size).cast("int"), F.floor(F.col("id") / size).cast("int")
    angle = 2 * math.pi / size * (k * f % size)
    w = (0.5 - 0.5 * F.cos(2 * math.pi / size * k)) / float(kernels.hann(size).sum())
    return F.broadcast(n.select(k.alias("k"), f.alias("f"), (w * F.cos(angle)).alias("re"), (-w * F.sin(angle)).alias("im")))


def stft_rows(rows: DataFrame, key: str, nperseg: int = NPERSEG, noverlap: int = NOVERLAP, n_freq: int | None = None, n_frames: int | None = None) -> DataFrame:
    """(key, t, f, re, im) of (key, n, v): frames under a periodic Hann window, half a frame of zeros before place 0.

    Samples are dealt to the frames that hold them and meet the waves in a join; frames without a sample have no rows.
    """
    if key in ("t", "f", "re", "im"):
        raise ValueError(f"the key column is named like a result, {key}: rename it")
    hop = nperseg - noverlap
    at = F.col("n") + nperseg // 2
    first, last = F.greatest(F.lit(0), F.ceil((at - nperseg + 1) / hop)).cast("int"), F.floor(at / hop).cast("int")
    if n_frames is not None:
        last = F.least(last, F.lit(n_frames - 1))
    framed = rows.select(F.col(key).alias("__key"), at.cast("int").alias("at"), "v", F.explode(F.when(first <= last, F.sequence(first, last))).alias("t"))
    framed = framed.select("__key", "t", "v", (F.col("at") - F.col("t") * hop).alias("k"))
    met = framed.join(_basis(rows, nperseg, n_freq or nperseg // 2 + 1), "k")
    return met.groupBy(F.col("__key").alias(key), "t", "f").agg(F.sum(F.col("v") * F.col("re")).alias("re"), F.sum(F.col("v") * F.col("im")).alias("im"))


def stft(arrays: DataFrame, key: str, value: str, fs: float = 250.0, nperseg: int = NPERSEG, noverlap: int = NOVERLAP, n_freq: int = N_FREQ, n_frames: int = N_FRAMES, kind: str = "float", stats: tuple | None = None) -> DataFrame:
    """(key, re, im, meta): per signal (an array column) the standardised planes, flattened by frequency, and a struct for the way back.

    ``stats``, two means and two deviations ((re, im), (re, im)), are used for all signals in place of each one's own. A null
    array, a null element, two signals of one key and a signal of too few frames are errors.
    """
    hop = nperseg - noverlap
    n, full_freq = F.size("a"), nperseg // 2 + 1
    full_frames = (F.ceil((n + 2 * (nperseg // 2) - nperseg) / hop) + 1).cast("int")
    outer, key = key, "__key"
    given = arrays.select(F.col(outer).alias(key), F.coalesce(F.col(value).cast("array<double>"), F.raise_error(F.lit(f"null in {value}")).cast("array<double>")).alias("a"))
    enough = F.when((full_frames < n_frames) | F.lit(full_freq < n_freq), F.raise_error(F.concat(F.lit(f"{n_freq} frequencies by {n_frames} frames asked for, {full_freq} by "), full_frames.cast("string"), F.lit(" found"))).cast("int")).otherwise(full_frames)
    cells = stft_rows(given.select(key, F.posexplode("a").alias("n", "x")).select(key, "n", checked("x", value).alias("v")), key, nperseg, noverlap, n_freq, n_frames)
    # frames of zeros alone count too, so sums are over what there is and divided by all cells
    total = float(n_freq * n_frames)
    shape = given.groupBy(key).agg(F.count("*").alias("signals"), F.max(n).alias("n"), F.max(enough).alias("full_frames"))
    shape = shape.withColumn("n", F.when(F.col("signals") > 1, F.raise_error(F.lit("two signals of one key")).cast("int")).otherwise(F.col("n")))
    listed = cells.groupBy(F.col(key).alias("__k")).agg(F.sort_array(F.collect_list(F.struct((F.col("f") * n_frames + F.col("t")).alias("p"), "re", "im"))).alias("c"))  # n_freq * n_frames at most
    out = shape.join(listed, F.col(key).eqNullSafe(F.col("__k")), "left")
    filled = lambda c: F.when(F.size("c") == int(total), F.col(f"c.{c}")).otherwise(_filled(c, int(total)))
    out = out.select(key, "n", "full_frames", filled("re").alias("re"), filled("im").alias("im"))
    if stats is None:
        mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v) / total
        out = out.withColumns({"loc_re": mean("re"), "loc_im": mean("im")})
        spread = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, v: a + (v - F.col(f"loc_{c}")) * (v - F.col(f"loc_{c}"))) / total) + 1e-8
        out = out.withColumns({"scale_re": spread("re"), "scale_im": spread("im")})
    else:
        known = [float(x) for pair in stats for x in np.ravel(pair)]
        out = out.withColumns({c: F.lit(x) for c, x in zip(META[:4], known, strict=True)})
    scaled = lambda c: F.transform(c, lambda v: (v - F.col(f"loc_{c}")) / F.col(f"scale_{c}")).cast(f"array<{kind}>").alias(c)
    fixed = {"fs": F.lit(float(fs)), "nperseg": F.lit(nperseg), "noverlap": F.lit(noverlap), "full_freq": F.lit(full_freq)}
    return out.select(F.col(key).alias(outer), scaled("re"), scaled("im"), F.struct(*(fixed.get(c, F.col(c)).alias(c) for c in META)).alias("meta"))


def _filled(c: str, total: int) -> Column:
    """The cells of a plane in order, with zeros for those of frames that hold no sample."""
    there = F.map_from_entries(F.transform(F.coalesce("c", F.array().cast("array<struct<p:int,re:double,im:double>>")), lambda x: F.struct(x["p"], x[c])))
    return F.transform(F.sequence(F.lit(0), F.lit(total - 1)), lambda p: F.coalesce(F.try_element_at(there, p), F.lit(0.0)))


def istft(spectra: DataFrame, key: str, n_freq: int = N_FREQ, n_frames: int = N_FRAMES) -> DataFrame:
    """(key, v): arrays back from the rows of ``stft``; what was cropped is zero. All rows are of one nperseg and noverlap.

    Cells meet the waves in a join, are added where frames overlap, and divided by the power of the windows there.
    """
    shapes = spectra.select("meta.nperseg", "meta.noverlap").distinct().limit(2).collect()
    if len(shapes) > 1:
        raise ValueError("spectra of different frames: give them one kind at a time")
    size, overlap = shapes[0] if shapes else (NPERSEG, NOVERLAP)
    hop, half = size - overlap, size // 2
    window = kernels.hann(size)
    outer, key = key, "__key"
    spectra = spectra.select(F.col(outer).alias(key), "re", "im", "meta")
    cells = spectra.select(key, "meta", F.posexplode(F.arrays_zip("re", "im")).alias("p", "z"))
    value = lambda c: checked(F.col(f"z.{c}"), c) * F.col(f"meta.scale_{c}") + F.col(f"meta.loc_{c}")
    cells = cells.select(key, F.col("meta.n").alias("n"), F.col("meta.full_frames").alias("full"), F.floor(F.col("p") / n_frames).cast("int").alias("f"), (F.col("p") % n_frames).alias("t"), value("re").alias("zr"), value("im").alias("zi"))
    # both sides of the spectrum but for its ends; the waves carry window / sum already
    sides = F.when((F.col("f") == 0) | (F.col("f") * 2 == size), 1.0).otherwise(2.0) * float(window.sum() ** 2 / size)
    met = cells.join(_basis(spectra, size, n_freq), "f").withColumn("at", F.col("t") * hop + F.col("k") - half)
    met = met.where((F.col("at") >= 0) & (F.col("at") < F.col("n")) & (F.col("at") < (F.col("full") - 1) * hop))
    sums = met.groupBy(key, "n", "full", "at").agg(F.sum(sides * (F.col("zr") * F.col("re") + F.col("zi") * F.col("im"))).alias("v"))
    # the windows' power at a place: of all frames, also those cropped
    first, last = F.greatest(F.lit(0), F.ceil((F.col("at") + half - size + 1) / hop)), F.least(F.col("full") - 1, F.floor((F.col("at") + half) / hop))
    squares = F.array(*(F.lit(float(w * w)) for w in window)) if size <= 512 else None
    square = (lambda k: F.get(squares, k)) if squares is not None else (lambda k: F.pow(0.5 - 0.5 * F.cos(2 * math.pi / size * k), 2))
    power = F.aggregate(F.sequence(first.cast("int"), last.cast("int")), F.lit(0.0), lambda a, t: a + square((F.col("at") + half - t * hop).cast("int")))
    sums = sums.select(key, "n", "at", (F.col("v") / F.when(power > 1e-10, power).otherwise(1.0)).alias("v"))
    listed = sums.groupBy(F.col(key).alias("__k")).agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m"))
    out = spectra.select(key, F.col("meta.n").alias("n")).join(listed, F.col(key).eqNullSafe(F.col("__k")), "left")
    places = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    return out.select(F.col(key).alias(outer), F.transform(places, lambda p: F.coalesce(F.try_element_at(F.col("m"), p), F.lit(0.0))).alias("v"))
