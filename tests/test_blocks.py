"""Signals in blocks against whole ones, wavelets and medians as joins and windows against the array kernels, null and tied input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.functions import design, kernels, sections
from tidewave.operators import blocks, cycles, networks, selection, signal, static, wavelets

rng = np.random.default_rng(5)
SIGNALS = {1: 1, 2: 2, 3: 7, 4: 20, 5: 333, 6: 1100}
X = {k: rng.standard_normal(n) for k, n in SIGNALS.items()}
X[7] = np.zeros(40)


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(k, i, float(v)) for k, x in X.items() for i, v in enumerate(x)], "k long, t int, v double").repartition(5).cache()


def signals(out, name="v"):
    found = {}
    for r in out.collect():
        assert found.setdefault(r.k, {}).setdefault(r.n, r[name]) is r[name]
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in found.items()}


def same(out, f, keys=tuple(X)):
    got = signals(out)
    assert set(got) == set(keys)
    for k in keys:
        want = f(X[k])
        assert got[k].shape == want.shape and np.allclose(got[k], want, atol=1e-9, equal_nan=True), k


def test_numbering(df):
    rows = blocks.numbered(df, "k", "t", {"v": "v"})
    same(rows, lambda x: x)
    assert {(r.k, r.nn) for r in rows.select("k", "nn").distinct().collect()} == {(k, x.size) for k, x in X.items()}


SOS = design.iir_sections(3, 40, fs=250)


@pytest.mark.parametrize(("block", "fan"), [(7, 2), (5000, 4096)])
def test_sections_over_blocks(df, block, fan):
    same(blocks.sections_filter(df, "k", "t", "v", SOS, False, block, fan), lambda x: kernels.sos_filter(SOS, x))
    same(blocks.sections_filter(df, "k", "t", "v", SOS, True, block, fan), lambda x: kernels.sos_zero_phase(SOS, x))


@pytest.mark.parametrize("n", [1, 5, 2047, 2048, 5000, 20_001])
def test_fast_runs(n):
    sos = design.iir_sections(5, [20, 60], btype="bandpass", ftype="ellip", rp=1, rs=40, fs=250)
    x, state = rng.standard_normal(n), rng.standard_normal(2 * len(sos))
    end = state.reshape(-1, 2).copy()
    y, got = sections.run(sos, x, state)
    assert np.allclose(y, kernels.sos_filter(sos, x, end), atol=1e-11) and np.allclose(got, end.ravel(), atol=1e-11)
    assert np.allclose(sections.ringing(sos, 50) @ state, kernels.sos_filter(sos, np.zeros(50), state.reshape(-1, 2).copy()))


def test_one_long_signal_over_many_tasks(spark):
    """A signal of 300,000 samples in blocks of 10,000: no task gets it whole, and it equals the whole filter to 1e-9."""
    n, block = 300_000, 10_000
    df = spark.range(n, numPartitions=16).select(F.lit(1).alias("k"), F.col("id").alias("t"), (F.sin(F.col("id") / 9) + F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("v"))
    x = df.orderBy("t").toPandas()["v"].to_numpy()
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = blocks.numbered(df, "k", "t", {"v": "v"})
        assert max(r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()) < n / 4
        got = static.iir_filter(df, "k", "t", "v", 4, 20, fs=250, zero_phase=False, block=block).withColumn("task", F.spark_partition_id()).toPandas().sort_values("n")
        assert got["task"].nunique() >= 8 and got["task"].value_counts().max() < n / 4
        assert np.abs(got["v"] - kernels.sos_filter(design.iir_sections(4, 20, fs=250), x)).max() < 1e-9
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("taps", [5, 101])
@pytest.mark.parametrize("block", [16])
def test_fir_over_blocks(df, taps, block):
    t = design.fir_taps(taps, 40, fs=250)
    same(static.fir_filter(df, "k", "t", "v", taps, 40, fs=250, block=block), lambda x: kernels.fir_zero_phase(t, x))
    same(static.fir_filter(df, "k", "t", "v", taps, 40, fs=250, zero_phase=False, block=block), lambda x: kernels.fir(t, x))


@pytest.mark.parametrize("block", [3, 64])
def test_moving_windows_over_blocks(df, block):
    long = df.where("k in (4, 5, 6)")
    same(static.moving_average(long, "k", "t", "v", 9, block=block), lambda x: np.convolve(np.pad(x, 4, mode="reflect"), np.ones(9) / 9, "valid"), (4, 5, 6))
    same(static.moving_median(long, "k", "t", "v", 9, block=block), lambda x: np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x, 4), 9), axis=1), (4, 5, 6))
    with pytest.raises(Exception, match="more than the signal has"):
        static.moving_average(df, "k", "t", "v", 9, block=block).collect()


@pytest.mark.parametrize(("wavelet", "level", "block"), [("haar", 2, 16), ("db4", 3, None), ("sym5", 1, 64)])
def test_wavelets_as_windows(df, wavelet, level, block):
    c = static.dwt_analysis(df, "k", "t", "v", wavelet, level, block=block)
    found = {}
    for r in c.collect():
        found.setdefault((r.k, r.level, r.band), {})[r.i] = r.c
    for k, x in X.items():
        for (lev, band), want in zip([(level, "a"), *((n, "d") for n in range(level, 0, -1))], kernels.decompose(x, wavelet, level), strict=True):
            assert np.allclose([found[k, lev, band][i] for i in range(want.size)], want, atol=1e-10) and len(found[k, lev, band]) == want.size
    back = signals(static.dwt_synthesis(c, "k", wavelet, block=block))
    assert all(np.abs(back[k][: x.size] - x).max() < 1e-10 for k, x in X.items())
    same(static.wavelet_baseline_removal(df, "k", "t", "v", wavelet, level, block=block), lambda x: kernels.wavelet_baseline(x, wavelet, level))


@pytest.mark.parametrize(("mode", "block"), [("soft", None), ("less", None), ("garrote", 16)])
def test_denoising_as_windows(df, mode, block):
    same(static.wavelet_denoising(df, "k", "t", "v", "db2", 2, mode, block=block), lambda x: kernels.wavelet_denoise(x, "db2", 2, mode))


def test_wavelets_run_in_the_jvm_only(df):
    for out in (static.wavelet_denoising(df, "k", "t", "v"), static.dwt_synthesis(static.dwt_analysis(df, "k", "t", "v"), "k", levels=1), static.wavelet_baseline_removal(df, "k", "t", "v", "db2", 2, block=64)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_unknown_threshold_modes_are_errors(df):
    with pytest.raises(ValueError, match="is not soft"):
        static.wavelet_denoising(df, "k", "t", "v", mode="firm")
    assert wavelets.shrunk(F.lit(1.0), F.lit(1.0), "soft") is not None


@pytest.mark.parametrize(("cells", "gather"), [(4096, 1 << 15), (3, 1)])
def test_medians(spark, cells, gather):
    groups = {k: np.round(x, 1) for k, x in X.items()} | {9: np.full(300, 5.0), 10: np.array([1e308, -1e308]), 11: np.array([0.0, -0.0, 1.0]), 12: np.repeat([1.0, 2.0], 50), None: np.array([3.0, 4.0, 9.0, 1.0])}
    df = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [(8, None), (9, None)], "k long, x double").repartition(4)
    got = {r.k: (r.n, r.median) for r in selection.medians(df, "k", "x", cells, gather).collect()}
    assert got.keys() == groups.keys()
    for k, x in groups.items():
        assert got[k][0] == x.size and got[k][1] == pytest.approx(np.median(x), abs=1e-12)
    assert selection.medians(df.limit(0), "k", "x").count() == 0


def wide(spark, rows):
    return spark.createDataFrame(rows, "k long, t int, v double")


BLOCKED = {
    "moving_average": lambda d: static.moving_average(d, "k", "t", "v", 3, block=8),
    "moving_median": lambda d: static.moving_median(d, "k", "t", "v", 3, block=8),
    "fir": lambda d: static.fir_filter(d, "k", "t", "v", 5, 40, fs=250, block=8),
    "fir_long": lambda d: static.fir_filter(d, "k", "t", "v", 101, 40, fs=250, zero_phase=False, block=8),
    "iir": lambda d: static.iir_filter(d, "k", "t", "v", 2, 40, fs=250, block=8),
    "wavelet": lambda d: static.wavelet_denoising(d, "k", "t", "v", block=8),
    "dwt": lambda d: static.dwt_analysis(d, "k", "t", "v", block=8),
    "resample": lambda d: cycles.resample(d, "k", "t", "v", 16),
    "scc": lambda d: cycles.preprocess(d.withColumnRenamed("t", "n"), wide(d.sparkSession, [(k, i, 10.0 * i) for k in (1, 2) for i in range(1, 4)]).select("k", F.col("t").alias("peak_no"), F.col("v").cast("int").alias("r")), "k", shortest=3, strict=False),
    "stft": lambda d: cycles.stft(d.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("t", "v")))["v"].alias("v")), "k", "v", nperseg=8, noverlap=4, n_freq=5, n_frames=4),
}


@pytest.mark.parametrize("name", BLOCKED)
def test_no_operator_takes_nulls_or_tied_orders(spark, name):
    rows = [(1, i, float(i % 7)) for i in range(40)]
    assert BLOCKED[name](wide(spark, rows)).count() > 0
    with pytest.raises(Exception, match="null in"):
        BLOCKED[name](wide(spark, [*rows, (1, 40, None)])).collect()
    if name != "stft":  # an array has no order to be tied
        with pytest.raises(Exception, match="tied order"):
            BLOCKED[name](wide(spark, [*rows[:20], (1, 15, 3.0), *rows[20:]])).collect()


def test_cycles_and_spectra_refuse_nulls(spark):
    s = spark.createDataFrame([(1, i, float(i)) for i in range(60)], "k long, n int, v double")
    peaks = lambda r: spark.createDataFrame(r, "k long, peak_no int, r int")
    with pytest.raises(Exception, match="null in r"):
        cycles.preprocess(s, peaks([(1, 0, 5), (1, 1, None), (1, 2, 45)]), "k").collect()
    with pytest.raises(Exception, match="tied order"):
        cycles.preprocess(s, peaks([(1, 0, 5), (1, 1, 25), (1, 1, 45)]), "k").collect()
    scc = cycles.preprocess(s, peaks([(1, 0, 5), (1, 1, 25), (1, 2, 45)]), "k", target=16, num_cycles=3)
    with pytest.raises(Exception, match="null in v"):
        cycles.postprocess(scc.withColumn("vals", F.array(F.lit(None).cast("double"), F.lit(1.0))), "k").collect()
    arrays = spark.createDataFrame([(1, None)], "k long, v array<double>")
    with pytest.raises(Exception, match="null in v"):
        cycles.stft(arrays, "k", "v").collect()
    twice = spark.createDataFrame([(1, [1.0] * 40), (1, [2.0] * 40)], "k long, v array<double>")
    with pytest.raises(Exception, match="two signals"):
        cycles.stft(twice, "k", "v", nperseg=8, noverlap=4, n_freq=5, n_frames=4).collect()


def test_regressors_magnitudes_and_nets_refuse_nulls(spark):
    df = lambda rows: spark.createDataFrame(rows, "k long, n int, a double, b double, c double")
    good = [(1, i, 1.0 * i, 2.0, 3.0) for i in range(6)]
    first = (1, 0, None, 2.0, 3.0)
    u = lambda rows: df(rows).select("n", signal.regressor(["a", "b"], 2, "k").alias("u"))
    assert [r.u for r in u(good).orderBy("n").collect()][:2] == [None, [1.0, 0.0, 2.0, 2.0]]
    svm = lambda rows: df(rows).select(signal.magnitude("a", "b", "c").alias("m"))
    assert svm(good).first().m == pytest.approx(13**0.5)
    for op in (u, svm):
        for at in (first, (1, 6, 1.0, None, 3.0)):
            with pytest.raises(Exception, match="null in"):
                op([at, *good[1:]]).collect()
    with pytest.raises(Exception, match="tied order"):
        u([*good, good[3]]).collect()
    weights = networks.seeded("ecgd", 3)
    for x in (None, [None] + [1.0] * 1023, [float("nan")] * 1024):
        with pytest.raises(Exception, match="null in x"):
            networks.infer(spark.createDataFrame([(1, x)], "i long, x array<float>"), "x", "ecgd", weights).collect()


def test_short_signals_have_frames_of_zeros(spark):
    """Frames that hold no sample are zeros, as in the whole transform."""
    x = rng.standard_normal(9)
    df = spark.createDataFrame([(1, x.tolist()), (2, [0.0] * 9)], "k long, v array<double>")
    planes, meta = cycles.spectrum(x, 250.0, 8, 6, 5, 6, kind=np.float64)
    got = {r.k: r for r in cycles.stft(df, "k", "v", nperseg=8, noverlap=6, n_freq=5, n_frames=6, kind="double").collect()}
    assert np.allclose(got[1].re, planes[0].ravel()) and np.allclose(got[1].im, planes[1].ravel())
    assert not np.any(got[2].re)
    back = cycles.istft(cycles.stft(df, "k", "v", nperseg=8, noverlap=6, n_freq=5, n_frames=6, kind="double"), "k", 5, 6)
    assert np.allclose({r.k: r.v for r in back.collect()}[1], cycles.from_spectrum(planes, meta))
