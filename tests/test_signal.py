"""The signal operators: SQL by DuckDB, recurrences by invariants, errors, streams against batch."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidewave.functions import design, kernels
from tidewave.operators import adaptive, cycles, losses, networks, signal, static
from tidewave.plans import signal_queries

SF = "/root/testdata/sf0.001"
rng = np.random.default_rng(7)


@pytest.fixture(scope="module")
def wave(spark):
    return spark.createDataFrame([(k, i, float(v)) for k in (1, 2) for i, v in enumerate(rng.standard_normal(80 + k))], "k long, t int, v double")


def column(df, key=1, name="v"):
    rows = df.where(F.col(df.columns[0]) == key).orderBy("n").collect()
    return np.array([r[name] for r in rows])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["lms_five_taps", "rls_five_taps", "blms_32_taps", "gall_laguerre", "gall_coefficients", "iir_causal_ellip_band", "iir_causal_butter", "dwt_analysis_three_levels", "wavelet_denoise_hard", "wavelet_denoise_garrote", "beat_triples", "moving_average", "moving_median", "fir_causal", "fir_zero_phase_window", "iir_zero_phase_ellip", "wavelet_denoise", "lms", "blms", "scc_preprocess", "stft", "regressor", "focal_loss"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "lineitem", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(signal_queries.oracle_sql()[name])
    got = signal_queries.queries()[name](spark, SF)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (d[cols].sort_values(cols[::-1]).reset_index(drop=True).astype(object) for d in (got.toPandas(), want.df()))
    a, b = (sorted(map(repr, d.itertuples(index=False))) for d in (a, b))
    assert a == b


def test_entry_has_a_query_for_each_sql():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_fir(wave, spark):
    taps = design.fir_taps(11, 40, fs=250)
    x = column(signal.indexed(wave, "k", "t", {"v": "v"}))
    assert taps.sum() == pytest.approx(1)
    assert np.allclose(column(static.fir_filter(wave, "k", "t", "v", 11, 40, fs=250)), kernels.fir_zero_phase(taps, x))
    assert np.allclose(column(static.fir_filter(wave, "k", "t", "v", 11, 40, fs=250, zero_phase=False)), np.convolve(x, taps)[: x.size])
    assert np.allclose(column(static.fir_filter(wave, "k", "t", "v", 101, 40, fs=250, zero_phase=False)), np.convolve(x, design.fir_taps(101, 40, fs=250))[: x.size])
    assert design.fir_taps(10, 40, pass_zero=False, fs=250).size == 11 and design.fir_taps(10, [20, 40], fs=250).size == 11 and design.fir_taps(10, 40, fs=250).size == 10
    with pytest.raises(ValueError, match="odd"):
        design.fir_taps(10, 40, pass_zero="highpass", fs=250)
    for bad in (0, 125, 200):
        with pytest.raises(ValueError, match="cutoff"):
            design.fir_taps(11, bad, fs=250)
    with pytest.raises(ValueError, match="fs"):
        design.fir_taps(11, 40)
    for n in (1, 2, 5, 40):  # shorter than the filter
        assert kernels.fir_zero_phase(taps, x[:n]).size == n


def response(sos, f, fs):
    z = np.exp(-2j * np.pi * np.atleast_1d(f) / fs)
    return np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, _, a1, a2 in sos], axis=0)


@pytest.mark.parametrize(("kind", "edge"), [("butter", -3.0103), ("cheby1", -1), ("cheby2", -40), ("ellip", -1)])
@pytest.mark.parametrize(("btype", "wn"), [("lowpass", 40), ("highpass", 40), ("bandpass", [20, 60]), ("bandstop", [20, 60])])
@pytest.mark.parametrize("order", [1, 4, 5])
def test_iir_design(kind, edge, btype, wn, order):
    sos = design.iir_sections(order, wn, rp=1, rs=40, btype=btype, fs=360, ftype=kind)
    assert all(np.abs(np.roots(s[3:])).max() < 1 for s in sos)
    if order > 1 or kind in ("butter", "cheby1", "cheby2"):
        assert np.allclose(20 * np.log10(np.abs(response(sos, wn, 360))), edge, atol=1e-3)
    assert np.abs(response(sos, np.linspace(0.1, 179, 500), 360)).max() < 1 + 1e-9
    assert np.allclose(kernels.sos_zero_phase(sos, np.full(60, 3.0)), 3 * abs(response(sos, 1e-9, 360)[0]) ** 2, atol=1e-6)


def test_iir_errors(wave):
    for args in ({"Wn": 40}, {"Wn": 200, "fs": 250}, {"Wn": 0, "fs": 250}, {"Wn": 40, "fs": 250, "analog": True}, {"Wn": 40, "fs": 250, "ftype": "cheby1"}, {"Wn": 40, "fs": 250, "ftype": "other"}):
        with pytest.raises(ValueError):  # noqa: PT011
            static.iir_filter(wave, "k", "t", "v", 2, **args)


def test_bessel():
    """Third order: roots of s^3 + 6 s^2 + 15 s + 15, and a delay that is flat in the pass band."""
    _, p, k = design.prototype("bessel", 3, None, None)
    c = 15 ** (1 / 3)
    assert np.allclose(np.poly(p).real, [1, 6 / c, 15 / c**2, 1]) and k == 1
    sos = design.iir_sections(4, 20, fs=1000, ftype="bessel")
    w = np.linspace(1, 10, 50)
    delay = -np.diff(np.unwrap(np.angle(response(sos, w, 1000)))) / np.diff(w)
    assert np.ptp(delay) < 0.01 * delay.mean()
    other = design.iir_sections(4, 20, fs=1000, ftype="butter")
    assert np.ptp(-np.diff(np.unwrap(np.angle(response(other, w, 1000)))) / np.diff(w)) > 0.05 * delay.mean()


WINDOWS = ["hamming", "hann", "blackman", "nuttall", "blackmanharris", "flattop", "boxcar", "bartlett", "triang", "barthann", "bohman", "cosine", "lanczos", "parzen", "tukey", "exponential", ("kaiser", 6.0), 6.0, ("gaussian", 3.0), ("general_gaussian", 1.5, 3.0), ("general_hamming", 0.6), ("general_cosine", (0.5, 0.4, 0.1)), ("tukey", 0.3)]


@pytest.mark.parametrize("kind", WINDOWS, ids=str)
@pytest.mark.parametrize("n", [1, 10, 21])
def test_windows(kind, n):
    w = design.window(kind, n)
    assert w.shape == (n,) and np.allclose(w, w[::-1]) and (0.9 < w.max() <= 1 + 1e-8 or n == 10)
    assert design.fir_taps(21, 40, window_kind=kind, fs=250).sum() == pytest.approx(1)


def test_windows_by_hand():
    """Published ones of a few windows."""
    assert np.allclose(design.window("parzen", 5), [0.016, 0.424, 1, 0.424, 0.016])
    assert np.allclose(design.window("bohman", 5), [0, 0.5 * 0 + 1 / np.pi, 1, 1 / np.pi, 0])
    assert np.allclose(design.window("cosine", 4), np.sin(np.pi * (np.arange(4) + 0.5) / 4))
    assert np.allclose(design.window("tukey", 9), [0, 0.5, 1, 1, 1, 1, 1, 0.5, 0])
    assert np.allclose(design.window("barthann", 3), [0, 1, 0])
    assert design.window("flattop", 11)[0] == pytest.approx(-0.000421051)
    with pytest.raises(ValueError, match="unknown window"):
        design.window("dpss", 9)


def test_symlets():
    """The usual tables of symlets and of the first coiflet, to eight digits."""
    table = {
        "sym2": [0.48296291, 0.83651630, 0.22414387, -0.12940952],
        "sym4": [0.03222310, -0.01260397, -0.09921954, 0.29785780, 0.80373875, 0.49761867, -0.02963553, -0.07576571],
        "sym5": [0.01953888, -0.02110183, -0.17532809, 0.01660211, 0.63397896, 0.72340769, 0.19939753, -0.03913425, 0.02951949, 0.02733307],
        "sym6": [-0.00780071, 0.00176771, 0.04472490, -0.02106029, -0.07263752, 0.33792942, 0.78764114, 0.49105594, -0.04831174, -0.11799011, 0.00349071, 0.01540411],
        "coif1": [-0.07273262, 0.33789766, 0.85257202, 0.38486485, -0.07273262, -0.01565573],
    }
    for name, taps in table.items():
        assert np.allclose(design.scaling_taps(name), taps, atol=1e-7), name


def test_beats_in_rows(spark):
    weights = networks.seeded("cstrans_classification", 2)
    x, rr = rng.standard_normal((7, 360)).astype(np.float32), rng.standard_normal((7, 4)).astype(np.float32)
    df = spark.createDataFrame([(i // 5, i % 5, x[i].tolist(), rr[i].tolist()) for i in range(7)], "k long, b long, x array<float>, rr array<float>")
    got = {(r.k, r.b): r.y for r in networks.classify_beats(df, "k", "b", "x", "rr", weights).collect()}
    assert set(got) == {(0, 1), (0, 2), (0, 3)}
    flat = np.concatenate([x[1], x[2], x[3], rr[2]])[None, None]
    assert np.allclose(got[0, 2], networks.cstrans_classification(networks.Weights(weights), flat)[0], atol=1e-5)


@pytest.mark.parametrize("name", ["haar", "db2", "db4", "db8", "db12", "db20", "sym4", "sym7", "sym8", "coif1"])
@pytest.mark.parametrize("n", [64, 67])
def test_wavelets(name, n):
    x = rng.standard_normal(n)
    assert np.allclose(kernels.recompose(kernels.decompose(x, name, 2), name)[:n], x, atol=1e-9)
    lo, hi, rl, rh = design.filter_bank(name)
    assert abs(lo @ hi) < 1e-9 and lo @ lo == pytest.approx(1)
    parts = kernels.decompose(x, name, 1)
    assert np.allclose(kernels.wavelet_baseline(x, name, 1) + kernels.recompose([parts[0], np.zeros_like(parts[1])], name)[:n], x)


def test_wavelet_modes_and_quirks():
    with pytest.raises(ValueError, match="not supported"):
        design.filter_bank("rbio3.1")
    c = np.array([-3.0, -1.0, 0.0, 1.0, 3.0])
    assert kernels.threshold(c, 2, "soft").tolist() == [-1, 0, 0, 0, 1]
    assert kernels.threshold(c, 2, "hard").tolist() == [-3, 0, 0, 0, 3]
    assert kernels.threshold(c, 2, "greater").tolist() == [0, 0, 0, 0, 3]
    assert kernels.threshold(c, 2, "less").tolist() == [-3, -1, 0, 1, 0]
    assert np.isnan(kernels.wavelet_denoise(np.zeros(64))).any()  # 0/0 in the soft formula
    assert kernels.wavelet_denoise(rng.standard_normal(3)).size == 3


def test_moving_windows(wave):
    x = column(signal.indexed(wave, "k", "t", {"v": "v"}))
    assert np.allclose(column(static.moving_average(wave, "k", "t", "v")), np.convolve(np.pad(x, 1, mode="reflect"), np.ones(3) / 3, "valid"))
    assert np.allclose(column(static.moving_average(wave, "k", "t", "v", 1)), x)
    assert np.allclose(column(static.moving_median(wave, "k", "t", "v", 0)), x)
    want = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x, 2), 5), axis=1)
    assert np.allclose(column(static.moving_median(wave, "k", "t", "v", 4)), want)
    for op in (static.moving_average, static.moving_median):
        with pytest.raises(Exception, match="more than the signal has"):
            op(wave, "k", "t", "v", 201).collect()


def test_null_and_tied_order(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 0, None)], "k long, t int, v double")
    with pytest.raises(Exception, match="null in v"):
        signal.indexed(df, "k", "t", {"v": "v"}).collect()
    with pytest.raises(Exception, match="tied order"):
        signal.indexed(df.fillna(0.0), "k", "t", {"v": "v"}).collect()


OPERATORS = {
    "moving_average": lambda d: static.moving_average(d, "k", "t", "a", 3),
    "moving_median": lambda d: static.moving_median(d, "k", "t", "a", 3),
    "fir": lambda d: static.fir_filter(d, "k", "t", "a", 5, 40, fs=250),
    "fir_causal": lambda d: static.fir_filter(d, "k", "t", "a", 5, 40, fs=250, zero_phase=False),
    "fir_long": lambda d: static.fir_filter(d, "k", "t", "a", 101, 40, fs=250, zero_phase=False),
    "fir_window": lambda d: static.fir_zero_phase_window(d, "k", "t", "a", [0.5, 0.5]),
    "iir": lambda d: static.iir_filter(d, "k", "t", "a", 2, 40, fs=250),
    "iir_causal": lambda d: static.iir_filter(d, "k", "t", "a", 2, 40, fs=250, zero_phase=False),
    "wavelet_denoising": lambda d: static.wavelet_denoising(d, "k", "t", "a"),
    "wavelet_baseline": lambda d: static.wavelet_baseline_removal(d, "k", "t", "a", "db2"),
    "dwt_analysis": lambda d: static.dwt_analysis(d, "k", "t", "a"),
    "emd": lambda d: static.emd_denoising(d, "k", "t", "a"),
    "miemd": lambda d: static.miemd(d, "k", "t", "a"),
    "lms": lambda d: adaptive.modified_lms_anc(d, "k", "t", "b", "b", ("a", "b", "b")),
    "rls": lambda d: adaptive.rls_anc(d, "k", "t", "b", ("a", "b", "b")),
    "blms": lambda d: adaptive.blms_filter(d, "k", "t", "b", ("b", "b", "a"), filter_order=4),
    "gall": lambda d: adaptive.gall_filter(d, "k", "t", "a", "b", M=2),
    "gall_frozen": lambda d: adaptive.gall_filter(d, "k", "t", "a", "b", k0=[0, 0.1], h0=[0, 1, 1]),
    "gall_coefficients": lambda d: adaptive.gall_coefficients(d.withColumnRenamed("k", "s"), "s", "t", "b", "a", 2),
    "hybrid": lambda d: adaptive.hybrid_gall_kalman(d, "k", "t", "b", ("b", "a", "b")),
    "hybrid_raw": lambda d: adaptive.hybrid_gall_kalman(d, "k", "t", "a", ("b", "b", "b")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_no_operator_takes_nulls_or_tied_orders(spark, name):
    rows = [(1, i, float(i % 7), float(i % 5)) for i in range(40)]
    make = lambda r: spark.createDataFrame(r, "k long, t int, a double, b double")
    assert OPERATORS[name](make(rows)).count() > 0
    with pytest.raises(Exception, match="null in"):
        OPERATORS[name](make([*rows, (2, 0, 1.0, 1.0), (1, 40, None, 1.0)])).collect()
    with pytest.raises(Exception, match="tied order"):
        OPERATORS[name](make([*rows, (1, 39, 3.0, 2.0)])).collect()


def test_adaptive_filters(wave):
    n = 200
    ref = rng.standard_normal((3, n))
    noise = 0.5 * ref[0] - 0.3 * np.concatenate([[0], ref[1][:-1]])
    clean = kernels.rls(noise, ref, 2, 1.0, 100.0)
    assert np.abs(clean[100:]).max() < 0.02
    raw = noise + 0.1 * np.sin(np.arange(n))
    assert kernels.lms(raw, raw, ref, 0.0, 5).tolist() == raw.tolist()
    for f in (kernels.lms(raw, raw, ref, 0.01), kernels.rls(raw, ref), kernels.blms(raw, ref, 10, 0.01, 8)):
        assert f[:4].tolist() == raw[:4].tolist()
    err, y, h, k = kernels.lattice(ref[0], raw, 4)
    assert np.allclose(err + y, raw) and k[1] == pytest.approx(0.5, abs=1e-2) and h.size == 6
    warm = kernels.lattice(ref[0], raw, 4, k0=np.ones(5), h0=np.ones(6))
    assert np.allclose(warm[0], err)
    e2, y2, _, _ = kernels.lattice(ref[0], raw, k0=k, h0=h)
    assert np.allclose(e2 + y2, raw)
    c, total, w = kernels.hybrid(raw, ref)
    assert np.allclose(c + total, raw) and w.shape == (n, 3)
    with pytest.raises(ValueError, match="rename"):
        adaptive.gall_coefficients(wave.withColumn("w", F.col("v")), "k", "t", "v", "w", 2)
    for call in (lambda: kernels.lms(raw, raw, ref[:, :5]), lambda: kernels.rls(raw, ref, lam=0), lambda: kernels.rls(raw, ref, lam=1.1), lambda: kernels.blms(raw, ref, 0), lambda: kernels.lms(raw[:3], raw, ref[:, :3], order=5), lambda: kernels.hybrid(raw, ref, lam=0), lambda: kernels.lattice(raw, raw), lambda: kernels.lattice(raw, raw, 2, alpha=1), lambda: kernels.lattice(raw, raw[:4], 2), lambda: kernels.lattice(raw, raw, k0=[0], h0=[0])):
        with pytest.raises(ValueError):  # noqa: PT011
            call()


def lattice_by_hand(x, d, order, beta, alpha, eps):
    """The recursions for one signal as difference equations over whole histories: every quantity is kept for every n."""
    size = len(x)
    f, b, c = np.zeros((order + 1, size)), np.zeros((order + 1, size)), np.zeros((order + 1, size))
    power = [[eps] * (order + 1)]
    cross, joint, fits = np.zeros(order + 1), np.zeros(order + 1), np.zeros(size)
    before = lambda a, m, n: a[m, n - 1] if n else 0.0
    for n in range(size):
        q = list(power[-1])
        f[0, n] = b[0, n] = alpha * before(b, 0, n) + np.sqrt(1 - alpha**2) * x[n]
        q[0] = beta * q[0] + f[0, n] ** 2
        for m in range(1, order + 1):
            late = b[0, n] if m == 1 else before(b, m - 1, n)
            c[m - 1, n] = late + alpha * (before(c, m - 1, n) - b[m - 1, n])
            q[m - 1] = beta * q[m - 1] + 0.5 * (f[m - 1, n] ** 2 + c[m - 1, n] ** 2)
            cross[m] = beta * cross[m] + f[m - 1, n] * c[m - 1, n]
            k = cross[m] / q[m - 1]
            f[m, n], b[m, n] = f[m - 1, n] - k * c[m - 1, n], c[m - 1, n] - k * f[m - 1, n]
        q[order] = beta * q[order] + 0.5 * f[order, n] ** 2
        e = d[n]
        for m in range(order + 1):
            joint[m] = beta * joint[m] + e * b[m, n]
            fits[n] += joint[m] / q[m] * b[m, n]
            e -= joint[m] / q[m] * b[m, n]
        power.append(q)
    return fits


@pytest.mark.parametrize(("order", "beta", "alpha"), [(0, 1.0, 0.0), (1, 1.0, 0.5), (4, 0.98, 0.3), (6, 1.0, 0.0)])
def test_lattice(order, beta, alpha):
    x, d = rng.standard_normal((2, 120))
    err, y, _, _ = kernels.lattice(x, d, order, beta, alpha)
    assert np.allclose(y, lattice_by_hand(x, d, order, beta, alpha, 1e-3)) and np.allclose(err, d - y)


def test_signals_of_different_lengths_together():
    sizes = (90, 7, 33, 90, 60)
    raw, low = ([rng.standard_normal(n) for n in sizes] for _ in range(2))
    ref = [rng.standard_normal((3, n)) for n in sizes]
    one = [r[0] for r in ref]
    for many, single in (
        (kernels.lms_all(raw, low, ref, 0.01), [kernels.lms(*a, 0.01) for a in zip(raw, low, ref, strict=True)]),
        (kernels.rls_all(raw, ref, 3), [kernels.rls(*a, 3) for a in zip(raw, ref, strict=True)]),
        (kernels.blms_all(raw, ref, 4, 0.01, 6), [kernels.blms(*a, 4, 0.01, 6) for a in zip(raw, ref, strict=True)]),
        *zip(zip(*kernels.lattice_all(raw, one, 3, 0.99, 0.2), strict=True), zip(*(kernels.lattice(*a, 3, 0.99, 0.2) for a in zip(raw, one, strict=True)), strict=True), strict=True),
        *zip(zip(*kernels.hybrid_all(raw, ref), strict=True), zip(*(kernels.hybrid(*a) for a in zip(raw, ref, strict=True)), strict=True), strict=True),
    ):
        assert all(np.allclose(a, b, atol=1e-12) and a.shape == b.shape for a, b in zip(many, single, strict=True))
    u = kernels.lagged(ref[0], 3)
    assert u[5].tolist() == [ref[0][c, 7 - i] for c in range(3) for i in range(3)]


def test_low_passed_signal_drives_the_weights():
    raw, low, ref = rng.standard_normal(50), rng.standard_normal(50), rng.standard_normal((2, 50))
    w, want = np.zeros(6), raw.copy()
    for n in range(2, 50):
        u = np.array([ref[c, n - i] for c in range(2) for i in range(3)])
        want[n] = raw[n] - w @ u
        w = w + 2 * 0.02 * (low[n] - w @ u) * u
    assert np.allclose(kernels.lms(raw, low, ref, 0.02, 3), want)
    assert not np.allclose(kernels.lms(low, raw, ref, 0.02, 3), want)


def test_adaptive_operators(spark):
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "t": range(60), **{c: rng.standard_normal(60) for c in ("raw", "x", "y", "z")}}))
    p = df.toPandas()
    ref = p[["x", "y", "z"]].to_numpy().T
    args = ("k", "t", "raw")
    assert np.allclose(column(adaptive.rls_anc(df, *args, ("x", "y", "z")), name="clean"), kernels.rls(p["raw"].to_numpy(), ref))
    svm = np.sqrt((ref**2).sum(axis=0))[None]
    assert np.allclose(column(adaptive.modified_lms_anc(df, *args, "raw", ("x", "y", "z"), SVM_condition=True), name="clean"), kernels.lms(p["raw"].to_numpy(), p["raw"].to_numpy(), svm))
    assert np.allclose(column(adaptive.blms_filter(df, *args, ("x", "y", "z"), filter_order=4), name="clean"), kernels.blms(p["raw"].to_numpy(), ref, order=4))
    assert np.allclose(column(adaptive.hybrid_gall_kalman(df, *args, ("x", "y", "z")), name="wy"), kernels.hybrid(p["raw"].to_numpy(), ref)[2][:, 1])


def beats():
    x = 0.1 * np.sin(2 * np.pi * 5 * np.arange(11520) / 360)
    peaks = 144 + 288 * np.arange(40)
    for r in peaks:
        x[r - 5 : r + 5] += np.hanning(10) * 2
    return x, peaks


def test_cycle_stack(spark):
    x, peaks = beats()
    rows, lengths, low, high = cycles.stack(x, peaks)
    assert rows.shape == (32, 384) and cycles.bounds_of(x.size, peaks)[0] == (0, 288) and cycles.bounds_of(x.size, peaks)[31] == (8928, 9216)
    back = cycles.unstack(rows, lengths, low, high)
    assert back.size == 9216 and np.abs(back - x[:9216]).max() < 1e-6
    scaled = cycles.stack(3 * x, peaks, (low, high))[0]
    assert np.allclose(scaled * (high - low) + low, 3 * (rows * (high - low) + low), atol=1e-8)
    for bad in (peaks[:1], np.array([5, 6])):
        with pytest.raises(ValueError):  # noqa: PT011
            cycles.stack(x, bad)
    s = spark.createDataFrame(pd.DataFrame({"k": 1, "n": range(x.size), "v": x}))
    p = spark.createDataFrame(pd.DataFrame({"k": 1, "peak_no": range(40), "r": peaks.astype("int32")}))
    b = cycles.segment_bounds(p, spark.createDataFrame([(1, x.size)], "k long, nn int"), "k").orderBy("cycle").collect()
    assert [(r.start, r.end) for r in b] == cycles.bounds_of(x.size, peaks)
    again = cycles.postprocess(cycles.preprocess(s, p, "k"), "k").orderBy("n").toPandas()
    assert np.allclose(again["v"], back)
    with pytest.raises(Exception, match="needs two peaks"):
        cycles.preprocess(s, p.limit(1), "k").collect()
    assert cycles.preprocess(s, p.limit(1), "k", strict=False).count() == 0
    # A short cycle in the middle leaves an empty row, and what follows moves up when the signal is put back.
    short = cycles.stack(x, np.array([144, 432, 436, 440, 720]))
    assert 0 in short[1][:4] and not short[0][short[1].index(0)].any()


@pytest.mark.parametrize(("n", "m"), [(288, 384), (287, 384), (384, 288), (400, 384), (384, 287)])
def test_fourier_resample(n, m):
    t = np.arange(n) / n
    x = 1 + np.cos(2 * np.pi * 3 * t) + np.sin(2 * np.pi * 7 * t)
    s = np.arange(m) / m
    assert np.allclose(kernels.fourier_resample(x, m), 1 + np.cos(2 * np.pi * 3 * s) + np.sin(2 * np.pi * 7 * s))


def test_spectra(spark):
    x = np.random.RandomState(0).randn(1024)
    planes, meta = cycles.spectrum(x, 250)
    assert planes.shape == (2, 129, 32) and planes.dtype == np.float32 and meta["full_shape"] == (129, 33)
    back = cycles.from_spectrum(planes, meta)
    assert back.size == 1024 and np.abs(back - x)[:896].max() < 1e-5 < np.abs(back - x)[900:].max()
    full, meta = cycles.spectrum(x, 250, n_frames=33)
    assert np.abs(cycles.from_spectrum(full, meta) - x).max() < 1e-5
    with pytest.raises(ValueError, match="asked for"):
        cycles.spectrum(x[:100], 250)
    df = spark.createDataFrame([(1, x.tolist())], "k long, v array<double>")
    assert np.allclose(cycles.istft(cycles.stft(df, "k", "v"), "k").first().v, back, atol=1e-5)
    stats = ((0.1, -0.2), (2.0, 3.0))
    own = cycles.stft(df, "k", "v", stats=stats).first()
    want, _ = cycles.spectrum(x, 250, stats=tuple(np.array(s).reshape(2, 1, 1) for s in stats))
    assert np.allclose(own.re, want[0].ravel()) and np.allclose(own.im, want[1].ravel()) and (own.meta.loc_im, own.meta.scale_re) == (-0.2, 2.0)
    assert np.allclose(cycles.istft(cycles.stft(df, "k", "v", stats=stats), "k").first().v, back, atol=1e-5)


def test_decomposition():
    t = np.arange(500)
    x = np.sin(t / 5) + np.sin(t / 40) + t / 100
    parts = kernels.emd(x)
    assert np.allclose(parts.sum(axis=0), x) and np.abs(parts[0] - np.sin(t / 5))[50:450].max() < 0.1
    assert len(kernels.emd(x, 1)) == 2
    assert np.allclose(kernels.emd_denoise(x, noise_components=9), x)  # too few parts: unchanged
    assert np.allclose(kernels.emd_denoise(x, noise_components=0), 0)  # all of them are taken away
    assert kernels.miemd(x).size == 500
    assert len(kernels.emd(np.arange(10.0))) == 1


def test_network_shapes_and_sizes():
    want = {"autoencoder": 64_942, "sced": 5_994_145, "cstrans_denoising": 181_521, "cstrans_classification": 466_713, "ecgd": 50_081, "deepced": 2_264_322}
    assert {n: networks.count_parameters(n) for n in want} == want
    for n, net in networks.NETS.items():
        if n != "sced":
            y = net.forward(networks.Weights(networks.seeded(n)), np.ones((2, *net.shape), np.float32))
            assert y.shape == ((2, 5) if n == "cstrans_classification" else (2, *net.shape)) and y.dtype == np.float32 and np.isfinite(y).all()
    with pytest.raises(ValueError, match="multiple of 4"):
        networks.ecgd(networks.Weights(seed=0), np.zeros((1, 1, 10), np.float32))
    with pytest.raises(ValueError, match="odd"):
        networks.dwt_layer(networks.Weights(seed=0), "x", np.zeros((1, 1, 32), np.float32), 3)
    with pytest.raises(AssertionError):
        networks.swt_conv(networks.Weights(seed=0), "x", np.zeros((1, 1, 32), np.float32), 6)


def test_layers_by_hand():
    x = rng.standard_normal((1, 2, 9)).astype(np.float32)
    k = rng.standard_normal((3, 2, 4)).astype(np.float32)
    w = networks.Weights({"c.weight": k, "c.bias": np.zeros(3, np.float32)})
    padded = np.pad(x, ((0, 0), (0, 0), (1, 2)))
    want = np.array([[(padded[0, :, i : i + 4] * k[o]).sum() for i in range(9)] for o in range(3)])
    assert np.allclose(networks.conv(w, "c", x, 3, (4,))[0], want, atol=1e-5)
    t = rng.standard_normal((2, 3, 4)).astype(np.float32)
    up = np.zeros((3, 20), np.float32)
    for i in range(9):
        up[:, 2 * i : 2 * i + 4] += np.einsum("c,cok->ok", x[0, :, i], t)
    assert np.allclose(networks.scatter(x, t, (2,), (1,), (0,))[0], up[:, 1:-1], atol=1e-5)
    y = rng.standard_normal((1, 6, 32)).astype(np.float32)
    net = networks.Weights(seed=1)
    a = networks.transformer(net, "t", y)
    q, kk, v = np.split(y @ net.arrays["t.attention.in_proj_weight"].T, 3, axis=2)
    s = np.stack([q[0, :, 2 * i : 2 * i + 2] @ kk[0, :, 2 * i : 2 * i + 2].T / 2**0.5 for i in range(16)])
    s = np.exp(s) / np.exp(s).sum(axis=-1, keepdims=True)
    att = np.concatenate([s[i] @ v[0, :, 2 * i : 2 * i + 2] for i in range(16)], axis=1)
    z = (y[0] + att @ net.arrays["t.attention.out_proj.weight"].T + net.arrays["t.attention.out_proj.bias"]) / (1 + 1e-5) ** 0.5
    f = np.maximum(z @ net.arrays["t.ffn.0.weight"].T + net.arrays["t.ffn.0.bias"], 0) @ net.arrays["t.ffn.2.weight"].T + net.arrays["t.ffn.2.bias"]
    assert np.allclose(a[0], (z + f) / (1 + 1e-5) ** 0.5, atol=1e-5)
    assert networks.pool(np.arange(5.0)[None, None]).tolist() == [[[1, 3]]]


def test_wavelet_layers_as_columns(spark):
    x = rng.standard_normal(32)
    df = spark.createDataFrame([(x.tolist(),)], "x array<double>")
    got = df.select(networks.dwt_bands(F.col("x")).alias("b")).first().b
    for band, taps in zip((got.low, got.high), networks._bank("db6", False), strict=True):
        want = networks.correlate(x[None, None].astype(np.float32), taps[None, None], 2, ((5, 5),), (1,))
        assert np.allclose(band, want[0, 0], atol=1e-5)
    up = df.select(networks.idwt_up(F.slice("x", 1, 16), F.slice("x", 17, 16)).alias("y")).first().y
    want = sum(networks.scatter(h[None, None].astype(np.float32), t[None, None], (2,), (5,), (0,)) for h, t in zip((x[:16], x[16:]), networks._bank("db6", True), strict=True))
    assert np.allclose(up, want[0, 0], atol=1e-5)
    four = df.select(networks.swt_kernels(F.slice("x", 1, 3)).alias("k")).first().k
    a, b, c = x[:3]
    assert four == [[a, b, c], [c, b, a], [a, -b, c], [c, -b, a]]


def test_inference_in_spark(spark):
    weights = networks.seeded("ecgd", 3)
    x = rng.standard_normal((5, 1024)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, x array<float>")
    stored = networks.weights_from(networks.weights_table(spark, weights))
    got = np.array([r.y for r in networks.infer(df, "x", "ecgd", stored).orderBy("i").collect()])
    assert np.allclose(got, networks.ecgd(networks.Weights(weights), x[:, None])[:, 0], atol=1e-5)


def test_losses(spark):
    rows = [(0, [1.0, 2.0, 0.5], 1), (0, [0.1, 0.2, 3.0], 0), (0, [1.0, 1.0, 1.0], -100)]
    df = spark.createDataFrame(rows, "g long, x array<double>, y int")
    ce = [float(np.log(np.exp(x).sum()) - x[y]) if y >= 0 else 0.0 for _, x, y in rows]
    want = np.mean([0.5 * (1 - np.exp(-c)) ** 2 * c for c in ce])
    assert df.agg(losses.focal_loss("x", "y", 0.5).alias("l")).first().l == pytest.approx(want)
    pairs = spark.createDataFrame([(1.0, 2.0), (0.0, -1.0)], "p double, t double")
    assert pairs.agg(losses.improved_mse("p", "t").alias("l")).first().l == pytest.approx((1 * 5 + 1 * 3) / 2)


@pytest.mark.parametrize("block", [None, 4])
def test_levels_are_made_once_and_go_on_together(spark, block):
    sizes = [1, 2, 3, 7, 8, 13, 30]
    signals = {n: rng.standard_normal(n) for n in sizes}
    df = spark.createDataFrame([(n, i, float(v)) for n, x in signals.items() for i, v in enumerate(x)], "k long, t int, v double")
    got = static.dwt_analysis(df, "k", "t", "v", "db2", 3, block=block)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and (block is not None or plan.count("Sort [") <= 3 + 1)
    collected, found = got.collect(), {}
    assert len({(r.k, r.level, r.band, r.i) for r in collected}) == len(collected)
    for r in collected:
        found.setdefault((r.k, r.level, r.band), {})[r.i] = r.c
    lo, hi, _, _ = design.filter_bank("db2")
    for n, a in signals.items():
        for level in (1, 2, 3):
            a, d = kernels.dwt(a, lo, hi)
            bands = {"d": d} | ({"a": a} if level == 3 else {})
            for band, want in bands.items():
                have = found.pop((n, level, band))
                assert sorted(have) == list(range(want.size)) and np.allclose([have[i] for i in range(want.size)], want)
    assert not found


def test_cycles_are_resampled_once(spark):
    x = {k: rng.standard_normal(60) for k in (1, 2)}
    at = {1: [3, 14, 15, 30, 52], 2: [0, 9, 31]}
    s = spark.createDataFrame([(k, i, float(v)) for k in x for i, v in enumerate(x[k])], "k long, n int, v double")
    p = spark.createDataFrame([(k, i, r) for k in at for i, r in enumerate(at[k])], "k long, peak_no int, r int")
    out = cycles.preprocess(s, p, "k", target=12, num_cycles=6, shortest=4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert sum("partial_sum" in line for line in plan.splitlines()) == 1
    for k in x:
        rows, lengths, low, high = cycles.stack(x[k], np.array(at[k]), None, 12, 6, 4)
        got = out.where(F.col("k") == k).orderBy("cycle").collect()
        assert [r.cycle for r in got] == list(range(6)) and [r.orig_len for r in got] == lengths
        assert np.allclose([r.vals for r in got], rows) and np.allclose([(r.g_min, r.g_max) for r in got], (low, high))
