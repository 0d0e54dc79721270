"""The signal queries over the driver's tables, and their SQL.

Stand-ins for recordings: ``events`` (one value per user, ordered by time) and ``lineitem`` (a primary signal and three
references per supplier). Values are rounded to six digits so that the order of sums doesn't show.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewave.functions import design, table_functions
from tidewave.operators import adaptive, cycles, losses, networks, selection, signal, static, wavelets
from tidewave.plans import sql_oracles as sql
from tidewave.sources.tables import events, lines, table

LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"]
REFS = ("l_quantity", "l_discount", "l_tax")
RAW, LOW = "l_extendedprice / 1000", "l_extendedprice / 2000 + l_quantity / 10"
GALL = {"M": 3, "beta": 0.99, "alpha": 0.3}
DEEP = {
    "cheby1_five": (5, 40.0, {"ftype": "cheby1", "rp": 1.0}),
    "ellip_band": (3, [20.0, 60.0], {"btype": "bandpass", "ftype": "ellip", "rp": 1.0, "rs": 40.0}),
    "cheby2_stop": (2, [30.0, 70.0], {"btype": "bandstop", "ftype": "cheby2", "rs": 30.0}),
    "butter_high": (3, 30.0, {"btype": "highpass"}),
}
FIR = {
    "lowpass": {"numtaps": 11, "cutoff": 40.0},
    "highpass": {"numtaps": 10, "cutoff": 40.0, "pass_zero": False},
    "bandpass": {"numtaps": 15, "cutoff": [30.0, 80.0], "pass_zero": False},
    "bandstop": {"numtaps": 14, "cutoff": [30.0, 80.0]},
    "kaiser": {"numtaps": 21, "cutoff": 40.0, "width": 30.0},
}
FS = 250.0
IIR = {"butter": {}, "cheby1": {"rp": 1.0}, "cheby2": {"rs": 40.0}, "ellip": {"rp": 1.0, "rs": 40.0}}
EV, LI = ("user_id", "ts"), ("l_suppkey", LINE_ORDER)
BLOCK, SCALES, MODES = 16, (0.0, 0.5), ("soft", "hard", "garrote", "greater", "less")
SCC = {"target": 64, "num_cycles": 32, "shortest": 3}
K0, H0 = (0.0, 0.3), (0.0, 0.5, -0.25)


def tidy(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in cols})


def _taps(kind: str):
    o = FIR[kind]
    return design.fir_taps(o["numtaps"], o["cutoff"], o.get("width"), pass_zero=o.get("pass_zero", True), fs=FS)


def _fir(kind: str, zero_phase: bool):
    return lambda spark, d: tidy(static.fir_filter(events(spark, d), *EV, "value", fs=FS, zero_phase=zero_phase, **FIR[kind]), "v")


def _iir(kind: str, zero_phase: bool):
    return lambda spark, d: tidy(static.iir_filter(events(spark, d), *EV, "value", 2, 40.0, fs=FS, ftype=kind, zero_phase=zero_phase, **IIR[kind]), "v")


def _sos(kind: str):
    return design.iir_sections(2, 40.0, fs=FS, ftype=kind, **IIR[kind])


def peaks(spark: SparkSession, d: str) -> DataFrame:
    """Purchases stand in for R peaks: (user_id, peak_no, r)."""
    w = signal.indexed(table(spark, d, "events"), *EV, {"v": F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0)})
    w = w.where("v = 1")
    return w.select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("n")) - 1).alias("peak_no"), F.col("n").alias("r"))


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return signal.indexed(events(spark, d), *EV, {"v": "value"})


def _bounds(spark, d):
    return cycles.segment_bounds(peaks(spark, d), _samples(spark, d).groupBy("user_id").agg(F.max("nn").alias("nn")), "user_id", SCC["num_cycles"], strict=False)


def _scc(spark, d):
    return cycles.preprocess(_samples(spark, d), peaks(spark, d), "user_id", strict=False, **SCC)


def _resample(spark, d):
    return tidy(cycles.resample(events(spark, d), *EV, "value", 64), "v")


def _swt(spark, d):
    """Four filters from the first three values of each vector: as it is, reversed, with alternating signs, both."""
    w = F.slice(F.col("embedding").cast("array<double>"), 1, 3)
    four = networks.swt_kernels(w)
    return tidy(table(spark, d, "embeddings").select("vec_id", F.posexplode(four).alias("filter", "w")).select("vec_id", "filter", F.posexplode("w").alias("i", "w")), "w")


def _time2vec(spark, d):
    e = F.col("embedding").cast("array<double>")
    return tidy(table(spark, d, "embeddings").select("vec_id", F.posexplode(networks.time2vec(e, 0.05, 0.02, -0.07, 0.1)).alias("i", "v")), "v")


def _values(spark, d):
    rows = signal.from_arrays(table(spark, d, "embeddings"), "vec_id", "embedding")
    return rows.withColumn("nn", F.lit(64))


def _dwt_layer(spark, d):
    lo, hi, _, _ = design.filter_bank("db6")
    bands = wavelets.layer_analysis(_values(spark, d), "vec_id", lo, hi)
    return tidy(bands.select("vec_id", F.col("n").alias("i"), F.inline(F.array(*(F.struct(F.lit(k).alias("band"), F.col(k).alias("c")) for k in ("low", "high"))))), "c")


def _idwt_layer(spark, d):
    """The first 32 values as low and the others as high coefficients."""
    _, _, lo, hi = design.filter_bank("db6")
    rows = _values(spark, d)
    low, high = rows.where("n < 32").withColumnRenamed("v", "a"), rows.where("n >= 32").select("vec_id", (F.col("n") - 32).alias("n"), F.col("v").alias("d"))
    met = low.join(high, ["vec_id", "n"]).withColumn("nn", F.lit(32))
    return tidy(wavelets.layer_synthesis(met, "vec_id", lo, hi).withColumnRenamed("n", "i"), "v")


def _stft(spark, d):
    s = cycles.stft(table(spark, d, "embeddings"), "vec_id", "embedding", nperseg=16, noverlap=12, n_freq=9, n_frames=16, kind="double")
    return tidy(s.select("vec_id", F.posexplode(F.arrays_zip("re", "im")).alias("pos", "z")).select("vec_id", "pos", F.col("z.re").cast("double").alias("re"), F.col("z.im").cast("double").alias("im")), "re", "im")


def _istft(spark, d):
    """All frames kept, so the way back is exact."""
    s = cycles.stft(table(spark, d, "embeddings"), "vec_id", "embedding", nperseg=16, noverlap=12, n_freq=9, n_frames=17, kind="double")
    return tidy(signal.from_arrays(cycles.istft(s, "vec_id", 9, 17), "vec_id"), "v")


def _istft_cropped(spark, d):
    """Twelve of 17 frames and seven of nine waves are kept: what is left out is missing from the signal."""
    s = cycles.stft(table(spark, d, "embeddings"), "vec_id", "embedding", nperseg=16, noverlap=12, n_freq=7, n_frames=12, kind="double")
    return tidy(signal.from_arrays(cycles.istft(s, "vec_id", 7, 12), "vec_id"), "v")


def _scaled(spark, d):
    """The finest details out, the next ones halved: the way back is no identity."""
    c = static.dwt_analysis(events(spark, d), *EV, "value", "db2", len(SCALES))
    factor = F.element_at(F.array(*(F.lit(x) for x in SCALES)), F.col("level"))
    c = c.withColumn("c", F.when(F.col("band") == "d", F.col("c") * factor).otherwise(F.col("c")))
    back = static.dwt_synthesis(c, "user_id", "db2", len(SCALES))
    return tidy(back.join(_samples(spark, d).select("user_id", "n"), ["user_id", "n"]), "v")


def _long_taps():
    return design.fir_taps(33, 40.0, fs=FS)


def _net(name: str):
    """The vectors in order, joined into inputs of the net's size (the last one filled up with zeros), through a net with seeded weights."""

    def query(spark, d):
        size = math.prod(networks.NETS[name].shape)
        per = -(-size // 64)
        groups = table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / per).alias("input")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("v"))
        joined = F.flatten(F.transform("v", lambda v: v["embedding"].cast("array<float>")))
        x = F.slice(F.concat(joined, F.array_repeat(F.lit(0.0).cast("float"), size)), 1, size)
        return networks.infer(groups.select("input", x.alias("x")), "x", name, networks.seeded(name, 0)).select("input", F.size("y").alias("size"), F.aggregate("y", F.lit(0.0), lambda a, v: a + v.cast("double")).alias("total"))

    return query


def queries() -> dict:
    q = {
        "moving_average": lambda s, d: tidy(static.moving_average(events(s, d), *EV, "value", 5), "v"),
        "moving_median": lambda s, d: tidy(static.moving_median(events(s, d), *EV, "value", 5), "v"),
        "fir_causal": _fir("lowpass", False),
        "fir_zero_phase": _fir("lowpass", True),
        "fir_zero_phase_window": lambda s, d: tidy(static.fir_zero_phase_window(events(s, d), *EV, "value", _taps("lowpass").tolist()), "v"),
        **{f"fir_{k}": _fir(k, True) for k in ("highpass", "bandpass", "bandstop", "kaiser")},
        **{f"iir_causal_{k}": _iir(k, False) for k in IIR},
        **{f"iir_zero_phase_{k}": _iir(k, True) for k in IIR},
        **{f"iir_causal_{k}": lambda s, d, n=n, wn=wn, o=o: tidy(static.iir_filter(events(s, d), *EV, "value", n, wn, fs=FS, zero_phase=False, **o), "v") for k, (n, wn, o) in DEEP.items()},
        "iir_causal_bessel": lambda s, d: tidy(static.iir_filter(events(s, d), *EV, "value", 2, 40.0, fs=FS, ftype="bessel", zero_phase=False), "v"),
        # the same operators in blocks, here of a few samples, so that a signal is many of them
        "moving_average_blocks": lambda s, d: tidy(static.moving_average(events(s, d), *EV, "value", 9, block=BLOCK), "v"),
        "moving_median_blocks": lambda s, d: tidy(static.moving_median(events(s, d), *EV, "value", 9, block=BLOCK), "v"),
        "fir_causal_blocks": lambda s, d: tidy(static.fir_filter(events(s, d), *EV, "value", fs=FS, zero_phase=False, block=BLOCK, **FIR["lowpass"]), "v"),
        "fir_zero_phase_blocks": lambda s, d: tidy(static.fir_filter(events(s, d), *EV, "value", 33, 40.0, fs=FS, block=BLOCK), "v"),
        "iir_causal_blocks": lambda s, d: tidy(static.iir_filter(events(s, d), *EV, "value", 3, [20.0, 60.0], fs=FS, btype="bandpass", ftype="ellip", rp=1.0, rs=40.0, zero_phase=False, block=BLOCK), "v"),
        "iir_zero_phase_blocks": lambda s, d: tidy(static.iir_filter(events(s, d), *EV, "value", 2, 40.0, fs=FS, ftype="ellip", block=BLOCK, **IIR["ellip"]), "v"),
        "wavelet_denoise_blocks": lambda s, d: tidy(static.wavelet_denoising(events(s, d), *EV, "value", "db4", 1, block=BLOCK), "v"),
        "dwt_synthesis_scaled": _scaled,
        "medians": lambda s, d: tidy(selection.medians(table(s, d, "lineitem"), "l_suppkey", "l_extendedprice", cells=16, gather=32), "median"),
        "threshold_modes": lambda s, d: tidy(table(s, d, "events").select("event_id", *(wavelets.shrunk(F.col("value") - 50, F.lit(10.0), m).alias(m) for m in MODES)), *MODES),
        "istft_cropped": _istft_cropped,
        "dwt_analysis_three_levels": lambda s, d: tidy(static.dwt_analysis(events(s, d), *EV, "value", "db2", 3), "c"),
        "wavelet_denoise_hard": lambda s, d: tidy(static.wavelet_denoising(events(s, d), *EV, "value", "sym4", 2, "hard"), "v"),
        "wavelet_denoise_garrote": lambda s, d: tidy(static.wavelet_denoising(events(s, d), *EV, "value", "haar", 2, "garrote"), "v"),
        "dwt_analysis": lambda s, d: tidy(static.dwt_analysis(events(s, d), *EV, "value", "db4", 1), "c"),
        "dwt_synthesis": lambda s, d: tidy(static.dwt_synthesis(static.dwt_analysis(events(s, d), *EV, "value", "db4", 3), "user_id").join(_samples(s, d).select("user_id", "n"), ["user_id", "n"]), "v"),
        "wavelet_denoise": lambda s, d: tidy(static.wavelet_denoising(events(s, d), *EV, "value", "db4", 1), "v"),
        "wavelet_baseline": lambda s, d: tidy(static.wavelet_baseline_removal(events(s, d), *EV, "value", "db4", 1), "v"),
        "soft_threshold": lambda s, d: tidy(table(s, d, "events").select("event_id", static.soft_threshold(F.col("value") - 50, 10.0).alias("v")), "v"),
        "signal_vector_magnitude": lambda s, d: tidy(_line(s, d).select("l_suppkey", "n", signal.magnitude("rx", "ry", "rz").alias("svm")), "svm"),
        "regressor": _regressor,
        "lms": lambda s, d: tidy(adaptive.modified_lms_anc(lines(s, d), *LI, F.expr(RAW), F.expr(RAW), REFS, mu=1e-5, filter_order=1), "clean"),
        "rls": lambda s, d: tidy(adaptive.rls_anc(lines(s, d), *LI, F.expr(RAW), REFS, filter_order=1, SVM_condition=True), "clean"),
        "blms": lambda s, d: tidy(adaptive.blms_filter(lines(s, d), *LI, F.expr(RAW), REFS, L=10, mu=1e-4, filter_order=1, SVM_condition=True), "clean"),
        "gall_learn": lambda s, d: tidy(adaptive.gall_filter(lines(s, d), *LI, F.col(REFS[0]), F.expr(RAW), M=0), "err", "y"),
        "gall_learn_first_order": lambda s, d: tidy(adaptive.gall_filter(lines(s, d), *LI, F.col(REFS[0]), F.expr(RAW), M=1), "err", "y"),
        "gall_freeze": lambda s, d: tidy(adaptive.gall_filter(lines(s, d), *LI, F.col(REFS[0]), F.expr(RAW), k0=K0, h0=H0), "err", "y"),
        "gall_laguerre": lambda s, d: tidy(adaptive.gall_filter(lines(s, d), *LI, F.col(REFS[0]), F.expr(RAW), **GALL), "err", "y", digits=4),
        "gall_coefficients": lambda s, d: tidy(adaptive.gall_coefficients(lines(s, d), *LI, F.col(REFS[0]), F.expr(RAW), **GALL).withColumn("k", F.when(~F.isnan("k"), F.col("k"))), "h", "k", digits=4),
        "hybrid_kalman": lambda s, d: tidy(adaptive.hybrid_gall_kalman(lines(s, d), *LI, F.expr(RAW), REFS, M_gall=1), "clean", "y_total", "wx", "wy", "wz", digits=4),
        "lms_five_taps": lambda s, d: tidy(adaptive.modified_lms_anc(lines(s, d), *LI, F.expr(RAW), F.expr(LOW), REFS, mu=1e-6), "clean", digits=5),
        "rls_five_taps": lambda s, d: tidy(adaptive.rls_anc(lines(s, d), *LI, F.expr(RAW), REFS), "clean", digits=2),
        "rls_table_function": _rls_sql,
        "blms_32_taps": lambda s, d: tidy(adaptive.blms_filter(lines(s, d), *LI, F.expr(RAW), REFS, mu=1e-6), "clean", digits=5),
        "scc_bounds": _bounds,
        "scc_preprocess": lambda s, d: tidy(_scc(s, d).select("user_id", "cycle", "orig_len", F.posexplode("vals").alias("i", "v")), "v"),
        "scc_postprocess": lambda s, d: tidy(cycles.postprocess(_scc(s, d), "user_id"), "v"),
        "fourier_resample": _resample,
        "stft": _stft,
        "istft": _istft,
        "improved_mse": lambda s, d: tidy(lines(s, d).groupBy("l_suppkey").agg(losses.improved_mse("l_discount", "l_tax").alias("loss")), "loss"),
        "focal_loss": lambda s, d: tidy(table(s, d, "embeddings").select((F.col("label") % 5).alias("label"), F.slice(F.col("embedding").cast("array<double>"), 1, 5).alias("x")).groupBy("label").agg(losses.focal_loss("x", "label").alias("loss")), "loss"),
        "swt_kernel": _swt,
        "time2vec": _time2vec,
        "dwt_layer": _dwt_layer,
        "idwt_layer": _idwt_layer,
        "beat_triples": _triples,
        "emd_denoise": lambda s, d: static.emd_denoising(events(s, d), *EV, "value"),
        "miemd": lambda s, d: static.miemd(events(s, d), *EV, "value"),
        **{f"net_{name}": _net(name) for name in networks.NETS},
    }
    return q


def _triples(s, d):
    """Vectors of a label stand in for the beats of a recording; what there are of intervals are their ids."""
    beats = table(s, d, "embeddings").select("label", "vec_id", F.slice("embedding", 1, 6).cast("array<double>").alias("s"), F.array(F.col("vec_id").cast("double"), F.lit(0.5)).alias("i"))
    return tidy(networks.beat_triples(beats, "label", "vec_id", "s", "i").select("label", "vec_id", F.posexplode("x").alias("i", "v")), "v")


def _rls_sql(s, d):
    """The same filter, called in SQL."""
    table_functions.register(s)
    signals = signal.gathered(lines(s, d), *LI, {"raw": F.expr(RAW), "rx": REFS[0], "ry": REFS[1], "rz": REFS[2]}).withColumnRenamed("__key", "l_suppkey")
    name = f"lines_{uuid.uuid4().hex}"
    signals.createOrReplaceTempView(name)
    return tidy(s.sql(f"SELECT l_suppkey, posexplode(clean) AS (n, clean) FROM rls(TABLE({name}), key => 'l_suppkey')"), "clean", digits=2)


def _line(s, d):
    return signal.indexed(lines(s, d), *LI, {"raw": F.expr(RAW), "rx": REFS[0], "ry": REFS[1], "rz": REFS[2]})


def _regressor(s, d):
    u = _line(s, d).select("l_suppkey", "n", signal.regressor(["rx", "ry"], 3, "l_suppkey").alias("u")).where("u is not null")
    return u.select("l_suppkey", "n", F.posexplode("u").alias("i", "x"))


def oracle_sql() -> dict[str, str]:
    lo, hi, rl, rh = (x.tolist() for x in design.filter_bank("db4"))
    return {
        "moving_average": sql.moving_average(2),
        "moving_median": sql.moving_median(2),
        "fir_causal": sql.fir_causal(FIR["lowpass"]["numtaps"], FIR["lowpass"]["cutoff"], FS),
        "fir_zero_phase": sql.fir_zero_phase(_taps("lowpass")),
        "fir_zero_phase_window": sql.fir_zero_phase(_taps("lowpass")),
        **{f"fir_{k}": sql.fir_zero_phase(_taps(k)) for k in ("highpass", "bandpass", "bandstop", "kaiser")},
        "iir_causal_butter": sql.second_order(40.0, FS),
        "iir_causal_bessel": sql.second_order(40.0, FS, 3),
        "moving_average_blocks": sql.moving_average(4),
        "moving_median_blocks": sql.moving_median(4),
        "fir_causal_blocks": sql.fir_causal(FIR["lowpass"]["numtaps"], FIR["lowpass"]["cutoff"], FS),
        "fir_zero_phase_blocks": sql.fir_zero_phase(_long_taps()),
        "iir_causal_blocks": sql.cascade(design.iir_sections(3, [20.0, 60.0], fs=FS, btype="bandpass", ftype="ellip", rp=1.0, rs=40.0)),
        "iir_zero_phase_blocks": sql.iir_zero_phase(_sos("ellip"), 9),
        "wavelet_denoise_blocks": sql.wavelet(lo, hi, rl, rh, "denoise"),
        "dwt_synthesis_scaled": sql.deep_synthesis(*(x.tolist() for x in design.filter_bank("db2")), SCALES),
        "medians": f"select l_suppkey, count(*) as n, {sql.rounded('median(l_extendedprice)')} as median from lineitem group by l_suppkey",
        "threshold_modes": sql.thresholds(10.0),
        "istft_cropped": sql.cropped_istft(16, 4, 7, 12, 64),
        **{f"iir_causal_{k}": sql.iir_causal(_sos(k)) for k in IIR if k != "butter"},
        **{f"iir_zero_phase_{k}": sql.iir_zero_phase(_sos(k), 9) for k in IIR},
        "dwt_analysis": sql.dwt_analysis(lo, hi),
        "dwt_synthesis": f"with {sql.EV} select user_id, n, {sql.rounded('v')} as v from ev",
        "wavelet_denoise": sql.wavelet(lo, hi, rl, rh, "denoise"),
        "wavelet_baseline": sql.wavelet(lo, hi, rl, rh, "baseline"),
        "soft_threshold": f"select event_id, {sql.rounded('sign(value - 50) * greatest(abs(value - 50) - 10.0, 0.0)')} as v from events",
        "signal_vector_magnitude": f"with {sql.LI} select l_suppkey, n, {sql.rounded('sqrt(rx * rx + ry * ry + rz * rz)')} as svm from li",
        "regressor": sql.regressor(3),
        "lms_five_taps": sql.lms_taps(1e-6, 5, 5),
        "rls_five_taps": sql.rls_taps(0.99, 5, 2),
        "rls_table_function": sql.rls_taps(0.99, 5, 2),
        "blms_32_taps": sql.blms_taps(1e-6, 10, 32, 5),
        "gall_laguerre": sql.laguerre(GALL["M"], GALL["beta"], GALL["alpha"], 1e-3, 4),
        "gall_coefficients": sql.laguerre_coefficients(GALL["M"], GALL["beta"], GALL["alpha"], 1e-3, 4),
        **{f"iir_causal_{k}": sql.cascade(design.iir_sections(n, wn, fs=FS, **o)) for k, (n, wn, o) in DEEP.items()},
        "dwt_analysis_three_levels": sql.deep_analysis(*(x.tolist() for x in design.filter_bank("db2")[:2]), 3),
        "wavelet_denoise_hard": sql.deep_denoise(*(x.tolist() for x in design.filter_bank("sym4")), 2, "hard"),
        "wavelet_denoise_garrote": sql.deep_denoise(*(x.tolist() for x in design.filter_bank("haar")), 2, "garrote"),
        "lms": sql.lms(1e-5),
        "rls": sql.rls(0.99),
        "blms": sql.blms(1e-4, 10),
        "gall_learn": sql.gall(1e-3),
        "gall_learn_first_order": sql.gall_one(1e-3),
        "hybrid_kalman": sql.hybrid(1e-3, 0.99),
        "dwt_layer": sql.dwt_layer(*(x.tolist() for x in design.filter_bank("db6")[:2])),
        "idwt_layer": sql.idwt_layer(*(x.tolist() for x in design.filter_bank("db6")[2:])),
        "gall_freeze": sql.gall_freeze(K0[1], H0[1], H0[2]),
        "scc_bounds": sql.scc_bounds(SCC["num_cycles"]),
        "scc_preprocess": sql.scc_preprocess(SCC["target"], SCC["num_cycles"], SCC["shortest"]),
        "scc_postprocess": sql.scc_postprocess(SCC["num_cycles"], SCC["shortest"]),
        "fourier_resample": sql.fourier_resample(64),
        "stft": sql.stft(16, 4, 9, 16),
        "istft": "select vec_id, (generate_subscripts(embedding, 1) - 1)::int as n, round(unnest(embedding)::double, 6) + 0.0 as v from embeddings",
        "improved_mse": f"select l_suppkey, {sql.rounded('avg((l_discount - l_tax) ^ 2 * (1 + 2 * abs(l_tax)))')} as loss from lineitem group by l_suppkey",
        "focal_loss": f"""with e as (select label % 5 as label, list_transform(embedding[1:5], lambda x: x::double) as x from embeddings), c as (select label, ln(list_sum(list_transform(x, lambda v: exp(v)))) - x[label + 1] as ce from e)
select label, {sql.rounded('avg((1 - exp(-ce)) ^ 2 * ce)')} as loss from c group by label""",
        "beat_triples": """with b as (select label, vec_id, list_transform(embedding[1:6], lambda x: x::double) as s from embeddings),
t as (select label, vec_id, lag(s) over w || s || lead(s) over w || [vec_id::double, 0.5] as x, lag(vec_id) over w as p, lead(vec_id) over w as q from b window w as (partition by label order by vec_id))
select label, vec_id, (generate_subscripts(x, 1) - 1)::int as i, round(unnest(x), 6) + 0.0 as v from t where p is not null and q is not null""",
        "swt_kernel": "with w as (select vec_id, embedding[1]::double as a, embedding[2]::double as b, embedding[3]::double as c from embeddings), f as (select vec_id, [[a, b, c], [c, b, a], [a, -b, c], [c, -b, a]] as f from w) select vec_id, (p - 1)::int as filter, (i - 1)::int as i, round(f[p][i], 6) + 0.0 as w from f, (select unnest([1, 2, 3, 4]) as p), (select unnest([1, 2, 3]) as i)",
        "time2vec": "with x as (select vec_id, unnest(embedding)::double as v, (generate_subscripts(embedding, 1) - 1)::int as i from embeddings) select vec_id, i, round(v + 0.05 * (i / 63.0) + 0.02 + sin(-0.07 * (i / 63.0) + 0.1), 6) + 0.0 as v from x",
    }
