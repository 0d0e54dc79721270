"""SQL table functions against the DataFrame operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.functions import kernels, table_functions
from tidewave.operators import adaptive, signal, static

rng = np.random.default_rng(3)


@pytest.fixture(scope="module")
def ecg(spark):
    table_functions.register(spark)
    df = spark.createDataFrame([(f"s{k}", i, *map(float, rng.standard_normal(4))) for k in (1, 2, 3) for i in range(40 + k)], "k string, n int, raw double, rx double, ry double, rz double").repartition(4)
    df.createOrReplaceTempView("ecg")
    return df


def rows(df, *cols):
    return {(r.k, r.n): tuple(r[c] for c in cols) for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


REFS = ("rx", "ry", "rz")
PARTED = "TABLE(ecg) PARTITION BY k ORDER BY n"


def test_results_are_those_of_the_operators(spark, ecg):
    run = lambda q: spark.sql(f"SELECT * FROM {q}")
    out = run(f"rls({PARTED})")
    assert dict(out.dtypes) == {"k": "string", "n": "int", "clean": "double"}
    same(rows(out, "clean"), rows(adaptive.rls_anc(ecg, "k", "n", "raw", REFS), "clean"))
    same(rows(run(f"rls({PARTED}, filter_order => 3, lam => 0.9D, svm => true)"), "clean"), rows(adaptive.rls_anc(ecg, "k", "n", "raw", REFS, 3, 0.9, SVM_condition=True), "clean"))
    same(rows(run(f"lms({PARTED}, lowpass => 'rx', mu => 0.01)"), "clean"), rows(adaptive.modified_lms_anc(ecg, "k", "n", "raw", "rx", REFS, 0.01), "clean"))
    same(rows(run(f"blms({PARTED}, l => 4, filter_order => 6)"), "clean"), rows(adaptive.blms_filter(ecg, "k", "n", "raw", REFS, 4, 0.01, 6), "clean"))
    same(rows(run(f"hybrid_kalman({PARTED}, m => 2)"), "clean", "y_total"), rows(adaptive.hybrid_gall_kalman(ecg, "k", "n", "raw", REFS, 2), "clean", "y_total"))
    same(rows(run(f"iir({PARTED}, value => 'raw', wn => ARRAY(20D, 60D), btype => 'bandpass', fs => 250)"), "v"), rows(static.iir_filter(ecg, "k", "n", "raw", 2, [20, 60], btype="bandpass", fs=250), "v"))
    same(rows(run(f"iir({PARTED}, value => 'raw', wn => 40, fs => 250, ftype => 'bessel', zero_phase => false)"), "v"), rows(static.iir_filter(ecg, "k", "n", "raw", 2, 40, fs=250, ftype="bessel", zero_phase=False), "v"))
    assert run("rls(TABLE(SELECT * FROM ecg WHERE k = 'none') PARTITION BY k ORDER BY n)").count() == 0


@pytest.mark.parametrize(("call", "error"), [("rls({t}, raw => 'none')", "no column none"), ("rls({t}, lam => 1.1D)", "forgetting factor"), ("rls({t}, order => 3)", "unknown argument"), ("iir({t}, value => 'raw')", "wn is missing"), ("iir({t}, value => 'raw', wn => 200, fs => 250)", "Wn|band edges"), ("blms({t}, l => 0)", "at least 1"), ("rls({t}, key => 'n')", "named like a result")])
def test_options_are_checked_when_the_query_is_analysed(spark, ecg, call, error):
    with pytest.raises(Exception, match=error):
        spark.sql(f"SELECT * FROM {call.format(t=PARTED)}")


def test_nulls_and_ties_are_errors(spark, ecg):
    ecg.unionAll(ecg.where("n = 7")).createOrReplaceTempView("tied")
    with pytest.raises(Exception, match="tied order"):
        spark.sql("SELECT * FROM rls(TABLE(tied) PARTITION BY k ORDER BY n)").collect()
    ecg.withColumn("ry", F.when(F.col("n") != 7, F.col("ry"))).createOrReplaceTempView("nulls")
    with pytest.raises(Exception, match="null in"):
        spark.sql("SELECT * FROM rls(TABLE(nulls) PARTITION BY k ORDER BY n)").collect()


def test_rows_of_arrays_are_signals(spark, ecg):
    """As signal by signal, whether few or many step together; nothing is partitioned by the signal, nor crosses row by row."""
    many = spark.createDataFrame([(f"s{k}", i, *map(float, rng.standard_normal(4))) for k in range(30) for i in range(12 + k)], "k string, n int, raw double, rx double, ry double, rz double")
    many.createOrReplaceTempView("many")
    for table, df in (("ecg", ecg), ("many", many)):
        signal.gathered(df, "k", "n", {c: c for c in ("raw", *REFS)}).withColumnRenamed("__key", "k").coalesce(1).createOrReplaceTempView("arrays")
        for call, option in (("rls", ""), ("lms", ", lowpass => 'rx'"), ("blms", ", filter_order => 6"), ("hybrid_kalman", ", m => 2"), ("iir", ", value => 'raw', wn => 40, fs => 250")):
            out = "v" if call == "iir" else "clean"
            got = spark.sql(f"SELECT k, posexplode({out}) AS (n, {out}) FROM {call}(TABLE(arrays){option})")
            same(rows(got, out), rows(spark.sql(f"SELECT * FROM {call}(TABLE({table}) PARTITION BY k ORDER BY n{option})"), out))
    assert spark.sql("SELECT * FROM hybrid_kalman(TABLE(arrays))").dtypes == [("k", "string"), ("clean", "array<double>"), ("y_total", "array<double>")]
    spark.sql("SELECT 'a' AS k, array() AS v UNION ALL SELECT 'b', array(1D, 2D)").selectExpr("k", "cast(v AS array<double>) AS v").createOrReplaceTempView("empty")
    assert {r.k: len(r.v) for r in spark.sql("SELECT * FROM iir(TABLE(empty), wn => 40, fs => 250)").collect()} == {"a": 0, "b": 2}


@pytest.mark.parametrize(("raw", "error"), [("array(1D, NULL, 2D, 3D, 4D, 5D)", "null in"), ("cast(NULL AS array<double>)", "null in"), ("array(1D)", "different lengths"), ("1D", "some are not")])
def test_arrays_are_checked(spark, raw, error):
    spark.sql(f"SELECT 1 AS k, {raw} AS raw, array_repeat(1D, 6) AS rx, array_repeat(1D, 6) AS ry, array_repeat(1D, 6) AS rz").createOrReplaceTempView("odd")
    with pytest.raises(Exception, match=error):
        spark.sql("SELECT * FROM rls(TABLE(odd))").collect()


def test_arrays_wait_in_groups_of_bounded_size():
    f = table_functions.Iir(table_functions.Analysed(None, given={"value": "v", **{k: v for k, v in table_functions.Iir.DEFAULTS.items() if k != "value"}, "wn": 40, "fs": 250}, key=0, values=(1,), arrays=True))
    done = [r for k in range(2500) for r in (f.eval((k, [1.0] * 3)) or ())]
    assert [r[0] for r in done] == list(range(2000)) and len(f.waiting) == 500
    assert [r[0] for r in f.eval((9999, [0.0] * table_functions.TOGETHER))][0] == 9999 and not f.waiting and not f.samples


@pytest.mark.parametrize("signals", [1, kernels.FEW - 1, kernels.FEW, 20])
def test_few_and_many_signals_give_the_same_rls(signals):
    raw = [rng.standard_normal(30 + i) for i in range(signals)]
    refs = [rng.standard_normal((3, x.size)) for x in raw]
    for x, u, got in zip(raw, refs, kernels.rls_all(raw, refs), strict=True):
        w, p = np.zeros((1, 15)), np.eye(15)[None]
        for i in range(4, x.size):
            at = kernels.lagged(u, 5)[i - 4][None]
            assert got[i] == pytest.approx(x[i] - (w @ at[0])[0])
            w, p = kernels.rls_step(w, p, at, np.array([got[i]]), 0.99)
