"""Streams against batch: typed states, restarts, initial states, timers, windows and spectra."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewave.functions import design, kernels
from tidewave.streaming import causal

rng = np.random.default_rng(11)


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", causal.ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def write(folder, i, rows):
    folder.mkdir(exist_ok=True)
    pd.DataFrame(rows).to_json(folder / f"{i}.json", orient="records", lines=True)
    os.utime(folder / f"{i}.json", (i + 1, i + 1))


def source(spark, folder, schema="k long, t long, v double"):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def ran(df, tmp_path, **trigger):
    """Runs until nothing is left; the results so far."""
    query = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    try:
        if trigger:
            query.processAllAvailable()
        else:
            query.awaitTermination(200)
    finally:
        query.stop()
    return df.sparkSession.read.parquet(str(tmp_path / "out"))


CUTS = [(0, 3), (3, 40), (40, 41), (41, 90)]


@pytest.mark.parametrize("make", [lambda: causal.SosStream(design.iir_sections(4, 40, fs=250)), lambda: causal.LmsStream(3, 5, 0.01), causal.RlsStream, lambda: causal.BlmsStream(3, 8, 0.01, 10), lambda: causal.LatticeStream(3, 0.99, 0.4), causal.FusionStream, lambda: causal.MeanStream(9), lambda: causal.MedianStream(8), lambda: causal.FrameStream(16, 12)])
def test_numbers_carry_the_whole_state(make):
    raw, ref = rng.standard_normal(90), rng.standard_normal((3, 90))
    whole = make()
    one = isinstance(whole, (causal.SosStream, causal.MeanStream, causal.FrameStream))
    args = lambda s, e: (raw[s:e],) if one else (raw[s:e], raw[s:e], ref[:1, s:e] if isinstance(whole, causal.LatticeStream) else ref[:, s:e])
    want, got, numbers = whole.push(*args(0, 90)), [], None
    for s, e in CUTS:
        part = make()
        if numbers is not None:
            part.restore(numbers)
        got.append(part.push(*args(s, e)))
        numbers = part.numbers()
    assert np.allclose(np.concatenate(got), want)


@pytest.mark.parametrize("n", [9, 10, 30])
def test_window_streams_equal_batch(n):
    x = rng.standard_normal(n)
    mean = np.convolve(np.pad(x, 4, mode="reflect"), np.ones(9) / 9, "valid")
    median = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x, 4), 9), axis=1)
    for made, want in ((causal.MeanStream, mean), (causal.MedianStream, median)):
        for step in (1, 2, 7, n):
            f = made(9)
            out = [f.push(x[i : i + step]) for i in range(0, n, step)]
            assert sum(map(len, out)) == n - 4
            assert np.allclose(np.concatenate([*out, f.push(np.empty(0), end=True)]), want)
    with pytest.raises(ValueError, match="more than the signal has"):
        causal.MeanStream(9).push(x[:8], end=True)


def test_frames_equal_batch():
    x = rng.standard_normal(203)
    f = causal.FrameStream(32, 24)
    out = [f.push(x[i : i + 11]) for i in range(0, 203, 11)]
    assert np.allclose(np.concatenate([*out, f.push(np.empty(0), end=True)]).T, kernels.stft(x, 32, 24))


def test_iir_stream_restarts_from_its_checkpoint(spark, tmp_path):
    x = rng.standard_normal((2, 80))
    sos = design.iir_sections(3, 40, fs=250)
    rows = lambda s, e: [{"k": k, "t": t, "v": x[k, t]} for k in (0, 1) for t in range(s, e)]
    write(tmp_path / "in", 0, rows(0, 25))
    write(tmp_path / "in", 1, rows(25, 40))
    assert ran(causal.iir_stream(source(spark, tmp_path / "in"), "k", "t", "v", sos), tmp_path).count() == 80
    write(tmp_path / "in", 2, [*rows(40, 80), {"k": 0, "t": 39, "v": 5.0}])  # one late sample
    got = ran(causal.iir_stream(source(spark, tmp_path / "in"), "k", "t", "v", sos), tmp_path)
    for k in (0, 1):
        assert np.allclose([r.clean for r in got.where(f"k = {k}").orderBy("t").collect()], kernels.sos_filter(sos, x[k]))
    # the state is a table
    state = spark.read.format("statestore").option("stateVarName", "filter").load(str(tmp_path / "ck"))
    found = {r.key.k: r.value for r in state.collect()}
    end = np.zeros((len(sos), 2))
    kernels.sos_filter(sos, x[1], end)
    assert set(found) == {0, 1} and found[1].last == 79
    assert np.allclose(found[1].state, end.ravel())


def test_initial_state_from_a_batch(spark, tmp_path):
    raw, ref = rng.standard_normal(70), rng.standard_normal((2, 70))
    rows = [{"k": 3, "t": t, "a": raw[t], "x": ref[0, t], "y": ref[1, t]} for t in range(70)]
    schema = "k long, t long, a double, x double, y double"
    make = lambda: causal.RlsStream(2, 4)
    history = spark.createDataFrame(pd.DataFrame(rows[:30])).select("k", "t", "a", "x", "y")
    states = causal.states_of(history, "k", "t", causal.adaptive_inputs("a", ("x", "y")), causal._Referenced(make))
    write(tmp_path / "in", 0, rows[30:])
    got = ran(causal.adaptive_stream(source(spark, tmp_path / "in", schema), "k", "t", "a", ("x", "y"), make, states=states), tmp_path)
    assert np.allclose([r.clean for r in got.orderBy("t").collect()], kernels.rls(raw, ref, 4)[30:])


@pytest.mark.parametrize("kind", ["mean", "median", "stft"])
def test_an_idle_signal_is_finished(spark, tmp_path, kind):
    x = rng.standard_normal(40)
    write(tmp_path / "in", 0, [{"k": 1, "t": t, "v": x[t]} for t in range(23)])
    write(tmp_path / "in", 1, [{"k": 1, "t": t, "v": x[t]} for t in range(23, 40)])
    stream = source(spark, tmp_path / "in")
    if kind == "stft":
        df = causal.stft_stream(stream, "k", "t", "v", 16, 12, idle_ms=4000)
    else:
        df = {"mean": causal.mean_stream, "median": causal.median_stream}[kind](stream, "k", "t", "v", 5, idle_ms=4000)
    query = df.writeStream.format("memory").queryName(f"idle_{kind}").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    want = kernels.stft(x, 16, 12).T if kind == "stft" else np.convolve(np.pad(x, 2, mode="reflect"), np.ones(5) / 5, "valid") if kind == "mean" else np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x, 2), 5), axis=1)
    try:
        for _ in range(60):
            query.awaitTermination(1)
            if spark.table(f"idle_{kind}").count() >= len(want):
                break
    finally:
        query.stop()
    got = spark.table(f"idle_{kind}").orderBy("t").collect()
    assert len(got) == len(want)
    assert np.allclose([np.array(r.re) + 1j * np.array(r.im) for r in got] if kind == "stft" else [r.clean for r in got], want)


def test_streams_refuse_nulls_and_other_stores(spark, tmp_path):
    write(tmp_path / "in", 0, [{"k": 1, "t": 0, "v": 1.0}, {"k": 1, "t": 1, "v": None}])
    df = source(spark, tmp_path / "in")
    with pytest.raises(Exception, match="null in v"):
        ran(causal.iir_stream(df, "k", "t", "v", design.iir_sections(2, 40, fs=250)), tmp_path)
    write(tmp_path / "late", 0, [{"k": 1, "t": 5, "v": 1.0}, {"k": 1, "t": 5, "v": 2.0}])
    with pytest.raises(Exception, match="late samples"):
        ran(causal.mean_stream(source(spark, tmp_path / "late"), "k", "t", "v", 3, late="fail"), tmp_path / "b")
    with pytest.raises(ValueError, match="drop or fail"):
        causal.mean_stream(df, "k", "t", "v", 3, late="x")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    with pytest.raises(ValueError, match="RocksDB"):
        causal.mean_stream(df.withColumn("v", F.col("v")), "k", "t", "v", 3)
