"""Adaptive noise cancelling against reference channels: the signals of an Arrow batch step through time together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tidewave.functions import kernels
from tidewave.operators.signal import per_signal

Arrays = list[np.ndarray]


def _refs(svm: bool, rx: Arrays, ry: Arrays, rz: Arrays) -> Arrays:
    return [np.sqrt(x**2 + y**2 + z**2)[None, :] if svm else np.stack([x, y, z]) for x, y, z in zip(rx, ry, rz, strict=True)]


def modified_lms_anc(df: DataFrame, key: str, order, raw, lowpass, refs, mu=0.001, filter_order=5, SVM_condition=False) -> DataFrame:  # noqa: N803
    """(key, n, clean): the low-passed signal's error drives the weights, the raw signal is cleaned."""
    x, y, z = refs
    fn = lambda raw, low, rx, ry, rz: {"clean": kernels.lms_all(raw, low, _refs(SVM_condition, rx, ry, rz), mu, filter_order)}
    return per_signal(df, key, order, {"raw": raw, "low": lowpass, "rx": x, "ry": y, "rz": z}, ["clean"], fn, together=True)


def rls_anc(df: DataFrame, key: str, order, raw, refs, filter_order=5, lam=0.99, delta=1.0, SVM_condition=False) -> DataFrame:  # noqa: N803
    """(key, n, clean)"""
    kernels.check_forgetting(lam)
    x, y, z = refs
    fn = lambda raw, rx, ry, rz: {"clean": kernels.rls_all(raw, _refs(SVM_condition, rx, ry, rz), filter_order, lam, delta)}
    return per_signal(df, key, order, {"raw": raw, "rx": x, "ry": y, "rz": z}, ["clean"], fn, together=True)


def blms_filter(df: DataFrame, key: str, order, raw, refs, L=10, mu=0.01, filter_order=32, SVM_condition=False) -> DataFrame:  # noqa: N803
    """(key, n, clean)"""
    kernels.check_block(L)
    x, y, z = refs
    fn = lambda raw, rx, ry, rz: {"clean": kernels.blms_all(raw, _refs(SVM_condition, rx, ry, rz), L, mu, filter_order)}
    return per_signal(df, key, order, {"raw": raw, "rx": x, "ry": y, "rz": z}, ["clean"], fn, together=True)


def hybrid_gall_kalman(df: DataFrame, key: str, order, raw, refs, M_gall=5, beta_gall=1.0, alpha_gall=0.0, epsi_gall=1e-3, lambda_K=0.99, delta_K=1.0) -> DataFrame:  # noqa: N803
    """(key, n, clean, y_total, wx, wy, wz)"""
    kernels.check_forgetting(lambda_K, "lambda_K")
    x, y, z = refs

    def fn(raw, rx, ry, rz):
        clean, noise, w = zip(*kernels.hybrid_all(raw, _refs(False, rx, ry, rz), M_gall, beta_gall, alpha_gall, epsi_gall, lambda_K, delta_K), strict=True)
        return {"clean": clean, "y_total": noise, **{f"w{a}": [v[:, i] for v in w] for i, a in enumerate("xyz")}}

    return per_signal(df, key, order, {"raw": raw, "rx": x, "ry": y, "rz": z}, ["clean", "y_total", "wx", "wy", "wz"], fn, together=True)


def gall_filter(df: DataFrame, key: str, order, x, d, M=None, beta=1.0, alpha=0.0, epsi=1e-3, k0=None, h0=None) -> DataFrame:  # noqa: N803
    """(key, n, err, y): learns with M given; else k0 and h0 stay fixed."""
    kernels.lattice(np.zeros(0), np.zeros(0), M, beta, alpha, epsi, k0, h0)  # an error on the driver if the options don't fit
    fn = lambda x, d: dict(zip(("err", "y"), list(zip(*kernels.lattice_all(x, d, M, beta, alpha, epsi, k0, h0), strict=True))[:2], strict=True))
    return per_signal(df, key, order, {"x": x, "d": d}, ["err", "y"], fn, together=True)


def gall_coefficients(df: DataFrame, key: str, order, x, d, M, beta=1.0, alpha=0.0, epsi=1e-3) -> DataFrame:  # noqa: N803
    """(key, n, h, k): the coefficients after the last sample; k has one fewer and ends in NaN."""

    def fn(x, d):
        found = kernels.lattice_all(x, d, M, beta, alpha, epsi)
        return {"h": [h for _, _, h, _ in found], "k": [np.append(k, np.nan) for *_, k in found]}

    return per_signal(df, key, order, {"x": x, "d": d}, ["h", "k"], fn, together=True)
