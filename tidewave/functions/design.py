"""Filter and wavelet design in NumPy: windowed-sinc FIR, the classical IIR families as second-order sections, Daubechies taps."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

#: Shares of cosines in generalised cosine windows.
_COSINES = {
    "hamming": (0.54, 0.46),
    "hann": (0.5, 0.5),
    "blackman": (0.42, 0.5, 0.08),
    "nuttall": (0.3635819, 0.4891775, 0.1365995, 0.0106411),
    "blackmanharris": (0.35875, 0.48829, 0.14128, 0.01168),
    "flattop": (0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368),
    "boxcar": (1.0,),
    "rectangular": (1.0,),
}


def _tukey(x: np.ndarray, alpha: float = 0.5) -> np.ndarray:
    if alpha <= 0:
        return np.ones_like(x)
    return np.where(np.abs(x) <= 1 - alpha, 1.0, 0.5 * (1 + np.cos(np.pi * (np.abs(x) - 1 + alpha) / alpha)))


def _parzen(n: int) -> np.ndarray:
    y = np.abs(np.arange(n) - (n - 1) / 2) / (n / 2)
    return np.where(y <= 0.5, 1 - 6 * y**2 * (1 - y), 2 * (1 - y) ** 3)


def window(kind, n: int) -> np.ndarray:
    """A symmetric window by name, or a tuple of name and parameters; a bare number is the beta of a Kaiser window."""
    name, *given = ("kaiser", kind) if isinstance(kind, (int, float)) else kind if isinstance(kind, (tuple, list)) else (kind,)
    if name in ("general_cosine", "general_hamming"):
        shares = given[0] if name == "general_cosine" else (given[0], 1 - given[0])
        return window_of_cosines(shares, n)
    if name in _COSINES:
        return window_of_cosines(_COSINES[name], n)
    m = np.arange(n) - (n - 1) / 2
    x = m / max((n - 1) / 2, 0.5)  # from -1 to 1
    shapes = {
        "kaiser": lambda beta: np.kaiser(n, beta),
        "gaussian": lambda std: np.exp(-0.5 * (m / std) ** 2),
        "general_gaussian": lambda power, sig: np.exp(-0.5 * np.abs(m / sig) ** (2 * power)),
        "exponential": lambda centre=None, tau=1.0: np.exp(-np.abs(m if centre is None else np.arange(n) - centre) / tau),
        "tukey": lambda alpha=0.5: _tukey(x, alpha),
        "bartlett": lambda: np.bartlett(n),
        "triang": lambda: 1 - np.abs(m / ((n + n % 2) / 2)),
        "barthann": lambda: 0.62 - 0.48 * np.abs(x / 2) + 0.38 * np.cos(np.pi * x),
        "bohman": lambda: np.where(np.abs(x) < 1, (1 - np.abs(x)) * np.cos(np.pi * np.abs(x)) + np.sin(np.pi * np.abs(x)) / np.pi, 0.0),
        "cosine": lambda: np.cos(np.pi * m / n),
        "lanczos": lambda: np.sinc(x),
        "parzen": lambda: _parzen(n),
    }
    if name not in shapes:
        raise ValueError(f"unknown window {kind!r}: {', '.join(sorted([*_COSINES, 'general_cosine', 'general_hamming', *shapes]))}")
    return shapes[name](*given) if n > 1 else np.ones(n)


def window_of_cosines(shares, n: int) -> np.ndarray:
    t = 2 * np.pi * np.arange(n) / max(1, n - 1)
    return sum(c * (-1) ** i * np.cos(i * t) for i, c in enumerate(shares)) * np.ones(n) if n > 1 else np.ones(n)


def check_band(cutoff, fs: float | None, what: str) -> np.ndarray:
    if fs is None:
        raise ValueError("the sampling rate fs is missing")
    edges = np.atleast_1d(np.asarray(cutoff, float))
    if np.any(edges <= 0) or np.any(edges >= fs / 2):
        raise ValueError(f"{what}: {edges.tolist()} Hz, but band edges are above 0 and below half of fs, {fs / 2}")
    return edges


def fir_taps(numtaps: int, cutoff, width: float | None = None, window_kind="hamming", pass_zero=True, scale: bool = True, fs: float | None = None) -> np.ndarray:
    """Window-method taps. ``pass_zero`` True and False choose low/stop and high/pass; a name does so without adding a tap."""
    edges = check_band(cutoff, fs, "cutoff")
    # A response that is not zero at fs/2 needs an odd length; lengths are only mended for the two plain flags.
    if numtaps % 2 == 0 and ((pass_zero is False and edges.size == 1) or (pass_zero is True and edges.size == 2)):
        numtaps += 1
    if isinstance(pass_zero, str):
        low = {"lowpass": True, "bandstop": True, "highpass": False, "bandpass": False}.get(pass_zero)
        if low is None:
            raise ValueError(f"pass_zero {pass_zero!r} is not a filter kind")
        pass_zero = low
    if width is not None:
        a = 2.285 * (numtaps - 1) * np.pi * width / (fs / 2) + 7.95
        beta = 0.1102 * (a - 8.7) if a > 50 else 0.5842 * (a - 21) ** 0.4 + 0.07886 * (a - 21) if a > 21 else 0.0
        window_kind = ("kaiser", beta)
    marks = [0.0] * bool(pass_zero) + (edges / (fs / 2)).tolist()
    marks += [1.0] * (len(marks) % 2)
    if marks[-1] == 1.0 and numtaps % 2 == 0:
        raise ValueError("a filter that passes fs/2 needs an odd number of taps")
    m = np.arange(numtaps) - (numtaps - 1) / 2
    bands = np.array(marks).reshape(-1, 2)
    taps = sum(hi * np.sinc(hi * m) - lo * np.sinc(lo * m) for lo, hi in bands) * window(window_kind, numtaps)
    if scale:
        lo, hi = bands[0]
        centre = 0.0 if lo == 0 else 1.0 if hi == 1 else (lo + hi) / 2
        taps = taps / np.sum(taps * np.cos(np.pi * m * centre))
    return taps


def _landen(k: float) -> list[float]:
    out = []
    while k > 1e-16 and len(out) < 12:
        k = (k / (1 + math.sqrt(max(0.0, 1 - k * k)))) ** 2
        out.append(k)
    return out


def _ascend(w, k: float):
    for v in reversed(_landen(k)):
        w = (1 + v) * w / (1 + v * w * w)
    return w


def _cd(u, k: float):
    return _ascend(np.cos(u * np.pi / 2), k)


def _sn(u, k: float):
    return _ascend(np.sin(u * np.pi / 2), k)


def _inverse_sn(w: complex, k: float) -> complex:
    before = k
    for v in _landen(k):
        w = 2 * w / ((1 + v) * (1 + np.sqrt(1 - (before * w) ** 2 + 0j)))
        before = v
    return 2 / np.pi * np.arcsin(w + 0j)


def prototype(kind: str, n: int, rp: float | None, rs: float | None) -> tuple[np.ndarray, np.ndarray, float]:
    """Zeros, poles and gain of the analog low-pass with its edge at 1."""
    m = np.arange(-n + 1, n, 2)
    none = np.empty(0, complex)
    circle = -np.exp(1j * np.pi * m / (2 * n))
    if kind in ("butter", "butterworth"):
        return none, circle, 1.0
    if kind in ("cheby1", "chebyshev1"):
        if rp is None:
            raise ValueError("a ripple in the passband, rp, is needed")
        eps = math.sqrt(10 ** (rp / 10) - 1)
        p = -np.sinh(math.asinh(1 / eps) / n + 1j * np.pi * m / (2 * n))
        return none, p, float(np.prod(-p).real) / (math.sqrt(1 + eps * eps) if n % 2 == 0 else 1.0)
    if kind in ("cheby2", "chebyshev2"):
        if rs is None:
            raise ValueError("an attenuation of the stopband, rs, is needed")
        mu = math.asinh(math.sqrt(10 ** (rs / 10) - 1)) / n
        z = 1j / np.sin(np.pi * m[m != 0] / (2 * n))
        p = 1 / (circle.real * math.sinh(mu) + 1j * circle.imag * math.cosh(mu))
        return z, p, float((np.prod(-p) / np.prod(-z)).real)
    if kind in ("ellip", "elliptic"):
        if rp is None or rs is None:
            raise ValueError("rp and rs are both needed")
        ep, es = math.sqrt(10 ** (rp / 10) - 1), math.sqrt(10 ** (rs / 10) - 1)
        k1 = ep / es
        if n == 1:
            p = np.array([-1 / ep + 0j])
            return none, p, 1 / ep
        u = (2 * np.arange(1, n // 2 + 1) - 1) / n
        comp = math.sqrt(1 - k1 * k1)
        k = math.sqrt(1 - (comp**n * float(np.prod(_sn(u, comp) ** 4))) ** 2)
        z = 1j / (k * _cd(u, k))
        v0 = -1j * _inverse_sn(1j / ep, k1) / n
        p = 1j * _cd(u - 1j * v0, k)
        z, p = np.concatenate([z, z.conj()]), np.concatenate([p, p.conj()])
        if n % 2:
            p = np.append(p, (1j * _sn(1j * v0, k)).real + 0j)
        gain = float((np.prod(-p) / np.prod(-z)).real)
        return z, p, gain * (10 ** (-rp / 20) if n % 2 == 0 else 1.0)
    if kind == "bessel":  # roots of the reverse Bessel polynomial, scaled so that their product is one (the phase's norm)
        p = np.roots([math.factorial(2 * n - k) / (2 ** (n - k) * math.factorial(k) * math.factorial(n - k)) for k in range(n, -1, -1)]).astype(complex)
        return none, p / abs(np.prod(p)) ** (1 / n), 1.0
    raise ValueError(f"filter family {kind!r} is not supported: butter, cheby1, cheby2, ellip or bessel")


def iir_sections(order: int, wn, rp: float | None = None, rs: float | None = None, btype: str = "lowpass", analog: bool = False, fs: float | None = None, ftype: str = "butter") -> np.ndarray:
    """Second-order sections, one row b0 b1 b2 a0 a1 a2 each."""
    edges = check_band(wn, fs, "Wn")
    if analog:
        raise ValueError("an analog filter has no sampling rate")
    kinds = {"low": "lowpass", "lp": "lowpass", "high": "highpass", "hp": "highpass", "band": "bandpass", "pass": "bandpass", "bp": "bandpass", "stop": "bandstop", "bs": "bandstop"}
    btype = kinds.get(btype, btype)
    if btype not in kinds.values():
        raise ValueError(f"btype {btype!r} is not a filter kind")
    if edges.size != (1 if btype in ("lowpass", "highpass") else 2):
        raise ValueError(f"{btype} needs {1 if btype in ('lowpass', 'highpass') else 2} edges")
    z, p, k = prototype(ftype, order, rp, rs)
    w = 4 * np.tan(np.pi * edges / fs)
    d = p.size - z.size
    if btype == "lowpass":
        z, p, k = z * w[0], p * w[0], k * w[0] ** d
    elif btype == "highpass":
        k *= float((np.prod(-z) / np.prod(-p)).real)
        z, p = np.concatenate([w[0] / z, np.zeros(d)]), w[0] / p
    else:
        bw, w0 = w[1] - w[0], math.sqrt(w[0] * w[1])
        if btype == "bandpass":
            two = lambda r: np.concatenate([r * bw / 2 + s * np.sqrt((r * bw / 2) ** 2 - w0**2 + 0j) for s in (1, -1)])
            z, p, k = np.concatenate([two(z), np.zeros(d)]), two(p), k * bw**d
        else:
            k *= float((np.prod(-z) / np.prod(-p)).real)
            two = lambda r: np.concatenate([bw / 2 / r + s * np.sqrt((bw / 2 / r) ** 2 - w0**2 + 0j) for s in (1, -1)])
            z, p = np.concatenate([two(z), np.full(d, 1j * w0), np.full(d, -1j * w0)]), two(p)
    k *= float((np.prod(4 - z) / np.prod(4 - p)).real)
    z, p = np.concatenate([(4 + z) / (4 - z), -np.ones(p.size - z.size)]), (4 + p) / (4 - p)

    def quadratics(r: np.ndarray) -> list[np.ndarray]:
        """Real quadratics with these roots, conjugates together, real roots in pairs; the last may be of degree one."""
        up = sorted(r[r.imag > 1e-9], key=lambda x: abs(abs(x) - 1))
        real = sorted(r[np.abs(r.imag) <= 1e-9].real, key=lambda x: abs(abs(x) - 1))
        out = [np.array([1.0, -2 * x.real, abs(x) ** 2]) for x in up]
        return out + [np.array([1.0, *([-sum(real[i : i + 2]), np.prod(real[i : i + 2])] if i + 1 < len(real) else [-real[i], 0.0])]) for i in range(0, len(real), 2)]

    nums, dens = quadratics(z), quadratics(p)
    sections = np.array([np.concatenate(x) for x in zip(nums, dens, strict=True)])
    sections[0, :3] *= k
    return sections


def _factors(n: int) -> list[np.ndarray]:
    """The polynomial of dbN's half-band filter beside its zeros at -1, in real factors: each has its roots inside the circle."""
    found = []
    for r in np.roots([math.comb(n - 1 + k, k) for k in range(n - 1, -1, -1)]):  # roots in y = (2 - z - 1/z) / 4
        if r.imag < -1e-12:
            continue
        b = 1 - 2 * r
        z = b + np.sqrt(b * b - 1 + 0j)
        z = z if abs(z) < 1 else 1 / z
        found.append(np.array([1, -z.real]) if abs(r.imag) <= 1e-12 else np.array([1, -2 * z.real, abs(z) ** 2]))
    return found


def _scaling(n: int, factors: list[np.ndarray]) -> np.ndarray:
    taps = np.ones(1)
    for f in [*factors, *[np.ones(2)] * n]:
        taps = np.convolve(taps, f)
    return taps * math.sqrt(2) / taps.sum()


def symlet(n: int) -> np.ndarray:
    """Of all choices of roots inside or outside the circle the one with the most nearly linear phase."""
    factors, best = _factors(n), None
    w = np.linspace(0, np.pi, 257)[1:-1]
    for choice in range(1 << len(factors)):
        taps = _scaling(n, [f[::-1] if choice >> i & 1 else f for i, f in enumerate(factors)])
        phase = np.unwrap(np.angle(np.exp(-1j * np.outer(w, np.arange(2 * n))) @ taps))
        off = phase - w * (w @ phase) / (w @ w)
        price = float(off @ off)
        if best is None or price < best[0] - 1e-9:
            best = (price, taps)
    taps = best[1]
    return taps if (abs(taps[0]) > abs(taps[-1])) == (n == 7) else taps[::-1]  # fixed: the usual tables' direction


def scaling_taps(name: str) -> np.ndarray:
    """The scaling (reconstruction low-pass) taps of haar, dbN, symN or coif1."""
    n = int(name.lstrip("dbsym")) if name[:2] == "db" and name[2:].isdigit() or name[:3] == "sym" and name[3:].isdigit() else 1 if name == "haar" else 0
    if name == "coif1":
        r = math.sqrt(7)
        return np.array([1 - r, 5 + r, 14 + 2 * r, 14 - 2 * r, 1 - r, r - 3]) / (16 * math.sqrt(2))
    if not (1 <= n <= 20 and name[:3] != "sym" or 2 <= n <= 8):
        raise ValueError(f"wavelet {name!r} is not supported: haar, db1 to db20, sym2 to sym8, coif1")
    return symlet(n) if name[:3] == "sym" and n > 3 else _scaling(n, _factors(n))


@lru_cache(64)
def filter_bank(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """dec_lo, dec_hi, rec_lo, rec_hi"""
    rec_lo = scaling_taps(name)
    dec_lo = rec_lo[::-1]
    dec_hi = rec_lo * (-1.0) ** (np.arange(rec_lo.size) + 1)
    return dec_lo, dec_hi, rec_lo, dec_hi[::-1]
