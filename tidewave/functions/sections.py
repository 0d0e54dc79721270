"""Second-order sections as a linear system of two numbers of state each: its transition, what it rings out to, and fast runs."""

from __future__ import annotations

import numpy as np

from tidewave.functions.kernels import sos_filter

#: Shorter stretches are filtered sample by sample.
SHORT = 2048


def _steps(sos: np.ndarray, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x`` step through time together; ``state`` is (rows, 2 * sections). Gives outputs and last states."""
    y, state = np.empty_like(x), state.T.copy()
    for n in range(x.shape[1]):
        v = x[:, n]
        for i, (b0, b1, b2, _, a1, a2) in enumerate(sos):
            w = b0 * v + state[2 * i]
            state[2 * i] = b1 * v - a1 * w + state[2 * i + 1]
            state[2 * i + 1] = b2 * v - a2 * w
            v = w
        y[:, n] = v
    return y, state.T


def transition(sos: np.ndarray) -> np.ndarray:
    """The matrix by which a sample of zero changes the state."""
    size = 2 * len(sos)
    return _steps(sos, np.zeros((size, 1)), np.eye(size))[1].T


def ringing(sos: np.ndarray, n: int) -> np.ndarray:
    """(n, states): the next n outputs to zeros, for each unit of state."""
    size = 2 * len(sos)
    rows = _steps(sos, np.zeros((size, 1)), np.eye(size))[0].T
    power = transition(sos)
    while len(rows) < n:
        rows, power = np.concatenate([rows, rows @ power]), power @ power
    return rows[:n]


def run(sos: np.ndarray, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs and last state from a first state: as ``kernels.sos_filter``, with stretches of a long one side by side."""
    width = int(np.sqrt(x.size)) if x.size >= SHORT else 0
    head = x.size - x.size % width if width else 0
    parts = []
    if head:
        y, ends = _steps(sos, x[:head].reshape(-1, width), np.zeros((head // width, state.size)))
        power, entry = np.linalg.matrix_power(transition(sos), width), np.empty_like(ends)
        for i, z in enumerate(ends):
            entry[i], state = state, power @ state + z
        parts.append((y + entry @ ringing(sos, width).T).ravel())
    rest = state.reshape(-1, 2).copy()
    parts.append(sos_filter(sos, x[head:], rest))
    return np.concatenate(parts), rest.ravel()
