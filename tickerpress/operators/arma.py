"""Regression with ARMA errors of one series: y = c + xb + u, u an ARMA(p, q) process.

Fitted by conditional sum of squares: Gauss-Newton steps from a start by lagged
least squares (Hannan & Rissanen 1982).  Without moving-average terms and
regressors that is ordinary least squares on the lagged target.
"""

from __future__ import annotations

import numpy as np

#: Length of the autoregression whose residuals stand in for the shocks at the start.
LONG_ORDER = 8
_STEPS, _TINY = 100, 1e-13


class Arma:
    """Orders and parameters in the order: constant, regressors, AR terms, MA terms."""

    def __init__(self, p: int, q: int, values: np.ndarray, rss: float = np.nan, n: int = 0):
        self.p, self.q, self.values, self.rss, self.n = p, q, values, rss, n

    def parts(self):
        k = len(self.values) - self.p - self.q
        return self.values[:k], self.values[k:k + self.p], self.values[k + self.p:]

    def fitted(self, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        """One-step forecasts of y from the values before; NaN for the first p."""
        return y - np.r_[np.full(self.p, np.nan), _shocks(self, y, x)[1]]

    def path(self, y: np.ndarray, x: np.ndarray, ahead: np.ndarray) -> np.ndarray:
        """Forecasts of the rows of ``ahead`` (later regressors), future shocks being zero."""
        b, phi, theta = self.parts()
        u, e = _shocks(self, y, x)
        u, e = list(u[::-1][:self.p]), list(e[::-1][:self.q]) + [0.0] * self.q
        out = []
        for base in np.column_stack([np.ones(len(ahead)), ahead]) @ b:
            step = phi @ np.array(u[:self.p]) + theta @ np.array(e[:self.q])
            u, e = [step, *u], [0.0, *e]
            out.append(base + step)
        return np.array(out)


def fit(y: np.ndarray, x: np.ndarray, p: int, q: int, skip: int | None = None, start: Arma | None = None) -> Arma | None:
    """The fit on all rows, errors counted from row ``skip`` (p by default) on; None if there are too few rows."""
    skip = p if skip is None else skip
    terms = 1 + x.shape[1] + p + q
    if len(y) - skip < terms + 1:
        return None
    if not q and not x.shape[1]:  # the closed form needs no steps
        now = Arma(p, q, _start(y[skip - p:], x[skip - p:], p, q), n=len(y) - skip)
        now.rss = _error(now, y, x, skip)[0]
        return now
    now = Arma(p, q, start.values.copy() if start else _start(y, x, p, q))
    now.values = _stable(now)
    rss, e = _error(now, y, x, skip)
    for _ in range(_STEPS):
        step = np.linalg.lstsq(_slopes(now, y, x)[skip - p:], -e, rcond=1e-10)[0]
        scale = 1.0
        while scale > 1e-6:
            trial = Arma(p, q, now.values + scale * step)
            trial.values = _stable(trial)
            new_rss, new_e = _error(trial, y, x, skip)
            if new_rss <= rss:
                break
            scale /= 2
        else:
            break
        gain, now, rss, e = rss - new_rss, trial, new_rss, new_e
        if gain <= _TINY * (1e-300 + rss):
            break
    now.rss, now.n = float(rss), len(y) - skip
    return now


def _design(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x])


def _lags(v: np.ndarray, n: int) -> np.ndarray:
    """Columns v[t-1] .. v[t-n] for t from n on."""
    return np.column_stack([v[n - i:len(v) - i] for i in range(1, n + 1)]) if n else np.empty((len(v), 0))


def _start(y: np.ndarray, x: np.ndarray, p: int, q: int) -> np.ndarray:
    if not p + q:
        return np.linalg.lstsq(_design(x), y, rcond=None)[0]
    if not q and not x.shape[1]:
        c = np.linalg.lstsq(np.column_stack([np.ones(len(y) - p), _lags(y, p)]), y[p:], rcond=None)[0]
        rest = 1 - c[1:].sum()
        return np.r_[c[0] / rest if abs(rest) > 1e-9 else y.mean(), c[1:]]
    b = np.linalg.lstsq(_design(x), y, rcond=None)[0]
    u = y - _design(x) @ b
    m = min(max(LONG_ORDER, p), max(1, len(u) // 4))
    e = np.r_[np.zeros(m), u[m:] - _lags(u, m) @ np.linalg.lstsq(_lags(u, m), u[m:], rcond=None)[0]]
    t = max(p, q)
    z = np.column_stack([_lags(u, p)[t - p:], _lags(e, q)[t - q:]])
    return np.r_[b, np.linalg.lstsq(z, u[t:], rcond=None)[0]]


def _stable(m: Arma) -> np.ndarray:
    """The parameters, both polynomials drawn inside the unit circle where they are not."""
    b, phi, theta = m.parts()
    return np.r_[b, _shrunk(phi), -_shrunk(-theta)]


def _shrunk(c: np.ndarray, most: float = 0.995) -> np.ndarray:
    if not len(c) or not np.isfinite(c).all():
        return np.zeros(len(c))
    largest = np.abs(np.linalg.eigvals(np.vstack([c, np.eye(len(c))[:-1]]))).max()
    return c if largest <= most else c * (most / largest) ** np.arange(1, len(c) + 1)


def _undo(theta: np.ndarray, v: np.ndarray) -> np.ndarray:
    """w with w[t] + theta_1 w[t-1] + .. = v[t], starting from zeros, for every column of v."""
    if not len(theta):
        return v
    response, q = [1.0], len(theta)
    while len(response) < len(v) and (len(response) <= q or max(map(abs, response[-q:])) > 1e-15):
        response.append(-sum(theta[i] * response[-1 - i] for i in range(min(q, len(response)))))
    response = np.array(response)
    return np.column_stack([np.convolve(c, response)[:len(v)] for c in v.T])


def _filtered(phi: np.ndarray, v: np.ndarray) -> np.ndarray:
    """v[t] - phi_1 v[t-1] - .. for t from p on."""
    p = len(phi)
    out = v[p:].copy()
    for i in range(p):
        out -= phi[i] * v[p - 1 - i:len(v) - 1 - i]
    return out


def _shocks(m: Arma, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Regression residuals, and the shocks from row p on."""
    b, phi, theta = m.parts()
    u = y - _design(x) @ b
    return u, _undo(theta, _filtered(phi, u)[:, None])[:, 0]


def _error(m: Arma, y: np.ndarray, x: np.ndarray, skip: int) -> tuple[float, np.ndarray]:
    e = _shocks(m, y, x)[1][skip - m.p:]
    rss = float(e @ e)
    return (rss if np.isfinite(rss) else np.inf), e


def _slopes(m: Arma, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Derivatives of the shocks by the parameters, from row p on."""
    _, phi, theta = m.parts()
    u, e = _shocks(m, y, x)
    late = np.column_stack([np.r_[np.zeros(i), e[:len(e) - i]] for i in range(1, m.q + 1)]) if m.q else np.empty((len(e), 0))
    return _undo(theta, -np.column_stack([_filtered(phi, _design(x)), _lags(u, m.p), late]))
