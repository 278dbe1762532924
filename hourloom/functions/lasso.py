"""A small exact lasso path with AIC choice for one target (runs inside a grouped map).

Homotopy of the published least-angle method (Efron, Hastie, Johnstone and Tibshirani, 2004): between two
breakpoints the solution moves on a straight line, so each breakpoint costs one solve over the columns in use.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

MIN_ROWS = 10
MAX_COEF = 1e3
LEAVING = 8  # columns that may leave a path again after its AIC seems settled


def noise_variance(gram: np.ndarray, cov: np.ndarray, yy: np.ndarray, n: int) -> np.ndarray:
    """Residual variance of each target, from products alone: gram and cov per observation, yy the targets' sums of squares.

    In the eigenvectors of gram a fit that keeps the share h of direction i leaves (1 - h)^2 of that direction's part of y, so the residual is a
    quadratic form. Least squares (h = 1) if rows outnumber columns by more than one; else a ridge whose penalty is the mean squared singular value.
    """
    p = len(gram)
    strength, basis = np.linalg.eigh(gram)
    real = strength > max(float(strength[-1]), 0.0) * 1e-12
    strength = strength[real]
    part = n * (basis[:, real].T @ cov) ** 2 / strength[:, None]  # squared length of y along each direction
    if n > p + 1:
        keep, used = np.ones(len(strength)), p + 1.0
    else:
        keep = strength / (strength + np.trace(gram) / min(n, p))
        used = float(keep.sum())
    left = yy - ((1 - (1 - keep) ** 2)[:, None] * part).sum(axis=0)
    return np.maximum(left / max(n - used, 1.0), 1e-8)


class Walk(NamedTuple):
    """The chosen breakpoint of a path, whether the path came to its end, and the breakpoints before and after (None at an end)."""

    coef: np.ndarray
    penalty: float
    ended: bool
    before: np.ndarray | None
    after: np.ndarray | None


def aic_path(gram: np.ndarray, cov: np.ndarray, yy: float, n: int, variance: float) -> Walk:
    """The breakpoint with the lowest AIC; gram and cov are per observation."""
    p = len(cov)
    w, c = np.zeros(p), cov.copy()
    alpha = float(np.abs(c).max())
    best, chosen = yy / variance, Walk(w.copy(), alpha, True, None, None)
    if alpha <= 0:
        return chosen
    least = max(n - p - 1.0, 0.0)  # residual term of the full fit, below which no model gets
    floor, used, blocked = alpha * 1e-8, [int(np.abs(c).argmax())], -1
    last, fresh = w.copy(), True
    for _ in range(50 * min(n, p)):
        sign = np.sign(c[used])
        inner = gram[np.ix_(used, used)]
        d = np.linalg.solve(inner + 1e-10 * np.trace(inner) / len(used) * np.eye(len(used)), sign)
        a = gram[:, used] @ d
        with np.errstate(divide="ignore", invalid="ignore"):
            join = np.fmin(_positive((alpha - c) / (1 - a)), _positive((alpha + c) / (1 + a)))
            leave = _positive(-w[used] / d)
        join[used] = np.inf
        if blocked >= 0:
            join[blocked] = np.inf
        step = min(float(join.min()), float(leave.min()), alpha - floor)
        w[used] += step * d
        c -= step * a
        alpha -= step
        leaves = step == float(leave.min())
        if leaves:  # at its breakpoint the leaving column is no part of the model
            blocked = used[int(leave.argmin())]
            w[blocked] = 0.0
        rss = max(yy - n * float(w @ (cov + c)), 0.0)
        aic = rss / variance + 2 * (len(used) - leaves)
        if aic < best:
            best, chosen, fresh = aic, Walk(w.copy(), alpha, True, last, None), True
        elif fresh:
            chosen, fresh = chosen._replace(after=w.copy()), False
        last = w.copy()
        # a model of as many columns cannot win once its penalty and the smallest residual exceed the best value; columns may still leave
        if alpha <= floor or least + 2 * (len(used) - LEAVING) > best or len(used) >= min(n - 1, p):
            break
        if leaves:
            used.remove(blocked)
            if not used:
                break
        else:
            blocked = -1
            used.append(int(join.argmin()))
    else:
        return chosen._replace(ended=False)
    return chosen


def violation(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float) -> float:
    """How far centred rows x, y and coefficients w are from the lasso's stationarity conditions, as a share of the largest product of x and y.

    The residual's product with a column in use equals the penalty with the coefficient's sign; no other column's product is larger.
    """
    product = x.T @ (y - x @ w) / len(x)
    off = np.where(w != 0, np.abs(product - penalty * np.sign(w)), np.maximum(np.abs(product) - penalty, 0.0))
    return float(off.max() / max(float(np.abs(x.T @ y).max()) / len(x), 1e-300))


def akaike(x: np.ndarray, y: np.ndarray, w: np.ndarray | None, variance: float) -> float:
    """AIC up to a constant, from the rows themselves; NaN where there is no model."""
    return np.nan if w is None else float(((y - x @ w) ** 2).sum() / variance + 2 * np.count_nonzero(w))


def _positive(x: np.ndarray) -> np.ndarray:
    return np.where(x > 1e-12, x, np.inf)


def descend(gram: np.ndarray, cov: np.ndarray, alpha: float, sweeps: int = 50_000, tol: float = 1e-6) -> tuple[np.ndarray, bool]:
    """Coordinate descent at one penalty, and whether it settled: the refit for a path that ran away on nearly equal columns."""
    w = np.zeros(len(cov))
    for _ in range(sweeps):
        largest = 0.0
        for j in np.flatnonzero(np.diag(gram) > 0):
            rho = cov[j] - gram[j] @ w + gram[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - alpha, 0.0) / gram[j, j]
            largest, w[j] = max(largest, abs(new - w[j])), new
        if largest < tol:
            return w, True
    return w, False


class Fit(NamedTuple):
    """Fitted models, one per target, with a certificate each: the stationarity violation and the AIC of the choice and of both neighbours."""

    coef: np.ndarray  # columns by targets
    intercept: np.ndarray
    failed: np.ndarray  # given up
    runaway: np.ndarray  # the path ran away and was refitted at the same penalty
    penalty: np.ndarray
    violation: np.ndarray
    aic: np.ndarray
    aic_before: np.ndarray
    aic_after: np.ndarray


def fit(x: np.ndarray, y: np.ndarray) -> Fit:
    """One model per column of y."""
    n, m = len(x), y.shape[1]
    xm, ym = x.mean(axis=0), y.mean(axis=0)
    xc, yc = x - xm, y - ym
    gram = xc.T @ xc / n
    variance = noise_variance(gram, xc.T @ yc / n, (yc**2).sum(axis=0), n)
    coef, failed, runaway = np.zeros((x.shape[1], m)), np.zeros(m, dtype=bool), np.zeros(m, dtype=bool)
    proof = np.full((5, m), np.nan)
    for k in range(m):
        t = yc[:, k]
        cov = xc.T @ t / n
        try:
            walk = aic_path(gram, cov, float(t @ t), n, float(variance[k]))
            w, done = walk.coef, walk.ended
            if np.abs(w).max() > MAX_COEF:
                runaway[k] = True
                w, done = descend(gram, cov, walk.penalty)
                walk = walk._replace(before=None, after=None)
        except np.linalg.LinAlgError:  # this target only
            failed[k] = True
            continue
        failed[k] = not done or np.abs(w).max() > MAX_COEF
        if not failed[k]:
            coef[:, k] = w
            v = float(variance[k])
            proof[:, k] = (walk.penalty, violation(xc, t, w, walk.penalty), akaike(xc, t, w, v), akaike(xc, t, walk.before, v), akaike(xc, t, walk.after, v))
    return Fit(coef, np.where(failed, 0.0, ym - xm @ coef), failed, runaway, *proof)
