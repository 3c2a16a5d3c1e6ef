"""Small k x k helpers used inside pandas UDFs, one call per segment.

Inputs are moment summaries (n, mean vector, population covariance matrix),
never rows, so these run on matrices whose size depends only on the number
of columns.
"""

from __future__ import annotations

import numpy as np

RCOND = 1e-12


def as_matrix(flat, k: int) -> np.ndarray:
    return np.asarray(flat, dtype=float).reshape(k, k)


def merge(parts):
    """Merge (n, mean, cov) summaries of disjoint row sets (pairwise update)."""
    n_tot, m_tot, c_tot = 0, None, None
    for n, m, c in parts:
        if n is None or n == 0:
            continue
        m = np.asarray(m, dtype=float)
        c = np.asarray(c, dtype=float)
        if n_tot == 0:
            n_tot, m_tot, c_tot = n, m.copy(), c.copy()
            continue
        n_new = n_tot + n
        d = m - m_tot
        m_new = m_tot + d * (n / n_new)
        c_new = (n_tot * c_tot + n * c) / n_new + np.outer(d, d) * (n_tot * n) / (n_new * n_new)
        n_tot, m_tot, c_tot = n_new, m_new, c_new
    return n_tot, m_tot, c_tot


def ols(mean: np.ndarray, cov: np.ndarray):
    """Least squares with intercept from moments; the last index is the target.

    Minimum-norm coefficients (pseudo-inverse), as an SVD least-squares solver gives
    for collinear features.  Returns (coef[k], intercept).
    """
    k = len(mean) - 1
    cxx = cov[:k, :k]
    cxy = cov[:k, k]
    b = np.linalg.pinv(cxx, rcond=RCOND, hermitian=True) @ cxy if k else np.zeros(0)
    a = mean[k] - (b @ mean[:k] if k else 0.0)
    return b, float(a)


def r2_sse(b: np.ndarray, a: float, mean: np.ndarray, cov: np.ndarray):
    """R^2 and mean squared error of a fixed linear model on a row set given by its moments."""
    k = len(mean) - 1
    var_y = cov[k, k]
    mean_e = mean[k] - a - (b @ mean[:k] if k else 0.0)
    var_e = var_y - 2 * (b @ cov[:k, k] if k else 0.0) + (b @ cov[:k, :k] @ b if k else 0.0)
    mse = max(var_e, 0.0) + mean_e * mean_e
    if var_y <= 0:
        return (1.0 if mse <= 0 else 0.0), mse
    return 1.0 - mse / var_y, mse


def perm_importance(b: np.ndarray, a: float, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Expected R^2 drop per feature when that feature is randomly permuted (test moments)."""
    k = len(mean) - 1
    var_y = cov[k, k]
    if var_y <= 0 or k == 0:
        return np.zeros(k)
    cov_ex = cov[:k, k] - cov[:k, :k] @ b  # cov(residual, x_j)
    return (2 * b * cov_ex + 2 * b * b * np.diag(cov[:k, :k])) / var_y


def holdout_many(n_tr, m_tr, c_tr, n_te, m_te, c_te):
    """The holdout fits of many segments at once; arrays over the segments: rows, means (s, k + 1) and covariances
    (s, k + 1, k + 1) of training and test rows, the last index being the target.  Every segment has training rows;
    the moments of one without test rows are zero.

    Per segment what ``ols``, ``r2_sse``, ``perm_importance``, ``merge``, ``corr_from_cov`` and ``vif_from_gram`` give:
    (coef, intercept, r2, mse, perm, coef over all rows, their feature deviations, vif)."""
    k = m_tr.shape[1] - 1
    n_tr, n_te = n_tr.astype(float), n_te.astype(float)

    def fit(mean, cov):
        b = (np.linalg.pinv(cov[:, :k, :k], rcond=RCOND, hermitian=True) @ cov[:, :k, k:])[:, :, 0]
        return b, mean[:, k] - (b * mean[:, :k]).sum(axis=1)

    b, a = fit(m_tr, c_tr)
    with np.errstate(all="ignore"):
        var_y, cxy, cxx = c_te[:, k, k], c_te[:, :k, k], c_te[:, :k, :k]
        cb = (cxx @ b[:, :, None])[:, :, 0]
        mean_e = m_te[:, k] - a - (b * m_te[:, :k]).sum(axis=1)
        var_e = var_y - 2 * (b * cxy).sum(axis=1) + (b * cb).sum(axis=1)
        mse = np.where(var_e < 0, 0.0, var_e) + mean_e * mean_e
        flat = var_y <= 0
        r2 = np.where(flat, np.where(mse <= 0, 1.0, 0.0), 1.0 - mse / var_y)
        diag = np.diagonal(cxx, axis1=1, axis2=2)
        perm = np.where(flat[:, None], 0.0, (2 * b * (cxy - cb) + 2 * b * b * diag) / var_y[:, None])

        n, w = n_tr + n_te, n_te[:, None]
        d = m_te - m_tr
        m_all = m_tr + d * (w / n[:, None])
        c_all = (n_tr[:, None, None] * c_tr + w[:, :, None] * c_te) / n[:, None, None] \
            + d[:, :, None] * d[:, None, :] * ((n_tr * n_te)[:, None, None] / (n * n)[:, None, None])
        alone = n_te == 0
        m_all, c_all = np.where(alone[:, None], m_tr, m_all), np.where(alone[:, None, None], c_tr, c_all)
        b_all, _ = fit(m_all, c_all)
        sd = np.sqrt(np.clip(np.diagonal(c_all, axis1=1, axis2=2)[:, :k], 0, None))
        const = sd <= 1e-12 * np.maximum(1.0, np.abs(m_all[:, :k]))
        inv = np.where(const, 0.0, 1.0 / np.where(const, 1.0, sd))
        r = c_all[:, :k, :k] * (inv[:, :, None] * inv[:, None, :])
        r[:, range(k), range(k)] = np.where(const, 0.0, 1.0)
        vif = np.empty((len(n), k))
        for i in range(k):
            rest = [j for j in range(k) if j != i]
            g = r[:, rest, i]
            beta = (np.linalg.pinv(r[:, rest][:, :, rest], rcond=RCOND, hermitian=True) @ g[:, :, None])[:, :, 0] if rest else g
            share = (beta * g).sum(axis=1) / r[:, i, i]
            vif[:, i] = np.where(r[:, i, i] <= 0, np.nan, np.where(share >= 1.0, np.inf, 1.0 / (1.0 - share)))
    return b, a, r2, mse, perm, b_all, sd, vif


def corr_from_cov(cov: np.ndarray, tiny: float = 1e-12, mean: np.ndarray | None = None):
    """Correlation matrix; constant columns (std below tiny, relative to |mean|) get zero rows/cols."""
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))
    scale = np.maximum(1.0, np.abs(mean)) if mean is not None else 1.0
    const = sd <= tiny * scale
    inv = np.where(const, 0.0, 1.0 / np.where(const, 1.0, sd))
    r = cov * np.outer(inv, inv)
    np.fill_diagonal(r, np.where(const, 0.0, 1.0))
    return r, const


def vif_from_gram(g: np.ndarray, centered: bool) -> np.ndarray:
    """VIF_i = 1 / (1 - R^2_i) regressing column i on the others without intercept.

    ``g`` is the (standardised or raw) second-moment matrix.  A zero column gives NaN
    (0/0), a perfect fit gives inf.
    """
    k = g.shape[0]
    out = np.empty(k)
    for i in range(k):
        tss = g[i, i]
        if tss <= 0:
            out[i] = np.nan
            continue
        idx = [j for j in range(k) if j != i]
        if not idx:
            out[i] = 1.0
            continue
        gi = g[np.ix_(idx, [i])][:, 0]
        goo = g[np.ix_(idx, idx)]
        beta = np.linalg.pinv(goo, rcond=RCOND, hermitian=True) @ gi
        r2 = float(beta @ gi) / tss
        out[i] = np.inf if r2 >= 1.0 else 1.0 / (1.0 - r2)
    return out


def pca_components(r: np.ndarray, ratio: float):
    """(n_components, explained ratio kept, eigenvalues desc, eigenvectors) of a correlation matrix.

    Keeps the smallest number of components whose cumulative explained ratio exceeds ``ratio``.
    """
    w, v = np.linalg.eigh(r)
    order = np.argsort(w)[::-1]
    w = np.clip(w[order], 0, None)
    v = v[:, order]
    tot = w.sum()
    if tot <= 0:
        return 1, 1.0, w, v
    cum = np.cumsum(w / tot)
    m = int(np.searchsorted(cum, ratio, side="right") + 1)
    m = min(m, len(w))
    return m, float(cum[m - 1]), w, v
