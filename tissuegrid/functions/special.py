"""Special functions Spark has no expression for, as vectorised UDFs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_LANCZOS = (676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0.5, by Lanczos' series."""
    x = np.asarray(x, float) - 1
    a = 0.99999999999980993 + sum(c / (x + k + 1) for k, c in enumerate(_LANCZOS))
    t = x + 7.5
    return 0.5 * np.log(2 * np.pi) + (x + 0.5) * np.log(t) - t + np.log(a)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function for a, b >= 0.5."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    low = x < (a + 1) / (a + b + 2)
    one = front * _beta_fraction(a, b, np.where(low, inner, 0.5)) / a
    two = 1 - front * _beta_fraction(b, a, np.where(low, 0.5, 1 - inner)) / b
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(low, one, two)))


def student_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t; null where t or df is null or NaN."""

    @F.pandas_udf("double")
    def p(ts: pd.Series, dfs: pd.Series) -> pd.Series:
        ts, dfs = ts.to_numpy(float, na_value=np.nan), dfs.to_numpy(float, na_value=np.nan)
        out = np.full(len(ts), np.nan)
        ok = np.isfinite(dfs) & (dfs >= 1) & ~np.isnan(ts)
        x = dfs[ok] / (dfs[ok] + ts[ok] ** 2)
        out[ok] = incomplete_beta(dfs[ok] / 2, np.full(ok.sum(), 0.5), x)
        return pd.Series(out)

    return p(t, df)


def log_tail(background: float, members: np.ndarray, drawn: np.ndarray, overlap: np.ndarray) -> np.ndarray:
    """ln of the chance that at least `overlap` >= 1 of `drawn` items are among `members`, drawn from `background` without replacement.

    Terms are summed outwards from the largest one in the tail, until they no longer change the sum; all cases advance together.
    """
    m, d, o = (np.asarray(v, float) for v in (members, drawn, overlap))
    rest, most = background - m - d, np.minimum(m, d)
    k = np.maximum(o, np.minimum(np.floor((m + 1) * (d + 1) / (background + 2)), most))
    ln = lambda n: log_gamma(n + 1)
    largest = ln(m) + ln(background - m) + ln(d) + ln(background - d) - ln(background) - ln(k) - ln(m - k) - ln(d - k) - ln(rest + k)
    total = np.ones_like(m)

    def outwards(steps: np.ndarray, ratio) -> None:
        """Each term is the one before it times ratio(step)."""
        at, p, step = np.arange(len(m)), np.ones_like(m), 0
        while len(at):
            step += 1
            on = (step <= steps[at]) & (p > 1e-20)
            at, p = at[on], p[on]
            p = p * ratio(at, step)
            total[at] += p

    outwards(most - k, lambda i, s: (m[i] - k[i] - s + 1) * (d[i] - k[i] - s + 1) / ((k[i] + s) * (rest[i] + k[i] + s)))
    outwards(k - o, lambda i, s: (k[i] - s + 1) * (rest[i] + k[i] - s + 1) / ((m[i] - k[i] + s) * (d[i] - k[i] + s)))
    return largest + np.log(total)


def tail_score(background: int, members: Column, drawn: Column, overlap: Column) -> Column:
    """-log10 of that chance; never below 0."""

    @F.pandas_udf("double")
    def score(m: pd.Series, d: pd.Series, o: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(log_tail(float(background), m.to_numpy(), d.to_numpy(), o.to_numpy()) / -np.log(10), 0.0))

    return score(members, drawn, overlap)


def smoothing_weights(window: int, order: int) -> list[float]:
    """Weights of a least-squares polynomial of the order over a window of even places, for its middle (between two places if the window is even)."""
    powers = np.vander(np.arange(window) - (window - 1) / 2, order + 1, increasing=True)
    return [float(w) for w in np.linalg.pinv(powers)[0]]
