"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

`above` counts the eigenvalues above a shift from the signs of the pivots of an LDL^T factorisation (Sylvester's law of inertia).
Bisection on such counts isolates each wanted eigenvalue, Rayleigh quotient iteration converges to it cubically, and two more counts,
just above and just below the result, certify that it is the one with this number.
"""

from __future__ import annotations

import numpy as np

_ALPHA = (1 + 17**0.5) / 8  # bounds the growth of the pivots
_EPS = float(np.finfo(np.float64).eps)


def above(v: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of `v` above `shift`: positive pivots of v - shift I. Pivots are single or in pairs, chosen so that
    the factors stay small; a pair has one positive and one negative eigenvalue."""
    a = v - shift * np.eye(len(v))
    positive = k = 0
    n = len(a)

    def swap(i: int, j: int) -> None:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        here = abs(a[k, k])
        below = np.abs(a[k + 1:, k])
        most = below.max() if len(below) else 0.0
        if max(here, most) == 0.0:
            k += 1
            continue
        pair = False
        if here < _ALPHA * most:
            row = k + 1 + int(below.argmax())
            others = np.abs(a[row, k:])
            others[row - k] = 0.0
            far = others.max()
            if here * far < _ALPHA * most * most:
                if abs(a[row, row]) >= _ALPHA * far:
                    swap(k, row)
                else:
                    swap(k + 1, row)
                    pair = True
        if pair:
            positive += 1
            rest = a[k + 2:, k:k + 2]
            a[k + 2:, k + 2:] -= rest @ np.linalg.solve(a[k:k + 2, k:k + 2], rest.T)
            k += 2
        else:
            positive += a[k, k] > 0
            rest = a[k + 1:, k]
            a[k + 1:, k + 1:] -= np.outer(rest, rest / a[k, k])
            k += 1
    return int(positive)


class Slicer:
    """Counts of one matrix, kept, so that what isolates one eigenvalue also helps the next."""

    def __init__(self, v: np.ndarray):
        self.v, self.n = v, len(v)
        radius = np.abs(v).sum(1) - np.abs(np.diag(v))
        low, high = float((np.diag(v) - radius).min()), float((np.diag(v) + radius).max())
        self.scale = max(abs(low), abs(high))
        margin = 4 * self.n * _EPS * self.scale
        self.counts = {low - margin: self.n, high + margin: 0}

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = above(self.v, shift)
        return self.counts[shift]

    def bracket(self, number: int) -> tuple[float, float]:
        """The nearest known shifts with at least `number` eigenvalues above the low one and fewer above the high one."""
        return max(s for s, c in self.counts.items() if c >= number), min(s for s, c in self.counts.items() if c < number)

    def isolate(self, number: int) -> tuple[float, float]:
        """An interval with eigenvalue `number` (from 1, falling) alone, or one so narrow that its eigenvalues are equal."""
        low, high = self.bracket(number)
        while self.above(low) - self.above(high) > 1 and high - low > self.n * _EPS * self.scale:
            middle = (low + high) / 2
            if not low < middle < high:
                break
            self.above(middle)
            low, high = self.bracket(number)
        return low, high

    def halve(self, number: int) -> tuple[float, float]:
        low, high = self.bracket(number)
        self.above((low + high) / 2)
        return self.bracket(number)

    def certified(self, number: int, value: float, error: float) -> bool:
        return self.above(value + error) < number <= self.above(value - error)


def _solve(v: np.ndarray, shift: float, x: np.ndarray, scale: float) -> np.ndarray:
    for nudge in (0.0, 1.0, 3.0, 9.0):
        try:
            w = np.linalg.solve(v - (shift + nudge * _EPS * scale) * np.eye(len(v)), x)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(w).all() and w.any():
            return w
    return x


def leading(v: np.ndarray, count: int, steps: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """The `count` largest eigenvalues, falling, and their unit eigenvectors as columns; the largest entry of each is positive.

    Equal eigenvalues get any orthonormal vectors of their space. Raises ArithmeticError if a count contradicts a result.
    """
    n = len(v)
    count = min(count, n)
    values, vectors = np.zeros(count), np.zeros((n, count))
    if not v.any():
        vectors[np.arange(count), np.arange(count)] = 1.0
        return values, vectors
    slicer = Slicer(v)
    rng = np.random.default_rng(13)
    for i in range(count):
        known = vectors[:, :i]

        def unit(x: np.ndarray, known=known) -> np.ndarray:
            for _ in range(2):
                x = x - known @ (known.T @ x)
                x = x / np.linalg.norm(x)
            return x

        low, high = slicer.isolate(i + 1)
        for _ in range(60):
            x = unit(rng.standard_normal(n))
            for _ in range(2):
                x = unit(_solve(v, (low + high) / 2, x, slicer.scale))
            value = float(x @ v @ x)
            best = np.inf
            for _ in range(steps):
                if not low <= value <= high and high - low > n * _EPS * slicer.scale:
                    break
                error = float(np.linalg.norm(v @ x - value * x))
                if error >= best / 2 and best < n * _EPS * slicer.scale * 16:
                    break
                best = min(best, error)
                x = unit(_solve(v, value, x, slicer.scale))
                value = float(x @ v @ x)
            error = max(float(np.linalg.norm(v @ x - value * x)), n * _EPS * slicer.scale)
            if error < 1e-9 * slicer.scale and slicer.certified(i + 1, value, 2 * error):
                break
            low, high = slicer.halve(i + 1)
        else:
            raise ArithmeticError(f"eigenvalue {i + 1} was not certified")
        values[i], vectors[:, i] = value, x * (1 if x[np.abs(x).argmax()] > 0 else -1)
    return values, vectors
