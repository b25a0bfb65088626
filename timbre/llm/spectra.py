"""Eigendecompositions that take one vector at a time: rank-one updates through the secular equation."""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np

_EPS = float(np.finfo(float).eps)
_MOST_STEPS = 80


def _secular_roots(poles: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum(squares / (poles - x))``, ``poles`` ascending and apart, ``squares`` positive.

    Root i lies between poles i and i + 1 (the last one above all). Returned are the roots and the matrix of
    ``poles[j] - root[i]``: each root is found as a distance from its nearer pole, so that these differences
    keep their digits. Steps solve the sum with one pole on either side; a bracket keeps them safe.
    """
    k = len(poles)
    lower, upper = np.arange(k), np.minimum(np.arange(k) + 1, k - 1)
    gap = np.append(np.diff(poles), squares.sum())
    middle = poles + gap / 2
    at_middle = 1 + (squares / (poles[None, :] - middle[:, None])).sum(axis=1)
    origin = np.where((at_middle >= 0) | (lower == k - 1), lower, upper)
    shifted = poles[None, :] - poles[origin][:, None]
    from_left = origin == lower
    low = np.where(from_left, 0.0, -gap / 2)
    high = np.where(from_left, np.where(lower == k - 1, gap, gap / 2), 0.0)
    x = (low + high) / 2
    below = np.arange(k)[None, :] <= lower[:, None]
    open_rows = np.arange(k)
    for _ in range(_MOST_STEPS):
        rows = open_rows
        away = shifted[rows] - x[rows, None]
        part = squares / away
        slope = part / away
        value = 1 + part.sum(axis=1)
        done = np.abs(value) <= _EPS * k * (1 + np.abs(part).sum(axis=1))
        low[rows] = np.where(value < 0, x[rows], low[rows])
        high[rows] = np.where(value < 0, high[rows], x[rows])
        spread = high[rows] - low[rows]
        done |= spread <= _EPS * np.maximum(np.abs(high[rows]), np.abs(low[rows]))
        if done.all():
            break
        left_slope = np.where(below[rows], slope, 0.0).sum(axis=1)
        right_slope = slope.sum(axis=1) - left_slope
        left, right = away[np.arange(len(rows)), rows], away[np.arange(len(rows)), upper[rows]]
        last = rows == k - 1
        c = value - left * left_slope - np.where(last, 0.0, right * right_slope)
        a = (left + right) * value - left * right * (left_slope + right_slope)
        b = left * right * value
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
        step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        step = np.where(last, left + left_slope * left * left / c, step)
        new = x[rows] + step
        bad = ~np.isfinite(new) | (new <= low[rows]) | (new >= high[rows])
        x[rows] = np.where(done, x[rows], np.where(bad, (low[rows] + high[rows]) / 2, new))
        open_rows = rows[~done]
    return poles[origin] + x, shifted - x[:, None]


def rank_one(values: np.ndarray, vectors: np.ndarray, direction: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors after ``weight * direction direction'`` is added (``weight`` >= 0)."""
    z = vectors.T @ direction * weight**0.5
    most = max(float(values[-1]), float(z @ z))
    if most == 0.0:
        return values, vectors
    small = 8 * _EPS * most
    # deflation: directions that the update hardly touches stay as they are
    active = np.flatnonzero(np.abs(z) * np.sqrt(z @ z) > small)
    if not len(active):
        return values, vectors
    values, vectors = values.copy(), vectors.copy()
    # deflation: of (nearly) equal eigenvalues one takes the whole update, by a reflection of their vectors
    close = np.diff(values[active]) <= small
    if close.any():
        starts = np.flatnonzero(np.append(True, ~close))
        keep = []
        for run in np.split(active, starts[1:]):
            if len(run) > 1:
                part = z[run]
                mirror = part.copy()
                mirror[-1] += np.copysign(np.sqrt(part @ part), part[-1])
                vectors[:, run] -= np.outer(vectors[:, run] @ mirror, mirror) * (2 / (mirror @ mirror))
                z[run[-1]] = -np.copysign(np.sqrt(part @ part), part[-1])
            keep.append(run[-1])
        active = np.array(keep)
    poles, own = values[active], z[active]
    with np.errstate(all="ignore"):
        roots, away = _secular_roots(poles, own * own)
        # the update that has exactly these roots: its vectors are orthogonal to all digits
        between = poles[:, None] - poles[None, :]
        np.fill_diagonal(between, 1.0)
        exact = np.copysign(np.sqrt(np.abs(np.prod(-away / between, axis=0))), own)
        turned = (exact[None, :] / away).T
    turned /= np.sqrt((turned * turned).sum(axis=0))
    values[active] = roots
    vectors[:, active] = vectors[:, active] @ turned
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Count, mean, and eigenpairs of the centred scatter of the vectors seen."""

    count: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def empty(width: int) -> Spectrum:
        return Spectrum(0, np.zeros(width), np.zeros(width), np.eye(width))

    def add(self, vector: np.ndarray) -> None:
        apart = vector - self.mean
        self.values, self.vectors = rank_one(self.values, self.vectors, apart, self.count / (self.count + 1))
        self.count += 1
        self.mean = self.mean + apart / self.count

    def merge(self, other: Spectrum) -> None:
        """The other's eigenpairs and the distance of the means, as one update each."""
        if not other.count:
            return
        for value, vector in zip(other.values.tolist(), other.vectors.T, strict=True):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, value)
        both, apart = self.count + other.count, other.mean - self.mean
        self.values, self.vectors = rank_one(self.values, self.vectors, apart, self.count * other.count / both)
        self.mean, self.count = self.mean + apart * (other.count / both), both

    def pack(self) -> bytes:
        return pack(np.array([self.count], float), self.mean, self.values, self.vectors)

    @staticmethod
    def unpack(packed: bytes) -> Spectrum:
        count, mean, values, vectors = unpack(packed)
        return Spectrum(int(count[0]), mean, values, vectors)


def pack(*arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, *arrays)
    return out.getvalue()


def unpack(packed: bytes) -> list[np.ndarray]:
    with np.load(io.BytesIO(packed)) as held:
        return [held[name] for name in held.files]
