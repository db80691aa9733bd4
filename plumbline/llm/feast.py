"""Largest eigenvalues of a symmetric matrix by contour integrals, counted by inertia.

The matrix is small, d by d; the rows it comes from are summed elsewhere. An
interval's eigenvectors are what the integral of the resolvent along a circle
around it lets through; a quadrature with few points damps all others by orders
of magnitude, and repeating it on its own result converges. How many
eigenvalues an interval holds is known beforehand: the factors of the shifted
matrix have as many negative pivots as it has eigenvalues below the shift.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_ALPHA = (1 + 17**0.5) / 8
_CLEAR = 1e-11  # of the largest row sum, on both sides of an interval's end
LEAST = 1e-12  # an eigenvalue below this share of the largest row sum is rounding error


@dataclass(frozen=True)
class Contour:
    """``points`` of quadrature on the half circle around an interval with at most ``crowd`` eigenvalues.

    Intervals whose eigenvalues can't be parted any more may hold more of them.
    """

    points: int = 8
    crowd: int = 8
    rounds: int = 30
    seed: int = 11


def count_below(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix lie below ``shift``: its inertia, from symmetric elimination."""
    a = matrix - shift * np.eye(len(matrix))
    n, k, negative = len(a), 0, 0
    while k < n:
        below = np.abs(a[k + 1 :, k])
        size = 1
        if below.size and (largest := below.max()) > 0 and abs(a[k, k]) < _ALPHA * largest:
            r = k + 1 + int(below.argmax())
            column = np.abs(a[k:, r])
            column[r - k] = 0
            if abs(a[k, k]) * column.max() < _ALPHA * largest**2:
                size = 1 if abs(a[r, r]) >= _ALPHA * column.max() else 2
                at = k + size - 1
                a[[at, r]] = a[[r, at]]
                a[:, [at, r]] = a[:, [r, at]]
        pivot, rest = a[k : k + size, k : k + size], a[k + size :, k : k + size]
        # A pivot of size two stands for one negative and one positive eigenvalue.
        negative += int(pivot[0, 0] < 0) if size == 1 else 1
        if rest.size and pivot.any():
            a[k + size :, k + size :] -= rest @ np.linalg.solve(pivot, rest.T)
        k += size
    return negative


def largest_eigenpairs(matrix: np.ndarray, wanted: int, contour: Contour = Contour()) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors as columns.

    Fewer if fewer are above rounding error: a covariance of vectors that lie in
    a subspace has no direction outside it. Raises ArithmeticError if not as many
    are found as the inertia counts.
    """
    d = len(matrix)
    scale = float(np.abs(matrix).sum(axis=1).max()) if d else 0.0  # no eigenvalue is larger
    if not scale:
        return np.zeros(0), np.zeros((d, 0))
    unit = (matrix + matrix.T) / (2 * scale)
    least, most = LEAST, 1.0 + 1e-6
    above = lambda cut: d - count_below(unit, cut)
    low, low_count, high = least, above(least), most
    while low_count > wanted and high - low > _CLEAR:
        cut = (low + high) / 2
        if (count := above(cut)) >= wanted:
            low, low_count = cut, count
        else:
            high = cut
    # Where the last of them stand close together, all of these are taken in.
    step = _CLEAR
    while low > least and above(low - _CLEAR) != above(low + _CLEAR):
        low, step = max(least, low - step), 2 * step
    low_count = above(low)
    found = [
        _interval(unit, a, b, count, contour) for a, b, count in _intervals(unit, low, most, low_count, contour.crowd)
    ]
    # What two intervals have both found, next to their common end, is there once.
    left, sizes, _ = np.linalg.svd(np.column_stack([np.zeros((d, 0)), *found]), full_matrices=False)
    basis = left[:, sizes > 0.5]
    values, turn = np.linalg.eigh(basis.T @ unit @ basis)
    order = np.argsort(-values)[:wanted]
    if len(order) < min(wanted, low_count) or len(order) and above(values[order[-1]] + _CLEAR) > (
        values > values[order[-1]] + _CLEAR / 2
    ).sum():
        raise ArithmeticError(f"{len(values)} eigenvalues found where the inertia counts {low_count}")
    return values[order] * scale, basis @ turn[:, order]


def _intervals(matrix: np.ndarray, low: float, high: float, count: int, crowd: int) -> list[tuple[float, float, int]]:
    """Intervals that cover (low, high) and hold ``count`` eigenvalues together, few in each."""
    if not count:
        return []
    if count <= crowd or high - low < 100 * _CLEAR:
        return [(low, high, count)]
    cut = _clear_cut(matrix, low, high)
    upper = len(matrix) - count_below(matrix, cut)
    beyond = len(matrix) - count_below(matrix, high)
    return _intervals(matrix, low, cut, count - (upper - beyond), crowd) + _intervals(
        matrix, cut, high, upper - beyond, crowd
    )


def _clear_cut(matrix: np.ndarray, low: float, high: float) -> float:
    """A point about the middle with no eigenvalue next to it, if there is one."""
    width = high - low
    for share in (0.5, 0.47, 0.53, 0.44, 0.56, 0.41, 0.59):
        cut = low + share * width
        if count_below(matrix, cut - 1e-3 * width) == count_below(matrix, cut + 1e-3 * width):
            return cut
    return low + width / 2


def _interval(matrix: np.ndarray, low: float, high: float, count: int, contour: Contour) -> np.ndarray:
    """The eigenvectors of the ``count`` eigenvalues between ``low`` and ``high``."""
    d = len(matrix)
    x, weights = np.polynomial.legendre.leggauss(contour.points)
    center, radius = (low + high) / 2, (high - low) / 2
    around = radius * np.exp(0.5j * np.pi * (1 - x))
    shifted = [np.linalg.inv((center + z) * np.eye(d) - matrix) for z in around]
    enough = 64 * np.finfo(float).eps * d**0.5
    width = min(d, max(count + 6, 3 * count // 2))
    while True:
        basis = np.random.default_rng(contour.seed).standard_normal((d, width))
        for _ in range(contour.rounds):
            basis = sum(w * (z * (inverse @ basis)).real for w, z, inverse in zip(weights, around, shifted))
            basis = np.linalg.qr(basis)[0]
            values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
            basis = basis @ turn
            rest = np.linalg.norm(matrix @ basis - basis * values, axis=0)
            # Rounding may put an eigenvalue on the other side of an end.
            inside = (values > low - enough) & (values < high + enough) & (rest < enough)
            surely = inside & (values > low + enough) & (values < high - enough)
            if surely.sum() <= count <= inside.sum():
                return basis[:, inside]
        if width == d:
            raise ArithmeticError(f"{inside.sum()} eigenvalues found where the inertia counts {count}")
        width = min(d, 2 * width)
