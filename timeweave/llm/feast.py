"""Eigenpairs of a symmetric matrix by contour integration, with inertia counts as proof that none is missing.

The matrix is a covariance, as large as the vectors' dimension and not as the data. An interval's spectral projector is the
integral of (zI - A)^-1 around it; a quadrature applies it to a block of vectors by complex shifted solves, and Rayleigh-Ritz
on what is left gives the pairs inside. The number of eigenvalues above a shift is the number of positive pivots of A - sI.
"""

from __future__ import annotations

import numpy as np

#: Quadrature points on the upper half of a contour; the lower half is its mirror.
POINTS = 12
#: Eigenvalues that one contour holds, unless they lie closer together than can be told apart.
PER_CONTOUR = 24
ROUNDS = 40
#: An interval whose ends are further apart than this factor gets more than one contour.
SPREAD = 16.0
#: A pair is found when its residual is below this part of the matrix' norm.
RESIDUAL = 1e-13


def positive_pivots(a: np.ndarray) -> int:
    """Positive eigenvalues of a symmetric matrix: signs of the pivots of its factorisation into L D L', D of blocks of one or two.

    Pivots are chosen as in Bunch and Kaufman, which keeps growth bounded; zero pivots count as not positive.
    """
    a = np.array(a, float)
    n, k, positive = len(a), 0, 0
    alpha = (1 + np.sqrt(17)) / 8

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j], :] = a[[j, i], :]
            a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        size = 1
        below = np.abs(a[k + 1 :, k])
        if len(below) and (most := below.max()) > 0:
            r = k + 1 + int(below.argmax())
            if abs(a[k, k]) < alpha * most:
                others = np.abs(a[k:, r])
                others[r - k] = 0
                sigma = others.max()
                if abs(a[k, k]) * sigma >= alpha * most * most:
                    pass
                elif abs(a[r, r]) >= alpha * sigma:
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    size = 2
        block, low = a[k : k + size, k : k + size], a[k + size :, k : k + size]
        if size == 1:
            positive += int(block[0, 0] > 0)
            if block[0, 0] != 0:
                a[k + 1 :, k + 1 :] -= np.outer(low[:, 0] / block[0, 0], low[:, 0])
        else:
            det = block[0, 0] * block[1, 1] - block[0, 1] * block[1, 0]
            positive += 1 if det < 0 else 2 * int(block[0, 0] + block[1, 1] > 0)
            a[k + 2 :, k + 2 :] -= low @ np.linalg.solve(block, low.T)
        k += size
    return positive


def above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues are larger than ``shift``."""
    return positive_pivots(a - shift * np.eye(len(a)))


def _gap(a: np.ndarray, want: int, low: float, high: float, tolerance: float) -> tuple[float, int]:
    """(shift, eigenvalues above it): exactly ``want`` if a shift in the widest part between two of them can be found, else more."""
    n_low, n_high = above(a, low), above(a, high)
    while n_low > want and high - low > tolerance:
        mid = (low + high) / 2
        n = above(a, mid)
        low, n_low, high, n_high = (mid, n, high, n_high) if n >= want else (low, n_low, mid, n)
    if n_low != want:
        return low, n_low
    # eigenvalue number ``want`` lies above low: move the shift away from both neighbours
    inner = low
    while high - inner > max(tolerance, (high - low) / 16, abs(high) * 1e-3):
        mid = (inner + high) / 2
        if above(a, mid) >= want:
            inner = mid
        else:
            high = mid
    outer = low
    step = max(inner - low, tolerance)
    while above(a, outer - step) == want and outer - step > 0:
        outer -= step
        step *= 2
    return (inner + outer) / 2, want


def contour_pairs(a: np.ndarray, low: float, high: float, count: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs between ``low`` and ``high``, smallest first.

    The block has half as many vectors again as there are eigenvalues inside. Each round filters it through the contour and
    takes Ritz pairs, until those inside are as many as the inertia says and their residuals vanish.
    """
    n = len(a)
    x, w = np.polynomial.legendre.leggauss(POINTS)
    angle = np.pi * (x + 1) / 2
    centre, radius = (low + high) / 2, (high - low) / 2
    z = centre + radius * np.exp(1j * angle)
    weight = w * radius * np.exp(1j * angle) / 2
    inverse = [np.linalg.inv(zi * np.eye(n) - a) for zi in z]
    block = min(n, count + max(4, count // 2))
    rng = np.random.default_rng(7)
    q = rng.standard_normal((n, block))
    for round_ in range(ROUNDS):
        filtered = sum((wi * (r @ q)).real for wi, r in zip(weight, inverse))
        q, _ = np.linalg.qr(filtered)
        values, y = np.linalg.eigh(q.T @ a @ q)
        q = q @ y
        residual = np.abs(a @ q - q * values).max(axis=0)
        loose = RESIDUAL if round_ < ROUNDS - 1 else 1e3 * RESIDUAL
        found = (values > low) & (values < high) & (residual <= loose * scale)  # the block's other columns are noise
        if found.sum() == count:
            return values[found], q[:, found]
    raise ArithmeticError(f"{found.sum()} pairs between {low} and {high} where {count} lie")


def _narrow(a: np.ndarray, low: float, high: float, over_low: int, over_high: int) -> tuple[float, float]:
    """The interval without most of the empty space at its ends."""
    for _ in range(12):
        mid = (low + high) / 2
        n = above(a, mid)
        if n == over_low:
            low = mid
        elif n == over_high:
            high = mid
        else:
            break
    room = (high - low) / 2
    for _ in range(5):  # what is left of the ends, more finely
        if above(a, low + room) == over_low:
            low += room
        if above(a, high - room) == over_high:
            high -= room
        room /= 2
    return low, high


def interval_pairs(a: np.ndarray, low: float, high: float, over_low: int, over_high: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """All eigenpairs between ``low`` and ``high``: in one contour, or bisected by inertia until each holds few.

    Where a cut falls among values too close to be told apart, the interval gets one wider block instead.
    """
    m = over_low - over_high
    if not m:
        return np.zeros(0), np.zeros((len(a), 0))
    low, high = _narrow(a, low, high, over_low, over_high)
    wide = m > 1 and low > 0 and high > SPREAD * low  # one contour can't tell small values of a wide interval apart
    tolerance = scale * 1e-12
    if (m > PER_CONTOUR or wide) and high - low > tolerance:
        want = min(max(above(a, np.sqrt(low * high)), over_high + 1), over_low - 1) if wide else over_high + m // 2
        cut, over = _gap(a, want, low, high, tolerance)
        if low < cut < high and over_high < over < over_low:
            try:
                parts = [interval_pairs(a, low, cut, over_low, over, scale), interval_pairs(a, cut, high, over, over_high, scale)]
                return np.concatenate([v for v, _ in parts]), np.concatenate([q for _, q in parts], axis=1)
            except ArithmeticError:
                pass
    return contour_pairs(a, low, high, m, scale)


def largest(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and unit eigenvectors as columns, their largest entry positive.

    Values that rounding can't tell from zero are not among them. What the contours give is counted against the inertia
    of the whole.
    """
    a = (a + a.T) / 2
    scale = float(np.abs(a).sum(axis=1).max(initial=0.0))
    if not k or scale == 0:
        return np.zeros(0), np.zeros((len(a), 0))
    floor, top = scale * 1e-13, scale * 1.01
    low, wanted = floor, above(a, floor)
    if wanted > k:
        low, wanted = _gap(a, k, floor, top, scale * 1e-12)
    values, vectors = interval_pairs(a, low, top, wanted, 0, scale)
    if len(values) != wanted:
        raise ArithmeticError(f"{len(values)} pairs found, {wanted} by inertia")
    q, _ = np.linalg.qr(vectors[:, np.argsort(-values, kind="stable")])  # once more over all contours: orthogonal between them too
    values, y = np.linalg.eigh(q.T @ a @ q)
    values, vectors = values[::-1][:k], (q @ y)[:, ::-1][:, :k]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    return values, vectors * sign
