"""Largest eigenvalues and eigenvectors of a symmetric matrix by contour integration.

The spectrum is cut into intervals by inertia counts (signs of a Sturm sequence on the
tridiagonal form).  For one interval, a rational filter, the quadrature of the resolvent on an
ellipse around it, is applied to a few vectors: each node is one complex shifted solve.
Rayleigh-Ritz on the filtered vectors gives the eigenpairs, which are filtered again until
their residuals reach rounding.  The count of the interval says when none is missing.
"""

from __future__ import annotations

import numpy as np

NODES = 8  # quadrature nodes on the upper half of an ellipse; the lower half is its mirror image
FLATTEN = 0.3  # height of the ellipse against its width
PER_INTERVAL = 8  # eigenvalues that an interval should hold at most
RESIDUAL = 2e-14  # of the matrix' norm
MOST_ROUNDS = 30


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix with the eigenvalues of ``a``."""
    a, d = np.array(a, float), len(a)
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if length == 0:
            continue
        v[0] += np.copysign(length, v[0])
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * np.outer(v, w) + 2 * np.outer(w, v)
        a[k + 1, k] = a[k, k + 1] = -np.copysign(length, a[k + 1, k]) if a[k + 1, k] else -length
        a[k + 2 :, k] = a[k, k + 2 :] = 0
    return np.diag(a).copy(), np.diag(a, 1).copy()


def count_above(tri: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """Inertia: the number of eigenvalues above ``shift``."""
    diagonal, off = tri[0].tolist(), tri[1].tolist()
    above, pivot = 0, 1.0
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    for i, value in enumerate(diagonal):
        pivot = value - shift - (off[i - 1] ** 2 / pivot if i else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        above += int(pivot > 0)
    return above


def intervals(a: np.ndarray, components: int, least: float) -> list[tuple[float, float, int]]:
    """(low, high, count) that cover the largest ``components`` eigenvalues above ``least``, each with few of them.

    An interval is halved until it holds ``PER_INTERVAL`` or its eigenvalues can't be told
    apart, so a multiple eigenvalue is never cut.
    """
    tri = tridiagonal(a)
    bound = float(np.abs(a).sum(axis=1).max())
    top = bound * (1 + 1e-9)
    found, work = [], [(float(least), top, count_above(tri, least), 0)]
    while work and sum(n for *_, n in found) < components:
        low, high, above_low, above_high = work.pop()
        n = above_low - above_high
        if n == 0:
            continue
        if n <= PER_INTERVAL or high - low < 1e-9 * bound:
            found.append((low, high, n))
            continue
        middle = (low + high) / 2
        above = count_above(tri, middle)
        work += [(low, middle, above_low, above), (middle, high, above, above_high)]  # the upper half is taken first
    return found


def eigenpairs(a: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues of ``a`` in (low, high] and their vectors as columns."""
    d, scale = len(a), float(np.abs(a).sum(axis=1).max())
    centre, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    angles = np.pi / 2 * (nodes + 1)
    size = min(d, 2 * count + 4)
    vectors = np.random.default_rng(d).standard_normal((d, size))
    for step in range(MOST_ROUNDS):
        if size < d:
            vectors = np.linalg.qr(vectors)[0]
            filtered = np.zeros_like(vectors)
            for angle, weight in zip(angles, weights):
                shift = centre + radius * (np.cos(angle) + 1j * FLATTEN * np.sin(angle))
                solved = np.linalg.solve(shift * np.eye(d) - a, vectors.astype(complex))
                filtered += weight / 2 * radius * ((FLATTEN * np.cos(angle) + 1j * np.sin(angle)) * solved).real
            left, strength, _ = np.linalg.svd(filtered, full_matrices=False)
            basis = left[:, strength > strength[0] * 1e-14]
        else:
            basis = np.eye(d)
        values, mix = np.linalg.eigh(basis.T @ a @ basis)
        vectors = basis @ mix
        inside = (values > low) & (values <= high)
        residuals = np.linalg.norm(a @ vectors - vectors * values, axis=0)
        if inside.sum() == count and (residuals[inside] <= RESIDUAL * scale * np.sqrt(d)).all():
            return values[inside], vectors[:, inside]
        if size == d:
            return on_the_edge(values, vectors, low, high, count, 1e-13 * scale)
        if step % 3 == 2 or vectors.shape[1] < size:  # too narrow for what lies near the interval
            size = min(d, size * 2)
            extra = np.random.default_rng(d + step).standard_normal((d, size - vectors.shape[1]))
            vectors = np.hstack([vectors, extra])
    return on_the_edge(*np.linalg.eigh(a), low, high, count, 1e-13 * scale)


def on_the_edge(values: np.ndarray, vectors: np.ndarray, low: float, high: float, count: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` pairs nearest to the interval, for values that rounding moves over its edge; none may be further off."""
    off = np.maximum(np.maximum(low - values, values - high), 0)
    nearest = np.argsort(off, kind="stable")[:count]
    if (off[nearest] > slack).any():
        raise ArithmeticError(f"the interval from {low} to {high} has fewer than {count} eigenvalues")
    return values[nearest], vectors[:, nearest]
