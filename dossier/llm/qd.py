"""Singular values and right singular vectors of a small triangular matrix: bidiagonal form, qd transforms, twisted factorisations."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Eigenvalues closer than CLUSTER, relatively, have vectors that are made orthogonal to each other; those closer than TIED are not told apart.
CLUSTER, TIED = 1e-3, 1e-9
#: Transforms for each value, at most, before its bound is taken as it is.
STEPS = 200


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and P with r = Q B P^T, by Householder reflections from both sides."""
    b = np.array(r, dtype=float)
    n = b.shape[1]
    p = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray:
        v = x.copy()
        v[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(v)
        return v / size if size else v

    for k in range(n):
        v = reflector(b[k:, k])
        b[k:, k:] -= 2 * np.outer(v, v @ b[k:, k:])
        if k < n - 2:
            v = reflector(b[k, k + 1:])
            b[k:, k + 1:] -= 2 * np.outer(b[k:, k + 1:] @ v, v)
            p[:, k + 1:] -= 2 * np.outer(p[:, k + 1:] @ v, v)
    return np.diag(b).copy(), np.diag(b, 1).copy(), p


def _dqds(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """One differential qd transform with a shift; None where the shift lies above the smallest eigenvalue."""
    out_q, out_e = np.empty_like(q), np.empty_like(e)
    d = q[0] - shift
    for i in range(len(e)):
        if d < 0:
            return None
        out_q[i] = d + e[i]
        ratio = q[i + 1] / out_q[i] if out_q[i] > 0 else 1.0
        out_e[i] = e[i] * ratio
        d = d * ratio - shift
    if not d >= 0:
        return None
    out_q[-1] = d
    return out_q, out_e


def _below(q: np.ndarray, e: np.ndarray) -> float:
    """A shift near, and hardly ever above, the smallest eigenvalue: Laguerre's step from zero by the traces of the inverse and its square."""
    n = len(q)
    with np.errstate(all="ignore"):
        try:
            inverse = np.linalg.inv(np.diag(np.sqrt(q)) + np.diag(np.sqrt(e), 1))
        except np.linalg.LinAlgError:
            return 0.0
        gram = inverse @ inverse.T
        first, second = np.trace(gram), (gram * gram).sum()
        step = n / (first + np.sqrt(max((n - 1) * (n * second - first * first), 0.0)))
    return float(step) if np.isfinite(step) else 0.0


def eigenvalues(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, falling. Only sums and quotients of positive numbers, so small ones are as exact as large ones."""
    largest = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if not largest:
        return np.zeros(len(diagonal))
    q = np.maximum(np.abs(diagonal), EPS * largest) ** 2
    e = np.asarray(above, dtype=float) ** 2
    found, moved, steps = [], 0.0, 0
    while len(q) > 1:
        if e[-1] <= EPS * EPS * (moved + q[-1]) or steps == STEPS:
            found.append(moved + q[-1])
            q, e, steps = q[:-1], e[:-1], 0
            continue
        shift, steps = _below(q, e), steps + 1
        for s in (shift, shift * (1 - 1e-6), shift / 2, 0.0):
            if (after := _dqds(q, e, s)) is not None:
                q, e = after
                moved += s
                break
    found.append(moved + q[0])
    return np.sort(np.array(found))[::-1]


@np.errstate(over="ignore", invalid="ignore")
def _twisted(q: np.ndarray, links: np.ndarray, value: float) -> np.ndarray:
    """Unit eigenvector of L D L^T for ``value``: top-down and bottom-up factorisations, twisted where they meet with the least remainder."""
    n = len(q)
    tiny = np.finfo(float).tiny
    s, p = np.empty(n), np.empty(n)
    down, up = np.empty(max(n - 1, 0)), np.empty(max(n - 1, 0))
    s[0], p[-1] = -value, q[-1] - value
    for i in range(n - 1):
        pivot = q[i] + s[i]
        down[i] = q[i] * links[i] / (pivot if pivot else tiny)
        s[i + 1] = down[i] * links[i] * s[i] - value
    for i in range(n - 2, -1, -1):
        pivot = q[i] * links[i] ** 2 + p[i + 1]
        ratio = q[i] / (pivot if pivot else tiny)
        up[i] = links[i] * ratio
        p[i] = p[i + 1] * ratio - value
    remainder = np.abs(s + p + value)
    k = int(np.nanargmin(np.where(np.isfinite(remainder), remainder, np.inf)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def _clusters(values: np.ndarray, gap: float) -> list[tuple[int, int]]:
    """Stretches of more than one of the falling values where each is within ``gap`` of the one before, relatively."""
    close = values[:-1] - values[1:] <= gap * values[:-1] + EPS * EPS * values[0]
    starts = [0, *(np.flatnonzero(~close) + 1)]
    return [(start, end) for start, end in zip(starts, [*starts[1:], len(values)]) if end - start > 1]


def _orthogonal(vectors: np.ndarray, values: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Vectors (columns) of falling values; those of a cluster become an orthogonal basis of the space they span.

    Vectors of equal values may be one and the same, so their space is found by block inverse iteration first.
    """
    out, noise = vectors.copy(), np.random.default_rng(1)
    for start, end in _clusters(values, TIED):
        # beside the values by more than rounding, so that the matrix can be solved with
        shifted = t - (values[start] + max(values[start] - values[end - 1], 64 * EPS * values[0])) * np.eye(len(t))
        basis = noise.standard_normal((len(t), end - start))
        for _ in range(6):
            basis = np.linalg.qr(np.linalg.solve(shifted, basis))[0]
        out[:, start:end] = basis
    for start, end in _clusters(values, CLUSTER):
        basis = np.linalg.qr(out[:, start:end])[0]
        ritz, turn = np.linalg.eigh(basis.T @ t @ basis)
        out[:, start:end] = basis @ turn[:, np.argsort(-ritz)]
    return out


def right_vectors(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values of ``r``, falling, and its right singular vectors as columns."""
    diagonal, above, p = bidiagonal(r)
    n = len(diagonal)
    largest = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if not largest:
        return np.zeros(n), np.eye(n)
    diagonal = np.where(np.abs(diagonal) < EPS * largest, EPS * largest, diagonal)
    # a link of rounding size parts the matrix: vectors of different blocks share no place
    cuts = np.flatnonzero(np.abs(above) <= EPS * np.minimum(np.abs(diagonal[:-1]) + np.abs(diagonal[1:]), largest)) + 1
    values, vectors = np.zeros(n), np.zeros((n, n))
    for start, end in zip([0, *cuts], [*cuts, n]):
        a, b = diagonal[start:end], above[start:end - 1]
        values[start:end] = found = eigenvalues(a, b)
        block = np.column_stack([_twisted(a * a, b / a[:-1], v) for v in found])
        bi = np.diag(a) + np.diag(b, 1)
        vectors[start:end, start:end] = _orthogonal(block, found, bi.T @ bi)
    order = np.argsort(-values, kind="stable")
    return values[order], p @ vectors[:, order]
