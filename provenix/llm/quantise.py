"""Score-aware (anisotropic) product quantisation with four bits to a code.

A vector is cut into SUB parts and each part named by one of 16 code words. The error along the vector counts ETA times
as much as the error across it, because it is what shifts the largest inner products. Code words and codes are fitted in
turn; for given codes the best code words are one linear system.
"""

from __future__ import annotations

import numpy as np

#: Parts of a vector, and code words to a part (four bits).
SUB, WORDS = 16, 16
#: Score from which inner products matter, relative to the norm; gives the weight of the parallel error.
SCORE_FROM = 0.2


def eta(dim: int, t: float = SCORE_FROM) -> float:
    return (dim - 1) * t * t / (1 - t * t)


def fit(x: np.ndarray, rounds: int = 4, seed: int = 3) -> np.ndarray:
    """Code words (SUB, WORDS, dim / SUB) for unit vectors."""
    n, dim = x.shape
    w = dim // SUB
    rng = np.random.default_rng(seed)
    if n == 0:
        return np.zeros((SUB, WORDS, w), "f4")
    book = x[rng.integers(0, n, WORDS)].reshape(WORDS, SUB, w).transpose(1, 0, 2).copy()
    h = eta(dim)
    for _ in range(rounds):
        codes = encode(x, book)
        u = np.zeros((n, SUB * WORDS, w), "f4")
        u[np.arange(n)[:, None], codes + np.arange(SUB) * WORDS] = x.reshape(n, SUB, w)
        u = u.reshape(n, -1)
        count = np.repeat(np.bincount((codes + np.arange(SUB) * WORDS).ravel(), minlength=SUB * WORDS), w)
        m = (h - 1) * (u.T @ u).astype("f8")
        m[np.diag_indices(len(m))] += count + 1e-3
        book = np.linalg.solve(m, h * u.sum(0).astype("f8") + 1e-3 * book.ravel()).reshape(SUB, WORDS, w)
    return book.astype("f4")


def encode(x: np.ndarray, book: np.ndarray, sweeps: int = 2) -> np.ndarray:
    """Codes (n, SUB) by coordinate descent on the weighted error, from the nearest code words."""
    n, dim = x.shape
    h = np.float32(eta(dim))
    parts = x.astype("f4").reshape(n, SUB, -1)
    codes = np.empty((n, SUB), "i8")
    along = np.empty((n, SUB), "f4")  # x_m . r_m of the chosen words
    dist, par = [], []
    for m in range(SUB):
        p, b = parts[:, m], book[m].astype("f4")
        dot, own = p @ b.T, np.einsum("ij,ij->i", p, p)[:, None]
        dist.append(own - 2 * dot + np.einsum("ij,ij->i", b, b)[None])
        par.append(own - dot)
        codes[:, m] = dist[m].argmin(1)
        along[:, m] = np.take_along_axis(par[m], codes[:, m:m + 1], 1)[:, 0]
    total = along.sum(1)
    for _ in range(sweeps):
        for m in range(SUB):
            new = (total - along[:, m])[:, None] + par[m]
            codes[:, m] = (dist[m] + (h - 1) * new * new).argmin(1)
            got = np.take_along_axis(par[m], codes[:, m:m + 1], 1)[:, 0]
            total += got - along[:, m]
            along[:, m] = got
    return codes


def decode(codes: np.ndarray, book: np.ndarray) -> np.ndarray:
    return book[np.arange(SUB), codes].reshape(len(codes), -1)


def residuals(x: np.ndarray, codes: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size of the error along each unit vector, and across it."""
    r = x - decode(codes, book)
    par = np.einsum("ij,ij->i", r, x)
    across = np.sqrt(np.maximum(np.einsum("ij,ij->i", r, r) - par * par, 0))
    return np.abs(par), across


def fused(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes to a byte, (n, SUB / 2)."""
    return (codes[:, 0::2] * WORDS + codes[:, 1::2]).astype("u1")


def tables(q: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Look-up tables (SUB / 2, 256, queries): inner products of the queries with two code words together."""
    t = np.einsum("qmw,mcw->mcq", q.astype("f4").reshape(len(q), SUB, -1), book.astype("f4"))
    return (t[0::2][:, :, None] + t[1::2][:, None, :]).reshape(SUB // 2, WORDS * WORDS, len(q))


def scan(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Approximate scores (rows, queries): the sum of one table entry per byte of the codes."""
    out = table[0].take(codes[:, 0], axis=0)
    for m in range(1, len(table)):
        out += table[m].take(codes[:, m], axis=0)
    return out
