"""Operators on decoded pixel grids (array of rows of numbers), as Arrow-batched UDFs; decoding itself is not done here."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _grid(v) -> np.ndarray | None:
    """A grid as a matrix; null, empty or ragged grids give None."""
    if v is None or len(v) == 0 or any(r is None or len(r) != len(v[0]) for r in v) or len(v[0]) == 0:
        return None
    return np.array([np.asarray(r, "f8") for r in v])


def _resized(g: np.ndarray, n: int) -> np.ndarray:
    """Mean over equal areas down to n x n (nearest where smaller)."""
    rows = [g[max(0, i * g.shape[0] // n):max(i * g.shape[0] // n + 1, (i + 1) * g.shape[0] // n)].mean(0) for i in range(n)]
    r = np.array(rows)
    return np.array([r[:, max(0, j * g.shape[1] // n):max(j * g.shape[1] // n + 1, (j + 1) * g.shape[1] // n)].mean(1) for j in range(n)]).T


def dct_matrix(n: int) -> np.ndarray:
    k, x = np.arange(n)[:, None], np.arange(n)[None]
    m = np.sqrt(2 / n) * np.cos(np.pi * (2 * x + 1) * k / (2 * n))
    m[0] /= np.sqrt(2)
    return m


def phash(g: np.ndarray) -> str:
    """16 hex digits: 32 x 32, orthonormal DCT-II, low 8 x 8, above the median of all 64."""
    m = dct_matrix(32)
    low = (m @ _resized(g, 32) @ m.T)[:8, :8].ravel()
    bits = low > np.median(low)
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def _box(x: np.ndarray, w: int) -> np.ndarray:
    """Mean over w x w windows, edges mirrored without repeating the border."""
    p = np.pad(x, w // 2, mode="reflect")
    c = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return (c[w:, w:] - c[:-w, w:] - c[w:, :-w] + c[:-w, :-w]) / (w * w)


def ssim(a: np.ndarray, b: np.ndarray, w: int = 11) -> float:
    """Structural similarity with a box window on 128 x 128 grey."""
    a, b = _resized(a, 128), _resized(b, 128)
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    ma, mb = _box(a, w), _box(b, w)
    va, vb, cov = _box(a * a, w) - ma * ma, _box(b * b, w) - mb * mb, _box(a * b, w) - ma * mb
    return float((((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean())


def blockiness(g: np.ndarray) -> float:
    """Step at the borders of 8-pixel blocks over the step elsewhere, mean of both directions; 1 below 16 pixels."""
    if min(g.shape) < 16:
        return 1.0

    def one(x: np.ndarray) -> float:
        step = np.abs(np.diff(x, axis=1)).mean(0)
        edge = np.arange(len(step)) % 8 == 7
        return step[edge].mean() / max(0.1, step[~edge].mean())

    return float((one(g) + one(g.T)) / 2)


def sharpness(g: np.ndarray) -> tuple[float, int]:
    """Variance of the Laplacian, and peaks in a ring of the spectrum of 256 x 256."""
    p = np.pad(g, 1, mode="reflect")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
    spec = np.log1p(np.abs(np.fft.fftshift(np.fft.fft2(_resized(g, 256)))))
    y, x = np.mgrid[:256, :256] - 128
    r = np.hypot(y, x)
    ring = spec[(r >= 64) & (r <= 120)]
    return float(lap.var()), int((ring > ring.mean() + 3.5 * ring.std()).sum())


def histogram_correlation(a: np.ndarray, b: np.ndarray, bins: int = 8) -> float:
    """Pearson correlation of two histograms of n x 3 HSV pixels (h below 180), at least 0."""
    h = [np.histogramdd(x, bins=bins, range=((0, 180), (0, 256), (0, 256)))[0].ravel() for x in (a, b)]
    h = [(x - x.min()) / max(np.ptp(x), 1e-12) for x in h]
    d = [x - x.mean() for x in h]
    norm = np.sqrt((d[0] ** 2).sum() * (d[1] ** 2).sum())
    return float(max(0.0, (d[0] * d[1]).sum() / norm)) if norm > 0 else 0.0


def patch_scores(g: np.ndarray, size: int = 128, step: int = 64) -> list[tuple[int, int, float]]:
    """(row, column, score) of sliding patches: how far each patch's noise is from that of the whole; flat ones score 0."""
    base = sharpness(g)[0]
    out = []
    for y in range(0, max(1, g.shape[0] - size + 1), step):
        for x in range(0, max(1, g.shape[1] - size + 1), step):
            p = g[y:y + size, x:x + size]
            flat = p.std() < 2
            out.append((y, x, 0.0 if flat or base == 0 else float(min(1.0, abs(sharpness(p)[0] - base) / base))))
    return out


def merged_boxes(boxes: list[tuple[int, int, int, int, float]], gap: int = 64) -> list[tuple[int, int, int, int, float]]:
    """Boxes (y, x, height, width, score) nearer than ``gap`` pixels joined until none is; scores keep the greatest."""
    todo = sorted(boxes)
    changed = True
    while changed:
        changed, out = False, []
        for b in todo:
            for i, o in enumerate(out):
                dy = max(o[0] - b[0] - b[2], b[0] - o[0] - o[2], 0)
                dx = max(o[1] - b[1] - b[3], b[1] - o[1] - o[3], 0)
                if max(dy, dx) < gap:
                    y, x = min(o[0], b[0]), min(o[1], b[1])
                    out[i] = (y, x, max(o[0] + o[2], b[0] + b[2]) - y, max(o[1] + o[3], b[1] + b[3]) - x, max(o[4], b[4]))
                    changed = True
                    break
            else:
                out.append(b)
        todo = out
    return todo


def cropped(g: np.ndarray, share: float) -> np.ndarray:
    y, x = int(g.shape[0] * share), int(g.shape[1] * share)
    return g[y:g.shape[0] - y, x:g.shape[1] - x]


def variant(g: np.ndarray, kind: str) -> np.ndarray:
    """A crop of 15 per cent off each side, or half the size."""
    return cropped(g, 0.15) if kind == "cropped" else _resized(g, max(1, min(g.shape) // 2)) if kind == "resized" else g


def _each(fn, empty):
    def run(grids: pd.Series) -> pd.Series:
        return grids.map(lambda v: empty if (g := _grid(v)) is None else fn(g))

    return run


grid_phash = F.pandas_udf(_each(phash, None), T.StringType())
grid_blockiness = F.pandas_udf(_each(blockiness, 1.0), T.DoubleType())
grid_laplacian = F.pandas_udf(_each(lambda g: sharpness(g)[0], None), T.DoubleType())
grid_peaks = F.pandas_udf(_each(lambda g: sharpness(g)[1], None), T.IntegerType())


@F.pandas_udf(T.DoubleType())
def grid_ssim(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        g, h = _grid(x), _grid(y)
        out.append(None if g is None or h is None else ssim(g, h))
    return pd.Series(out, dtype="float64")


_REGION = T.StructType([*(T.StructField(n, T.IntegerType()) for n in ("y", "x", "height", "width")), T.StructField("score", T.DoubleType())])


@F.pandas_udf(T.ArrayType(_REGION))
def edited_regions(grids: pd.Series) -> pd.Series:
    """Merged patches whose score is a quarter or more."""
    def one(v):
        g = _grid(v)
        if g is None:
            return []
        return [{"y": y, "x": x, "height": h, "width": w, "score": s} for y, x, h, w, s in merged_boxes([(y, x, 128, 128, s) for y, x, s in patch_scores(g) if s >= 0.25])]

    return grids.map(one)
