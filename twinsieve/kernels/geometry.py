"""Corners, binary descriptors, matching and homographies."""

from __future__ import annotations

import numpy as np

from .images import gradients, sampled

BITS, PATCH = 256, 15
_rng = np.random.default_rng(20)
#: Pairs of places whose brightness a descriptor compares.
PLACES = np.clip(_rng.normal(0, PATCH / 2.5, (BITS, 4)), -PATCH + 2, PATCH - 2)


def corners(g: np.ndarray, most: int = 1000, quality: float = 0.01) -> np.ndarray:
    """x, y, response, angle of the strongest corners, by the smaller eigenvalue of smoothed gradients, one in each 3 x 3."""
    gx, gy = gradients(g)

    def smooth(a: np.ndarray) -> np.ndarray:
        s = np.pad(np.pad(a, 2, mode="edge"), ((1, 0), (1, 0))).cumsum(0).cumsum(1)
        return s[5:, 5:] - s[:-5, 5:] - s[5:, :-5] + s[:-5, :-5]

    xx, yy, xy = smooth(gx * gx), smooth(gy * gy), smooth(gx * gy)
    r = (xx + yy) / 2 - np.sqrt(((xx - yy) / 2) ** 2 + xy * xy)
    edge = PATCH + 3
    if min(g.shape) <= 2 * edge:
        return np.empty((0, 4))
    p = np.pad(r, 1, constant_values=-np.inf)
    top = np.max([p[i : i + r.shape[0], j : j + r.shape[1]] for i in range(3) for j in range(3)], axis=0)
    y, x = np.nonzero((r == top) & (r > quality * r.max()) & (r > 0))
    inside = (x >= edge) & (x < g.shape[1] - edge) & (y >= edge) & (y < g.shape[0] - edge)
    y, x = y[inside], x[inside]
    order = np.lexsort((x, y, -r[y, x]))[:most]
    y, x = y[order], x[order]
    dy, dx = np.mgrid[-7:8, -7:8]
    round_ = dy * dy + dx * dx <= 49
    dy, dx = dy[round_], dx[round_]
    near = g[y[:, None] + dy, x[:, None] + dx].astype("f8")
    return np.column_stack([x, y, r[y, x], np.arctan2(near @ dy, near @ dx)])


def descriptors(g: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Rotated brightness comparisons, 32 bytes a point, on a lightly smoothed image."""
    p = np.pad(g.astype("f8"), 2, mode="edge")
    soft = sum(p[i : i + g.shape[0], j : j + g.shape[1]] for i in range(5) for j in range(5)) / 25
    c, s = np.cos(points[:, 3])[:, None], np.sin(points[:, 3])[:, None]
    at = lambda u, v: sampled(soft, points[:, 1:2] + s * u + c * v, points[:, :1] + c * u - s * v)
    return np.packbits(at(PLACES[:, 0], PLACES[:, 1]) < at(PLACES[:, 2], PLACES[:, 3]), axis=1)


def features(g: np.ndarray, most: int = 1000, enough: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Points and descriptors; at other scales too, until there are enough points."""
    from .images import resized

    found = []
    for scale in (1.0, 2.0, 0.5):
        h, w = round(g.shape[0] * scale), round(g.shape[1] * scale)
        if min(h, w) < 2 * PATCH + 8:
            continue
        small = g if scale == 1 else resized(g, h, w)
        points = corners(small, most)
        d = descriptors(small, points) if len(points) else np.empty((0, BITS // 8), "u1")
        found.append((np.column_stack([points[:, :2] / scale, points[:, 2:]]), d))
        if sum(len(p) for p, _ in found) >= enough:
            break
    if not found:
        return np.empty((0, 4)), np.empty((0, BITS // 8), "u1")
    return np.concatenate([p for p, _ in found])[:most], np.concatenate([d for _, d in found])[:most]


def matched(a: np.ndarray, b: np.ndarray, ratio: float = 0.75) -> np.ndarray:
    """Index pairs whose nearest descriptor is clearly nearer than the second."""
    if len(a) == 0 or len(b) < 2:
        return np.empty((0, 2), int)
    x, y = a.view("<u8"), b.view("<u8")
    out = []
    for i in range(0, len(x), 256):
        d = sum(np.bitwise_count(x[i : i + 256, None, k] ^ y[None, :, k]).astype(int) for k in range(x.shape[1]))
        two = np.argpartition(d, 1, axis=1)[:, :2]
        dist = np.take_along_axis(d, two, 1)
        best = np.where(dist[:, 0] <= dist[:, 1], two[:, 0], two[:, 1])
        ok = dist.min(1) < ratio * dist.max(1)
        out.append(np.column_stack([np.arange(i, i + len(d))[ok], best[ok]]))
    return np.concatenate(out)


def _fit(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    def scaled(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = z.mean(0)
        s = np.sqrt(2) / max(1e-9, np.linalg.norm(z - mean, axis=1).mean())
        return (z - mean) * s, np.array([[s, 0, -s * mean[0]], [0, s, -s * mean[1]], [0, 0, 1]])

    (u, t), (v, r) = scaled(p), scaled(q)
    one, zero = np.ones(len(u)), np.zeros((len(u), 3))
    left = np.column_stack([u, one])
    rows = np.concatenate([np.column_stack([left, zero, -v[:, :1] * left]), np.column_stack([zero, left, -v[:, 1:] * left])])
    h = np.linalg.inv(r) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ t
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else h


def projected(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    z = np.column_stack([p, np.ones(len(p))]) @ h.T
    return z[:, :2] / np.where(np.abs(z[:, 2:]) < 1e-12, 1e-12, z[:, 2:])


def homography(p: np.ndarray, q: np.ndarray, within: float = 5.0, tries: int = 500, seed: int = 42) -> tuple[np.ndarray | None, np.ndarray]:
    """(map from p to q, which pairs fit): the best of seeded samples of four, fitted again to all that agree with it."""
    if len(p) < 4:
        return None, np.zeros(len(p), bool)
    rng, best = np.random.default_rng(seed), np.zeros(len(p), bool)
    for _ in range(tries):
        four = rng.choice(len(p), 4, replace=False)
        h = _fit(p[four], q[four])
        fit = np.linalg.norm(projected(h, p) - q, axis=1) <= within
        if fit.sum() > best.sum():
            best = fit
            if best.all():
                break
    if best.sum() < 4:
        return None, best
    h = _fit(p[best], q[best])
    return h, np.linalg.norm(projected(h, p) - q, axis=1) <= within


def coverage(h: np.ndarray, shape_a: tuple[int, int], shape_b: tuple[int, int]) -> float:
    """The smaller of the share of a's corners inside b, a pixel over its border included, and the share of b's area that a covers."""
    box = np.array([[0, 0], [shape_a[1], 0], [shape_a[1], shape_a[0]], [0, shape_a[0]]], "f8")
    z = projected(h, box)
    inside = ((z >= -1.001) & (z <= np.array([shape_b[1], shape_b[0]]) + 1.001)).all(1).mean()
    x, y = z.T
    area = abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2
    return float(min(inside, area / (shape_b[0] * shape_b[1])))


def verified(a: np.ndarray, b: np.ndarray, inliers: int = 30, ratio: float = 0.30, error: float = 4.0, cover: float = 0.85) -> dict:
    """orb_inliers, inlier_ratio, reproj_error, crop_coverage, homography_type, is_partial and the reason of a refusal."""
    none = {"orb_inliers": 0, "inlier_ratio": 0.0, "reproj_error": 999.0, "crop_coverage": 0.0, "homography_type": None, "is_partial": False}
    (pa, da), (pb, db) = features(a), features(b)
    pairs = matched(da, db)
    if len(pairs) < inliers:
        return none | {"reason": "few_matches"}
    p, q = pa[pairs[:, 0], :2], pb[pairs[:, 1], :2]
    h, fit = homography(p, q)
    if h is None:
        return none | {"reason": "no_homography"}
    if not 0.1 <= abs(np.linalg.det(h[:2, :2])) <= 10:
        return none | {"reason": "degenerate"}
    n, share = int(fit.sum()), float(fit.mean())
    if n < inliers or share < ratio:
        return none | {"reason": "few_inliers"}
    off = float(np.median(np.linalg.norm(projected(h, p[fit]) - q[fit], axis=1)))
    if off > error:
        return none | {"reason": "inexact"}
    c = coverage(h, a.shape, b.shape)
    kind = "affine" if np.allclose(h[2], [0, 0, 1], atol=1e-5) else "projective"
    return {"orb_inliers": n, "inlier_ratio": share, "reproj_error": off, "crop_coverage": c, "homography_type": kind, "is_partial": c >= cover, "reason": "ok"}
