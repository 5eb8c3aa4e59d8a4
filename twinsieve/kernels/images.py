"""Signatures and comparisons of grey images (two-dimensional arrays of 0 to 255).

Without an image library these follow the published definitions, not another library's rounding:
results keep their contract (range, invariances, thresholds), not their last digits.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SIDE, LOW = 32, 8
#: Luma weights of red, green, blue.
LUMA = np.array([0.299, 0.587, 0.114])


def decoded(raw: bytes | None) -> np.ndarray | None:
    """A binary PGM or PPM of 8 bits; None for anything else."""
    if not raw or raw[:2] not in (b"P5", b"P6"):
        return None
    fields, at = [], 2
    while len(fields) < 3 and at < len(raw):
        end = at
        while end < len(raw) and not raw[end : end + 1].isspace():
            end += 1
        word = raw[at:end]
        if word.startswith(b"#"):
            end = raw.find(b"\n", at)
            end = len(raw) if end < 0 else end
        elif word:
            if not word.isdigit():
                return None
            fields.append(int(word))
        at = end + 1
    if len(fields) < 3 or fields[2] > 255:
        return None
    depth = 3 if raw[:2] == b"P6" else 1
    w, h = fields[:2]
    if w < 1 or h < 1 or len(raw) - at < w * h * depth:
        return None
    pixels = np.frombuffer(raw, "u1", w * h * depth, at)
    return pixels.reshape(h, w, 3) if depth == 3 else pixels.reshape(h, w)


def encoded(grey: np.ndarray) -> bytes:
    return f"P5 {grey.shape[1]} {grey.shape[0]} 255\n".encode() + grey.astype("u1").tobytes()


def grey_of(image: np.ndarray) -> np.ndarray:
    return image.astype("f8") @ LUMA if image.ndim == 3 else image.astype("f8")


@lru_cache(64)
def _weights(n: int, m: int) -> np.ndarray:
    """m x n matrix that averages n samples into m by overlap, or interpolates if m is larger."""
    if m <= n:
        edges = np.linspace(0, n, m + 1)
        lo, hi = edges[:-1, None], edges[1:, None]
        cover = np.clip(np.minimum(hi, np.arange(n) + 1) - np.maximum(lo, np.arange(n)), 0, None)
        return cover / cover.sum(1, keepdims=True)
    at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    return np.clip(1 - np.abs(at[:, None] - np.arange(n)), 0, None)


def resized(image: np.ndarray, h: int, w: int) -> np.ndarray:
    return _weights(image.shape[0], h) @ image.astype("f8") @ _weights(image.shape[1], w).T


def stretched(image: np.ndarray) -> np.ndarray:
    lo, hi = float(image.min()), float(image.max())
    return (image - lo) * (255.0 / (hi - lo)) if hi > lo else image.astype("f8")


@lru_cache(4)
def _cosines(n: int) -> np.ndarray:
    return np.cos(np.pi / n * np.outer(np.arange(n), np.arange(n) + 0.5))


def phash(image: np.ndarray) -> int:
    """64 bits: low cosine coefficients of a 32 x 32 reduction over their median."""
    c = _cosines(SIDE)
    low = (c @ resized(image, SIDE, SIDE) @ c.T)[:LOW, :LOW]
    return int.from_bytes(np.packbits((low > np.median(low)).ravel()).tobytes(), "big")


def phash_bundle(image: np.ndarray) -> dict[str, int]:
    """The hashes of the eight symmetries of the stretched image."""
    flat = stretched(image)
    return {f"{name}{90 * k}": phash(np.rot90(side, k)) for name, side in (("rot_", flat), ("mirror_h_rot_", flat[:, ::-1])) for k in range(4)}


def bundle_distance(a: dict[str, int], b: dict[str, int]) -> tuple[int, str]:
    """The least distance and its two transforms, the first among equals; (999, none) without hashes."""
    return min((((x ^ y).bit_count(), i * 8 + j, f"{p} vs {q}") for i, (p, x) in enumerate(a.items()) for j, (q, y) in enumerate(b.items())), default=(999, 0, "none"))[::2]


def equalised(image: np.ndarray, clip: float = 2.5, grid: int = 8) -> np.ndarray:
    """Contrast-limited equalisation: each cell's clipped histogram gives a curve, curves are interpolated between cell centres."""
    h, w = image.shape
    level = np.clip(np.rint(image), 0, 255).astype("i8")
    ys, xs = np.linspace(0, h, grid + 1).astype(int), np.linspace(0, w, grid + 1).astype(int)
    curves = np.empty((grid, grid, 256))
    for r in range(grid):
        for c in range(grid):
            cell = level[ys[r] : max(ys[r + 1], ys[r] + 1), xs[c] : max(xs[c + 1], xs[c] + 1)]
            n = np.bincount(cell.ravel(), minlength=256).astype("f8")
            most = max(1.0, clip * cell.size / 256)
            spare = np.clip(n - most, 0, None).sum()
            curves[r, c] = np.cumsum(np.minimum(n, most) + spare / 256) * (255.0 / cell.size)

    def between(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
        lo = np.minimum(at.astype(int), n - 1)
        return lo, np.minimum(lo + 1, n - 1), at - lo

    (r0, r1, fy), (c0, c1, fx) = between(grid, h), between(grid, w)
    pick = lambda r, c: curves[r[:, None], c[None, :], level]
    top, low = pick(r0, c0) * (1 - fx) + pick(r0, c1) * fx, pick(r1, c0) * (1 - fx) + pick(r1, c1) * fx
    return top * (1 - fy)[:, None] + low * fy[:, None]


def normalised(image: np.ndarray, clahe: bool = True) -> np.ndarray:
    """Grey, equalised, mean 128 and deviation 50, cut to 0..255."""
    g = grey_of(image)
    g = equalised(g) if clahe else g
    sd = g.std()
    return np.clip((g - g.mean()) / (sd if sd > 1e-6 else 1.0) * 50 + 128, 0, 255)


def _box(a: np.ndarray, k: int) -> np.ndarray:
    s = np.pad(a, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    return (s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]) / (k * k)


def ssim(a: np.ndarray, b: np.ndarray, span: float = 255.0, window: int = 7) -> float:
    """Mean structural similarity over uniform windows with sample moments; images smaller than a window are one window."""
    a, b = a.astype("f8"), b.astype("f8")
    k = min(window, *a.shape)
    n = k * k / max(1, k * k - 1)
    ma, mb = _box(a, k), _box(b, k)
    va, vb, cov = n * (_box(a * a, k) - ma * ma), n * (_box(b * b, k) - mb * mb), n * (_box(a * b, k) - ma * mb)
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    return float((((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean())


def fitted(a: np.ndarray, b: np.ndarray, height: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Both at one height, the narrower padded with white on its right."""
    scale = lambda x: resized(x, height, max(1, round(x.shape[1] * height / x.shape[0])))
    a, b = scale(a), scale(b)
    w = max(a.shape[1], b.shape[1])
    pad = lambda x: np.pad(x, ((0, 0), (0, w - x.shape[1])), constant_values=255)
    return pad(a), pad(b)


def patch_scores(a: np.ndarray, b: np.ndarray, grid: int = 3, top: int = 4, weight: float = 0.6, height: int = 512) -> dict[str, float]:
    """global, patch_min, patch_topk, patches and their mix ssim of two images, normalised and at one height."""
    a, b = fitted(normalised(a), normalised(b), height)
    whole = ssim(a, b)
    cuts = lambda n: [(n * i // grid, n * (i + 1) // grid) for i in range(grid)]
    each = sorted((ssim(a[y:Y, x:X], b[y:Y, x:X]) for y, Y in cuts(a.shape[0]) for x, X in cuts(a.shape[1]) if Y > y and X > x), reverse=True)
    mean = float(np.mean(each[:top]))
    return {"global_ssim": whole, "patch_min": each[-1], "patch_topk": mean, "patches": len(each), "ssim": (1 - weight) * whole + weight * mean}


def ncc(a: np.ndarray, b: np.ndarray) -> float:
    """Correlation; 0 for a flat image or other shapes."""
    if a.shape != b.shape or a.std() == 0 or b.std() == 0:
        return 0.0
    return float(np.corrcoef(a.ravel(), b.ravel())[0, 1])


def gradients(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """3 x 3 Sobel derivatives with repeated borders."""
    p = np.pad(g.astype("f8"), 1, mode="edge")
    smooth = lambda q, axis: np.take(q, range(q.shape[axis] - 2), axis) + 2 * np.take(q, range(1, q.shape[axis] - 1), axis) + np.take(q, range(2, q.shape[axis]), axis)
    return smooth(p[:, 2:] - p[:, :-2], 0), smooth(p[2:] - p[:-2], 1)


def texture_features(g: np.ndarray) -> dict[str, float]:
    """edge, anisotropy, mid, high and the vertical texture score, as the modality rules take them."""
    gx, gy = gradients(g)
    power = np.abs(np.fft.fftshift(np.fft.fft2(g.astype("f8"))))
    h, w = g.shape
    return {
        "edge": float((np.abs(gx) + np.abs(gy) > 150).mean()), "anisotropy": float(np.abs(gy).mean() / (np.abs(gx).mean() + 1e-6)), "mid": float(power[h // 4 : max(h // 4 + 1, 3 * h // 4), w // 4 : max(w // 4 + 1, 3 * w // 4)].mean()),
        "high": float(power[3 * h // 8 : max(3 * h // 8 + 1, 5 * h // 8), 3 * w // 8 : max(3 * w // 8 + 1, 5 * w // 8)].mean()), "vertical": float(np.abs(gx).mean()),
    }


def aligned(a: np.ndarray, b: np.ndarray, steps: int = 120, least: float = 1e-5) -> np.ndarray:
    """b moved onto a by an affine map from Gauss-Newton steps on the difference; b itself if that gets worse."""
    h, w = a.shape
    y, x = np.mgrid[0:h, 0:w].astype("f8")
    basis = np.stack([x - w / 2, y - h / 2, np.ones_like(x)])
    m = np.array([[1.0, 0, 0], [0, 1.0, 0]])
    moved, best, least_error = b.astype("f8"), b.astype("f8"), float(((a - b) ** 2).mean())
    for _ in range(steps):
        gx, gy = (d / 8 for d in gradients(moved))
        jac = np.concatenate([gx * basis, gy * basis]).reshape(6, -1)
        gram = jac @ jac.T
        step = np.linalg.lstsq(gram + 1e-6 * np.trace(gram) / 6 * np.eye(6), jac @ (a - moved).ravel(), rcond=None)[0].reshape(2, 3)
        m = m + step
        px, py = m[0, 0] * basis[0] + m[0, 1] * basis[1] + m[0, 2] + w / 2, m[1, 0] * basis[0] + m[1, 1] * basis[1] + m[1, 2] + h / 2
        moved = sampled(b, py, px)
        error = float(((a - moved) ** 2).mean())
        if error < least_error:
            best, least_error = moved, error
        if np.abs(step).max() < least:
            break
    return best


def sampled(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear values at real places, borders repeated."""
    h, w = image.shape
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.minimum(y.astype(int), max(h - 2, 0)), np.minimum(x.astype(int), max(w - 2, 0))
    y1, x1, fy, fx = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1), y - y0, x - x0
    f = image.astype("f8")
    return (f[y0, x0] * (1 - fx) + f[y0, x1] * fx) * (1 - fy) + (f[y1, x0] * (1 - fx) + f[y1, x1] * fx) * fy


def deep_verified(a: np.ndarray, b: np.ndarray, need_ssim: float = 0.90, need_ncc: float = 0.985, need_hamming: int = 5, height: int = 256) -> dict[str, float | bool]:
    """Scores after alignment, the least bundle distance, and whether they prove the two the same."""
    p, q = fitted(normalised(a), normalised(b), height)
    q = aligned(p, q)
    s, n, (d, _) = ssim(p, q), ncc(p, q), bundle_distance(phash_bundle(grey_of(a)), phash_bundle(grey_of(b)))
    return {"deep_ssim": s, "deep_ncc": n, "deep_hamming": d, "ok": (s >= need_ssim and n >= need_ncc) or d <= need_hamming}


#: Fixed values of the stain test: hue from and to in half degrees, least saturation and least brightness of 255; brown, then violet.
STAINS = ((10, 35, 50, 30), (120, 160, 40, 30))


def stain_share(rgb: np.ndarray) -> tuple[float, float]:
    """Shares of brown and of blue-violet pixels, by hue, saturation and brightness."""
    f = rgb.astype("f8")
    hi, lo = f.max(-1), f.min(-1)
    span = np.where(hi > lo, hi - lo, 1.0)
    r, g, b = f[..., 0], f[..., 1], f[..., 2]
    hue = np.select([hi == r, hi == g], [(g - b) / span % 6, (b - r) / span + 2], (r - g) / span + 4) * 60
    half = np.where(hi > lo, np.round(hue / 2) % 180, 0)
    saturation = np.round(255 * (hi - lo) / np.where(hi > 0, hi, 1.0))
    return tuple(float(((half >= at) & (half <= to) & (saturation >= s) & (hi >= v)).mean()) for at, to, s, v in STAINS)


def ihc_like(rgb: np.ndarray, least: float = 0.10) -> bool:
    """Whether one of the two stains, not both together, covers the least share."""
    return rgb.ndim == 3 and rgb.size > 0 and max(stain_share(rgb)) >= least


def valleys(profile: np.ndarray, depth: float = 10, width: int = 5) -> list[int]:
    """Middles of runs of at least `width` samples that lie `depth` under the median."""
    low = np.r_[False, profile < np.median(profile) - depth, False]
    turns = np.flatnonzero(low[1:] != low[:-1]).reshape(-1, 2)
    inner = turns[(turns[:, 1] - turns[:, 0] >= width) & (turns[:, 0] > 0) & (turns[:, 1] < len(profile))]
    return inner.mean(axis=1).astype(int).tolist()


def grid_cells(g: np.ndarray, least_area: int = 9000, cells: tuple[int, int] = (2, 30)) -> list[tuple[int, int, int, int]]:
    """x, y, w, h of a grid's cells between dark or empty separators; none if there is no grid."""
    ys, xs = [0, *valleys(g.mean(axis=1)), g.shape[0]], [0, *valleys(g.mean(axis=0)), g.shape[1]]
    if not cells[0] <= (len(ys) - 1) * (len(xs) - 1) <= cells[1]:
        return []
    found = [(x, y, X - x, Y - y) for y, Y in zip(ys, ys[1:]) for x, X in zip(xs, xs[1:]) if (X - x) * (Y - y) >= least_area]
    return found if len(found) >= cells[0] else []


def lane_profiles(g: np.ndarray, lanes: list[tuple[int, int]], samples: int = 256) -> list[np.ndarray]:
    """Row means of each lane (start, end) at one length, from 0 to 1; the whole image without lanes."""
    out = []
    for start, end in lanes or [(0, g.shape[1])]:
        rows = g[:, max(0, start) : max(start + 1, end)].mean(axis=1)
        if len(rows) > 1:
            p = np.interp(np.linspace(0, len(rows) - 1, samples), np.arange(len(rows)), rows)
            p = p - p.min()
            out.append(p / p.max() if p.max() > 1e-6 else p)
    return out


def warping_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Dynamic time warping over both lengths; the table is filled one anti-diagonal at a time."""
    n, m = len(a), len(b)
    gap = np.abs(a[:, None] - b[None, :])
    older, old = np.full(n + 1, np.inf), np.full(n + 1, np.inf)
    older[0] = 0.0
    for s in range(2, n + m + 1):
        i = np.arange(max(1, s - m), min(n, s - 1) + 1)
        new = np.full(n + 1, np.inf)
        new[i] = gap[i - 1, s - i - 1] + np.minimum(np.minimum(old[i - 1], old[i]), older[i - 1])
        older, old = old, new
    return float(old[n] / (n + m))


def lanes_distance(a: list[np.ndarray], b: list[np.ndarray], penalty: float = 1.0) -> float | None:
    """Mean warping distance of lanes in order; each lane without a partner costs the penalty."""
    if not a or not b:
        return None
    return float(np.mean([warping_distance(x, y) for x, y in zip(a, b)] + [penalty] * abs(len(a) - len(b))))


def panel_boxes(g: np.ndarray, white: float = 245, gutter: int = 8, least: int = 40) -> list[tuple[int, int, int, int]]:
    """x, y, w, h of a page's panels: the page is cut along its widest blank gutters, again and again, until none is left."""
    ink = g < white
    found, open_ = [], [(0, 0, g.shape[1], g.shape[0])]
    while open_:
        x, y, w, h = open_.pop()
        part = ink[y : y + h, x : x + w]
        rows, cols = np.flatnonzero(part.any(1)), np.flatnonzero(part.any(0))
        if not len(rows):
            continue
        y, x, h, w = y + rows[0], x + cols[0], rows[-1] - rows[0] + 1, cols[-1] - cols[0] + 1
        if h < least or w < least:
            continue
        gaps = []
        for axis, used in ((0, rows), (1, cols)):
            step = np.diff(used)
            if len(step) and step.max() > gutter:
                k = int(step.argmax())
                gaps.append((int(step[k]), axis, int(used[k] - used[0]) + 1))
        if not gaps:
            found.append((int(x), int(y), int(w), int(h)))
            continue
        _, axis, at = max(gaps)
        open_ += [(x, y, w, at), (x, y + at, w, h - at)] if axis == 0 else [(x, y, at, h), (x + at, y, w - at, h)]
    return sorted(found, key=lambda b: (b[1], b[0]))


def jpeg_like(g: np.ndarray, factor: float = 1.2) -> bool:
    """Whether steps at the borders of 8 x 8 blocks are larger than elsewhere."""
    steps = [np.abs(np.diff(g.astype("f8"), axis=a)) for a in (0, 1)]
    at = [np.arange(7, s.shape[a], 8) for a, s in enumerate(steps)]
    if not len(at[0]) or not len(at[1]):
        return False
    return bool(np.mean([s.take(i, a).mean() for a, (s, i) in enumerate(zip(steps, at))]) > factor * np.mean([s.mean() for s in steps]))


def text_like(boxes: list[tuple[int, int, int, int]], shape: tuple[int, int], margin: float = 0.10) -> list[tuple[int, int, int, int]]:
    """Boxes that look like a line of text: 3 to 10 times as wide as high, and near the border."""
    h, w = shape
    my, mx = h * margin, w * margin
    return [b for b in boxes if 3 <= b[2] / max(1, b[3]) <= 10 and (b[0] < mx or b[1] < my or b[0] + b[2] > w - mx or b[1] + b[3] > h - my)]
