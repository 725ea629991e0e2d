"""Local image descriptors in numpy, for stacks of grey images of one size.

Corners are found at several scales by the smaller structure-tensor measure
(determinant over trace); each gets an orientation from the intensity centroid
of its disc and a string of intensity comparisons at places turned by it.
"""

from __future__ import annotations

import numpy as np

#: Each scale's shrink factor and the corners that are kept at it.
SCALES = ((1.0, 16), (1.25, 8), (1.5625, 6))
RADIUS = 11
MARGIN = RADIUS + 2
TESTS = 256
_rng = np.random.default_rng(12)
_angle, _far = _rng.uniform(0, 2 * np.pi, (2, TESTS)), RADIUS * np.sqrt(_rng.uniform(0.02, 1, (2, TESTS)))
#: The places compared, (2, TESTS, xy), inside the disc; a fixed pseudo-random pattern.
PATTERN = np.stack([_far * np.cos(_angle), _far * np.sin(_angle)], -1).astype(np.float32)
_yy, _xx = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_DISC = (_xx**2 + _yy**2 <= RADIUS**2).astype(np.float32)


def resampling(n: int, factor: float) -> np.ndarray:
    """(m, n) matrix that shrinks n samples by factor, with a triangle filter."""
    m = int(n / factor)
    centre = (np.arange(m) + 0.5) * factor - 0.5
    w = np.maximum(0, 1 - np.abs(np.arange(n)[None] - centre[:, None]) / factor)
    return (w / w.sum(1, keepdims=True)).astype(np.float32)


def _blurred(a: np.ndarray) -> np.ndarray:
    for axis in (1, 2):
        p = np.pad(a, [(2, 2) if i == axis else (0, 0) for i in range(3)], mode="edge")
        n = a.shape[axis]
        s = lambda k: p[:, k : k + n] if axis == 1 else p[:, :, k : k + n]  # noqa: E731,B023
        a = (s(0) + 4 * s(1) + 6 * s(2) + 4 * s(3) + s(4)) / 16
    return a


def corners(images: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """image, y, x and strength of at most ``most`` corners of each image of (n, h, w)."""
    gy, gx = np.gradient(images, axis=(1, 2))
    a, b, c = _blurred(gx * gx), _blurred(gy * gy), _blurred(gx * gy)
    r = (a * b - c * c) / (a + b + 1e-3)
    n, h, w = r.shape
    if h <= 2 * MARGIN or w <= 2 * MARGIN:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, np.float32)
    core = r[:, MARGIN:-MARGIN, MARGIN:-MARGIN]
    peak = core > 0.05
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            if (dy, dx) != (0, 0):
                near = r[:, MARGIN + dy : h - MARGIN + dy, MARGIN + dx : w - MARGIN + dx]
                peak &= (core > near) if (dy, dx) < (0, 0) else (core >= near)
    i, y, x = np.nonzero(peak)
    s = core[i, y, x]
    order = np.lexsort((x, y, -s, i))
    i, y, x, s = i[order], y[order], x[order], s[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    keep = place < most
    return i[keep], y[keep] + MARGIN, x[keep] + MARGIN, s[keep]


def describe(images: np.ndarray) -> dict[str, np.ndarray]:
    """image, x, y (in pixels of the image), scale, angle and bits (k, TESTS / 8) of all corners of (n, h, w)."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("image", "x", "y", "scale", "angle", "bits")}
    images = images.astype(np.float32)
    for factor, most in SCALES:
        small = images if factor == 1 else resampling(images.shape[1], factor) @ images @ resampling(images.shape[2], factor).T
        i, y, x, _ = corners(small, most)
        if not len(i):
            continue
        at = lambda dy, dx: small[i.reshape(-1, *[1] * (dy.ndim - 1)), y.reshape(-1, *[1] * (dy.ndim - 1)) + dy, x.reshape(-1, *[1] * (dx.ndim - 1)) + dx]  # noqa: E731,B023
        disc = at(_yy[None], _xx[None]) * _DISC
        angle = np.arctan2((disc * _yy).sum((1, 2)), (disc * _xx).sum((1, 2)))
        cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
        seen = []
        for p in PATTERN:
            px, py = p[:, 0][None], p[:, 1][None]
            seen.append(at(np.rint(sin * px + cos * py).astype(np.int64), np.rint(cos * px - sin * py).astype(np.int64)))
        out["image"].append(i)
        out["x"].append((x + 0.5) * factor - 0.5)
        out["y"].append((y + 0.5) * factor - 0.5)
        out["scale"].append(np.full(len(i), factor, np.float32))
        out["angle"].append(angle)
        out["bits"].append(np.packbits(seen[0] < seen[1], axis=1))
    if not out["image"]:
        return {k: np.empty((0, TESTS // 8), np.uint8) if k == "bits" else np.empty(0) for k in out}
    return {k: np.concatenate(v) for k, v in out.items()}
