"""Pixel operators in numpy, for use inside Arrow or pandas functions; images are arrays [height, width(, 3)]."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np


def gray(image: np.ndarray) -> np.ndarray:
    return image.astype(float) if image.ndim == 2 else image @ np.array([0.114, 0.587, 0.299])


def is_screenshot(image: np.ndarray, least: float = 500.0) -> bool:
    """Sharp edges everywhere: the variance of the Laplacian is large."""
    g = gray(image)
    lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return bool(lap.var() > least)


def runs_at_least(dark: np.ndarray, length: int) -> np.ndarray:
    """Keep horizontal runs of at least ``length`` dark pixels (a morphological opening with a line)."""
    n = dark.shape[1]
    if length > n:
        return np.zeros_like(dark)
    sums = np.cumsum(np.pad(dark.astype(np.int32), ((0, 0), (1, 0))), axis=1)
    full = (sums[:, length:] - sums[:, :-length]) == length
    out = np.zeros(dark.shape, np.int32)
    out[:, : full.shape[1]] += full
    ends = np.zeros((dark.shape[0], n + 1), np.int32)
    ends[:, : full.shape[1]] += full
    ends[:, length : length + full.shape[1]] -= full
    return np.cumsum(ends, axis=1)[:, :n] > 0


def line_positions(lines: np.ndarray, axis: int, share: float = 0.3) -> list[int]:
    """Places where the projection of line pixels is above a share of its maximum."""
    p = lines.sum(axis=axis)
    return np.flatnonzero(p > share * p.max()).tolist() if p.max() > 0 else []


def merge_close(positions: list[int], threshold: float) -> list[int]:
    """Neighbours within the threshold of a running mark become its integer mean; a mark ends where the next position is further away."""
    rising = sorted(positions)
    marks = list(accumulate(rising, lambda mark, p: (mark + p) // 2 if p - mark <= threshold else p))
    return [m for m, after in zip(marks, rising[1:] + [float("inf")]) if after - m > threshold]


def local_mean(g: np.ndarray, size: int = 15) -> np.ndarray:
    """Gaussian mean over a window of odd size, edges repeated."""
    sigma = 0.3 * ((size - 1) / 2 - 1) + 0.8
    weights = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    weights /= weights.sum()
    out = g
    for axis in (0, 1):
        pad = [(size // 2, size // 2) if k == axis else (0, 0) for k in (0, 1)]
        wide = np.pad(out, pad, mode="edge")
        n = out.shape[axis]
        out = sum(w * np.take(wide, np.arange(n) + k, axis=axis) for k, w in enumerate(weights))
    return out


def binarised(g: np.ndarray) -> Iterator[np.ndarray]:
    """Where a gray image is dark: by a fixed level, by its surroundings, by a lower level.  Fixed values."""
    yield g <= 180
    yield g <= np.rint(local_mean(g)) - 5
    yield g <= 150


def column_places(dark: np.ndarray) -> list[int]:
    return line_positions(runs_at_least(dark.T, max(int(dark.shape[0] * 0.02), 10)), 1)


def table_cells(image: np.ndarray, ratio: float = 0.05) -> list[dict[str, int]]:
    """Cells of a ruled table of two rows and two columns or more: the first binarisation that shows lines in each direction."""
    g = gray(image)
    height, width = g.shape
    for dark in binarised(g):
        rows, cols = line_positions(runs_at_least(dark, max(int(width * ratio), 20)), 1), column_places(dark)
        rows, cols = merge_close(rows, max(height * 0.005, 3)), merge_close(cols, max(width * 0.004, 3))
        if len(rows) >= 2 and len(cols) >= 2:
            if len(rows) < 3 or len(cols) < 3:
                return []
            return [{"row": r, "col": k, "x_min": cols[k], "x_max": cols[k + 1], "y_min": rows[r], "y_max": rows[r + 1]} for r in range(len(rows) - 1) for k in range(len(cols) - 1)]
    return []


def column_boundaries(image: np.ndarray, least: int = 5) -> list[int]:
    """Places of vertical lines alone, where a binarisation shows enough of them."""
    for dark in binarised(gray(image)):
        merged = merge_close(column_places(dark), max(dark.shape[1] * 0.004, 3))
        if len(merged) >= least:
            return merged
    return []


def occupied(image: np.ndarray, cell: dict[str, int], share: float = 0.008, difference: int = 40, margin: float = 0.1) -> bool:
    """Whether enough pixels differ from the cell's background (the median of its corners); a tenth, two pixels at least, is left out at each side."""
    mx, my = (max(int((cell[f"{a}_max"] - cell[f"{a}_min"]) * margin), 2) for a in "xy")
    inner = gray(image)[cell["y_min"] + my : max(cell["y_max"] - my, 0), cell["x_min"] + mx : max(cell["x_max"] - mx, 0)]
    if not inner.size:
        return False
    ground = int(np.median([inner[0, 0], inner[0, -1], inner[-1, 0], inner[-1, -1]]))
    return bool((np.abs(inner - ground) > difference).mean() > share)


def crop(image: np.ndarray, cell: dict[str, int], pad: int = 1) -> np.ndarray:
    """A cell's pixels with some around them, inverted where they are dark on the whole."""
    part = image[max(cell["y_min"] - pad, 0) : cell["y_max"] + pad, max(cell["x_min"] - pad, 0) : cell["x_max"] + pad]
    return 255 - part if part.size and gray(part).mean() < 128 else part


def cubic_weights(n: int, scale: int, a: float = -0.75) -> np.ndarray:
    """Weights [n * scale, n] of cubic interpolation at pixel centers, edges repeated."""
    at = (np.arange(n * scale) + 0.5) / scale - 0.5
    base = np.floor(at).astype(int)
    out = np.zeros((n * scale, n))
    for k in range(-1, 3):
        x = np.abs(at - (base + k))
        near, far = (a + 2) * x**3 - (a + 3) * x**2 + 1, a * x**3 - 5 * a * x**2 + 8 * a * x - 4 * a
        np.add.at(out, (np.arange(n * scale), np.clip(base + k, 0, n - 1)), np.where(x <= 1, near, far))
    return out


def upscaled(image: np.ndarray, least: int = 1500) -> np.ndarray:
    """A low image enlarged by a whole factor, two at least, until it is as high as asked for."""
    height, width = image.shape[:2]
    if height >= least:
        return image
    scale = max(2, least // height + 1)
    planes = image[..., None] if image.ndim == 2 else image
    big = np.stack([cubic_weights(height, scale) @ planes[..., c] @ cubic_weights(width, scale).T for c in range(planes.shape[2])], axis=-1)
    big = np.clip(np.rint(big), 0, 255).astype(np.uint8)
    return big[..., 0] if image.ndim == 2 else big


def equalised(g: np.ndarray, tiles: int = 8, limit: float = 2.0) -> np.ndarray:
    """Contrast by tiles: each tile's histogram is clipped, spread evenly and made a mapping; pixels blend the mappings of the tiles around them."""
    height, width = g.shape
    th, tw = -(-height // tiles), -(-width // tiles)
    wide = np.pad(g, ((0, th * tiles - height), (0, tw * tiles - width)), mode="reflect" if min(height, width) > max(th, tw) else "edge")
    maps = np.zeros((tiles, tiles, 256))
    for r in range(tiles):
        for c in range(tiles):
            counts = np.bincount(wide[r * th : (r + 1) * th, c * tw : (c + 1) * tw].ravel(), minlength=256).astype(float)
            most = max(limit * th * tw / 256, 1)
            over = np.maximum(counts - most, 0).sum()
            maps[r, c] = np.cumsum(np.minimum(counts, most) + over / 256) * 255 / (th * tw)
    y, x = (np.arange(height) + 0.5) / th - 0.5, (np.arange(width) + 0.5) / tw - 0.5
    r, c = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - r)[:, None], (x - c)[None, :]
    at = lambda dr, dc: maps[np.clip(r + dr, 0, tiles - 1)[:, None], np.clip(c + dc, 0, tiles - 1)[None, :], g]
    mixed = (1 - fy) * ((1 - fx) * at(0, 0) + fx * at(0, 1)) + fy * ((1 - fx) * at(1, 0) + fx * at(1, 1))
    return np.clip(np.rint(mixed), 0, 255).astype(np.uint8)


def otsu(g: np.ndarray) -> int:
    """The level that parts dark from light with the largest variance between them."""
    counts = np.bincount(g.ravel(), minlength=256).astype(float)
    below, mass = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.nanargmax(np.where(np.isfinite(spread), spread, -1)))


def prepared(image: np.ndarray, least: int = 1500) -> np.ndarray:
    """An image for a recogniser: enlarged, then sharpened if it is a screenshot, else equalised, binarised and cleaned of specks."""
    big = upscaled(image, least)
    g = np.rint(gray(big)).astype(np.uint8)
    if is_screenshot(big):
        wide = np.pad(g.astype(float), 1, mode="reflect")
        sharp = 3 * wide[1:-1, 1:-1] - 0.5 * (wide[:-2, 1:-1] + wide[2:, 1:-1] + wide[1:-1, :-2] + wide[1:-1, 2:])
        return np.clip(np.rint(sharp), 0, 255).astype(np.uint8)
    even = equalised(g)
    light = even > otsu(even)
    worn = np.pad(light, ((1, 0), (1, 0)), constant_values=True)
    worn = worn[1:, 1:] & worn[:-1, 1:] & worn[1:, :-1] & worn[:-1, :-1]
    grown = np.pad(worn, ((0, 1), (0, 1)), constant_values=False)
    return (grown[:-1, :-1] | grown[1:, :-1] | grown[:-1, 1:] | grown[1:, 1:]).astype(np.uint8) * 255


def perceptual_hash(image: np.ndarray) -> int:
    """64 bits: low frequencies of a 32 x 32 cosine transform above their median."""
    g = gray(image)
    ys, xs = (np.linspace(0, n, 33).astype(int) for n in g.shape)
    small = np.array([[g[ys[i] : max(ys[i + 1], ys[i] + 1), xs[j] : max(xs[j + 1], xs[j] + 1)].mean() for j in range(32)] for i in range(32)])
    k = np.arange(32)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64)
    low = (basis @ small @ basis.T)[:8, :8].ravel()
    return int("".join("1" if b else "0" for b in low > np.median(low)), 2)


def header_kind(image: np.ndarray, cells: list[dict[str, int]]) -> str:
    """The document type by the mean colour (blue, green, red) of the first header cells: dark blue, light blue or neither.  Fixed values."""
    first = [c for c in cells if c["row"] == 0][:5]
    parts = [image[c["y_min"] + 2 : max(c["y_max"] - 2, 0), c["x_min"] + 2 : max(c["x_max"] - 2, 0)] for c in first]
    parts = [p.reshape(-1, 3).mean(0) for p in parts if p.size] if image.ndim == 3 else []
    if not parts:
        return "default"
    blue, green, red = np.mean(parts, axis=0).astype(int)
    if blue > 80 and red < 30 and green < 50:
        return "demand_forecast"
    return "financial_statement" if blue > 200 and green > 200 and red > 180 else "default"


def split_wide(image: np.ndarray, most: int = 1800, overlap: float = 0.15) -> list[np.ndarray]:
    """Halves of a wide image that overlap in the middle."""
    width = image.shape[1]
    if width <= most:
        return [image]
    mid, extra = width // 2, int(width * overlap / 2)
    return [image[:, : mid + extra], image[:, mid - extra :]]
