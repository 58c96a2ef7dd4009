"""Pages as grey pixels (rows of 0 to 255, dark ink on light paper): statistics and clean-up before text is recognised.

Plain numpy over one page at a time; ``sources.images`` applies it to a table of pages.
"""

from __future__ import annotations

import numpy as np

# Sizes, angles and bounds of the clean-up.
TARGET_SIDE, MOST_SIDE, MOST_ENLARGED, LEAST_ENLARGED = 3000, 5000, 3.0, 1.05
MOST_SKEW, LEAST_SKEW, COARSE, FINE, SKEW_SIDE = 8.0, 0.3, 0.5, 0.1, 1200
GLYPH_HEIGHT, GLYPH_AREA, GLYPH_FLATNESS = (8, 300), 20, 3
UNEVEN_LIGHT, LIGHT_WINDOW, LOCAL_WINDOW, LOCAL_OFFSET = 60, 31, 41, 15
LUMA = np.array([299, 587, 114]) / 1000


def grey(pixels: np.ndarray) -> np.ndarray:
    """Grey values of (height, width[, channels]) pixels; what is transparent shows white paper. Channels: grey, grey and
    opacity, three colours, or three colours and opacity."""
    if pixels.ndim == 2:
        return pixels
    colours, opacity = (pixels, None) if pixels.shape[2] in (1, 3) else (pixels[..., :-1], pixels[..., -1:] / 255.0)
    value = colours.astype(float)
    if opacity is not None:
        value = value * opacity + 255.0 * (1 - opacity)
    return np.rint(value @ LUMA if value.shape[2] == 3 else value[..., 0]).astype(np.uint8)


def _along_rows(page: np.ndarray, size: int) -> np.ndarray:
    """The first axis resampled: means of what a new row covers, or a line between the nearest two if there are more rows."""
    old = len(page)
    if size < old:
        edges = np.linspace(0, old, size + 1)
        total = np.concatenate([np.zeros((1, page.shape[1])), np.cumsum(page, 0)])
        low = edges.astype(int)
        at_edge = total[low] + (edges - low)[:, None] * page[np.minimum(low, old - 1)]
        return np.diff(at_edge, axis=0) / (old / size)
    place = np.clip((np.arange(size) + 0.5) * old / size - 0.5, 0, old - 1)
    low = place.astype(int)
    part = (place - low)[:, None]
    return page[low] * (1 - part) + page[np.minimum(low + 1, old - 1)] * part


def resized(page: np.ndarray, factor: float) -> np.ndarray:
    height, width = (max(1, round(n * factor)) for n in page.shape)
    return np.clip(np.rint(_along_rows(_along_rows(page.astype(float), height).T, width).T), 0, 255).astype(np.uint8)


def rescaled(page: np.ndarray) -> np.ndarray:
    """Small pages enlarged, up to three times, and huge ones reduced."""
    side = max(page.shape)
    factor = min(TARGET_SIDE / side, MOST_ENLARGED) if side < TARGET_SIDE else min(1.0, MOST_SIDE / side)
    return page if 1 <= factor <= LEAST_ENLARGED else resized(page, factor)


def _windows(page: np.ndarray, size: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(np.pad(page, size // 2, mode="edge"), (size, size))


def denoised(page: np.ndarray) -> np.ndarray:
    """The median of each pixel and its eight neighbours."""
    padded = np.pad(page, 1, mode="edge")
    near = np.stack([padded[y : y + page.shape[0], x : x + page.shape[1]] for y in range(3) for x in range(3)])
    return np.partition(near, 4, axis=0)[4]


def ink_bound(page: np.ndarray) -> int:
    """The grey value up to which pixels are ink: the two sides' means lie as far apart as they can, weighed by their sizes."""
    counts = np.bincount(page.ravel(), minlength=256).astype(float)
    below, sums = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (sums / below - (sums[-1] - sums) / above) ** 2
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def ink(page: np.ndarray) -> np.ndarray:
    return page <= ink_bound(page) if page.size and page.min() < page.max() else np.zeros(page.shape, bool)


def runs(dark: np.ndarray) -> np.ndarray:
    """Horizontal runs of dark pixels in reading order: row, first column, column after the last."""
    step = np.diff(np.pad(dark, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(step == 1)
    return np.stack([row, first, np.nonzero(step == -1)[1]], 1)


def glyph_height(dark: np.ndarray) -> float:
    """The median height of connected shapes with the size of a letter, 0 without any. Corners connect."""
    found = runs(dark)
    if not len(found):
        return 0.0
    row, first, last = found.T
    wide = dark.shape[1] + 2
    # a run touches the runs of the next row that end at its first column or later and begin at its last or before
    a = np.searchsorted(row * wide + last, (row + 1) * wide + first)
    b = np.searchsorted(row * wide + first, (row + 1) * wide + last, "right")
    touching = np.maximum(b - a, 0)
    upper = np.repeat(np.arange(len(found)), touching)
    lower = np.repeat(a - np.cumsum(touching) + touching, touching) + np.arange(touching.sum())
    label = np.arange(len(found))
    while True:  # the least label spreads; jumps to the label's own label make this take few rounds
        old = label.copy()
        least = np.minimum(label[upper], label[lower])
        np.minimum.at(label, label[upper], least)
        np.minimum.at(label, label[lower], least)
        np.minimum.at(label, upper, least)
        np.minimum.at(label, lower, least)
        label = label[label]
        if (label == old).all():
            break
    _, shape = np.unique(label, return_inverse=True)
    n = shape.max() + 1
    top, bottom, left, right = np.full(n, dark.shape[0]), np.zeros(n, int), np.full(n, wide), np.zeros(n, int)
    np.minimum.at(top, shape, row)
    np.maximum.at(bottom, shape, row + 1)
    np.minimum.at(left, shape, first)
    np.maximum.at(right, shape, last)
    height, area = bottom - top, np.bincount(shape, last - first)
    letters = (height >= GLYPH_HEIGHT[0]) & (height <= GLYPH_HEIGHT[1]) & (area >= GLYPH_AREA) & (right - left <= GLYPH_FLATNESS * height)
    return float(np.median(height[letters])) if letters.any() else 0.0


def _long_runs(dark: np.ndarray, least: int) -> np.ndarray:
    found = runs(dark)
    found = found[found[:, 2] - found[:, 1] >= least]
    change = np.zeros((dark.shape[0], dark.shape[1] + 1), np.int32)
    np.add.at(change, (found[:, 0], found[:, 1]), 1)
    np.add.at(change, (found[:, 0], found[:, 2]), -1)
    return np.cumsum(change, 1)[:, :-1] > 0


def without_lines(page: np.ndarray) -> np.ndarray:
    """Ruling lines, far longer than any stroke of the page's letters, turned into paper."""
    dark = ink(page)
    least = int(4 * glyph_height(dark))
    lines = _long_runs(dark, max(40, page.shape[1] // 25, least)) | _long_runs(dark.T, max(40, page.shape[0] // 40, least)).T
    return np.where(_windows(lines, 3).any((2, 3)), np.uint8(255), page) if lines.any() else page


def skew(page: np.ndarray) -> float:
    """Degrees by which the page's lines of text fall to the right (negative: rise): turned back by it, ink gathers in the
    fewest rows. Looked for in steps of half a degree, then of a tenth."""
    side = max(page.shape, default=0)
    y, x = np.nonzero(ink(resized(page, SKEW_SIDE / side) if side > SKEW_SIDE else page))
    if not len(y):
        return 0.0
    reach = int(np.hypot(y.max(), x.max())) + 2

    def gathered(tenths: int) -> float:
        angle = np.deg2rad(tenths / 10)
        rows = np.bincount(np.rint(y * np.cos(angle) - x * np.sin(angle)).astype(int) + reach, minlength=2 * reach)
        return float((rows.astype(float) ** 2).sum())

    most, coarse = round(MOST_SKEW * 10), round(COARSE * 10)
    best = max(range(-most, most + 1, coarse), key=lambda t: (gathered(t), -abs(t)))
    return max(range(best - coarse, best + coarse + 1, round(FINE * 10)), key=lambda t: (gathered(t), -abs(t))) / 10


def deskewed(page: np.ndarray) -> np.ndarray:
    """Turned so that lines of text are level; level pages and those at the end of the search stay."""
    degrees = skew(page)
    if not LEAST_SKEW <= abs(degrees) < MOST_SKEW:
        return page
    angle, (height, width) = np.deg2rad(degrees), page.shape
    dy, dx = np.arange(height)[:, None] - height / 2, np.arange(width)[None, :] - width / 2
    y = np.clip(dy * np.cos(angle) + dx * np.sin(angle) + height / 2, 0, height - 1)
    x = np.clip(dx * np.cos(angle) - dy * np.sin(angle) + width / 2, 0, width - 1)
    top, left = y.astype(int), x.astype(int)
    low, right = np.minimum(top + 1, height - 1), np.minimum(left + 1, width - 1)
    py, px = y - top, x - left
    value = (page[top, left] * (1 - px) + page[top, right] * px) * (1 - py) + (page[low, left] * (1 - px) + page[low, right] * px) * py
    return np.rint(value).astype(np.uint8)


def _blurred(page: np.ndarray, size: int) -> np.ndarray:
    spread = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    weights = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * spread**2))
    out = page.astype(float)
    for _ in range(2):  # along one axis, then the other
        padded = np.pad(out, ((size // 2, size // 2), (0, 0)), mode="edge")
        out = sum(w * padded[k : k + len(out)] for k, w in enumerate(weights / weights.sum())).T
    return out


def light_spread(page: np.ndarray) -> float:
    """How far apart dark and bright paper are: percentiles 5 and 95 of local medians (taken at every eighth pixel)."""
    paper = page if min(page.shape) <= LIGHT_WINDOW else np.median(_windows(page, LIGHT_WINDOW)[::8, ::8], axis=(2, 3))
    low, high = np.percentile(paper, [5, 95])
    return float(high - low)


def binarized(page: np.ndarray) -> np.ndarray:
    """Black and white: one bound for an evenly lit page, bounds by neighbourhood for others."""
    soft = np.rint(_blurred(page, 3)).astype(np.uint8)
    if light_spread(page) > UNEVEN_LIGHT:
        dark = soft <= _blurred(soft, LOCAL_WINDOW) - LOCAL_OFFSET
    else:
        dark = ink(soft)
    return np.where(dark, np.uint8(0), np.uint8(255))


def light(page: np.ndarray) -> np.ndarray:
    return without_lines(deskewed(denoised(rescaled(grey(page)))))


def binary(page: np.ndarray) -> np.ndarray:
    return binarized(light(page))


PIPELINES = {"light": light, "binary": binary, "none": grey}
