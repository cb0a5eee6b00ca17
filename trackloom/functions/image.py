"""Preparing a frame for text detection, in NumPy: small helpers of the detector's task."""

from __future__ import annotations

import numpy as np

#: Weights of blue, green and red in grey; the cubic kernel's constant; side and offset of the local threshold.
GREY, CUBIC, SIDE, OFFSET = (0.114, 0.587, 0.299), -0.75, 11, 2
#: Fixed values of the denoising: strength, sides of a patch and of the square that is searched, and the weight below which a pixel doesn't count.
STRENGTH, PATCH, AROUND, LEAST = 10.0, 7, 21, 0.001


def grey(frame: np.ndarray) -> np.ndarray:
    """(height, width, 3), blue first, to (height, width); any other shape is a ValueError."""
    if frame.ndim != 3 or frame.shape[2] != 3:
        raise ValueError(f"a frame has the shape (height, width, 3), not {frame.shape}")
    return np.clip(np.rint(frame.astype(float) @ np.array(GREY)), 0, 255).astype(np.uint8)


def _resample(image: np.ndarray, size: int, axis: int) -> np.ndarray:
    n = image.shape[axis]
    at = (np.arange(size) + 0.5) * n / size - 0.5
    low, out = np.floor(at).astype(int), 0.0
    for k in range(-1, 3):
        d = np.abs(at - (low + k))
        w = np.where(d <= 1, (CUBIC + 2) * d**3 - (CUBIC + 3) * d**2 + 1, CUBIC * (d**3 - 5 * d**2 + 8 * d - 4))
        part = np.take(image, np.clip(low + k, 0, n - 1), axis=axis)
        out = out + part * (w if axis else w[:, None])
    return out


def upscale(image: np.ndarray, scale: float) -> np.ndarray:
    """Cubic interpolation to scale times the size, rounded down."""
    height, width = (int(n * scale) for n in image.shape)
    return np.clip(np.rint(_resample(_resample(image.astype(float), width, 1), height, 0)), 0, 255).astype(np.uint8)


def otsu(image: np.ndarray) -> int:
    """The threshold with the greatest variance between what is above it and the rest; the least one of equals."""
    n = np.bincount(image.ravel(), minlength=256).astype(float)
    below, total = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (total / below - (total[-1] - total) / above) ** 2
    return int(np.argmax(np.nan_to_num(between, nan=-1.0)))


def adaptive(image: np.ndarray) -> np.ndarray:
    """255 where a pixel is over its Gaussian neighbourhood's mean less OFFSET, else 0."""
    sigma, r = 0.3 * ((SIDE - 1) * 0.5 - 1) + 0.8, SIDE // 2
    w = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    w /= w.sum()
    mean = image.astype(float)
    for axis in (0, 1):
        padded = np.pad(mean, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        mean = sum(x * np.take(padded, np.arange(i, i + image.shape[axis]), axis=axis) for i, x in enumerate(w))
    return np.where(image > np.rint(mean) - OFFSET, 255, 0).astype(np.uint8)


def denoise(image: np.ndarray, strength: float = STRENGTH) -> np.ndarray:
    """Non-local means: each pixel is the mean of those around it, weighted by how alike the patches around both are.

    For each shift of the picture against itself, squared differences are added up over all patches at once by an
    integral image, so the work is pixels times shifts, whatever the patch's size. Edges are mirrored.
    """
    height, width = image.shape
    r, p = AROUND // 2, PATCH // 2
    whole = np.pad(image.astype(float), r + p, mode="reflect")
    inner = whole[r : r + height + 2 * p, r : r + width + 2 * p]
    total, weights = np.zeros((height, width)), np.zeros((height, width))
    for dy in range(2 * r + 1):
        for dx in range(2 * r + 1):
            other = whole[dy : dy + height + 2 * p, dx : dx + width + 2 * p]
            sums = np.pad(((inner - other) ** 2).cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
            alike = (sums[PATCH:, PATCH:] - sums[:-PATCH, PATCH:] - sums[PATCH:, :-PATCH] + sums[:-PATCH, :-PATCH]) / PATCH**2
            w = np.exp(-alike / strength**2)
            w[w < LEAST] = 0
            total += w * other[p : p + height, p : p + width]
            weights += w
    return np.clip(np.rint(total / weights), 0, 255).astype(np.uint8)


def prepare(frame: np.ndarray, threshold: bool = True, method: str = "otsu", scale: float = 1.0, denoised: bool = False) -> np.ndarray:
    image = grey(frame)
    if scale != 1:
        image = upscale(image, scale)
    if denoised:
        image = denoise(image)
    if not threshold:
        return image
    return adaptive(image) if method == "adaptive" else np.where(image > otsu(image), 255, 0).astype(np.uint8)
