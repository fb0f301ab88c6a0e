"""Operations on pixels: colours, histograms, contrast, crops, gutters, resampling, dithering."""

from __future__ import annotations

import numpy as np

# Luma weights (Rec. 601) and the JFIF colour transform.
LUMA = np.array([0.299, 0.587, 0.114])
JFIF = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])


def half_up(x: np.ndarray) -> np.ndarray:
    """Rounded half away from zero, inside a byte."""
    return np.clip(np.floor(np.abs(x) + 0.5) * np.sign(x), 0, 255).astype(np.uint8)


def gray(pixels: np.ndarray) -> np.ndarray:
    """Luma of an image; a gray one as it is."""
    return pixels if pixels.ndim == 2 else half_up(pixels.astype(np.float64) @ LUMA)


def to_ycc(pixels: np.ndarray) -> np.ndarray:
    """Luma and two chroma planes around 128."""
    out = pixels.astype(np.float64) @ JFIF.T
    out[..., 1:] += 128
    return half_up(out)


def from_ycc(ycc: np.ndarray) -> np.ndarray:
    """The colours of luma and chroma."""
    planes = ycc.astype(np.float64)
    planes[..., 1:] -= 128
    return half_up(planes @ np.linalg.inv(JFIF).T)


def histogram(plane: np.ndarray) -> np.ndarray:
    """Counts of the 256 values."""
    return np.bincount(plane.ravel(), minlength=256)


def trim_ends(counts: np.ndarray, cut: int) -> np.ndarray:
    """A histogram without ``cut`` samples at either end, the low end first."""
    out = counts.astype(np.int64).copy()
    for order in (slice(None), slice(None, None, -1)):
        side = out[order]
        taken = np.minimum(side, np.maximum(0, cut - (np.cumsum(side) - side)))
        out[order] = side - taken
    return out


def chroma_spread(pixels: np.ndarray, cut: float = 0.0) -> int:
    """Largest distance of a chroma value from gray, a share of the samples trimmed from either end."""
    ycc = to_ycc(pixels)
    worst = 0
    for plane in (ycc[..., 1], ycc[..., 2]):
        left = np.flatnonzero(trim_ends(histogram(plane), int(plane.size * cut)))
        if left.size:
            worst = max(worst, abs(int(left[0]) - 128), abs(int(left[-1]) - 128))
    return worst


def is_colour(pixels: np.ndarray, near: int = 22, far: int = 40, cut: float = 0.005) -> bool:
    """Whether an image has colour: none without chroma, surely with strong chroma, else by chroma beyond a few samples."""
    if pixels.ndim == 2:
        return False
    whole = chroma_spread(pixels)
    if whole <= near:
        return False
    return chroma_spread(pixels, cut) > (near if whole > far else far)


def stretch(plane: np.ndarray, low: int, high: int) -> np.ndarray:
    """Values from low to high spread over the whole byte, truncated; unchanged where there is nothing to spread."""
    if high <= low:
        return plane
    scale = 255.0 / (high - low)
    table = np.clip((np.arange(256) - low) * scale, 0, 255).astype(np.uint8)
    return table[plane]


def autocontrast(plane: np.ndarray, percent: float = 0.0) -> np.ndarray:
    """Stretched between the ends that a percentage of trimmed samples leaves."""
    left = np.flatnonzero(trim_ends(histogram(plane), int(plane.size * percent // 100)))
    return stretch(plane, int(left[0]), int(left[-1])) if left.size else plane


def gamma(plane: np.ndarray, power: float) -> np.ndarray:
    """Each value raised to a power of its share of 255."""
    return half_up(255.0 * (np.arange(256) / 255.0) ** power)[plane]


def black_point(plane: np.ndarray, dark: int = 64) -> int:
    """First value that is as frequent as the most frequent dark one."""
    counts = histogram(plane)
    return int(np.flatnonzero(counts == counts[:dark].max())[0])


def blur3(plane: np.ndarray) -> np.ndarray:
    """Mean of three along rows, then along columns, ends repeated, rounded up by thirds."""
    out = plane.astype(np.int32)
    for axis in (1, 0):
        padded = np.pad(out, [(1, 1) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        n = out.shape[axis]
        out = (padded.take(range(n), axis) + padded.take(range(1, n + 1), axis) + padded.take(range(2, n + 2), axis) + 1) // 3
    return out.astype(np.uint8)


def edges(plane: np.ndarray, above: int = 6) -> np.ndarray:
    """Mask (0 or 255) of a 3 x 3 Laplacian above a threshold; the outermost ring keeps the source values before it."""
    source = plane.astype(np.int32)
    out = source.copy()
    if min(plane.shape) > 2:
        around = sum(source[1 + dy : plane.shape[0] - 1 + dy, 1 + dx : plane.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1))
        out[1:-1, 1:-1] = np.clip(9 * source[1:-1, 1:-1] - around, 0, 255)
    return np.where(out > above, 255, 0).astype(np.uint8)


def box_of(mask: np.ndarray) -> tuple[int, int, int, int] | None:
    """Half-open box (left, top, right, bottom) of the true samples."""
    rows, columns = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    return (int(columns[0]), int(rows[0]), int(columns[-1]) + 1, int(rows[-1]) + 1) if rows.size else None


def border_vote(mask: np.ndarray, strip: int = 5) -> int:
    """Votes of the strips of rows and of columns of a mask of dark samples: positive for dark, negative for light."""
    total = 0
    for plane in (mask, mask.T):
        n = plane.shape[0]
        for start in range(0, n, strip):
            part = plane[max(0, n - strip) if start + strip > n else start :][:strip]
            total += part.size if part.all() else -part.size if not part.any() else 0
    return total


def background(pixels: np.ndarray, light: int = 128) -> str:
    """black or white, by the strips of the image; white on a tie."""
    return "black" if border_vote(gray(pixels) < light) > 0 else "white"


def empty_runs(mask: np.ndarray, axis: int) -> list[tuple[int, int]]:
    """Half-open runs of rows (axis 0) or columns (1) without a true sample."""
    empty = ~mask.any(1 - axis)
    steps = np.flatnonzero(np.diff(np.concatenate([[False], empty, [False]]).astype(np.int8)))
    return [(int(a), int(b)) for a, b in zip(steps[::2], steps[1::2])]


def without_gutters(pixels: np.ndarray, mask: np.ndarray, axis: int, keep: float = 0.04, least: int = 2) -> np.ndarray:
    """An image without its inner empty runs, of each of which a share stays as margin; runs at the ends stay."""
    n, drop = pixels.shape[axis], []
    for a, b in empty_runs(mask, axis):
        if a > 0 and b < n and b - a >= least:
            margin = keep / 2 * (b - a)
            drop.extend(range(int(a + margin), int(b - margin)))
    return np.delete(pixels, drop, axis)


def margin_box(pixels: np.ndarray, power: float = 1.0, share: float = 0.1) -> tuple[int, int, int, int]:
    """Crop box of what is darker than the background, at most a share off each side."""
    plane = gray(pixels)
    if background(pixels) == "black":
        plane = 255 - plane
    h, w = plane.shape
    found = box_of(blur3(plane) < 240 - 64 * power) or (0, 0, w, h)
    left, top = min(found[0], share * w), min(found[1], share * h)
    right, bottom = max(found[2], (1 - share) * w), max(found[3], (1 - share) * h)
    return tuple(int(np.rint(v)) for v in (left, top, right, bottom))


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


def _cubic(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0.0))


def _weights(n: int, m: int, kernel, reach: float) -> np.ndarray:
    scale = max(1.0, n / m)
    centres = (np.arange(m) + 0.5) * n / m - 0.5
    out = kernel((np.arange(n)[None, :] - centres[:, None]) / scale)
    out[np.abs(np.arange(n)[None, :] - centres[:, None]) > reach * scale] = 0
    return out / out.sum(1, keepdims=True)


def resize(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Resampled with Lanczos where it shrinks and a cubic where it doesn't."""
    h, w = pixels.shape[:2]
    kernel, reach = (_cubic, 2.0) if w <= width and h <= height else (_lanczos, 3.0)
    rows, columns = _weights(h, height, kernel, reach), _weights(w, width, kernel, reach)
    planes = pixels[..., None] if pixels.ndim == 2 else pixels
    out = np.stack([rows @ planes[..., k].astype(np.float64) @ columns.T for k in range(planes.shape[-1])], -1)
    return half_up(out[..., 0] if pixels.ndim == 2 else out)


def without_moire(plane: np.ndarray, angle: float = 10.0, low: float = 0.30, damp: float = 0.10) -> np.ndarray:
    """A plane whose high diagonal frequencies are damped."""
    spectrum = np.fft.fft2(plane.astype(np.float64))
    fy, fx = np.fft.fftfreq(plane.shape[0])[:, None], np.fft.fftfreq(plane.shape[1])[None, :]
    slant = np.degrees(np.arctan2(np.abs(fy), np.abs(fx)))
    spectrum[(np.hypot(fx, fy) >= low) & (np.abs(slant - 45) <= angle)] *= damp
    return half_up(np.fft.ifft2(spectrum).real)


def dither(plane: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Index of the nearest level of each sample, the error passed on to its neighbours (Floyd-Steinberg).

    A sample waits for those before it in its row and for those of the row above up to one beyond it, so
    all samples with the same x + 2y are done at once.
    """
    levels = np.asarray(levels, np.float64)
    h, w = plane.shape
    out = np.zeros((h, w), np.uint8)
    carried = np.pad(plane.astype(np.float64), ((0, 1), (1, 1)))
    for step in range(w + 2 * (h - 1)):
        y = np.arange(max(0, -(-(step - w + 1) // 2)), min(h, step // 2 + 1))
        x = step - 2 * y + 1
        value = carried[y, x]
        k = np.abs(levels[None, :] - value[:, None]).argmin(1)
        error = value - levels[k]
        out[y, x - 1] = k
        carried[y, x + 1] += error * 7 / 16
        carried[y + 1, x - 1] += error * 3 / 16
        carried[y + 1, x] += error * 5 / 16
        carried[y + 1, x + 1] += error / 16
    return out


def to_yuv(pixels: np.ndarray) -> np.ndarray:
    """Luma and the two colour differences, analogue scaling, as floats."""
    r, g, b = (pixels[..., k].astype(np.float64) for k in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return np.stack([y, (b - y) * 0.492, (r - y) * 0.877], axis=-1)


def from_yuv(yuv: np.ndarray) -> np.ndarray:
    """The image of a luma and its colour differences."""
    y, u, v = (yuv[..., k] for k in range(3))
    r, b = y + v / 0.877, y + u / 0.492
    return half_up(np.stack([r, (y - 0.299 * r - 0.114 * b) / 0.587, b], axis=-1))


def erase_moire(pixels: np.ndarray) -> np.ndarray:
    """An image whose luma has no high diagonal frequencies; its colours stay."""
    if pixels.ndim == 2:
        return without_moire(pixels)
    yuv = to_yuv(pixels)
    yuv[..., 0] = without_moire(half_up(yuv[..., 0]))
    return from_yuv(yuv)


def keep_tone_contrast(pixels: np.ndarray, least: int = 0) -> np.ndarray:
    """All channels stretched by the range of the luma; unchanged if that is less than ``least`` or nothing."""
    luma = pixels if pixels.ndim == 2 else gray(pixels)
    low, high = int(luma.min()), int(luma.max())
    return pixels if high - low < max(1, least) else stretch(pixels, low, high)


def raise_black(pixels: np.ndarray) -> np.ndarray:
    """Luma below the most common dark value raised to it."""
    if pixels.ndim == 2:
        return np.maximum(pixels, black_point(pixels)).astype(np.uint8)
    ycc = to_ycc(pixels)
    ycc[..., 0] = np.maximum(ycc[..., 0], black_point(ycc[..., 0]))
    return from_ycc(ycc)
