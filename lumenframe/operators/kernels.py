"""Pixel kernels on numpy arrays of shape (height, width, channels), uint8 in BGR order.

They follow published definitions (Keys cubic convolution with a = -0.75 and
replicated borders, ITU-R 601 luma, Zuiderveld's contrast-limited adaptive
equalisation); bit-exact agreement with other libraries is not claimed. Results
are rounded to millionths before they become whole numbers, so that ties don't hang
on the last bit of a sum.
"""

from __future__ import annotations

import numpy as np

#: Luma weights of blue, green and red, and the cubic kernel's parameter.
LUMA = (0.114, 0.587, 0.299)
CUBIC_A = -0.75


def to_array(image: dict) -> np.ndarray:
    """An image struct as an array."""
    shape = (image["height"], image["width"], image["n_channels"])
    return np.frombuffer(image["data"], np.uint8).reshape(shape)


def to_image(array: np.ndarray) -> dict:
    array = array[:, :, None] if array.ndim == 2 else array
    h, w, c = array.shape
    return {"height": h, "width": w, "n_channels": c, "data": np.ascontiguousarray(array, np.uint8).tobytes()}


def crop(array: np.ndarray, box) -> np.ndarray:
    """Half-open crop; corners beyond the image are clipped."""
    x1, y1, x2, y2 = (max(0, int(v)) for v in box)
    return array[y1:y2, x1:x2]


def _whole(values: np.ndarray) -> np.ndarray:
    """The nearest whole numbers from 0 to 255; halves go up."""
    return np.clip(np.floor(np.round(values, 6) + 0.5), 0, 255).astype(np.uint8)


def gray(array: np.ndarray) -> np.ndarray:
    return _whole(array[:, :, :3] @ np.array(LUMA))


def to_bgr(plane: np.ndarray) -> np.ndarray:
    return np.repeat(plane[:, :, None], 3, axis=2)


def _cubic_matrix(source: int, target: int) -> np.ndarray:
    """Rows of weights that resample ``source`` points to ``target`` with half-pixel centres."""
    at = (np.arange(target) + 0.5) * source / target - 0.5
    base = np.floor(at).astype(int)
    out = np.zeros((target, source))
    for k in range(-1, 3):
        d = np.abs(at - (base + k))
        near = (CUBIC_A + 2) * d**3 - (CUBIC_A + 3) * d**2 + 1
        far = CUBIC_A * (d**3 - 5 * d**2 + 8 * d - 4)
        weight = np.where(d <= 1, near, np.where(d < 2, far, 0.0))
        np.add.at(out, (np.arange(target), np.clip(base + k, 0, source - 1)), weight)
    return out


def resize(array: np.ndarray, width: int, height: int) -> np.ndarray:
    """Separable bicubic resize."""
    rows, columns = _cubic_matrix(array.shape[0], height), _cubic_matrix(array.shape[1], width)
    out = np.einsum("yi,ij...->yj...", rows, array.astype(float), optimize=True)
    out = np.einsum("xj,yj...->yx...", columns, out, optimize=True)
    return _whole(out)


def clahe(plane: np.ndarray, clip_limit: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation of a gray plane."""
    h, w = plane.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    padded = np.pad(plane, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect" if min(h, w) > max(th, tw) else "edge")
    pixels = th * tw
    most = max(int(clip_limit * pixels / 256), 1)
    maps = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            counts = np.bincount(padded[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            excess = int(np.maximum(counts - most, 0).sum())
            counts = np.minimum(counts, most) + excess // 256
            if rest := excess % 256:
                counts[:: max(256 // rest, 1)][:rest] += 1
            maps[i, j] = np.clip(np.floor(np.cumsum(counts) * 255.0 / pixels + 0.5), 0, 255)
    y, x = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    at = lambda a, b: maps[np.clip(a, 0, tiles - 1)[:, None], np.clip(b, 0, tiles - 1)[None, :], plane]
    top = at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx
    low = at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx
    return _whole(top * (1 - fy) + low * fy)


def enhance(array: np.ndarray, width: int, height: int, clip_limit: float, tiles: int) -> np.ndarray:
    """Resize, gray, equalise and back to three channels, in this order."""
    if (height, width) != array.shape[:2]:
        array = resize(array, width, height)
    return to_bgr(clahe(gray(array), clip_limit, tiles))


def draw_box(array: np.ndarray, box, colour=(0, 255, 0), thickness: int = 2) -> np.ndarray:
    """A copy with the outline of a box, clipped to the image."""
    out = np.array(array, copy=True)
    x1, y1, x2, y2 = (int(v) for v in box)
    h, w = out.shape[:2]
    xs, ys = slice(max(0, x1), max(0, min(w, x2))), slice(max(0, y1), max(0, min(h, y2)))
    for t in range(thickness):
        for y in (y1 + t, y2 - 1 - t):
            if 0 <= y < h:
                out[y, xs] = colour
        for x in (x1 + t, x2 - 1 - t):
            if 0 <= x < w:
                out[ys, x] = colour
    return out
