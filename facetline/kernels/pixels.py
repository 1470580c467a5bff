"""Painting boxes of RGBA frames (height x width x 4 arrays, changed in place)."""

from __future__ import annotations

import numpy as np

from facetline.kernels.redaction import Box, clip

BLACK = (0, 0, 0, 255)


def black(img: np.ndarray, b: Box) -> None:
    img[b[1] : b[3], b[0] : b[2]] = BLACK


def secure(img: np.ndarray, b: Box) -> None:
    """Filled with the mean colour of the ring of pixels around the box; black where the frame has none."""
    h, w = img.shape[:2]
    x1, y1, x2, y2 = max(b[0] - 1, 0), max(b[1] - 1, 0), min(b[2] + 1, w), min(b[3] + 1, h)
    ring = np.ones((y2 - y1, x2 - x1), bool)
    ring[b[1] - y1 : b[3] - y1, b[0] - x1 : b[2] - x1] = False
    if not ring.any():
        return black(img, b)
    mean = img[y1:y2, x1:x2][ring][:, :3].astype(np.int64).sum(0) // int(ring.sum())
    img[b[1] : b[3], b[0] : b[2]] = (*mean, 255)


def _blur_rows(a: np.ndarray, r: int) -> np.ndarray:
    """Means over windows of 2 r + 1 along axis 1, cut at the edges, in whole numbers."""
    n = a.shape[1]
    sums = np.concatenate([np.zeros_like(a[:, :1]), a.cumsum(1)], 1)
    lo, hi = np.maximum(np.arange(n) - r, 0), np.minimum(np.arange(n) + r + 1, n)
    return (sums[:, hi] - sums[:, lo]) // (hi - lo)[None, :, None]


def gauss(img: np.ndarray, b: Box, strength: int = 15) -> None:
    """A box blur, rows then columns, that looks at pixels of the box only."""
    r = max(1, strength)
    part = img[b[1] : b[3], b[0] : b[2], :3].astype(np.int64)
    part = _blur_rows(_blur_rows(part, r).transpose(1, 0, 2), r).transpose(1, 0, 2)
    img[b[1] : b[3], b[0] : b[2], :3] = part
    img[b[1] : b[3], b[0] : b[2], 3] = 255


def pixel(img: np.ndarray, b: Box, strength: int = 15) -> None:
    """Blocks in the colour of their top left pixel."""
    s = max(1, strength)
    part = img[b[1] : b[3], b[0] : b[2]]
    ys, xs = np.arange(part.shape[0]) // s * s, np.arange(part.shape[1]) // s * s
    img[b[1] : b[3], b[0] : b[2]] = part[ys][:, xs]


def paint(img: np.ndarray, boxes: list[Box], style: str = "pixel", strength: int = 15) -> np.ndarray:
    """Boxes in order, each clipped; a later one sees what earlier ones painted."""
    for box in boxes:
        b = clip(box, img.shape[1], img.shape[0])
        if b[2] > b[0] and b[3] > b[1]:
            if style == "black":
                black(img, b)
            elif style == "secure":
                secure(img, b)
            elif style == "gauss":
                gauss(img, b, strength)
            else:
                pixel(img, b, strength)
    return img
