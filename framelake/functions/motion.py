"""NumPy helpers for registration and dense flow; frames are single arrays (height, width)."""

from __future__ import annotations

import numpy as np

from . import stack

# Half of the symmetric 12-tap binomial kernel, over 2048.
BINOMIAL = (462, 330, 165, 55, 11, 1)
KERNEL = np.array([*BINOMIAL[::-1], *BINOMIAL]) / 2048.0


def pyramid(frame: np.ndarray, levels: int) -> list[np.ndarray]:
    """Half-sized levels; the three outer pixels of a level stay 0."""
    out = [frame]
    for _ in range(levels - 1):
        big = out[-1]
        h, w = big.shape[0] // 2, big.shape[1] // 2
        small = np.zeros((h, w))
        if min(h, w) > 6:
            taps = np.arange(12) - 5
            x = 2 * np.arange(3, w - 3)[:, None] + taps
            rows = big[:, x] @ KERNEL
            y = 2 * np.arange(3, h - 3)[:, None] + taps
            small[3 : h - 3, 3 : w - 3] = np.einsum("yto,t->yo", rows[y], KERNEL)
        out.append(small)
    return out


def levels_of(h: int, w: int) -> int:
    return max(1, int(np.log2(max(h, w))))


def cropped(frame: np.ndarray, levels: int) -> np.ndarray:
    """The centre part whose sides are multiples of 2**(levels - 1) (at least one such step)."""
    step = 1 << (levels - 1)
    h, w = max(frame.shape[0] // step, 1) * step, max(frame.shape[1] // step, 1) * step
    h, w = min(h, frame.shape[0]), min(w, frame.shape[1])
    y, x = (frame.shape[0] - h) // 2, (frame.shape[1] - w) // 2
    return frame[y : y + h, x : x + w]


def register(image: np.ndarray, ref: np.ndarray, pooled: bool = False, least: float = 1e-4) -> tuple[float, float]:
    """h with image(x) = ref(x + h): Lucas-Kanade from the coarsest level to level 1, seven steps each.

    A step is the mean of difference * gradient / |gradient|**2; pooled: the sum of products over the summed square.
    """
    levels = levels_of(*image.shape)
    images, refs = pyramid(cropped(image, levels), levels), pyramid(cropped(ref, levels), levels)
    hx = hy = 0.0
    for level in range(levels - 1, min(1, levels - 1) - 1, -1):
        if level < levels - 1:
            hx, hy = 2 * hx, 2 * hy
        img, old = images[level], refs[level]
        edge = 4 if level else 1  # beside the border that the pyramid leaves at 0 the gradients mean nothing
        if min(img.shape) < 2 * edge + 2:
            continue
        dx, dy = (g[0, :, :, 0] for g in stack.gradients(img[None, :, :, None]))
        square = dx * dx + dy * dy
        inner = np.zeros(img.shape, bool)
        inner[edge:-edge, edge:-edge] = square[edge:-edge, edge:-edge] > least
        y, x = np.nonzero(inner)
        for _ in range(7):
            ix, iy = int(np.floor(hx)), int(np.floor(hy))
            ok = (x + ix >= edge) & (y + iy >= edge) & (x + ix + 1 + edge <= img.shape[1] - 1) & (y + iy + 1 + edge <= img.shape[0] - 1)
            if not ok.any():
                break
            a, b = y[ok], x[ok]
            moved = stack.bilinear(old[:, :, None], b + hx, a + hy)[:, 0]
            diff = img[a, b] - moved
            if pooled:
                total = square[a, b].sum()
                hx, hy = hx + (diff * dx[a, b]).sum() / total, hy + (diff * dy[a, b]).sum() / total
            else:
                hx, hy = hx + (diff * dx[a, b] / square[a, b]).mean(), hy + (diff * dy[a, b] / square[a, b]).mean()
    scale = 2.0 if levels > 1 else 1.0
    return float(hx * scale), float(hy * scale)


def dense_flow(image: np.ndarray, ref: np.ndarray, levels: int = 5, steps: int = 7, least: float = 2.5e-4, most: float = 0.75) -> tuple[np.ndarray, np.ndarray]:
    """Per-pixel h with ref(x) = image(x + h), smoothed by a Gaussian after each step."""
    levels = max(1, min(levels, levels_of(*image.shape) - 2))
    images, refs = pyramid(image, levels), pyramid(ref, levels)
    fx = fy = np.zeros(images[-1].shape)
    smooth = lambda f: stack._padded(f[None, :, :, None], 11, lambda s: stack.gauss(s, 2.5, 11), 1)[0, :, :, 0]
    for level in range(levels - 1, -1, -1):
        img, goal = images[level], refs[level]
        h, w = img.shape
        if fx.shape != img.shape:
            y, x = np.mgrid[:h, :w]
            y, x = np.minimum(y // 2, fx.shape[0] - 1), np.minimum(x // 2, fx.shape[1] - 1)
            fx, fy = 2 * fx[y, x], 2 * fy[y, x]
        dx, dy = (g[0, :, :, 0] for g in stack.gradients(goal[None, :, :, None]))
        square = dx * dx + dy * dy
        y, x = np.mgrid[:h, :w]
        for _ in range(steps):
            ax, ay = np.clip(x + fx, 0, w - 1), np.clip(y + fy, 0, h - 1)
            diff = goal - stack.bilinear(img[:, :, None], ax, ay)[:, :, 0]
            step = np.divide(diff, square, out=np.zeros(square.shape), where=square > least)
            fx = smooth(fx + np.clip(step * dx, -most, most))
            fy = smooth(fy + np.clip(step * dy, -most, most))
    return fx, fy


def warp(frame: np.ndarray, fx: np.ndarray, fy: np.ndarray, border: float = 0.0) -> np.ndarray:
    y, x = np.mgrid[: frame.shape[0], : frame.shape[1]]
    return stack.bilinear(frame, x + fx, y + fy, border)
