"""NumPy kernels on stacks of equal-sized frames: arrays of shape (frames, height, width, channels).

A neighbourhood of odd size K is defined where it lies inside the frame; elsewhere the output holds the border value.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view


def odd(k: int) -> int:
    return int(k) | 1


def framed(inner: np.ndarray, like: np.ndarray, h: int, border: float) -> np.ndarray:
    """inner, put h pixels inside a frame of `border`."""
    out = np.full(like.shape, border, float)
    if inner.size:
        out[:, h : h + inner.shape[1], h : h + inner.shape[2]] = inner
    return out


def _slide(s: np.ndarray, k: int, axis: int) -> np.ndarray:
    """Windows of k along an axis, on a new last axis; empty if the frame is smaller."""
    if s.shape[axis] < k:
        shape = list(s.shape)
        shape[axis] = 0
        return np.empty((*shape, k))
    return sliding_window_view(s, k, axis=axis)


def integral(s: np.ndarray) -> np.ndarray:
    return s.cumsum(axis=2).cumsum(axis=1)


def box(s: np.ndarray, k: int, mode: str = "mean", border: float = 0.0) -> np.ndarray:
    """mean: exact; direct: whole division after each pass; integral: the mean rounded half up."""
    k = odd(k)
    rows = _slide(s, k, 2).sum(-1)
    if mode == "direct":
        inner = np.floor_divide(_slide(np.floor_divide(rows, k), k, 1).sum(-1), k)
    else:
        inner = _slide(rows, k, 1).sum(-1) / (k * k)
        if mode == "integral":
            inner = np.floor(inner + 0.5)
    return framed(inner, s, k >> 1, border)


def box_sigma(k: int) -> float:
    return ((k * k - 1) / 12) ** 0.5


def gauss_kernel(radius: float, k: int) -> np.ndarray:
    x = np.arange(k) - (k - 1) / 2
    weights = np.exp(-(x**2) / (2 * (radius / 2) ** 2))
    return weights / weights.sum()


def gauss(s: np.ndarray, radius: float, k: int, whole: bool = False, border: float = 0.0) -> np.ndarray:
    """Separable; whole rounds half up after each pass."""
    k = odd(k)
    w = gauss_kernel(radius, k)
    once = _slide(s, k, 2) @ w
    if whole:
        once = np.floor(once + 0.5)
    inner = _slide(once, k, 1) @ w
    if whole:
        inner = np.floor(inner + 0.5)
    return framed(inner, s, k >> 1, border)


def gauss_approx(s: np.ndarray, k: int, n: int, border: float = 0.0) -> np.ndarray:
    for _ in range(n):
        s = box(s, k, "mean", border)
    return s


def gradients(s: np.ndarray, border: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Scharr dx and dy with weights 3, 10, 3 over 32."""
    if min(s.shape[1:3]) < 3:
        return np.full(s.shape, border), np.full(s.shape, border)
    across = s[:, :, 2:] - s[:, :, :-2]
    down = s[:, 2:] - s[:, :-2]
    dx = (3 * across[:, :-2] + 10 * across[:, 1:-1] + 3 * across[:, 2:]) / 32
    dy = (3 * down[:, :, :-2] + 10 * down[:, :, 1:-1] + 3 * down[:, :, 2:]) / 32
    return framed(dx, s, 1, border), framed(dy, s, 1, border)


def edge_detect(s: np.ndarray, d: int = 1, border: float = 0.0) -> np.ndarray:
    h, w = s.shape[1:3]
    if min(h, w) <= 2 * d:
        return np.full(s.shape, border)
    at = lambda dy, dx: s[:, d + dy : h - d + dy, d + dx : w - d + dx]
    sides = at(-d, 0) + at(d, 0) + at(0, -d) + at(0, d)
    corners = at(-d, -d) + at(-d, d) + at(d, -d) + at(d, d)
    return framed(12 * at(0, 0) - 2 * sides - corners, s, d, border)


def laplacian(s: np.ndarray) -> np.ndarray:
    """3 x 3 aperture (2, 0, 2 / 0, -8, 0 / 2, 0, 2) with mirrored borders, the edge pixel itself not repeated."""
    p = np.pad(s, ((0, 0), (1, 1), (1, 1), (0, 0)), mode="reflect" if min(s.shape[1:3]) > 1 else "edge")
    return 2 * (p[:, :-2, :-2] + p[:, :-2, 2:] + p[:, 2:, :-2] + p[:, 2:, 2:]) - 8 * s


def extreme(s: np.ndarray, k: int, greatest: bool, border: float = 0.0) -> np.ndarray:
    """Dilation (greatest) or erosion over odd k x k."""
    k = odd(k)
    pick = np.max if greatest else np.min
    rows, h = _slide(s, k, 2), k >> 1
    if not rows.size:
        return np.full(s.shape, border, float)
    columns = _slide(pick(rows, axis=-1), k, 1)
    return framed(pick(columns, axis=-1), s, h, border) if columns.size else np.full(s.shape, border, float)


def median_quadrant(s: np.ndarray, f: int) -> np.ndarray:
    """Greatest of the least values of the four f x f windows that have the pixel in a corner; f - 1 border pixels are 0."""
    h, w = s.shape[1:3]
    out = np.zeros(s.shape)
    b = f - 1
    if min(h, w) <= 2 * b:
        return out
    least = _slide(_slide(s, f, 2).min(-1), f, 1).min(-1)  # by the window's first pixel
    at = lambda dy, dx: least[:, b + dy : h - b + dy, b + dx : w - b + dx]
    out[:, b : h - b, b : w - b] = np.maximum(np.maximum(at(-b, -b), at(-b, 0)), np.maximum(at(0, -b), at(0, 0)))
    return out


def morphology(s: np.ndarray, passes: list[str], k: int, threshold: float, most: float) -> np.ndarray:
    source = s
    steps = {
        "ERODE": lambda x: extreme(x, k, False),
        "DILATE": lambda x: extreme(x, k, True),
        "SOURCE_MINUS": lambda x: np.abs(source - x),
        "MINUS_SOURCE": lambda x: np.abs(x - source),
        "THRESHOLD": lambda x: np.where(x >= threshold, most, 0.0),
    }
    for name in passes:
        s = steps[name](s)
    return s


def unsharp(s: np.ndarray, gain: float, radius: float) -> np.ndarray:
    k = int(np.ceil(2 * radius + 0.5) + 0.5) * 2 - 1
    blurred, h = gauss(s, radius, k), odd(k) >> 1
    out = s.astype(float).copy()
    inner = np.s_[:, h : s.shape[1] - h, h : s.shape[2] - h]
    if min(s.shape[1:3]) > 2 * h:
        out[inner] = (s[inner] - blurred[inner]) * gain + s[inner]
    return out


def adaptive_threshold(s: np.ndarray, k: int, n: int, offset: float, whole: bool, most: float, noise_k: int = 7) -> np.ndarray:
    """Noise-filtered frame less offset above the wider reference: most, else 0; the border is never set."""
    mode = "integral" if whole else "mean"
    fine, wide = s, s
    for _ in range(n):
        fine, wide = box(fine, noise_k, mode), box(wide, k, mode, border=most)
    return np.where(fine - (np.trunc(offset * 255.5) if whole else offset) > wide, most, 0.0)


def equalise_local(s: np.ndarray, target: np.ndarray | float, w: int) -> np.ndarray:
    mean = box(s, w)
    return np.divide(s * target, mean, out=np.zeros(s.shape), where=mean != 0)


def retinex(s: np.ndarray, g: int = 20, scales: int = 3, blur: str = "gauss") -> np.ndarray:
    """Multi-scale retinex of frames with values 0 to 1, frame by frame."""
    grey = s.mean(-1, keepdims=True)
    tiny = 1.0 / 4096
    out = np.empty(s.shape)
    n, h, w, c = s.shape
    for i in range(n):
        own = np.maximum(grey[i : i + 1], tiny)
        total = np.zeros(own.shape)
        for scale in range(scales):
            k = odd(int(w / (g * 2**scale)))
            smooth = _padded(own, k, lambda x, k=k: gauss(x, k / 2, k) if blur == "gauss" else gauss_approx(x, k, 1), 1 if blur == "gauss" else 3)
            r = 3 * (np.log10(own) - np.log10(np.maximum(smooth, tiny)))
            centre = r[:, h // 4 : h - h // 4, w // 4 : w - w // 4]
            counts, edges = np.histogram(np.clip(centre, -1, 1), 10_000, (-1, 1))
            drop = 1e-4 * counts.sum()
            up = int(np.searchsorted(np.cumsum(counts), drop, "right"))
            down = len(counts) - 1 - int(np.searchsorted(np.cumsum(counts[::-1]), drop, "right"))
            low, high = edges[min(up, down)], edges[max(up, down) + 1]
            total += (r - low) / (high - low)
        m = total / scales
        gain = m / (own + 2.5 / 255)
        out[i] = (own * gain if c == 1 else gain * s[i : i + 1] + 2.5 * (s[i : i + 1] - own))[0]
    return out


def _padded(s: np.ndarray, k: int, fn, times: int) -> np.ndarray:
    """fn with edges repeated, so that the whole frame is defined."""
    h = k >> 1
    for _ in range(times):
        wide = np.pad(s, ((0, 0), (h, h), (h, h), (0, 0)), mode="edge")
        s = fn(wide)[:, h : wide.shape[1] - h, h : wide.shape[2] - h]
    return s


def clahe(s: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited equalisation of u8 grey: a clipped CDF per tile, blended bilinearly between tile centres."""
    n, h, w, _ = s.shape
    ty, tx = min(tiles, h), min(tiles, w)
    ys, xs = np.linspace(0, h, ty + 1).astype(int), np.linspace(0, w, tx + 1).astype(int)
    out = np.empty(s.shape)
    cy, cx = (ys[:-1] + ys[1:] - 1) / 2, (xs[:-1] + xs[1:] - 1) / 2
    py, px = np.interp(np.arange(h), cy, np.arange(ty)), np.interp(np.arange(w), cx, np.arange(tx))
    y0, x0 = np.floor(py).astype(int), np.floor(px).astype(int)
    y1, x1 = np.minimum(y0 + 1, ty - 1), np.minimum(x0 + 1, tx - 1)
    fy, fx = (py - y0)[:, None], (px - x0)[None, :]
    for i in range(n):
        v = s[i, :, :, 0].astype(int)
        lut = np.empty((ty, tx, 256))
        for a in range(ty):
            for b in range(tx):
                tile = v[ys[a] : ys[a + 1], xs[b] : xs[b + 1]]
                counts = np.bincount(tile.ravel(), minlength=256).astype(float)
                most = max(1.0, clip * tile.size / 256)
                extra = np.maximum(counts - most, 0).sum()
                lut[a, b] = np.cumsum(np.minimum(counts, most) + extra / 256) * 255 / tile.size
        at = lambda a, b: lut[a[:, None], b[None, :], v]
        top = at(y0, x0) * (1 - fx) + at(y0, x1) * fx
        low = at(y1, x0) * (1 - fx) + at(y1, x1) * fx
        out[i, :, :, 0] = np.clip(np.floor(top * (1 - fy) + low * fy + 0.5), 0, 255)
    return out


def downsample_box(s: np.ndarray, f: int) -> np.ndarray:
    n, h, w, c = s.shape
    return s[:, : h // f * f, : w // f * f].reshape(n, h // f, f, w // f, f, c).mean((2, 4))


def downsample_gauss(s: np.ndarray, radius: float, k: int) -> np.ndarray:
    """Half size by an even separable kernel that starts at twice the output place; results stand K/4 further on."""
    k += k & 1
    weights, (n, h, w, c) = gauss_kernel(radius, k), s.shape
    out = np.zeros((n, h // 2, w // 2, c))
    if min(h, w) >= k:
        inner = _slide(_slide(s, k, 2)[:, :, ::2] @ weights, k, 1)[:, ::2] @ weights
        shift = k // 4
        inner = inner[:, : out.shape[1] - shift, : out.shape[2] - shift]
        out[:, shift : shift + inner.shape[1], shift : shift + inner.shape[2]] = inner
    return out


def bilinear(frame: np.ndarray, x: np.ndarray, y: np.ndarray, border: float = 0.0) -> np.ndarray:
    """Samples of one frame (height, width, channels) at fractional places; outside: border."""
    h, w = frame.shape[:2]
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]
    inside = (x >= 0) & (y >= 0) & (x <= w - 1) & (y <= h - 1)
    xa, ya = np.clip(x0, 0, w - 1), np.clip(y0, 0, h - 1)
    xb, yb = np.clip(x0 + 1, 0, w - 1), np.clip(y0 + 1, 0, h - 1)
    mixed = (frame[ya, xa] * (1 - fx) + frame[ya, xb] * fx) * (1 - fy) + (frame[yb, xa] * (1 - fx) + frame[yb, xb] * fx) * fy
    return np.where(inside[..., None], mixed, border)


def label_regions(same_right: np.ndarray, same_down: np.ndarray, diagonals: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Component numbers (height, width) from which neighbours hold together, by spreading the least number."""
    h, w = same_right.shape[0], same_down.shape[1]
    label = np.arange(h * w).reshape(h, w)
    while True:
        before = label.copy()
        for joined, a, b in _neighbour_slices(same_right, same_down, diagonals):
            low = np.where(joined, np.minimum(label[a], label[b]), -1)
            label[a] = np.where(joined, low, label[a])
            label[b] = np.where(joined, np.minimum(low, label[b]), label[b])
        label = label.ravel()[label]  # follow names that were renamed meanwhile
        if (label == before).all():
            return label


def _neighbour_slices(right, down, diagonals):
    yield right, np.s_[:, :-1], np.s_[:, 1:]
    yield down, np.s_[:-1, :], np.s_[1:, :]
    if diagonals:
        yield diagonals[0], np.s_[:-1, :-1], np.s_[1:, 1:]
        yield diagonals[1], np.s_[:-1, 1:], np.s_[1:, :-1]


def pulse_filter(frame: np.ndarray, p: int) -> np.ndarray:
    """Flat regions take the value of their nearest neighbour region, smallest regions first, up to sizes of p.

    A round takes the regions of the smallest size in order of their first pixel; each takes the value that its nearest neighbour has by
    then (of equally near ones the one whose first pixel is last), and regions of one value that touch become one. The
    round in which the smallest size reaches p is the last. Regions are the nodes of a graph with their neighbours, joined
    by union-find, and a queue by size; a round costs what its regions and their neighbours are.
    """
    flat = frame.astype(float).ravel()
    label = label_regions(frame[:, :-1] == frame[:, 1:], frame[:-1] == frame[1:])
    ids, node, size = np.unique(label.ravel(), return_inverse=True, return_counts=True)
    grid = node.reshape(frame.shape)
    pairs = np.concatenate([np.stack([grid[:, :-1].ravel(), grid[:, 1:].ravel()], 1), np.stack([grid[:-1].ravel(), grid[1:].ravel()], 1)])
    near: list[set[int]] = [set() for _ in ids]
    for x, y in pairs[pairs[:, 0] != pairs[:, 1]].tolist():
        near[x].add(y)
        near[y].add(x)
    value, size, first, head, live = flat[ids].tolist(), size.tolist(), list(range(len(ids))), list(range(len(ids))), len(ids)

    def find(k: int) -> int:
        while head[k] != k:
            head[k] = k = head[head[k]]
        return k

    queue = [(n, k) for k, n in enumerate(size)]
    heapify(queue)
    reached = 0
    while reached < p and live > 1:
        while head[queue[0][1]] != queue[0][1] or size[queue[0][1]] != queue[0][0]:
            heappop(queue)
        reached, group = queue[0][0], set()
        while queue and queue[0][0] == reached:
            n, k = heappop(queue)
            if head[k] == k and size[k] == n:
                group.add(k)
        ordered = sorted(group, key=first.__getitem__)
        for k in ordered:
            near[k] = {find(x) for x in near[k]} - {k}
            value[k] = value[min(near[k], key=lambda x: (abs(value[x] - value[k]), -first[x]))]  # noqa: B023 (used at once)
        for k in ordered:
            for x in list(near[k]) if head[k] == k else [find(x) for x in near[k]]:
                a, b = find(k), find(x)
                if a != b and value[a] == value[b]:
                    if len(near[a]) < len(near[b]):
                        a, b = b, a
                    head[b], live = a, live - 1
                    size[a], first[a] = size[a] + size[b], min(first[a], first[b])
                    near[a] |= near[b]
        for k in {find(k) for k in ordered}:
            heappush(queue, (size[k], k))
    return np.array([value[find(k)] for k in range(len(ids))])[node].reshape(frame.shape)


def counts(values: np.ndarray) -> list[np.ndarray]:
    """The histogram of whole parts of each row: 256 bins, or more if a value needs them; values under 0 count as 0."""
    return [np.bincount(v, minlength=256) for v in np.maximum(values, 0).astype(np.int64)]


def match_lut(n: np.ndarray, ref: np.ndarray | None = None) -> np.ndarray:
    """For each bin the first reference bin whose total passes what lies before the bin; ref: uniform by default."""
    total = n.sum()
    upto = np.floor(np.arange(1, 257) / 256.0 * total + 0.5) if ref is None else np.cumsum(ref)
    return np.minimum(255, np.searchsorted(upto, np.cumsum(n) - n, "right"))


def stretch_lut(n: np.ndarray, lo: float, hi: float) -> np.ndarray:
    share, bins = (np.cumsum(n) - n) / max(1, n.sum()), np.arange(256)
    a, z = (int(under[-1]) if len(under := np.flatnonzero(share < limit)) else default for limit, default in ((lo, 0), (hi, 255)))
    line = np.floor((bins - a) / float(max(1, z - a)) * 255)
    return np.where(bins < a, 0, np.where((bins > z) | (a == z), 255, line))


def cdf_lut(n: np.ndarray) -> np.ndarray:
    return np.floor(np.cumsum(n) * 255 / max(1, n.sum()))


def spread_lut(n: np.ndarray) -> np.ndarray:
    upto, total = np.cumsum(n), n.sum()
    least = upto[np.argmax(upto > 0)]
    if total == least:
        return np.arange(256)
    return np.maximum(0, np.floor((upto - least) * 255.0 / (total - least) + 0.5))
