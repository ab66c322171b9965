"""Object extraction: edge pixels, components, rectangles and detections."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stack
from ..functions.ordered import grouped, whole_groups
from .vector import per_stack, shapes, small_batches, stacked

BY = ["stream_id", "frame_no", "img_no"]


def edges(s: np.ndarray, border: bool = False) -> np.ndarray:
    """Nonzero pixels with a zero 4-neighbour; border: what lies outside counts as zero."""
    on = s[..., :1] != 0
    wide = np.pad(on, ((0, 0), (1, 1), (1, 1), (0, 0)), constant_values=not border)
    around = wide[:, :-2, 1:-1] & wide[:, 2:, 1:-1] & wide[:, 1:-1, :-2] & wide[:, 1:-1, 2:]
    return on & ~around


def edge_pixels(df: DataFrame, border: bool = False) -> DataFrame:
    """255 where a nonzero pixel has a zero neighbour, else 0."""
    return per_stack(df, lambda s: edges(s, border) * 255.0, "Y_8")


def components(df: DataFrame, border: bool = True) -> DataFrame:
    """RECTS of 8-connected groups of edge pixels: (key, rect_id, l, r, t, b); frames are independent."""
    small_batches(df)
    schema = df.select(*BY).schema.add("rect_id", "long").add("l", "integer").add("r", "integer").add("t", "integer").add("b", "integer")

    def run(batches):
        for batch in batches:
            found = []
            for shape, rows in shapes(batch).items():
                for i, e in zip(rows.tolist(), edges(stacked(batch.column("px"), rows, shape), border)[..., 0]):
                    found += [(i, *rect) for rect in rectangles(e)]
            columns = list(zip(*found)) or [[]] * 6
            picked = pa.array(columns[0], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(picked) for c in BY), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.int32()) for c in columns[2:])], names=schema.names)

    return df.mapInArrow(run, schema)


def rectangles(on: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(number, left, right, top, bottom) of each 8-connected group of set pixels."""
    if not on.any():
        return []
    label = stack.label_regions(on[:, :-1] & on[:, 1:], on[:-1] & on[1:], (on[:-1, :-1] & on[1:, 1:], on[:-1, 1:] & on[1:, :-1]))
    y, x = np.nonzero(on)
    ids, group = np.unique(label[y, x], return_inverse=True)
    bounds = np.array([[x.max() + 1, -1, y.max() + 1, -1]] * len(ids))
    np.minimum.at(bounds[:, 0], group, x)
    np.maximum.at(bounds[:, 1], group, x)
    np.minimum.at(bounds[:, 2], group, y)
    np.maximum.at(bounds[:, 3], group, y)
    return [(k, *map(int, row)) for k, row in enumerate(bounds)]


def grow(rects: DataFrame, f: float, width: int, height: int) -> DataFrame:
    """Each side moved out by trunc(size * f + 0.5), clipped to the frame."""
    dx, dy = F.floor((F.col("r") - F.col("l")) * f + 0.5).cast("int"), F.floor((F.col("b") - F.col("t")) * f + 0.5).cast("int")
    return rects.withColumns({
        "l": F.greatest(F.lit(0), F.col("l") - dx), "r": F.least(F.lit(width - 1), F.col("r") + dx),
        "t": F.greatest(F.lit(0), F.col("t") - dy), "b": F.least(F.lit(height - 1), F.col("b") + dy),
    })


def groups(lo_x: np.ndarray, hi_x: np.ndarray, lo_y: np.ndarray, hi_y: np.ndarray) -> np.ndarray:
    """The group of each box; boxes that overlap, ends included, are of one group. A sweep over their left ends.

    The active set is disjoint pieces of the other axis in order, each with a box and how far right it is covered: boxes under a
    piece are one group by then, so a piece stands for all of them, and overlaps are never listed.
    """
    head = list(range(len(lo_x)))

    def find(k: int) -> int:
        while head[k] != k:
            head[k] = k = head[head[k]]
        return k

    starts, ends, owner, until = [], [], [], []
    for k in np.argsort(lo_x, kind="stable").tolist():
        x, e, a, b = int(lo_x[k]), int(hi_x[k]), int(lo_y[k]), int(hi_y[k])
        i, j = bisect_left(ends, a), bisect_right(starts, b)
        new: list[tuple[int, int, int, int]] = []
        at = a

        def put(s: int, t: int, box: int, far: int) -> None:
            if s > t:
                return
            if new and new[-1][3] == far and new[-1][1] == s - 1 and find(new[-1][2]) == find(box):  # noqa: B023 (used at once)
                new[-1] = (new[-1][0], t, box, far)  # noqa: B023
            else:
                new.append((s, t, box, far))  # noqa: B023

        for q in range(i, j):
            s, t, box, far = starts[q], ends[q], owner[q], until[q]
            if far < x:  # ended before
                continue
            head[find(box)] = find(k)
            put(s, a - 1, box, far)
            put(at, max(s, a) - 1, k, e)
            put(max(s, a), min(t, b), k, max(far, e))
            put(b + 1, t, box, far)
            at = min(t, b) + 1
        if at <= b:
            put(at, b, k, e)
        starts[i:j], ends[i:j], owner[i:j], until[i:j] = ([piece[c] for piece in new] for c in range(4))
    return np.array([find(k) for k in range(len(head))], np.int64)


def merged(boxes: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Unions of overlapping rectangles until none overlap: in each round all groups of overlapping ones become one each.

    Two rectangles overlap if their centres are no further apart than the whole halves of both widths and heights: each reaches
    from centre - half to centre + half.
    """
    box = np.array(boxes, np.int64).reshape(-1, 4)
    while len(box):
        centre, half = (box[:, 0::2] + box[:, 1::2]) // 2, (box[:, 1::2] - box[:, 0::2]) // 2
        low, high = centre - half, centre + half
        _, group = np.unique(groups(low[:, 0], high[:, 0], low[:, 1], high[:, 1]), return_inverse=True)
        n = group.max() + 1
        if n == len(box):
            break
        new = np.array([[1 << 40, -(1 << 40)] * 2] * n, np.int64)
        for c, ufunc in enumerate((np.minimum, np.maximum, np.minimum, np.maximum)):
            ufunc.at(new[:, c], group, box[:, c])
        box = new
    return [tuple(row) for row in box.tolist()]


#: Frames of so many boxes at most are merged together, by all pairs of each; larger ones by a sweep, one after another.
FEW = 16


def merged_small(frame: np.ndarray, box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """merged() of many frames of a few boxes at once: frame(n) in ascending order and box(n, 4) -> the same of the unions."""
    done = [(frame[:0], box[:0])]
    while len(frame):
        first = np.flatnonzero(np.diff(frame, prepend=frame[0] - 1))
        n = np.diff(first, append=len(frame))
        # every pair (a, b) of a frame with a < b: a box with each of those after it
        after = np.repeat(first + n, n) - 1 - np.arange(len(frame))
        a = np.repeat(np.arange(len(frame)), after)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(after) - after, after)
        centre, half = (box[:, 0::2] + box[:, 1::2]) // 2, (box[:, 1::2] - box[:, 0::2]) // 2
        near = np.ones(len(a), bool)
        for c in (0, 1):
            near &= np.abs(centre[a, c] - centre[b, c]) <= half[a, c] + half[b, c]
        a, b = a[near], b[near]
        least = linked(a, b, len(frame))
        busy = np.zeros(len(first), bool)
        busy[np.searchsorted(first, a, "right") - 1] = True
        live = np.repeat(busy, n)
        done.append((frame[~live], box[~live]))
        # the boxes of a group one after another; groups stay in their frame's place, as a group's least box does
        order = np.argsort(least[live], kind="stable")
        head = least[live][order]
        cut = np.flatnonzero(np.diff(head, prepend=-1))
        frame, box = frame[live][order], box[live][order]
        if len(cut):
            box = np.stack([ufunc.reduceat(box[:, c], cut) for c, ufunc in enumerate((np.minimum, np.maximum, np.minimum, np.maximum))], 1)
        frame = frame[cut]
    return np.concatenate([f for f, _ in done]), np.concatenate([x for _, x in done])


def linked(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes reaches over links a - b."""
    least = np.arange(n)
    while True:
        new = least.copy()
        np.minimum.at(new, a, least[b])
        np.minimum.at(new, b, least[a])
        np.minimum.at(new, least, new.copy())  # a node's head learns what the node learnt
        new = new[new]
        if (new == least).all():
            return least
        least = new


def merge_rects(rects: DataFrame, by: list[str] = BY, max_area: int | None = None, max_width: int | None = None, max_height: int | None = None) -> DataFrame:
    """(by, rect_id, l, r, t, b) of merged rectangles per frame; whole frames pass through a task, small ones many at a time.

    Unions above a maximum are dropped with all that went into them, once no rectangles overlap any more.
    """
    sides = ["l", "r", "t", "b"]
    rows = rects.select(*by, *[F.col(c).cast("int").alias(c) for c in sides])
    schema = rows.select(*by).schema.add("rect_id", "long").add("l", "integer").add("r", "integer").add("t", "integer").add("b", "integer")

    def run(batches):
        for batch, first in whole_groups(batches, by):
            if any(batch.column(c).null_count for c in sides):
                raise ValueError("a rectangle lacks a side")
            box = np.stack([batch.column(c).to_numpy() for c in sides], 1).astype(np.int64)
            n = np.diff(first, append=len(box))
            small = np.repeat(n <= FEW, n)
            found = [merged_small(np.repeat(np.arange(len(first)), n)[small], box[small])]
            for k in np.flatnonzero(n > FEW).tolist():
                large = np.array(merged(box[first[k] : first[k] + n[k]]), np.int64)
                found.append((np.full(len(large), k), large))
            frame, box = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((*box.T[::-1], frame))
            frame, box = frame[order], box[order]
            number = np.arange(len(frame)) - np.searchsorted(frame, frame)
            place = pa.array(first[frame])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(place) for c in by), pa.array(number), *(pa.array(x.astype(np.int32)) for x in box.T)], names=schema.names)

    whole = grouped(rows, by).mapInArrow(run, schema)
    return size_filter(whole, max_area=max_area, max_width=max_width, max_height=max_height)


def size_filter(rects: DataFrame, min_area: int = 0, max_area: int | None = None, min_width: int = 0, max_width: int | None = None, min_height: int = 0, max_height: int | None = None) -> DataFrame:
    """Greatest sizes before a merge, least sizes after it; width is r - l, area their product."""
    w, h = F.col("r") - F.col("l"), F.col("b") - F.col("t")
    for value, least, most in ((w * h, min_area, max_area), (w, min_width, max_width), (h, min_height, max_height)):
        rects = rects.where(value >= least)
        if most is not None:
            rects = rects.where(value <= most)
    return rects


def detections(raw: DataFrame, w: int, h: int, thr: float = 0.1, strict: bool = False) -> DataFrame:
    """Rows of a detector with image_id -1 dropped, score >= thr (strict: > thr), boxes in pixels."""
    kept = raw.where((F.col("image_id") != -1) & ((F.col("score") > thr) if strict else (F.col("score") >= thr)))
    return kept.withColumns({"xmin": F.col("xmin") * w, "xmax": F.col("xmax") * w, "ymin": F.col("ymin") * h, "ymax": F.col("ymax") * h})
