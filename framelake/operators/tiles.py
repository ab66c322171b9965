"""Frames too large for one row: tables of tiles, whose neighbourhoods come from the tiles around them.

TILES  the columns of FRAMES, and tile_y, tile_x, x0, y0, w, h, halo. width and height are the frame's; px holds the tile and
       `halo` pixels on each side, as far as the frame goes.
A filter that works on whole frames works on a tile with a halo of its reach, and its border rule holds where the frame ends.
Sums and components of whole frames are put together from what tiles say about their edges. A task holds a few tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..frames import FORMATS, KEY
from ..functions import stack
from ..functions.ordered import grouped, whole_groups
from ..functions.shared import written
from .objects import edges, linked
from .vector import stacked

AT = [*KEY, "tile_y", "tile_x"]
PLACE = ["tile_y", "tile_x", "x0", "y0", "w", "h", "halo"]


def _window(row: dict) -> tuple[int, int, int, int]:
    """The frame's rows and columns that a tile's px holds: top, bottom, left, right (ends exclusive)."""
    halo = row["halo"]
    return max(0, row["y0"] - halo), min(row["height"], row["y0"] + row["h"] + halo), max(0, row["x0"] - halo), min(row["width"], row["x0"] + row["w"] + halo)


#: Bytes of pixels, as doubles, in one stack of tiles, about.
STACK_BYTES = 16 << 20


def _alike(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple[dict, np.ndarray]]:
    """The rows that agree in size, format and the columns named: those values with n, the channels, and the row numbers."""
    names = ["width", "height", *[c for c in names if c in batch.schema.names]]
    if not batch.num_rows:
        return
    n = np.array([FORMATS[f].channels for f in batch.column("pix_fmt").dictionary_encode().dictionary.to_pylist()], np.int64)
    kind = n[batch.column("pix_fmt").dictionary_encode().indices.to_numpy()]
    table = np.stack([*(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names), kind], 1)
    code = np.zeros(len(table), np.int64)
    for column in table.T:  # codes are fewer than rows, so their product with a column's values stays small
        values, place = np.unique(column, return_inverse=True)
        code = np.unique(code * len(values) + place, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
        yield dict(zip([*names, "n"], table[rows[0]].tolist())), rows


def _stacks(batch: pa.RecordBatch, column: str = "px", names: list[str] = PLACE, shape: Callable[[dict], tuple[int, int]] | None = None) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """Tiles of one place, or frames of one size, as stacks (tiles, height, width, channels): their row, their row numbers, the stack."""

    def size(row: dict) -> tuple[int, int]:
        top, bottom, left, right = _window(row) if "halo" in row else (0, row["height"], 0, row["width"])
        return bottom - top, right - left

    for row, rows in _alike(batch, names):
        h, w = (shape or size)(row)
        step = max(1, STACK_BYTES // (8 * max(1, h * w * row["n"])))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            yield row, some, stacked(batch.column(column), some, (h, w, row["n"]))


def _batch(batch: pa.RecordBatch, take: list[np.ndarray], made: list[np.ndarray], place: list[dict], names: list[str], wide: bool = False) -> pa.RecordBatch:
    """Stacks `made` of the rows `take` with the values `place`, one dict a stack, in new rows."""
    picked, n = pa.array(np.concatenate(take) if take else np.zeros(0, np.int64)), [len(t) for t in take]
    new = {c: pa.array(np.repeat(np.array([p[c] for p in place]), n)) for c in (place[0] if place else ())}
    new = {c: v if pa.types.is_boolean(v.type) else v.cast(pa.int32()) for c, v in new.items()} | {"px": _lists(made, wide)}
    return pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c).take(picked) for c in names], names=names)


def _lists(stacks: list[np.ndarray], wide: bool = False) -> pa.Array:
    """A list column of the tiles of stacks; floats, in which NaN becomes null, or doubles (wide)."""
    sizes = np.concatenate([np.zeros(1, np.int64), *(np.full(len(s), s[0].size if len(s) else 0) for s in stacks)]).cumsum()
    kind = np.float64 if wide else np.float32
    flat = np.concatenate([s.ravel().astype(kind) for s in stacks]) if stacks else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)), pa.array(flat, from_pandas=not wide))


def split(df: DataFrame, w: int, h: int, halo: int = 0) -> DataFrame:
    """TILES of w x h pixels (less at the right and bottom ends) of frames that still fit a row; no shuffle."""
    schema = StructType(list(df.schema))
    for c in PLACE:
        schema = schema.add(c, "integer")

    def run(batches):
        for batch in batches:
            for row, rows, frames in _stacks(batch, names=[]):
                take, made, place = [], [], []
                for y0 in range(0, row["height"], h):
                    for x0 in range(0, row["width"], w):
                        tile = {"tile_y": y0 // h, "tile_x": x0 // w, "x0": x0, "y0": y0, "w": min(w, row["width"] - x0), "h": min(h, row["height"] - y0), "halo": halo}
                        top, bottom, left, right = _window(row | tile)
                        take.append(rows)
                        made.append(frames[:, top:bottom, left:right])
                        place.append(tile)
                if place:
                    yield _batch(batch, take, made, place, schema.names)

    return df.mapInArrow(run, schema)


def _pasted(batch: pa.RecordBatch, first: np.ndarray, names: list[str], part: Callable[[dict], tuple[int, int, int, int]], whole: Callable[[dict], tuple[int, int, int, int]]) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """One array for each group of rows, of the parts that the rows hold: a row's values, the groups' numbers, the stack.

    part, whole: top, bottom, left, right in the frame of what a row holds and of what its group gives, by the row's values.
    """
    group = np.repeat(np.arange(len(first)), np.diff(first, append=batch.num_rows))
    goals: dict[tuple, tuple[dict, list[np.ndarray], list]] = {}
    for row, rows in _alike(batch, names):
        goal = (*whole(row), row["n"])
        _, members, parts = goals.setdefault(goal, (row, [], []))
        members.append(group[rows])
        parts.append((part(row), rows))
    for (top, bottom, left, right, n), (row, members, parts) in goals.items():
        every = np.unique(np.concatenate(members))
        step = max(1, STACK_BYTES // (8 * max(1, (bottom - top) * (right - left) * n)))
        for at in range(0, len(every), step):
            some = every[at : at + step]
            made = np.zeros((len(some), bottom - top, right - left, n))
            for (a, b, c, d), rows in parts:
                mine = rows[(group[rows] >= some[0]) & (group[rows] <= some[-1])]
                if len(mine):
                    made[np.searchsorted(some, group[mine]), a - top : b - top, c - left : d - left] = stacked(batch.column("px"), mine, (b - a, d - c, n))
            yield row, some, made


def merge(tiles: DataFrame) -> DataFrame:
    """FRAMES of tiles without a halo; px keeps its type."""
    names = [c for c in tiles.columns if c not in PLACE]
    schema = tiles.select(*names).schema
    wide = dict(tiles.dtypes)["px"] == "array<double>"

    def run(batches):
        for batch, first in whole_groups(batches, KEY):
            for _, frames, made in _pasted(batch, first, ["x0", "y0", "w", "h"], lambda row: (row["y0"], row["y0"] + row["h"], row["x0"], row["x0"] + row["w"]), lambda row: (0, row["height"], 0, row["width"])):
                yield _batch(batch, [first[frames]], [made], [{}], names, wide)

    return grouped(tiles, KEY).mapInArrow(run, schema)


def with_halo(tiles: DataFrame, halo: int) -> DataFrame:
    """Tiles without a halo -> the same with one: each sends the strips that others need; a halo may reach over several tiles.

    All tiles of a frame but the last of a row or column have one size.
    """
    names = tiles.columns
    schema = StructType(list(tiles.schema)).add("own", "boolean").add("px0", "integer").add("py0", "integer").add("pw", "integer").add("ph", "integer")

    def send(batches):
        for batch in batches:
            for row, rows, px in _stacks(batch):
                take, made, extra = [], [], []
                y0, x0 = row["y0"], row["x0"]
                # the size of inner tiles: a last one's place says how large those before are
                h = y0 // row["tile_y"] if row["tile_y"] else row["h"]
                w = x0 // row["tile_x"] if row["tile_x"] else row["w"]
                for ty in range(max(0, y0 - halo) // h, min(row["height"] - 1, y0 + row["h"] - 1 + halo) // h + 1):
                    for tx in range(max(0, x0 - halo) // w, min(row["width"] - 1, x0 + row["w"] - 1 + halo) // w + 1):
                        goal = {"tile_y": ty, "tile_x": tx, "x0": tx * w, "y0": ty * h, "w": min(w, row["width"] - tx * w), "h": min(h, row["height"] - ty * h), "halo": halo}
                        top, bottom, left, right = _window(row | goal)
                        top, bottom, left, right = max(top, y0), min(bottom, y0 + row["h"]), max(left, x0), min(right, x0 + row["w"])
                        take.append(rows)
                        made.append(px[:, top - y0 : bottom - y0, left - x0 : right - x0])
                        extra.append(goal | {"own": (ty, tx) == (row["tile_y"], row["tile_x"]), "px0": left, "py0": top, "pw": right - left, "ph": bottom - top})
                yield _batch(batch, take, made, extra, schema.names)

    def join(batches):
        for batch, first in whole_groups(batches, AT):
            own = np.full(len(first), -1)
            mine = np.flatnonzero(batch.column("own").to_numpy(zero_copy_only=False))
            own[np.searchsorted(first, mine, "right") - 1] = mine
            if (own < 0).any():
                raise ValueError("a frame lacks a tile")
            for _, some, made in _pasted(batch, first, [*PLACE, "px0", "py0", "pw", "ph"], lambda row: (row["py0"], row["py0"] + row["ph"], row["px0"], row["px0"] + row["pw"]), _window):
                yield _batch(batch, [own[some]], [made], [{}], names)

    return grouped(tiles.mapInArrow(send, schema), AT).mapInArrow(join, tiles.schema)


def _cropped(made: np.ndarray, row: dict) -> np.ndarray:
    top, _, left, _ = _window(row)
    return made[:, row["y0"] - top :, row["x0"] - left :][:, : row["h"], : row["w"]]


def filtered(tiles: DataFrame, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Tiles after a filter of stacks (frames, height, width, channels) of the same size, whose reach their halo covers; the halo goes."""
    names = tiles.columns

    def run(batches):
        for batch in batches:
            for row, rows, px in _stacks(batch):
                yield _batch(batch, [rows], [_cropped(fn(px), row)], [{"halo": 0}], names)

    return tiles.mapInArrow(run, tiles.schema)


def integral(tiles: DataFrame) -> DataFrame:
    """Inclusive prefix sums over whole frames, of tiles without a halo, in px as doubles.

    A tile's last column, last row and total are what others need: columns and totals are added along a row of tiles, then rows
    and those sums along a column. Each such group is some vectors of one row or column of tiles.
    """
    names = tiles.columns
    doubles = tiles.withColumn("px", F.col("px").cast("array<double>")).schema
    at = "stream_id string, frame_no bigint, img_no int, tile_y int, tile_x int"

    def ends(batches):
        for batch in batches:
            for _, rows, px in _stacks(batch):
                s = stack.integral(px)
                lists = [_lists([x], True) for x in (s[:, :, -1], s[:, -1], s[:, -1, -1])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows)) for c in AT), *lists], names=[*AT, "col", "row", "total"])

    def before(group: list[str], sums: dict[str, str], kept: list[str]):
        """Sums over the tiles before each, in order of their places: of the columns that `sums` gives new names."""

        def run(batches):
            for batch, first in whole_groups(batches, group):
                n = np.diff(first, append=batch.num_rows)
                rank, out = np.arange(batch.num_rows) - np.repeat(first, n), []
                for column in sums:
                    cells = batch.column(column)
                    sizes, flat = np.diff(cells.offsets.to_numpy()), cells.flatten().to_numpy()
                    start = np.cumsum(sizes) - sizes
                    made = np.zeros(len(flat))
                    for k in range(1, int(n.max())):
                        rows = first[n > k] + k  # the k-th tiles of all groups; a group's vectors are of one size
                        size = sizes[rows]
                        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                        here, last = np.repeat(start[rows], size) + inside, np.repeat(start[rows - 1], size) + inside
                        made[here] = made[last] + flat[last]
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(start, len(flat)).astype(np.int32)), pa.array(made)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*AT, *kept]), *out], names=[*AT, *kept, *sums.values()])

        return run

    known = tiles.mapInArrow(ends, f"{at}, col array<double>, row array<double>, total array<double>")
    along = grouped(known, [*KEY, "tile_y"], ["tile_x"]).mapInArrow(before([*KEY, "tile_y"], {"col": "left", "total": "corner"}, ["row"]), f"{at}, row array<double>, left array<double>, corner array<double>")
    down = grouped(along, [*KEY, "tile_x"], ["tile_y"]).mapInArrow(before([*KEY, "tile_x"], {"row": "up", "corner": "sums"}, ["left"]), f"{at}, left array<double>, up array<double>, sums array<double>")
    whole = tiles.join(down, AT)

    def add(batches):
        for batch in batches:
            for row, rows, px in _stacks(batch):
                n, h, w = row["n"], row["h"], row["w"]
                left, up, corner = (stacked(batch.column(c), rows, shape) for c, shape in (("left", (h, 1, n)), ("up", (1, w, n)), ("sums", (1, 1, n))))
                yield _batch(batch, [rows], [stack.integral(px) + left + up + corner], [{}], names, True)

    return whole.mapInArrow(add, doubles)


def components(tiles: DataFrame, border: bool = True) -> DataFrame:
    """RECTS of 8-connected groups of edge pixels over whole frames, from tiles with a halo of one pixel.

    A tile finds its own groups and says which of them its outer pixels belong to; pixels that touch across tiles link two groups.
    The links of a frame, which lie along the edges of tiles alone, are joined in one task; then rectangles are united.
    """

    def local(batches):
        for batch in batches:
            for row, rows, px in _stacks(batch):
                on = _cropped(edges(px, border), row)[..., 0]
                if not on.any():
                    continue
                # the tiles one under the other, with an empty line after each
                on = np.pad(on, ((0, 0), (0, 1), (0, 0))).reshape(-1, row["w"])
                label = stack.label_regions(on[:, :-1] & on[:, 1:], on[:-1] & on[1:], (on[:-1, :-1] & on[1:, 1:], on[:-1, 1:] & on[1:, :-1]))
                y, x = np.nonzero(on)
                ids, group = np.unique(label[y, x], return_inverse=True)
                tile = ids // (row["w"] * (row["h"] + 1))
                own = (row["tile_y"] << 44) + (row["tile_x"] << 24) + np.arange(len(ids)) - np.searchsorted(tile, tile)  # tiles have fewer than 2**24 groups
                y, x = y % (row["h"] + 1) + row["y0"], x + row["x0"]
                order = np.argsort(group, kind="stable")
                cut = np.searchsorted(group[order], np.arange(len(ids)))
                box = [ufunc.reduceat(values[order], cut) for values, ufunc in ((x, np.minimum), (x, np.maximum), (y, np.minimum), (y, np.maximum))]
                least = np.minimum.reduceat((y.astype(np.int64) * row["width"] + x)[order], cut)
                right, low = row["x0"] + row["w"] - 1, row["y0"] + row["h"] - 1
                outer = (y == row["y0"]) & (row["y0"] > 0) | (y == low) & (low + 1 < row["height"]) | (x == row["x0"]) & (row["x0"] > 0) | (x == right) & (right + 1 < row["width"])
                edge = order[outer[order]]
                ends = pa.array(np.searchsorted(group[edge], np.arange(len(ids) + 1)).astype(np.int32))
                sides = [pa.array(np.full(len(ids), v, np.int32)) for v in (row["x0"], right, row["y0"], low)]
                lists = [pa.ListArray.from_arrays(ends, pa.array(values[edge].astype(np.int32))) for values in (x, y)]
                picked = pa.array(rows[tile])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(picked) for c in KEY), pa.array(own), *(pa.array(v.astype(np.int32)) for v in box), pa.array(least), *sides, *lists], names=[*KEY, "id", "l", "r", "t", "b", "least", *bounds, "xs", "ys"])

    bounds = ["x0", "x1", "y0", "y1"]
    key = "stream_id string, frame_no bigint, img_no int"
    groups = written(tiles.mapInArrow(local, f"{key}, id bigint, l int, r int, t int, b int, least bigint, x0 int, x1 int, y0 int, y1 int, xs array<int>, ys array<int>"), "tile-groups")
    outer = groups.select(*KEY, "id", *bounds, F.explode(F.arrays_zip("xs", "ys")).alias("p")).select(*KEY, "id", *bounds, F.col("p.xs").alias("x"), F.col("p.ys").alias("y"))
    near = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    around = outer.withColumn("d", near).select(*KEY, *bounds, F.col("id").alias("other"), (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y"))
    asked = around.where("NOT (x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)").drop(*bounds)  # what lies in other tiles
    links = outer.drop(*bounds).join(asked, [*KEY, "x", "y"]).select(*KEY, "id", "other").distinct()

    def joined(batches):
        for batch, first in whole_groups(batches, KEY):
            frame = np.repeat(np.arange(len(first)), np.diff(first, append=batch.num_rows))
            known, place = np.unique(np.concatenate([batch.column(c).to_numpy() for c in ("id", "other")]), return_inverse=True)
            nodes, place = np.unique(np.tile(frame, 2) * len(known) + place, return_inverse=True)
            ids = known[nodes % len(known)]
            least = linked(place[: len(frame)], place[len(frame) :], len(nodes))
            picked = pa.array(first[nodes // len(known)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(picked) for c in KEY), pa.array(ids), pa.array(ids[least])], names=[*KEY, "id", "root"])

    roots = grouped(links, KEY).mapInArrow(joined, f"{key}, id bigint, root bigint")
    named = groups.join(roots, [*KEY, "id"], "left").withColumn("root", F.coalesce("root", "id"))
    boxes = named.groupBy(*KEY, "root").agg(F.min("l").alias("l"), F.max("r").alias("r"), F.min("t").alias("t"), F.max("b").alias("b"), F.min("least").alias("least"))
    number = F.row_number().over(Window.partitionBy(*KEY).orderBy("least")) - 1  # a frame's rectangles
    return boxes.select(*KEY, number.cast("long").alias("rect_id"), "l", "r", "t", "b")
