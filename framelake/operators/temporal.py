"""Operators over frames in time. A stream is split in blocks of consecutive frames, so one long stream is many tasks.

Finite windows copy the last frames of a block into the next (with_context); recursive filters are affine recurrences and
are scanned in three passes (affine_scan), nested ones over blocks that are shuffled once (block_scan). frame_no counts the frames of (stream_id, img_no) without gaps.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import FORMATS, IMAGE, KEY, channels, with_px
from ..functions import stack
from ..functions.let import let
from ..functions.ordered import running
from ..functions.shared import bucketed, written
from .vector import px_lists, shapes, small_batches, stacked, utc

#: Frames in a block at most, and bytes of pixels that it holds, about.
BLOCK, BLOCK_BYTES = 64, 64 << 20
#: Values of a frame whose carries one task scans over all blocks of a stream.
TILE = 4096


def block_frames(size: int | None = None) -> Column:
    """Frames in a block: BLOCK, or fewer where frames are large; all frames of an image stream have one size."""
    if size:
        return F.lit(size)
    frame = F.greatest(F.lit(1), F.col("width") * F.col("height") * channels() * 4)
    return F.greatest(F.lit(4), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_BYTES) / frame)))


def with_context(df: DataFrame, before: int, size: int | None = None) -> DataFrame:
    """df with block; the last `before` frames of each block also stand in the next ones that need them."""
    size = block_frames(size)
    own = F.floor(F.col("frame_no") / size)
    return df.withColumn("own_block", own).withColumn("block", F.explode(F.sequence(own, F.floor((F.col("frame_no") + before) / size))))


def with_previous(df: DataFrame, name: str = "prev", size: int | None = None, of: str = "px") -> DataFrame:
    """df with the pixels (or another column) of the frame before, null for the first: one exchange by block, not by stream."""
    order = Window.partitionBy(*IMAGE, "block").orderBy("frame_no")
    return with_context(df, 1, size).withColumn(name, F.lag(of).over(order)).where("block = own_block").drop("block", "own_block")


def over_blocks(df: DataFrame, before: int, fn: Callable[[np.ndarray], np.ndarray], size: int | None = None) -> DataFrame:
    """Pixels from windows of before + 1 frames: fn maps a block's rows (its context first) to as many rows.

    A pixel's result depends on that pixel alone, so a block goes through fn some columns at a time.
    """
    small_batches(df)
    spread = with_context(df, before, size)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("frame_no")
        flat = table["px"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        made = np.empty(flat.shape, np.float32)
        for i in range(0, flat.shape[1], 1 << 16):
            made[:, i : i + (1 << 16)] = fn(flat[:, i : i + (1 << 16)].astype(np.float64))
        keep = np.flatnonzero(table["own_block"].to_numpy() == table["block"].to_numpy())
        kept = table.take(pa.array(keep)).drop_columns(["block", "own_block"])
        return utc(kept.set_column(kept.schema.get_field_index("px"), "px", px_lists([made[i] for i in keep])))

    return spread.groupBy(*IMAGE, "block").applyInArrow(run, df.schema).select(*df.columns)


def average(df: DataFrame, b: int) -> DataFrame:
    """Sum of the last N = 2**b frames over N, with zeros before the first."""
    n = 1 << b

    def fn(rows: np.ndarray) -> np.ndarray:
        total = np.cumsum(rows, axis=0)
        total[n:] = total[n:] - total[:-n]
        return total / n

    return over_blocks(df, n - 1, fn)


def beat(df: DataFrame, b: int, bin: int = 2) -> DataFrame:
    """2.625 * |X|**2 + 0.5 with X the given bin of the DFT of each pixel's last 2**b frames, zeros before the first."""
    n = 1 << b

    def fn(rows: np.ndarray) -> np.ndarray:
        turn = np.exp(-2j * np.pi * bin * np.arange(len(rows)) / n)[:, None]
        total = np.cumsum(rows * turn, axis=0)
        total[n:] = total[n:] - total[:-n]
        return 2.625 * np.abs(total) ** 2 + 0.5

    return over_blocks(df, n - 1, fn)


def history(df: DataFrame, age: int, name: str = "past") -> DataFrame:
    """df with the pixels of the frame `age` before, or of the oldest: an equi-join on its number."""
    oldest = df.groupBy(*IMAGE).agg(F.min("frame_no").alias("oldest"))
    wanted = df.join(oldest, IMAGE).withColumn("past_no", F.greatest("oldest", F.col("frame_no") - age))
    past = df.select(*IMAGE, F.col("frame_no").alias("past_no"), F.col("px").alias(name))
    return wanted.join(past, [*IMAGE, "past_no"]).select(*df.columns, name)


def deinterlace(df: DataFrame, method: str = "linear") -> DataFrame:
    """Rows of the frame's parity stay; the others come from both frames. The first frame has no output.

    linear: mean of previous and current; interframe: median of above, below and the same of the previous frame's row;
    smooth: the cross of neighbours in both frames over 8.
    """
    rows = with_previous(df).where(F.col("prev").isNotNull())

    def median3(a: Column, b: Column, c: Column) -> Column:
        return a + b + c - F.least(a, b, c) - F.greatest(a, b, c)

    def value(v: Column, i: Column, px: Column, before: Column, line: Column, n: Column) -> Column:
        cur, prev = (lambda i: F.get(px, i.cast("int")).cast("double")), (lambda i: F.get(before, i.cast("int")).cast("double"))
        y, v = F.floor(i / line), v.cast("double")
        kept = (y + 1) % 2 == F.col("frame_no") % 2
        if method == "linear":
            return F.when(kept, v).otherwise((v + prev(i)) / 2)
        if method == "interframe":
            inner = (y >= 2) & (y < F.col("height") - 1)
            return F.when(kept | ~inner, v).otherwise(median3(cur(i - line), cur(i + line), prev(i)))
        x = F.floor(i % line / n)
        inner = (y >= 1) & (y < F.col("height") - 1) & (x >= 1) & (x < F.col("width") - 1)
        cross = sum((at(i - line) + at(i + line) + at(i - n) + at(i + n) for at in (cur, prev)), F.lit(0.0))
        return F.when(kept | ~inner, v).otherwise(cross / 8)

    made = lambda px, before, line, n: F.transform(px, lambda v, i: value(v, i, px, before, line, n))
    return with_px(rows, let(made, "px", "prev", F.col("width") * channels(), channels())).select(*df.columns)


def arrays(table: pa.Table, column: str) -> list[np.ndarray]:
    return [np.asarray(x.values.to_numpy(zero_copy_only=False), float) for x in table[column].combine_chunks()]


def doubles(found: list[np.ndarray] | np.ndarray) -> pa.Array:
    at = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(found.ravel() if isinstance(found, np.ndarray) else np.concatenate(found)))


def lists(found: list[np.ndarray]) -> pa.Array:
    return doubles(found) if found else pa.array([], pa.list_(pa.float64()))


def _carried(tiles: DataFrame, onward: bool = False) -> DataFrame:
    """tiles(image, block, tile, a, b): product and local result of each block -> (image, block, tile, x0), what it takes over.

    onward: a row gives what the next block takes over; so the last block of a stream needs none. A task scans one tile of each block of a stream.
    """

    def carry(table: pa.Table) -> pa.Table:
        table, x, taken = table.sort_by("block"), np.zeros(1), []
        for p, q in zip(arrays(table, "a"), arrays(table, "b")):
            before, x = np.broadcast_to(x, q.shape), p * x + q
            taken.append(x if onward else before)
        block = pc.add(table["block"], 1) if onward else table["block"]
        return pa.table({c: table[c] for c in (*IMAGE, "tile")} | {"block": block, "x0": doubles(taken)})

    return tiles.groupBy(*IMAGE, "tile").applyInArrow(carry, "stream_id string, img_no int, tile int, block bigint, x0 array<double>")


def _starts(ends: DataFrame) -> DataFrame:
    """ends(image, block, a, b) of whole frames -> (image, block, x0)."""
    part = lambda c: F.when(F.size(c) == 1, F.col(c)).otherwise(F.slice(c, F.col("tile") * TILE + 1, F.lit(TILE)))
    tiles = ends.withColumn("tile", F.explode(F.sequence(F.lit(0), F.ceil(F.greatest(F.lit(1), F.size("b")) / TILE).cast("int") - 1))).select(*IMAGE, "tile", "block", part("a").alias("a"), part("b").alias("b"))
    return _carried(tiles).groupBy(*IMAGE, "block").agg(F.array_sort(F.collect_list(F.struct("tile", "x0"))).alias("t")).select(*IMAGE, "block", F.flatten("t.x0").alias("x0"))


def affine_scan(df: DataFrame, a: Column, b: Column, name: str, size: int | None = None) -> DataFrame:
    """df with name = x_n, where x_n = a_n * x_(n-1) + b_n per (stream_id, img_no) in order of frame_no; x before is 0.

    a, b: arrays of doubles of one length (or of length 1, for all). Each block gives its product of a and local result
    (one row), the rows of blocks are scanned, TILE values by themselves, and each block is replayed with what it takes
    over. So a task holds a block, or TILE values of each block of a stream.
    """
    small_batches(df)
    rows = df.withColumn("__a", a.cast("array<double>")).withColumn("__b", b.cast("array<double>")).withColumn("block", F.floor(F.col("frame_no") / block_frames(size)))

    def head(table: pa.Table) -> dict:
        return {c: table[c].slice(0, 1) for c in (*IMAGE, "block")}

    def local(table: pa.Table) -> pa.Table:
        table = table.sort_by("frame_no")
        product, x = np.ones(1), np.zeros(1)
        for p, q in zip(arrays(table, "__a"), arrays(table, "__b")):
            product, x = p * product, p * x + q
        return pa.table(head(table) | {"a": doubles([product]), "b": doubles([x])})

    def replay(table: pa.Table, taken: pa.Table) -> pa.Table:
        table = table.sort_by("frame_no")
        x, out = (arrays(taken, "x0")[0] if taken.num_rows else np.zeros(1)), []
        for p, q in zip(arrays(table, "__a"), arrays(table, "__b")):
            x = p * x + q
            out.append(x)
        return utc(table.drop_columns(["__a", "__b", "block"]).append_column(name, doubles(out)))

    by = [*IMAGE, "block"]
    summary = "stream_id string, img_no int, block bigint, "
    ends = rows.select(*by, "frame_no", "__a", "__b").groupBy(*by).applyInArrow(local, summary + "a array<double>, b array<double>")
    starts = _starts(ends)
    return rows.groupBy(*by).cogroup(starts.groupBy(*by)).applyInArrow(replay, df.withColumn(name, F.lit(None).cast("array<double>")).schema)


class Block:
    """The frames of a block and, with context, the frame before each: rows of values; `some` are those that a pass works on."""

    def __init__(self, table: pa.Table):
        ahead = table["own_block"].to_numpy() > table["block"].to_numpy()
        #: Whether the stream goes on in a further block, whose first frame has sent a row without pixels.
        self.goes_on = bool(ahead.any())
        self.table = table = table.filter(pa.array(~ahead)).sort_by("frame_no")
        flat = np.frombuffer(b"".join(table["px"].to_pylist()), np.float32)
        self.all = flat.reshape(table.num_rows, -1) if table.num_rows else flat.reshape(0, 0)
        self.rows = np.flatnonzero(table["own_block"].to_numpy() == table["block"].to_numpy())
        self.no = table["frame_no"].to_numpy()[self.rows]
        #: The row of the frame before; a stream's first frame stands for itself.
        self.before = np.maximum(self.rows - 1, 0)
        if table.num_rows:
            self.shape = (table["height"][0].as_py(), table["width"][0].as_py(), FORMATS[table["pix_fmt"][0].as_py()].channels)

    def px(self, some: slice) -> np.ndarray:
        return self.all[self.rows, some].astype(np.float64)

    def prev(self, some: slice) -> np.ndarray:
        return self.all[self.before, some].astype(np.float64)


def _packed(batches):
    """px as the bytes of its float32 values, null as NaN: a block's frames are read and moved without looking at values."""
    for batch in batches:
        at = batch.schema.get_field_index("px")
        px = batch.column(at)
        flat = px.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
        ends = np.cumsum([0, *(px.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        body = pa.array([flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([body if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)


#: Values of all frames of a block that are worked on at once.
SOME = 1 << 16


def block_scan(df: DataFrame, steps: list[Callable], finish: Callable[[Block, list], pa.Table], schema, before: int = 0, prepare: Callable | None = None, size: int | None = None) -> DataFrame:
    """Nested recursions x_n = a_n * x_(n-1) + b_n in order of frame_no, whose frames are shuffled once.

    steps: (a, b) = step(block, some, held, done) for the values `some` of the block's frames, with what prepare(block) gives and the
    results of the steps before. finish(block, chunks) makes the rows; chunks gives (some, results of all steps) in turn.
    Frames are written in blocks, bucketed by block. Each step is a pass that gives one row a block; those are scanned
    (_starts) and meet the blocks where they lie. The last pass runs all steps at once.
    """
    by = [*IMAGE, "block"]
    size_of = block_frames(size)
    own = F.floor(F.col("frame_no") / size_of)
    here = F.sequence(own, F.floor((F.col("frame_no") + before) / size_of))
    back = F.when((F.col("frame_no") % size_of == 0) & (own > 0), F.array(own - 1)).otherwise(F.array().cast("array<bigint>"))
    spread = df.withColumn("own_block", own).withColumn("block", F.explode(F.concat(here, back)))
    spread = spread.withColumn("px", F.when(F.col("own_block") <= F.col("block"), F.col("px")))
    packed = spread.mapInArrow(_packed, spread.withColumn("px", F.lit(None).cast("binary")).schema)
    rows = bucketed(packed, by, "frame_blocks")
    read = rows.select(*by, "own_block", "frame_no", "width", "height", "pix_fmt", "px")

    def chunks(block: Block, taken: pa.Table | None, upto: int):
        """(some, results of the first steps, a and b of the next)."""
        held = prepare(block) if prepare else None
        starts = [np.zeros(1)] * upto  # a stream's first block takes nothing over
        if upto and taken.num_rows:
            starts = [np.concatenate(arrays(taken.filter(pc.equal(taken["step"], k)).sort_by("tile"), "x0")) for k in range(upto)]
        width = block.all.shape[1]
        for k in range(0, width, SOME):
            some, done = slice(k, min(k + SOME, width)), []
            for step, x in zip(steps, starts):
                a, b = step(block, some, held, done)
                out, x = np.empty(b.shape), x if len(x) == 1 else x[some]
                for i in range(len(b)):
                    x = a[i] * x + b[i]
                    out[i] = x
                done.append(out)
            yield some, done, step_of(block, some, held, done, upto)

    def step_of(block: Block, some: slice, held, done: list, k: int):
        return steps[k](block, some, held, done) if k < len(steps) else None

    def end(k: int, table: pa.Table, taken: pa.Table | None) -> pa.Table:
        """Product and local result of the block, a row a tile; nothing if no block follows."""
        block = Block(table)
        products, results = [], []
        for _, _, (a, b) in chunks(block, taken, k) if block.goes_on else ():
            product, x = np.ones(1), np.zeros(1)
            for i in range(len(b)):
                product, x = a[i] * product, a[i] * x + b[i]
            products.append(product)
            results.append(x)
        made = np.concatenate(results) if results else np.zeros(0)
        cuts = range(0, len(made), TILE)
        a = [products[0]] * len(cuts) if results and len(products[0]) == 1 else [np.concatenate(products)[i : i + TILE] for i in cuts]
        head = {c: table[c].take(pa.array([0] * len(cuts), pa.int64())) for c in by}
        return pa.table(head | {"tile": pa.array(range(len(cuts)), pa.int32()), "a": lists(a), "b": lists([made[i : i + TILE] for i in cuts])})

    def last(table: pa.Table, taken: pa.Table) -> pa.Table:
        block = Block(table)
        return finish(block, ((some, done) for some, done, _ in chunks(block, taken, len(steps)))) if len(block.rows) else finish(block, iter(()))

    summary = "stream_id string, img_no int, block bigint, tile int, a array<double>, b array<double>"
    carried = None
    for k in range(len(steps)):
        if carried is None:
            found = read.groupBy(*by).applyInArrow(lambda table: end(0, table, None), summary)
        else:
            found = read.groupBy(*by).cogroup(carried.groupBy(*by)).applyInArrow(lambda table, taken: end(k, table, taken), summary)  # noqa: B023 (runs before the loop goes on)
        starts = written(_carried(found, onward=True).withColumn("step", F.lit(k)), "block-starts")
        carried = starts if carried is None else carried.unionByName(starts)
    return rows.groupBy(*by).cogroup(carried.groupBy(*by)).applyInArrow(last, schema)


def own_frames(block: Block, px: np.ndarray | list | None = None) -> pa.Table:
    """The block's frames as they came, or with other pixels."""
    own = block.table.drop_columns(["block", "own_block", "px"]).take(pa.array(block.rows))
    values = px_lists(list(block.all[block.rows]) if px is None else list(px))
    return own.add_column(block.table.schema.get_field_index("px"), "px", values)


def _model(a: float) -> list[Callable]:
    """Steps of the background model: running mean, and running square of the whole-number difference from it."""

    def mean(block: Block, some: slice, held, done: list):
        first, v = (block.no == 0)[:, None], block.px(some)
        return np.where(first, 0.0, 1 - a), np.where(first, v, v * a)

    def variance(block: Block, some: slice, held, done: list):
        first = (block.no == 0)[:, None]
        return np.where(first, 0.0, 1 - a), np.where(first, 100.0, (np.floor(block.px(some)) - np.floor(done[0])) ** 2 * a)

    return [mean, variance]


def background_model(df: DataFrame, a: float = 0.01) -> DataFrame:
    """df with bg_mean and bg_var: running mean, and running square of the whole-number difference from it."""
    names = df.columns

    def finish(block: Block, chunks) -> pa.Table:
        out = np.empty((2, len(block.rows), block.all.shape[1]))
        for some, done in chunks:
            out[0, :, some], out[1, :, some] = done
        return utc(own_frames(block).select(names).append_column("bg_mean", lists(list(out[0]))).append_column("bg_var", lists(list(out[1]))))

    none = F.lit(None).cast("array<double>")
    return block_scan(df, _model(a), finish, df.withColumns({"bg_mean": none, "bg_var": none}).schema)


CELLS = "stream_id string, frame_no bigint, img_no int, cell_x int, cell_y int, marked boolean"


def motion(df: DataFrame, a: float = 0.01, thr: float = 3.5, cell: int = 16) -> DataFrame:
    """motion_cells(background_model(df, a), thr, cell) without the models as columns: a block goes to its cells at once."""

    def finish(block: Block, chunks) -> pa.Table:
        hit = np.zeros((len(block.rows), block.all.shape[1]), bool)
        for some, (mean, var) in chunks:
            with np.errstate(divide="ignore", invalid="ignore"):
                hit[:, some] = np.abs(block.px(some) - mean) / np.sqrt(var) > thr
        hit = hit.reshape(len(block.rows), *block.shape).any(3) if len(block.rows) else hit.reshape(0, 1, 1)
        return cells_of(hit, cell, [block.table[c].take(pa.array(block.rows)) for c in KEY])

    return block_scan(df, _model(a), finish, CELLS)


def cells_of(hit: np.ndarray, cell: int, keys: list) -> pa.Table:
    """One row a cell of stacked marks (frames, height, width), with the frames' keys."""
    if len(hit):
        hit = np.logical_or.reduceat(hit, np.arange(0, hit.shape[1], cell), axis=1)
        hit = np.logical_or.reduceat(hit, np.arange(0, hit.shape[2], cell), axis=2)
    i, y, x = (v.ravel() for v in np.indices(hit.shape))
    return pa.table([*(k.take(pa.array(i)) for k in keys), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(hit.ravel())], names=[*KEY, "cell_x", "cell_y", "marked"])


def motion_cells(model: DataFrame, thr: float = 3.5, cell: int = 16) -> DataFrame:
    """(key, cell_x, cell_y, marked) of every cell: some pixel lies over thr standard deviations from the mean.

    A frame is reduced to its cells inside its row.
    """
    small_batches(model)
    columns = ("px", "bg_mean", "bg_var")
    ready = model.select(*KEY, "width", "height", "pix_fmt", *columns)

    def run(batches):
        for batch in batches:
            for shape, rows in shapes(batch).items():
                v, mean, var = (stacked(batch.column(c), rows, shape) for c in columns)
                with np.errstate(divide="ignore", invalid="ignore"):
                    hit = (np.abs(v - mean) / np.sqrt(var) > thr).any(axis=3)
                yield from cells_of(hit, cell, [batch.column(c).take(pa.array(rows)) for c in KEY]).to_batches()

    return ready.mapInArrow(run, CELLS)


def persistent(cells: DataFrame, n: int = 2) -> DataFrame:
    """cells with run (marked frames in a row so far) and detected (run > n).

    Unmarked frames number the islands of a cell, and marked ones are counted in their island; both are running sums over ranges of
    cells and frames, so a long history is many tasks.
    """
    own = [*IMAGE, "cell_x", "cell_y"]
    on = F.coalesce("marked", F.lit(False))
    rows = cells.withColumn("island", (~on).cast("long")).withColumn("run", on.cast("long"))
    counted = running(running(rows, own, ["frame_no"], sums=["island"]), [*own, "island"], ["frame_no"], sums=["run"])
    return counted.withColumn("detected", F.col("run") > n).drop("island")


def motion_overlay(df: DataFrame, cells: DataFrame, cell: int = 16) -> DataFrame:
    """Detected cells brightened, (v >> 1) + 128; in colour the first and third component."""
    lit = cells.where("detected").groupBy(*KEY).agg(F.collect_set(F.struct("cell_x", "cell_y")).alias("lit"))  # a frame's cells
    per_row = F.ceil(F.col("width") / cell).cast("int")
    count = (per_row * F.ceil(F.col("height") / cell)).cast("int")
    joined = df.join(lit, KEY, "left")
    numbers = F.transform("lit", lambda c: c["cell_y"] * per_row + c["cell_x"])
    on = let(lambda own, last: F.transform(F.sequence(F.lit(0), last), lambda i: F.array_contains(own, i)), numbers, count - 1)

    def value(v: Column, i: Column, on: Column, n: Column, across: Column) -> Column:
        pixel = F.floor(i / n)
        at = F.floor(F.floor(pixel / F.col("width")) / cell) * across + F.floor(pixel % F.col("width") / cell)
        hit = F.coalesce(F.get(on, at.cast("int")), F.lit(False)) & (i % n != 1)
        return F.when(hit, F.floor(v / 2) + 128).otherwise(v)

    made = let(lambda on, n, across: F.transform("px", lambda v, i: value(v, i, on, n, across)), on, channels(), per_row)
    return with_px(joined, F.when(F.col("lit").isNull(), F.col("px").cast("array<double>")).otherwise(made.cast("array<double>"))).select(*df.columns)


def motion_frames(df: DataFrame, cells: DataFrame) -> DataFrame:
    """Frames with a detection."""
    return df.join(cells.where("detected").select(*KEY).distinct(), KEY, "left_semi")


def subtract_reference(df: DataFrame, n: int, t: float = 70.0) -> DataFrame:
    """|frame - frame at the last multiple of n| > t: 255, else 0."""
    held = df.where(F.col("frame_no") % n == 0).select(*IMAGE, F.col("frame_no").alias("ref_no"), F.col("px").alias("ref"))
    rows = df.withColumn("ref_no", F.col("frame_no") - F.col("frame_no") % n).join(held, [*IMAGE, "ref_no"])
    return with_px(rows, F.zip_with("px", "ref", lambda a, b: F.when(F.abs(a - b) > t, 255.0).otherwise(0.0))).select(*df.columns)


def with_blur(df: DataFrame, k: int | None = None) -> DataFrame:
    """df with blur: the frame's mean component after two box means of k (a 75th of the width), for each component."""
    small_batches(df)
    schema = df.withColumn("blur", F.lit(None).cast("array<double>")).schema

    def run(batches):
        for batch in batches:
            made: list = [None] * batch.num_rows
            for shape, rows in shapes(batch).items():
                plane = blurred(stacked(batch.column("px"), rows, shape), k)
                for i, x in zip(rows, np.repeat(plane, shape[2], axis=-1)):
                    made[i] = x.ravel()
            yield batch.append_column("blur", pa.array(made, pa.list_(pa.float64())))

    return df.mapInArrow(run, schema)


def blurred(stacks: np.ndarray, k: int | None) -> np.ndarray:
    """Mean component of frames (frames, height, width, channels) after two box means of k, or of a 75th of the width."""
    size = stack.odd(k or max(1, stacks.shape[2] // 75))
    plane = stacks.mean(-1, keepdims=True)
    for _ in range(2):
        plane = stack._padded(plane, size, lambda s: stack.box(s, size), 1)
    return plane


def average_adaptive(df: DataFrame, control: float, k: int | None = None) -> DataFrame:
    """Recursive average whose rate follows the blurred difference of consecutive frames, between 0.1 and 1.

    The rate is |blur(frame) - blur(frame before)| * control, clamped; the first frame is taken as it is.
    """

    names = df.columns

    def rates(block: Block) -> np.ndarray:
        blur = np.concatenate([blurred(f.astype(np.float64).reshape(1, *block.shape), k) for f in block.all])
        rate = np.clip(np.abs(blur[block.rows] - blur[block.before]) * control, 0.1, 1.0)
        rate[block.no == 0] = 1.0
        return np.repeat(rate, block.shape[2], axis=-1).reshape(len(block.rows), -1)

    def step(block: Block, some: slice, held: np.ndarray, done: list):
        return 1 - held[:, some], block.px(some) * held[:, some]

    def finish(block: Block, chunks) -> pa.Table:
        out = np.empty((len(block.rows), block.all.shape[1]), np.float32)
        for some, done in chunks:
            out[:, some] = done[0]
        return utc(own_frames(block, out).select(names))

    return block_scan(df, [step], finish, df.schema, before=1, prepare=rates)


def top_n(preds: DataFrame, n: int, by: list[str] = KEY) -> DataFrame:
    """The n rows of greatest score of each frame; equal scores go by class_id."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "class_id")
    return preds.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def track_position(samples: DataFrame, interval: float, times: DataFrame) -> DataFrame:
    """samples(track_id, idx, x, y), times(track_id, t): linear between the samples around t, the last one from there on."""
    last = samples.groupBy("track_id").agg(F.max("idx").alias("last"))
    here = times.join(last, "track_id").withColumn("pos", F.col("t") / interval).withColumn("idx", F.least(F.floor("pos"), F.col("last")))
    after = samples.select("track_id", (F.col("idx") - 1).alias("idx"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    joined = here.join(samples, ["track_id", "idx"]).join(after, ["track_id", "idx"], "left")
    weight = F.when(F.col("x1").isNull(), 0.0).otherwise(F.col("pos") - F.col("idx"))
    lerp = lambda a, b: F.col(a) + (F.coalesce(b, a) - F.col(a)) * weight
    return joined.select("track_id", "t", lerp("x", "x1").alias("x"), lerp("y", "y1").alias("y"))
