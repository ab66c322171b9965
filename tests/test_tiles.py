"""Tiles with halos against whole frames, with sides that tiles don't divide and reaches over several tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import stack
from framelake.operators import filters, objects, tiles

from .test_frames import frames, px, same


def scenes(n=2, h=37, w=50):
    rng = np.random.default_rng(3)
    y, x = np.mgrid[:h, :w]
    return [np.where(np.sin(x / (2 + k)) * np.cos(y / 3) + rng.normal(0, 0.3, (h, w)) > 0.3, 200 + k, rng.integers(0, 120, (h, w))).astype(float) for k in range(n)]


@pytest.mark.parametrize(("w", "h"), [(16, 16), (7, 40), (64, 64), (5, 3)])
def test_filters_sums_and_groups_of_tiles(spark, w, h):
    source = scenes()
    df = frames(spark, source)
    cut = tiles.split(df, w, h)
    assert cut.count() == 2 * -(-50 // w) * -(-37 // h)
    assert same(px(tiles.merge(cut)), source)
    wide = tiles.with_halo(cut, 4)
    for fn, whole in ((lambda s: stack.box(s, 9), filters.box(df, 9)), (lambda s: stack.gauss(s, 2.0, 7), filters.gauss(df, 2.0, 7)), (lambda s: stack.extreme(s, 5, True), filters.dilate(df, 5)), (stack.laplacian, filters.laplacian(df))):
        assert all(np.abs(a - b).max() < 1e-3 for a, b in zip(px(tiles.merge(tiles.filtered(wide, fn))), px(whole), strict=True))
    same_px = tiles.with_halo(cut, 4).select(*tiles.AT, "px").exceptAll(tiles.split(df, w, h, 4).select(*tiles.AT, "px"))
    assert same_px.count() == 0
    sums = tiles.merge(tiles.integral(cut))
    assert all(np.abs(np.array(r.px).reshape(37, 50) - v.cumsum(0).cumsum(1)).max() < 1e-6 for r, v in zip(sums.orderBy("frame_no").collect(), source))
    for border in (True, False):
        on = frames(spark, [np.where(v > 150, 255.0, 0.0) for v in source])
        found = tiles.components(tiles.with_halo(tiles.split(on, w, h), 1), border)
        columns = ["frame_no", "rect_id", "l", "r", "t", "b"]
        assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, objects.components(on, border).select(*columns).collect()))


def test_tiles_of_colour_and_of_nothing(spark):
    rgb = np.stack(scenes(3), -1)
    df = frames(spark, [rgb[:, :, 0]]).withColumns({"px": F.lit(rgb.ravel().tolist()).cast("array<float>"), "pix_fmt": F.lit("RGB_8")})
    back = tiles.merge(tiles.filtered(tiles.with_halo(tiles.split(df, 20, 9), 2), lambda s: stack.box(s, 5)))
    assert np.abs(np.array(back.first().px) - np.array(filters.box(df, 5).first().px)).max() < 1e-3
    sums = np.array(tiles.merge(tiles.integral(tiles.split(df, 20, 9))).first().px).reshape(rgb.shape)
    assert np.abs(sums - rgb.cumsum(0).cumsum(1)).max() < 1e-6
    none = tiles.with_halo(tiles.split(df.where("false"), 4, 4), 1)
    assert tiles.merge(none).count() == tiles.components(none).count() == tiles.integral(none).count() == 0


def test_tiles_of_one_place_pass_as_a_stack(spark):
    """Filters get the tiles of many frames in a call, in batches that split frames too."""
    source = [np.full((6, 9), k, float) for k in range(200)]
    df = frames(spark, source).coalesce(1)
    sizes = tiles.filtered(tiles.split(df, 4, 4, 1), lambda s: np.full(s.shape, len(s), float))
    assert min(r.px[0] for r in sizes.collect()) > 1
    back = tiles.merge(tiles.filtered(tiles.with_halo(tiles.split(df, 4, 4), 1), lambda s: s))
    assert same(px(back), source)
