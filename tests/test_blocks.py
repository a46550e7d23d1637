"""Which cubes are formed, and which part of them is looked at."""

import numpy as np
import pytest

from voxtable.operators import blocks as bl, neighbours as nb

VOX = "scan_id long, p int, i int, r int, v int"


@pytest.mark.parametrize("halo", [1, 8])
def test_no_cube_below_zero(spark, halo):
    vox = spark.createDataFrame([(1, p, i, 0, 7) for p in (0, 31) for i in (0, 40)], VOX)
    run = lambda layers, corner, _: {"c": [",".join(map(str, (corner + halo) // bl.BLOCK))]}
    found = {row["c"] for row in bl.by_block([(vox, "v")], ["scan_id"], halo, run, "c string").collect()}
    assert found == ({"0,0,0", "1,0,0", "0,1,0", "1,1,0"})


def test_voxels_below_zero_raise(spark):
    vox = spark.createDataFrame([(1, 0, -1, 0, 7)], VOX)
    with pytest.raises(Exception, match="indices of voxels must lie in"):
        nb.erode(vox, "v").collect()


def test_growth_looks_at_what_can_be_grown_into():
    edge = bl.BLOCK + 16
    place = np.ravel_multi_index(([10, 12], [20, 20], [9, 9]), (edge,) * 3)
    window = bl.window_of(place, 8)
    assert bl.clipped(window, place, np.array([[8, 8, 8], [19, 47, 15]]), 8) == (slice(8, 20), slice(12, 29), slice(8, 16))
    assert bl.clipped(window, place, np.array([[0] * 3, [-1] * 3]), 8) == (slice(10, 13), slice(20, 21), slice(9, 10))


def test_growth_in_a_clipped_window_equals_growth_in_the_whole(spark):
    rng = np.random.default_rng(3)
    shape = (5, 40, 35)
    full = np.where(rng.random(shape) < 0.002, rng.integers(1, 4, shape), bl.ABSENT)
    free = rng.random(shape) < 0.6
    rows = [(1, *map(int, at), int(full[tuple(at)])) for at in np.argwhere(full != bl.ABSENT)]
    mask = spark.createDataFrame([(1, *map(int, at), 1) for at in np.argwhere(free)], VOX)
    scans = spark.createDataFrame([(1, *shape)], "scan_id long, np int, ni int, nr int")
    vox, steps = spark.createDataFrame(rows, VOX), bl.offsets(3)
    for want, got in (
        (bl.grow(full, free, steps, 11), nb.dilate(vox, "v", scans, 11, 3, mask=mask)),
        (bl.grow(full, np.ones(shape, bool), steps, 3), nb.dilate(vox, "v", scans, 3, 3)),
    ):
        expected = {(*map(int, at), int(want[tuple(at)])) for at in np.argwhere(want != bl.ABSENT)}
        assert {tuple(row)[1:] for row in got.collect()} == expected
