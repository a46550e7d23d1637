"""Splitting of merged bodies, centres of both kinds of scans and the model's grid, against dense versions."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtable.operators import grids as gr, instances as ins, splitting as sp
from voxtable.operators.voxels import KEY

SHAPE = (16, 26, 16)


def around(a, combine, start):
    """Each place with its 26 neighbours, outside being ``start``."""
    wide = np.pad(a, 1, constant_values=start)
    out = a.copy()
    for o in product((0, 1, 2), repeat=3):
        out = combine(out, wide[tuple(slice(x, x + n) for x, n in zip(o, a.shape, strict=True))])
    return out


def parts(a):
    """Components (26-connected), largest first, the first met first on ties."""
    left, out = a.copy(), []
    while left.any():
        seed = np.zeros_like(a)
        seed[tuple(np.argwhere(left)[0])] = True
        while True:
            more = around(seed, np.logical_or, False) & left
            if (more == seed).all():
                break
            seed = more
        out.append(seed)
        left &= ~seed
    return sorted(out, key=lambda x: -x.sum())


def dense_split(a):
    """True below the plane; None where the body can't be split."""
    now, old = a.copy(), a.copy()
    for _ in range(11):
        less = around(now, np.logical_and, False)
        found = parts(less)
        if len(found) > 1:
            s, t = found[:2]
            break
        if not found:
            core = now.copy()
            if (core == old).all():
                return None
            while core.sum() / old.sum() < 0.5:
                more = around(core, np.logical_or, False) & old
                if (more == core).all():
                    return None
                core = more
            if not (old & ~core).any():
                return None
            s, t = parts(core)[0], parts(old & ~core)[0]
            break
        old, now = now, less
    else:
        return None
    u, v, turn = around(s, np.logical_or, False), around(t, np.logical_or, False), 0
    while not (u & v).any():
        if turn == 0:
            u = around(u, np.logical_or, False)
        else:
            v = around(v, np.logical_or, False)
        turn = 1 - turn
    middle = lambda x: np.argwhere(x).sum(0) / x.sum()
    c, n = middle(u & v), middle(s) - middle(t)
    k = int(np.argmax(np.abs(n)))
    d1, d2 = (x for x in range(3) if x != k)
    plane = np.zeros(a.shape, bool)
    shift = -(c[0] * n[0] + c[1] * n[1] + c[2] * n[2])
    for x, y in product(range(a.shape[d1]), range(a.shape[d2])):
        z = min(max((-n[d1] * x - n[d2] * y - shift) / n[k], 0), a.shape[k] - 1)
        at = [0, 0, 0]
        at[k], at[d1], at[d2] = int(z), x, y
        plane[tuple(at)] = True
    above = np.flip(np.maximum.accumulate(np.flip(plane, 1), axis=1), 1)
    return a & ~above


def bodies():
    neck = np.zeros(SHAPE, bool)  # unequal halves
    neck[2:10, 2:8, 2:10] = True
    neck[1:13, 10:22, 1:13] = True
    neck[5:7, 8:10, 5:7] = True
    taper = np.zeros(SHAPE, bool)  # without a neck: wears away in one piece
    taper[4:9, 2:7, 4:9] = True
    taper[5:8, 7:24, 5:8] = True
    convex = np.zeros(SHAPE, bool)  # a core that grows by one voxel is the whole
    convex[3:12, 2:21, 3:12] = True
    slab = np.zeros(SHAPE, bool)  # wears away at once
    slab[3:5, 2:20, 3:12] = True
    leaning = np.zeros(SHAPE, bool)  # the plane stands across the first axis
    leaning[0:6, 4:10, 4:10] = True
    leaning[8:15, 6:13, 4:11] = True
    leaning[6:8, 7:9, 6:8] = True
    return [neck, taper, leaning, convex, slab]


def frame(spark, arrays):
    rows = [(k, *map(int, x), 1) for k, a in enumerate(arrays) for x in np.argwhere(a)]
    scans = spark.createDataFrame([(k, *SHAPE, 1.0, 1.0, 1.0) for k in range(len(arrays))], "scan_id int, np int, ni int, nr int, zp double, zi double, zr double")
    return spark.createDataFrame(rows, "scan_id int, p int, i int, r int, inst int"), scans


def test_bodies_are_cut_where_a_dense_version_cuts_them(spark):
    arrays = bodies()
    vox, scans = frame(spark, arrays)
    flagged = spark.createDataFrame([(k, 1) for k in range(len(arrays))], "scan_id int, target int")
    out = sp.split_merged(vox, flagged, scans).collect()
    assert len(out) == vox.count()
    cut = []
    for k, a in enumerate(arrays):
        want, got = dense_split(a), np.zeros(SHAPE, int)
        for r in out:
            if r.scan_id == k:
                got[r.p, r.i, r.r] = r.inst
        cut.append(want is not None)
        assert ((got == 2) == (a & False if want is None else want)).all(), k
        assert ((got > 0) == a).all()
    assert cut == [True, True, True, False, False]


def test_unequal_halves_are_cut_at_the_contact(spark):
    vox, scans = frame(spark, bodies()[:1])
    out = sp.split_merged(vox, spark.createDataFrame([(0, 1)], "scan_id int, target int"), scans)
    ends = {r.inst: (r.lo, r.hi) for r in out.groupBy("inst").agg(F.min("i").alias("lo"), F.max("i").alias("hi")).collect()}
    assert ends[1][0] == 2 and ends[1][1] in (8, 9) and ends[2][0] in (8, 9) and ends[2][1] == 21


def test_centres_of_scans_with_and_without_the_dense_label(spark):
    rows = []
    for scan, label in ((0, 50), (1, 49)):
        rows += [(scan, p, i, r, label) for b in range(3) for p in range(2, 11) for i in range(12 * b + 2, 12 * b + 11) for r in range(2, 11)]
        rows += [(scan, p, 12 * b + 12, r, 100) for b in range(2) for p in range(2, 11) for r in range(2, 11)]
        rows += [(scan, p, i, r, 51) for p in (5, 6) for i in (0, 1) for r in (5, 6)]
    rows += [(0, 0, 5, 0, 49), (1, 13, 20, 13, 49), (2, 1, 1, 1, 100)]
    sem = spark.createDataFrame(rows, "scan_id int, p int, i int, r int, sem int")
    scans = spark.createDataFrame([(k, 14, 40, 14, 1.0, 1.0, 1.0) for k in range(3)], "scan_id int, np int, ni int, nr int, zp double, zi double, zr double")
    got = [tuple(r) for r in ins.corpus_centers(sem, scans, cleaning_mm3=8.0).orderBy("scan_id", "rank").collect()]
    three = [(6.0, 30.0, 6.0), (6.0, 18.0, 6.0), (6.0, 6.0, 6.0)]
    assert got == [(0, 1, 5.5, 0.5, 5.5), *[(0, k + 2, *c) for k, c in enumerate(three)], *[(1, k + 1, *c) for k, c in enumerate(three)]]


def test_a_merged_body_gets_two_centres(spark):
    heights = [(2, 9), (12, 19), (22, 40), (43, 50), (53, 60)]
    rows = [(0, p, i, r, 50) for lo, hi in heights for p in range(8) for i in range(lo, hi + 1) for r in range(8) if not (30 <= i <= 32 and not (p in (3, 4) and r in (3, 4)))]
    rows += [(0, p, hi + 2, r, 100) for lo, hi in heights if hi not in (19,) for p in range(8) for r in range(8)]
    sem = spark.createDataFrame(rows, "scan_id int, p int, i int, r int, sem int")
    scans = spark.createDataFrame([(0, 8, 64, 8, 1.0, 1.0, 1.0)], "scan_id int, np int, ni int, nr int, zp double, zi double, zr double")
    got = [r.ci for r in ins.corpus_centers(sem, scans).orderBy("rank").collect()]
    assert len(got) == 6 and got[0] == 56.5 and [round(x) for x in got[2:4]] == [36, 26]


@pytest.mark.parametrize("pad", [0, 2])
def test_model_grid_equals_a_dense_version_and_comes_back(spark, pad):
    rng, shape = np.random.default_rng(1), (9, 14, 6)
    codes, data = ["PIR", "ASL", "LPI", "SRA"], []
    for _ in codes:
        a = np.zeros(shape, int)
        a[1:8, 2:12, 1:5] = rng.integers(0, 4, (7, 10, 4))
        data.append(a)
    rows = [(k, *map(int, x), int(a[tuple(x)])) for k, a in enumerate(data) for x in np.argwhere(a)]
    vox = spark.createDataFrame(rows, "scan_id int, p int, i int, r int, sem int")
    scans = spark.createDataFrame([(k, *shape, 1.0, 0.5, 2.0, c) for k, c in enumerate(codes)], "scan_id int, np int, ni int, nr int, zp double, zi double, zr double, orientation string")
    low, high = F.array(*map(F.lit, (0.5, 0.5, 0.5))), F.array(*map(F.lit, (0.8, 0.8, 2.0)))
    cut, model, grid = gr.to_model_grid(vox, gr.model_grid(scans, low, high, pad), margin_mm=1.0)
    got, back = cut.collect(), gr.from_model_grid(cut, grid).collect()
    sizes = {r.scan_id: r for r in model.collect()}
    for k, (a, code) in enumerate(zip(data, codes, strict=True)):
        axes = [next(j for j, c in enumerate(code) if c in pair) for pair in gr.LETTERS]
        dense = a.transpose(axes)
        for j, pair in enumerate(gr.LETTERS):
            if pair[0] not in code:
                dense = np.flip(dense, j)
        zoom = [(1.0, 0.5, 2.0)[x] for x in axes]
        dense = np.pad(dense, pad, mode="edge")
        target = [min(max(z, 0.5), h) for z, h in zip(zoom, (0.8, 0.8, 2.0), strict=True)]
        before = dense.shape
        for j in range(3):
            m = int(np.round(before[j] * zoom[j] / target[j]))
            at = np.minimum(((np.arange(m) + 0.5) * before[j] / m).astype(int), before[j] - 1)
            dense = dense.take(at, axis=j)
        d = int(np.ceil(1.0 / min(target)))
        places = np.argwhere(dense)
        lo, hi = np.maximum(places.min(0) - d, 0), np.minimum(places.max(0) + d, np.array(dense.shape) - 1)
        crop = dense[tuple(slice(x, y + 1) for x, y in zip(lo, hi, strict=True))]
        assert (sizes[k]["np"], sizes[k]["ni"], sizes[k]["nr"]) == crop.shape
        assert {(*map(int, x), int(crop[tuple(x)])) for x in np.argwhere(crop)} == {(r.p, r.i, r.r, r.sem) for r in got if r.scan_id == k}
        # All zooms of this model are at most those of the scan along an axis, or near it: what comes back lies on the stored grid.
        mine = {(r.p, r.i, r.r): r.sem for r in back if r.scan_id == k}
        assert all(0 <= x < n for at in mine for x, n in zip(at, shape, strict=True))
        if all(t <= z for t, z in zip(target, zoom, strict=True)):
            assert mine == {tuple(map(int, x)): int(a[tuple(x)]) for x in np.argwhere(a)}
    assert set(cut.columns) == {*KEY, "sem"}
