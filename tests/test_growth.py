"""Steps that must not grow faster than their input: cubes of any edge, joins by scan, partitions by rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtable.operators import blocks as bl, grids as gr, neighbours as nb, pipelines as pl
from voxtable.operators.voxels import KEY
from voxtable.plans.storage import PARTITIONS, enough_partitions, small_side, staged_rows
from voxtable.registry import queries

VOX = "scan_id long, p int, i int, r int, v int"


def table(spark, full, scan=1):
    return spark.createDataFrame([(scan, *map(int, at), int(full[tuple(at)])) for at in np.argwhere(full > 0)], VOX)


def flooded(full, steps):
    """Each place with the smallest packed place that it is connected with within its label."""
    seen, out = set(), {}
    for start in map(tuple, np.argwhere(full > 0)):  # in packed order, so the first place met is the smallest
        todo = [] if start in seen else [start]
        seen.update(todo)
        while todo:
            at = todo.pop()
            out[at] = start
            for s in steps:
                near = tuple(np.add(at, s))
                if min(near) >= 0 and near not in seen and all(np.less(near, full.shape)) and full[near] == full[at]:
                    seen.add(near)
                    todo.append(near)
    return {k: int(bl.pack(np.array([v]))[0]) for k, v in out.items()}


@pytest.mark.parametrize(("block", "connectivity"), [(4, 1), (4, 3), (64, 1), (64, 2)])
def test_components_by_cubes_of_any_edge(spark, monkeypatch, block, connectivity):
    full = np.random.default_rng(7).choice(3, (7, 13, 9), p=[0.45, 0.45, 0.1])
    monkeypatch.setattr(bl, "WIDE", block)
    got = {(x.p, x.i, x.r): x.comp for x in nb.components(table(spark, full), "v", connectivity).collect()}
    assert got == flooded(full, bl.offsets(connectivity))


def test_a_scan_in_one_cube_takes_no_rounds(spark, monkeypatch):
    def fail(edges):
        raise AssertionError("no part reaches another cube")

    monkeypatch.setattr(nb, "graph_components", fail)
    full = np.ones((12, 40, 8), int)
    assert {x.comp for x in nb.components(table(spark, full), "v").select("comp").distinct().collect()} == {0}


@pytest.mark.parametrize("block", [4, 64])
def test_growth_and_erosion_by_cubes_of_any_edge(spark, monkeypatch, block):
    rng = np.random.default_rng(5)
    full = np.where(rng.random((7, 13, 9)) < 0.05, 1, 0)
    scans = spark.createDataFrame([(1, *full.shape)], "scan_id long, np int, ni int, nr int")
    monkeypatch.setattr(bl, "WIDE", block)
    dense = np.where(full > 0, full, bl.ABSENT)
    want = bl.grow(dense, np.ones(full.shape, bool), bl.offsets(1), 2)
    grown = nb.dilate(table(spark, full), "v", scans, 2)
    assert {(x.p, x.i, x.r) for x in grown.collect()} == set(map(tuple, np.argwhere(want != bl.ABSENT).tolist()))
    kept = bl.shrink(want, bl.offsets(2), 1)
    assert {(x.p, x.i, x.r) for x in nb.erode(grown, "v", 1, 2).collect()} == set(map(tuple, np.argwhere(kept != bl.ABSENT).tolist()))


@pytest.mark.parametrize(("n", "m"), [(12, 5), (5, 12), (7, 7), (1, 4), (4, 1), (40, 21), (39, 121), (500, 3)])
def test_nearest_voxels_without_a_shuffle(spark, n, m):
    line = spark.createDataFrame([(1, x, 0, 0, x) for x in range(-1, n + 1)], VOX)
    sizes = small_side(staged_rows(spark.createDataFrame([(1, n, m, 1, 1, 1, 1)], "scan_id long, from_p int, to_p int, from_i int, to_i int, from_r int, to_r int")))
    out = gr.resize_nearest(line, sizes)
    assert {x.p: x.v for x in out.collect()} == {t: min(int(np.floor((t + 0.5) * n / m)), n - 1) for t in range(m)}
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()


def test_voxels_are_not_shuffled_for_a_row_a_scan(spark):
    rows = spark.range(300_000).selectExpr("id div 1000 as scan_id", "cast(id % 10 as int) as p", "cast(id % 1000 div 10 as int) as i", "0 as r", "61 as sem")
    scans = small_side(staged_rows(rows.select("scan_id", F.lit(0.75).alias("zi")).distinct()))
    out = nb.trim_to_canal(staged_rows(rows), "sem", scans)
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 300_000


def test_only_scans_that_lost_voxels_are_boxed_again(spark, monkeypatch):
    """Scan 1 loses a stray piece to the box, after which the canal is shorter; scan 2 keeps all."""
    body = [(p, i, r, 49) for p in range(6) for i in range(6) for r in range(6)]
    rows = [(1, *x) for x in [*body, (5, 5, 5, 61), *[(0, 60 + i, 0, 61) for i in range(40)], (5, 11, 5, 100)]] + [(2, *x) for x in [*body, (6, 5, 5, 61)]]
    vox = spark.createDataFrame([x for x in rows if x[1:] != (5, 5, 5, 49)], "scan_id long, p int, i int, r int, sem int")
    scans = spark.createDataFrame([(k, 16, 120, 16, 1.0, 1.0, 1.0) for k in (1, 2)], "scan_id long, np int, ni int, nr int, zp double, zi double, zr double")
    seen, real = [], nb.bounding_box_clean
    monkeypatch.setattr(nb, "bounding_box_clean", lambda v, *a: seen.append({x[0] for x in v.select("scan_id").distinct().collect()}) or real(v, *a))
    out = pl.clean_semantic(vox, scans, holes=(60,), small=(42,))
    want = vox
    for _ in range(2):
        want = real(nb.trim_to_canal(want, "sem", scans), "sem", scans, 5)
    key = [*KEY, "sem"]
    assert seen == [{1, 2}, {1}] and sorted(map(tuple, out.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))


def test_partitions_follow_the_rows(spark):
    before = spark.conf.get(PARTITIONS)
    try:
        spark.conf.set(PARTITIONS, "4")
        enough_partitions(spark, 1_500_000)
        assert spark.conf.get(PARTITIONS) == "4"
        enough_partitions(spark, 36_000_000)
        assert spark.conf.get(PARTITIONS) == "72"
        spark.conf.set(PARTITIONS, "1")
        queries()["a13_fold_mean"](spark, "/root/testdata/sf0.1")
        assert spark.conf.get(PARTITIONS) == "2"
    finally:
        spark.conf.set(PARTITIONS, before)
