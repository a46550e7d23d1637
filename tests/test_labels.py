"""Errors, overrides and geometry on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from voxtable.functions import labels as lb, units as un
from voxtable.operators import labelling as la, neighbours as nb, points as pt, regions as rg, targets as tg, tiles as tl
from voxtable.sources import catalog as ct


def test_unknown_names_and_unequal_arrays_fail(spark):
    df = spark.createDataFrame([({"1": "S1", "2": "7"},)], "m map<string,string>")
    assert df.select(ct.resolve_labels(F.col("m"), {"C1": 1}, {"S1": 26})).head()[0] == {"1": 26, "2": 7}
    bad = spark.createDataFrame([({"1": "nowhere"},)], "m map<string,string>")
    with pytest.raises(Exception, match="unknown label"):
        bad.select(ct.resolve_labels(F.col("m"), {"C1": 1})).collect()
    with pytest.raises(Exception, match="unequal"):
        spark.range(1).select(un.zip_strict(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2)))).collect()
    with pytest.raises(Exception, match="unsupported"):
        ct.modality_keys(spark.createDataFrame([("PD",)], "modality string")).collect()


def test_label_override_and_removal(spark):
    rows = [(1, 18), (1, 19), (1, 28), (2, 19), (2, 20), (3, 20)]
    anomalies = [(1, False, False, False, [17, 18, 19]), (2, False, True, False, None), (3, False, True, False, None)]
    out = tg.apply_anomalies(spark.createDataFrame(rows, "subject int, label int"), spark.createDataFrame(anomalies, "subject int, t11 boolean, t13 boolean, remove boolean, label_override array<int>"))
    got = {(r.subject, r.label): (r.actual, r.removed) for r in out.collect()}
    assert [got[1, x][0] for x in (18, 19, 28)] == [17, 18, 19]
    assert got[2, 20] == (28, False) and got[3, 20] == (28, True)


def test_one_hot_targets(spark):
    row = spark.createDataFrame([(1, 20, 2, 4, "0")], "subject int, actual int, vert_region int, vert_rel int, vert_cut string")
    out = tg.objective_vectors(row, ["REGION", "VERTREL", "FULLYVISIBLE"]).head()
    assert (out.REGION, out.VERTREL, out.FULLYVISIBLE) == ([0, 0, 1], [0, 0, 0, 0, 1, 0], [0, 1])
    with pytest.raises(ValueError, match="vert_exact"):
        tg.objective_vectors(row, ["VERT"])


def test_partial_group_in_the_middle_fails(spark):
    rows = spark.createDataFrame([(1, i, g) for i, g in enumerate([0, 0, 1, 2, 2])], "scan_id int, rw int, grp int")
    with pytest.raises(Exception, match="partial group"):
        la.group_sequence_to_class(rows).collect()
    assert spark.range(1).select(lb.region_of(F.lit(19))).head()[0] == 2


def test_component_centres_and_nearest_vertices(spark):
    block = lambda i0: [(0, p, i, r, 1) for p in (1, 2) for i in (i0, i0 + 1) for r in (1, 2)]
    vox = spark.createDataFrame(block(6) + block(1), "scan_id int, p int, i int, r int, sem int")
    st = nb.component_stats(nb.components(vox, "sem", 1), "sem").orderBy("rank").collect()
    assert [(r.cp, r.ci, r.cr) for r in st] == [(1, 1, 1), (1, 6, 1)]
    line = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 10.0, 0.0, 0.0)], "scan_id int, k int, x double, y double, z double")
    points = spark.createDataFrame([(0, 1, 0.4, 5.0, 0.0), (0, 2, 10.0, 0.0, 0.0)], "scan_id int, disc int, x double, y double, z double")
    got = {r.disc: (r.k, round(r.d2, 6)) for r in pt.nearest_on_line(points, line, ["disc"]).collect()}
    assert got == {1: (0, 25.16), 2: (1, 0.0)}


def test_as_of_is_strict_and_falls_back(spark):
    bases = spark.createDataFrame([(0, 5, 1.0), (0, 3, 1.0), (0, 7, 4.0)], "scan_id int, label int, ci double")
    points = spark.createDataFrame([(0, 1, 1.0), (0, 2, 4.0), (0, 3, 4.5)], "scan_id int, label int, ci double")
    got = {r.label: (r.base, r.above_all) for r in rg.asof_lower(points, bases).collect()}
    assert got == {1: (3, True), 2: (3, False), 3: (7, False)}


def test_tiles_cover_every_place(spark):
    scans = spark.createDataFrame([(0, 5, 33, 8)], "scan_id int, np int, ni int, nr int")
    vox = spark.createDataFrame([(0, p, i, r) for p in range(5) for i in range(33) for r in range(8)], "scan_id int, p int, i int, r int")
    out = tl.with_weight(tl.tile_assign(vox, scans, (6, 16, 4)), (6, 16, 4))
    assert out.select("p", "i", "r").distinct().count() == vox.count() and out.filter("weight <= 0 or weight > 1").count() == 0
