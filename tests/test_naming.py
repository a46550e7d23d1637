"""Naming of instances by hand-made heads."""

from pyspark.sql import functions as F

from voxtable.operators import instances as ins, labelling as la
from voxtable.sources.views import staged_views


def heads(spark, classes, scan=0):
    rows = []
    for rw, c in enumerate(classes):
        vert = [0.01] * 24
        vert[c] = 0.9
        rows.append((scan, rw, [0.0] * 3, vert, [0.0] * 12, 1.0))
    return spark.createDataFrame(rows, "scan_id int, rw int, region array<double>, vert array<double>, grp array<double>, visible double")


def column(labels, dens=(), per=40):
    """One slab of ``per`` voxels a label, from top to bottom; those of ``dens`` are dens."""
    vox = []
    for k, label in enumerate(labels):
        vox += [(0, p, 2 * k, r, 51 if label in dens else 49, label) for p in range(4) for r in range(per // 4)]
    return vox


def named(spark, labels, classes, dens=(), **options):
    vox = spark.createDataFrame(column(labels, dens), "scan_id int, p int, i int, r int, sem int, inst int")
    scans = spark.createDataFrame([(0, 3.0, 3.0, 3.0)], "scan_id int, zp double, zi double, zr double")
    out = ins.label_instances(vox.drop("sem"), heads(spark, classes), sem=vox.drop("inst"), scans=scans, **options)
    got = out.join(vox.select("p", "i", "r", F.col("inst").alias("old")), ["p", "i", "r"]).select("old", "inst").distinct().collect()
    return dict(sorted((r.old, r.inst) for r in got))


def test_labels_follow_the_heads(spark):
    assert named(spark, [1, 2, 3], [4, 5, 6]) == {1: 5, 2: 6, 3: 7}


def test_the_dens_forces_the_second_vertebra_and_the_one_before(spark):
    assert named(spark, [1, 2, 3], [4, 5, 6], dens=(2,), c1=True) == {1: 1, 2: 2, 3: 3}
    assert named(spark, [1, 2, 3], [4, 5, 6], dens=(2,)) == {1: 5, 2: 6, 3: 7}


def test_a_first_vertebra_without_a_body_is_added(spark):
    rows = [(0, p, i, r, {0: 41, 2: 49, 4: 49}[i], {0: 1, 2: 2, 4: 3}[i]) for p in range(4) for i in (0, 2, 4) for r in range(4)]
    vox = spark.createDataFrame(rows, "scan_id int, p int, i int, r int, sem int, inst int")
    scans = spark.createDataFrame([(0, 1.0, 1.0, 1.0)], "scan_id int, zp double, zi double, zr double")
    out = ins.label_instances(vox.drop("sem"), heads(spark, [1, 2]), c1=True, sem=vox.drop("inst"), scans=scans)
    assert sorted(r.inst for r in out.select("inst").distinct().collect()) == [1, 2, 3]
    assert {r.inst for r in out.filter("i = 0").collect()} == {1}


def test_relative_and_t13_costs(spark):
    rows = spark.createDataFrame([(0, r, [0.5] * 6, [0.0, v]) for r, v in enumerate((0.2, 0.6))], "scan_id int, rw int, vertrel array<double>, vt13 array<double>")
    t13 = {r.rw: round(r.w, 6) for r in la.t13_costs(rows).collect()}
    assert t13 == {0: -0.1, 1: -0.3}
    rel = {(r.rw, r.col): round(r.w, 4) for r in la.relative_costs(rows).collect()}
    assert rel[0, 0] == -0.3 and abs(rel[0, 1] + 0.3) < 1e-4  # column sums of 1 and a little stay as they are


def test_discs_and_endplates_are_attached_by_short_plans(spark):
    """The driver keeps and compiles every plan; in one with all components of both labels it needed too much memory."""
    vox, _ = staged_views(spark, "/root/testdata/sf0.001")
    out = ins.attach_ivd_endplates(vox, vox.filter("inst > 0"), corpus=49)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") < 20
    assert out.count() == vox.filter("inst > 0 or sem in (62, 100)").count()
