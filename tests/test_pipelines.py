"""Entry pipelines on typed volumes: instances on the stored grid, labels, codes per scan, cervical skips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtable.operators import pipelines as pl
from voxtable.operators.voxels import KEY
from voxtable.queries.q_pipelines import merged_bodies
from voxtable.registry import queries

SF = "/root/testdata/sf0.001"
VERTS = ((4, 11), (18, 25), (32, 39))  # heights of three bodies


def phantom():
    """Bodies with posterior parts, endplates on both sides of each disc and below the last body: (p, i, r, sem)."""
    rows = []
    for lo, hi in VERTS:
        rows += [(p, i, r, 49) for p in range(2, 10) for i in range(lo, hi + 1) for r in range(2, 10)]
        rows += [(p, i, r, 41) for p in range(10, 13) for i in range(lo + 2, hi - 1) for r in range(4, 8)]
    for i, sem in ((12, 62), (14, 100), (15, 100), (17, 62), (26, 62), (28, 100), (29, 100), (31, 62), (40, 62)):
        rows += [(p, i, r, sem) for p in range(2, 10) for r in range(2, 10)]
    return rows


def body_of(i):
    return min(range(3), key=lambda k: abs(i - sum(VERTS[k]) / 2))


def three():
    def run(batch):
        near = batch["i"].to_numpy() - 12
        return np.stack([np.full(len(batch), 0.5), near < -6, abs(near) <= 6, near > 6], axis=1).astype(float)

    return run


def frame(spark, scans, volumes):
    table = spark.createDataFrame(scans, "scan_id int, np int, ni int, nr int, zp double, zi double, zr double, orientation string")
    vox = spark.createDataFrame([(k, p, i, r, float(100 + sem) if sem else 0.0, sem) for k, rows in volumes.items() for p, i, r, sem in rows], "scan_id int, p int, i int, r int, intensity double, sem int")
    return table, vox


MODEL = pl.InstanceModel(cutout=(20, 24, 20), high_zoom=(2.0, 2.0, 2.0))


def test_instances_lie_on_the_stored_grid(spark):
    turned = [(43 - i, r, p, sem) for p, i, r, sem in phantom()]  # stored as S, R, P
    scans, vox = frame(spark, [(0, 16, 44, 12, 1.0, 1.0, 1.0, None), (1, 44, 12, 16, 1.0, 1.0, 1.0, "SRP"), (2, 8, 8, 8, 1.0, 1.0, 1.0, "PIR"), (3, 8, 8, 8, 1.0, 1.0, 1.0, "PIR")], {0: phantom(), 1: turned, 2: [(3, 3, 3, 100)], 3: [(3, 3, 3, 49)]})
    inst, codes = pl.build_instances(vox, scans, three, MODEL)
    assert sorted(map(tuple, codes.collect())) == [(2, "EMPTY"), (3, "UNKNOWN")]
    want = {(p, i, r): body_of(i) for p, i, r, sem in phantom() if sem in (41, 49)}
    found = {0: {}, 1: {}}
    for x in inst.collect():
        place = (x.p, x.i, x.r) if x.scan_id == 0 else (x.r, 43 - x.p, x.i)
        found[x.scan_id][place] = x.inst
    for got in found.values():
        assert got.keys() == want.keys()
        assert len({(want[k], v) for k, v in got.items()}) == 3 == len(set(got.values()))


def test_labels_and_endplates_after_post_processing(spark):
    scans, vox = frame(spark, [(0, 16, 44, 12, 1.0, 1.0, 1.0, None)], {0: phantom()})
    inst = vox.filter("sem in (41, 49)").withColumn("inst", F.lit(9) - F.floor(F.col("i") / 14).cast("int"))
    sem, full = pl.postprocess(vox, inst, scans)
    assert {r.inst for r in full.select("inst").distinct().collect()} == {1, 2, 3, 101, 102, 201, 202, 203}
    parts = {(r.i, r.sem) for r in sem.filter("sem between 52 and 62").select("i", "sem").distinct().collect()}
    below, above = pl.PARTS["inferior"], pl.PARTS["superior"]
    assert parts == {(12, below), (17, above), (26, below), (31, above), (40, below)}
    heights = {r.inst: r.i for r in full.filter("inst < 40").groupBy("inst").agg(F.min("i").alias("i")).collect()}
    assert heights == {1: 4, 2: 18, 3: 32}
    assert vox.count() == sem.count() == full.count()


def test_sacrum_dens_and_decoded_names(spark):
    rows = phantom() + [(p, 42, 5, 26) for p in range(3, 6)] + [(10, 5, 4, 51)]
    scans, vox = frame(spark, [(0, 16, 44, 12, 1.0, 1.0, 1.0, None)], {0: rows})
    inst = vox.filter("sem in (41, 49)").withColumn("inst", 1 + F.floor(F.col("i") / 14).cast("int"))
    one = lambda n, k: [1.0 if x == k else 0.0 for x in range(n)]
    heads = spark.createDataFrame([(0, k, one(3, 0), one(24, 2 + k), one(12, 2), 1.0) for k in range(3)], "scan_id int, rw int, region array<double>, vert array<double>, grp array<double>, visible double")
    _, full = pl.postprocess(vox, inst, scans, heads=heads)
    assert {r.inst for r in full.select("inst").distinct().collect()} >= {3, 4, 5, 103, 104, 203, 204, 205, 26, 2}
    assert [r.inst for r in full.filter("i = 42").select("inst").distinct().collect()] == [26]


def test_each_scan_gets_its_own_code_and_the_others_go_on(spark, tmp_path):
    box = (1.0, 1.0, 1.0, None)
    whole = [*phantom(), *[(13, i, r, 61) for i in range(44) for r in (5, 6)], (0, 0, 0, 0)]
    scans, vox = frame(
        spark,
        [(0, 16, 44, 12, *box), (1, 16, 30, 12, *box), (2, 16, 44, 12, *box), (3, 16, 44, 12, *box), (4, 16, 44, 12, *box), (5, 16, 44, 12, *box)],
        {0: whole, 1: whole, 2: [(1, 1, 1, 0)], 3: whole, 4: whole},
    )
    none = F.lit(None).cast("string")
    catalog = scans.select(F.col("scan_id").alias("file_id"), F.col("scan_id").alias("subject"), F.lit("T2w").alias("format"), F.when(F.col("scan_id") == 3, "ax").otherwise("sag").alias("acq"), none.alias("seg"), none.alias("label"), none.alias("part"))
    manifest = spark.createDataFrame([(4, n) for n in ("out_spine", "out_vert", "out_snap", "out_ctd")], "scan_id int, name string")
    models = spark.createDataFrame([("sem", ["T2w"], "sag", ["T2w"]), ("inst", ["T2w"], "sag", ["T2w", "SEG"])], "model_id string, formats array<string>, acquisition string, modality array<string>")
    pairs = spark.createDataFrame([("sem", "inst")], "semantic string, instance string")
    out = pl.process_dataset(catalog, manifest, vox, scans, three, ["T2w"], ["sag", "ax"], models=models, pairs=pairs, model=MODEL, sinks=str(tmp_path))
    codes = {r.scan_id: r.errcode for r in out["run_log"].collect()}
    assert codes == {0: "OK", 1: "SHAPE", 2: "EMPTY", 3: "COMPATIBILITY", 4: "ALL_DONE", 5: "EMPTY"}
    got = out["summary"].head()
    assert (got.seen, got.ok, got.all_done, got.failed, got.codes) == (6, 1, 1, 4, ["COMPATIBILITY", "EMPTY", "SHAPE"])
    labels = {r.inst for r in out["instances"].select("inst").distinct().collect()}
    assert labels == {1, 2, 3, 101, 102, 201, 202, 203} and {r.scan_id for r in out["instances"].select("scan_id").distinct().collect()} == {0}
    assert spark.read.parquet(f"{tmp_path}/instances").count() == out["instances"].count()
    assert out["plan"].filter("run_semantic").count() == 5
    # Models that don't go together stop what isn't finished.
    wrong = models.withColumn("acquisition", F.when(F.col("model_id") == "inst", "ax").otherwise(F.col("acquisition")))
    log = pl.process_dataset(catalog, manifest, vox, scans, three, ["T2w"], ["sag"], models=wrong, pairs=pairs, model=MODEL)["run_log"]
    assert {r.scan_id: r.errcode for r in log.collect()} == {0: "COMPATIBILITY", 1: "COMPATIBILITY", 2: "COMPATIBILITY", 4: "ALL_DONE", 5: "COMPATIBILITY"}


@pytest.mark.parametrize("skip", [True, False])
def test_a_cervical_class_may_be_skipped(spark, skip):
    def scorer():
        def run(batch):
            out = np.zeros((len(batch), 46))
            for k, rw in enumerate(batch["rw"]):
                out[k, 0] = 1.0
                out[k, 3 + (rw + 2 if rw < 2 else rw + 3)] = 1.0  # C3, C4, C6, C7
                out[k, 39] = 1.0
            return out

        return run

    rows = spark.createDataFrame([(0, k) for k in range(4)], "scan_id int, rw int")
    got = [r.label for r in pl.label_cutouts(rows, ["scan_id", "rw"], scorer, cervical_skip=skip).orderBy("rw").collect()]
    assert got == ([3, 4, 6, 7] if skip else got) and (skip or got != [3, 4, 6, 7])


def test_small_components_are_deleted_by_their_volume(spark):
    whole = [*phantom(), *[(13, i, r, 61) for i in range(44) for r in (5, 6)]]
    rows = whole + [(14, 2, 2, 41), (14, 2, 3, 41)]
    scans, vox = frame(spark, [(0, 16, 44, 12, 1.0, 1.0, 1.0, None)], {0: rows})
    out = pl.clean_semantic(vox.select(*KEY, "sem"), scans)
    assert out.filter("p = 14").count() == 0 and out.count() == len(whole)


def test_query_of_merged_bodies_equals_a_dense_version(spark):
    from tests.test_splitting import dense_split

    rows = merged_bodies(spark, SF).collect()
    got = {(r.scan_id, r.p, r.i, r.r): r.inst for r in queries()["i13_i14_split_merged"](spark, SF).collect()}
    for scan in {r.scan_id for r in rows}:
        a = np.zeros((12, 40, 8), bool)
        for r in rows:
            if r.scan_id == scan:
                a[r.p, r.i, r.r] = True
        below = dense_split(a)
        assert below is not None and below.any()
        assert {k[1:]: v for k, v in got.items() if k[0] == scan} == {tuple(map(int, x)): 2 if below[tuple(x)] else 1 for x in np.argwhere(a)}
