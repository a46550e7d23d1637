"""Invariants of morphology, components and merging, sources and sinks."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtable.functions import units as un
from voxtable.operators import instances as ins, neighbours as nb, overlap as ov
from voxtable.operators.voxels import KEY
from voxtable.sources import catalog as ct
from voxtable.sources.views import view
from voxtable.sources.volumes import VolumeDataSource

SF = "/root/testdata/sf0.001"


def places(df):
    return {tuple(r) for r in df.select(*KEY).collect()}


def test_growing_and_shrinking(spark):
    vox, scans = view(spark, SF, "vox").filter("inst > 0"), view(spark, SF, "scans")
    small, same, big = places(nb.erode(vox, "inst")), places(vox), places(nb.dilate(vox, "inst", scans))
    assert small <= same <= big and small and len(big) > len(same)


def test_components_do_not_depend_on_partitions(spark):
    vox = view(spark, SF, "vox").filter("(p + i + r) % 3 <> 0")
    a = {tuple(r) for r in nb.components(vox, "sem", 1).collect()}
    b = {tuple(r) for r in nb.components(vox.repartition(7), "sem", 1).collect()}
    assert a == b and len(a) == vox.count()


def test_infection_covers_what_it_can_reach(spark):
    vox, scans = view(spark, SF, "vox"), view(spark, SF, "scans")
    own, missing = vox.filter("inst > 0"), vox.filter("inst = 0")
    grown = nb.infect(own, "inst", missing, scans)
    left = missing.select(*KEY).join(grown.select(*KEY), KEY, "left_anti")
    assert nb.shifted(left, 1).select(*KEY).join(grown.select(*KEY), KEY, "left_semi").count() == 0


def test_missing_components_are_assigned_or_deleted(spark):
    vox, scans = view(spark, SF, "vox"), view(spark, SF, "scans")
    inst, deleted = nb.assign_missing(vox, vox.filter("inst > 0 and p > 1"), scans)
    assert places(inst) | places(deleted) == places(vox) and not places(inst) & places(deleted)


def test_couples_claim_disjoint_voxels(spark):
    preds = view(spark, SF, "preds")
    out = ov.merge_couples(preds, ov.couple_predictions(preds))
    assert out.count() == out.select(*KEY).distinct().count() and places(out) <= places(preds)
    assert [r.inst for r in out.select("inst").distinct().orderBy("inst").collect()] == list(range(1, 1 + out.select("inst").distinct().count()))


def test_merged_bodies_are_split_in_the_middle(spark):
    rows = [(0, p, i, r, 1) for p in range(6) for i in range(18) for r in range(6) if i not in (8, 9) or (p == 2 and r == 3)]
    vox = spark.createDataFrame(rows, "scan_id int, p int, i int, r int, inst int")
    scans = spark.createDataFrame([(0, 6, 18, 6)], "scan_id int, np int, ni int, nr int")
    out = ins.split_merged(vox, spark.createDataFrame([(0, 1)], "scan_id int, target int"), scans)
    sides = {r.inst: (r.lo, r.hi) for r in out.groupBy("inst").agg(F.min("i").alias("lo"), F.max("i").alias("hi")).collect()}
    assert set(sides) == {1, 2} and sorted(v for s in sides.values() for v in s)[0] == 0 and {s[1] < 10 for s in sides.values()} == {True, False}


def test_endplates_go_to_both_neighbours(spark):
    rows = [(0, p, i, 0, 1 + i // 5) for p in range(3) for i in range(10) if i not in (3, 4)]
    plates = [(0, p, i, 0, 201) for p in range(3) for i in (3, 4)]
    schema = "scan_id int, p int, i int, r int, inst int"
    scans = spark.createDataFrame([(0, 3, 10, 1)], "scan_id int, np int, ni int, nr int")
    out = {(r.p, r.i): r.part for r in nb.split_endplates(spark.createDataFrame(rows, schema), spark.createDataFrame(plates, schema), scans).collect()}
    assert out == {(p, i): "inferior" if i == 3 else "superior" for p in range(3) for i in (3, 4)}


def test_thresholds_in_mm(spark):
    z = F.array(F.lit(0.8), F.lit(0.8), F.lit(0.8))
    ref = F.array(*map(F.lit, un.REFERENCE_ZOOM))
    row = spark.range(1).select(un.mm3_to_voxels(F.lit(un.reference_voxels(30)), z).alias("a"), un.mm3_to_voxels(F.lit(un.reference_voxels(30)), ref).alias("b"), un.mm3_to_voxels(F.lit(0.0), z).alias("c"), un.mm_to_voxels(F.lit(0.1), z).alias("d")).head()
    assert tuple(row) == (54, 30, 1, 0)


def test_volume_source(spark, tmp_path):
    rng = np.random.default_rng(1)
    data = np.zeros((30, 4, 5), dtype=np.int16)
    data[rng.random(data.shape) < 0.3] = 7
    affine = np.arange(16.0).reshape(4, 4)
    np.savez(tmp_path / "a.npz", data=data, zoom=np.array([0.75, 0.75, 1.65]), affine=affine)
    np.savez_compressed(tmp_path / "c.npz", data=data)
    np.save(tmp_path / "b.npy", np.asfortranarray(data.astype(">f4") * 2))
    np.save(tmp_path / "empty.npy", np.zeros((0, 4, 5)))
    spark.dataSource.register(VolumeDataSource)
    want = {tuple(map(int, x)) for x in np.argwhere(data)}
    for size in (100, 1 << 20):
        df = spark.read.format("volumes").option("slabBytes", size).load(f"{tmp_path}/a.npz,file://{tmp_path}/b.npy,{tmp_path}/c.npz,{tmp_path}/empty.npy")
        rows = df.collect()
        assert len(rows) == 3 * len(want)
        for name, value, zoom in (("a.npz", 7.0, 1.65), ("b.npy", 14.0, 1.0), ("c.npz", 7.0, 1.0)):
            mine = [r for r in rows if r.path.endswith(name)]
            assert {(r.p, r.i, r.r) for r in mine} == want and {(r.value, r.zoom[2], tuple(r.shape)) for r in mine} == {(value, zoom, (30, 4, 5))}
        assert next(r for r in rows if r.path.endswith("a.npz")).affine == list(range(16))
        tasks = df.filter("path like '%b.npy'").groupBy(F.spark_partition_id()).count().count()
        assert tasks == (5 if size == 100 else 1)  # planes of the slowest axis


def test_sinks_and_catalogs(spark, tmp_path):
    vox = view(spark, SF, "vox")
    ct.write_masks(vox.select(*KEY, "sem"), f"{tmp_path}/masks")
    assert spark.read.parquet(f"{tmp_path}/masks").count() == vox.count()
    points = spark.createDataFrame([(1, 2, 50, 1.0, 2.0, 3.0)], "scan_id int, vert int, subreg int, x double, y double, z double")
    ct.write_poi(ct.provenance(points, {"sem": "m"}, {"step": 0.5}, "1", "t"), f"{tmp_path}/poi")
    assert ct.read_poi(spark, f"{tmp_path}/poi").head().info["step"] == "0.5"
    for name, body in (("Alpha", {"log_name": "a", "modality": ["T2w"], "modeltype": "unet"}), ("Beta", {"log_name": "b", "modality": ["SEG"]}), ("Gamma", {"log_name": "c", "modality": ["SEG"], "modeltype": "classifier"})):
        (tmp_path / "models" / name).mkdir(parents=True)
        (tmp_path / "models" / name / "inference_config.json").write_text(json.dumps(body))
    (tmp_path / "models" / "Bad").mkdir()
    (tmp_path / "models" / "Bad" / "inference_config.json").write_text("{ not json")
    got = {r.model_id: r.model_class for r in ct.read_model_configs(spark, f"{tmp_path}/models").select("model_id", "model_class").collect()}
    assert got == {"alpha": "semantic", "beta": "instance", "gamma": "labeling"}
    assert ct.find_paths(spark, f"{tmp_path}/models", "*.json").count() == 4
    with pytest.warns(UserWarning):
        ct.find_paths(spark, f"{tmp_path}/models", "*.txt")
    (tmp_path / "models" / "deep" / "Delta").mkdir(parents=True)
    (tmp_path / "models" / "deep" / "Delta" / "inference_config.json").write_text("{}")
    ends = {name: ct.find_model(spark, f"{tmp_path}/models", name).split("/models")[-1] for name in ("Alpha", "Delta", "None")}
    assert ends == {"Alpha": "/Alpha", "Delta": "/deep/Delta", "None": "/None"}
    tap = ct.DebugTap(f"{tmp_path}/tap")
    assert tap("points")(points).count() == 1 == spark.read.parquet(f"{tmp_path}/tap/points").count() and set(tap.frames) == {"points"}
    scores = points.select("scan_id", F.array("x", "y").alias("scores"))
    ct.write_scores(scores, f"{tmp_path}/scores")
    assert spark.read.parquet(f"{tmp_path}/scores").head().scores == [1.0, 2.0]


def test_new_files_are_processed_once(spark, tmp_path):
    from voxtable.streaming.incremental import process_new

    seen = []
    for k in range(2):
        spark.range(k * 3, k * 3 + 3).write.mode("append").parquet(f"{tmp_path}/in")
        process_new(spark, f"{tmp_path}/in", "id long", lambda df, _: seen.append(df.count()), f"{tmp_path}/cp").awaitTermination(120)
    assert seen == [3, 3]


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_infection_has_no_bound_on_its_rounds(spark, monkeypatch):
    monkeypatch.setattr(nb, "MAX_ROUNDS", 3, raising=False)
    row = spark.range(8).selectExpr("1 as scan_id", "cast(id as int) as p", "0 as i", "0 as r", "7 as inst")
    scans = spark.createDataFrame([(1, 8, 1, 1)], "scan_id int, np int, ni int, nr int")
    grown = nb.infect(row.filter("p = 0"), "inst", row.filter("p > 0").drop("inst"), scans)
    assert grown.count() == 8


def test_samples_have_their_sizes_and_can_be_drawn_again(spark):
    from voxtable.operators import regions as rg

    vox = view(spark, SF, "vox").select(*KEY, "sem")
    draw = lambda seed, df: sorted(map(tuple, rg.sample_per_class(df, "sem", 40, 0.25, seed).collect()))
    once = draw(1, vox)
    sizes = {tuple(r)[:2]: r["count"] for r in vox.groupBy("scan_id", "sem").count().collect()}
    got = {}
    for r in once:
        got[(r[0], r[4])] = got.get((r[0], r[4]), 0) + 1
    assert got == {k: max(min(40, n), -(-n // 4)) for k, n in sizes.items()}
    assert once == draw(1, vox.repartition(5)) != draw(2, vox) and len(set(once)) == len(once)


def test_volumes_are_written_whole_or_not_at_all(spark, tmp_path):
    from voxtable.sources import volumes as vl

    rows = spark.createDataFrame([(1, 0, 0, 0, 5), (1, 1, 2, 0, 7), (2, 1, 2, 0, None), (3, 0, 0, 0, 1)], "scan_id int, p int, i int, r int, v int")
    scans = spark.createDataFrame([(1, 2, 3, 1, 0.5, 0.5, 2.0), (2, 2, 3, 1, 1.0, 1.0, 1.0)], "scan_id int, np int, ni int, nr int, zp double, zi double, zr double")
    for _ in range(2):  # files of an earlier attempt are replaced
        assert sorted(r.scan_id for r in vl.write_volumes(rows, scans, f"{tmp_path}/v", "v").collect()) == [1, 2]
    one, two = np.load(tmp_path / "v" / "1.npz"), np.load(tmp_path / "v" / "2.npz")
    assert one["data"].tolist() == [[[5], [0], [0]], [[0], [0], [7]]] and one["zoom"].tolist() == [0.5, 0.5, 2.0] and not two["data"].any()
    assert sorted(p.name for p in (tmp_path / "v").iterdir()) == ["1.npz", "2.npz"]
    assert vl.write_volumes(rows.limit(0), scans, f"{tmp_path}/e", "v").count() == 0
    for place in (-1, 9):
        with pytest.raises(Exception, match="negative|out of bounds"):
            vl.write_volumes(rows.withColumn("p", F.lit(place)), scans, f"{tmp_path}/w", "v").collect()
    assert vl.write_files(spark.createDataFrame([("a/b.json", "{}"), ("c.txt", "")], "path string, body string"), f"{tmp_path}/f") == 2
    assert (tmp_path / "f" / "a" / "b.json").read_text() == "{}" and vl.write_files(spark.createDataFrame([], "path string, body string"), f"{tmp_path}/g") == 0


def test_hooks_keep_the_columns(spark):
    from voxtable.operators.pipelines import apply_hook

    sem = spark.createDataFrame([(1, 0, 0, 0, 49), (1, 0, 0, 1, 61), (1, 0, 0, 2, None)], "scan_id int, p int, i int, r int, sem int")
    out = apply_hook(sem, lambda df: df.withColumns({"sem": F.when(F.col("sem") == 61, 0).otherwise(F.col("sem")), "more": F.lit(1)}))
    assert out.columns == sem.columns and [r.sem for r in out.collect()] == [49]
    with pytest.raises(ValueError, match="sem"):
        apply_hook(sem, lambda df: df.drop("sem"))


def test_small_slabs_share_tasks_and_tasks_carry_no_list_of_files(tmp_path):
    from voxtable.sources.volumes import VolumeReader

    for k in range(40):
        np.save(f"{tmp_path}/{k}.npy", np.arange(60.0).reshape(3, 4, 5))
    reader = VolumeReader({"path": ",".join(f"{tmp_path}/{k}.npy" for k in range(40)), "slabBytes": "100"})
    parts = reader.partitions()
    slabs = [(s.path, s.k) for p in parts for s in p.slabs]
    assert len(parts) <= 40 and len(slabs) == len(set(slabs)) == 40 * 7
    assert not reader.paths
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 40 * 59


def test_output_paths_are_parsed_once_a_file(spark):
    out = ct.derive_outputs(spark.createDataFrame([("a/sub-1_T2w.nii.gz",)], "path string"))
    generate = next(line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in line)
    assert "regexp" not in generate and out.count() == 12
