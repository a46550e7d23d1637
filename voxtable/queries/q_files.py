"""Queries over sources and sinks: what they write to the shared folder is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtable.operators import pipelines as pl, regions as rg, voxels as vx
from voxtable.plans.storage import fresh_path, staged
from voxtable.registry import register
from voxtable.sources import catalog as ct, volumes as vl
from voxtable.sources.views import ctes, view


def _masks(s, d):
    """The folder that ``write_masks`` has made of all scans, a folder a scan."""
    path = fresh_path(s, "masks")
    ct.write_masks(view(s, d, "vox").select(*vx.KEY, "sem", "inst"), path)
    return path


def _scan(path):
    return F.regexp_extract(path, r"scan_id=(\d+)", 1).cast("int")


@register("s1_scan_catalog", ctes("vox", "select distinct scan_id, 'parquet' as filetype, true as filled from vox"))
def s1(s, d):
    files = ct.scan_catalog(s, _masks(s, d))
    return files.filter("path like '%.parquet'").select(_scan("path").alias("scan_id"), F.substring_index("path", ".", -1).alias("filetype"), (F.col("length") > 0).alias("filled"))


@register("s5_find_paths", ctes("vox", "select distinct 'scan_id=' || scan_id as folder, scan_id % 10 as last from vox"))
def s5(s, d):
    """Masks of each scan by a pattern."""
    found = ct.find_paths(s, _masks(s, d), "part-*.parquet")
    return found.select(F.regexp_extract("path", r"/(scan_id=\d+)/", 1).alias("folder"), (_scan("path") % 10).alias("last"))


@register("s6_read_volumes", ctes("vox scans", "select scan_id, p, i, r, cast(sem as double) as value, [np, ni, nr] as shape, [zp, zi, zr] as zoom, [zp, 0, 0, 0, 0, zi, 0, 0, 0, 0, zr, 0, 0, 0, 0, 1]::double[] as affine from vox join scans using (scan_id)"))
def s6(s, d):
    """Array files of all scans, read by slabs of 4000 bytes."""
    written = vl.write_volumes(view(s, d, "vox"), view(s, d, "scans"), fresh_path(s, "volumes"), "sem")
    paths = ",".join(r.path for r in staged(written, "volume-paths").select("path").collect())  # one a scan, what a reader takes
    s.dataSource.register(vl.VolumeDataSource)
    read = s.read.format("volumes").option("slabBytes", 4000).load(paths)
    return read.select(F.regexp_extract("path", r"(\d+)\.npz$", 1).cast("int").alias("scan_id"), "p", "i", "r", "value", "shape", "zoom", "affine")


@register("s7_write_masks", ctes("vox", "select scan_id, p, i, r, sem, inst from vox where scan_id >= 1 or i < 30"))
def s7(s, d):
    """Masks read back; the filter prunes folders and row groups."""
    return s.read.parquet(_masks(s, d)).filter("scan_id >= 1 or i < 30").select(*vx.KEY, "sem", "inst")


@register("s8_write_read_poi", ctes("vox", """select scan_id, inst as vert, sem as subreg, round(sum(p) / count(*), 6) as x, round(sum(i) / count(*), 6) as y, round(sum(r) / count(*), 6) as z, '0.5' as step
from vox where inst > 0 group by all"""))
def s8(s, d):
    points = rg.centroids(view(s, d, "vox")).select("scan_id", "vert", "subreg", F.col("cp").alias("x"), F.col("ci").alias("y"), F.col("cr").alias("z"))
    path = fresh_path(s, "poi")
    ct.write_poi(ct.provenance(points, {"semantic": "a2"}, {"step": 0.5}, "1.0", "2024-01-01"), path)
    return ct.read_poi(s, path).select("scan_id", "vert", "subreg", *[F.round(a, 6).alias(a) for a in "xyz"], F.col("info")["step"].alias("step"))


@register("s9_write_scores", ctes("cost", "select scan_id, rw, list(w order by cls) as scores from cost group by all"))
def s9(s, d):
    ordered = F.array_sort(F.collect_list(F.struct("cls", "w")))
    rows = view(s, d, "cost").groupBy("scan_id", "rw").agg(F.transform(ordered, lambda x: x["w"]).alias("scores"))
    path = fresh_path(s, "scores")
    ct.write_scores(rows, path)
    return s.read.parquet(path)


@register("s10_read_model_configs", """select case when s_suppkey % 4 = 1 then 'nnunetplans__' || s_suppkey else 'model' || s_suppkey end as folder, 'Model' || s_suppkey as log_name,
'model' || s_suppkey as model_id, case when s_suppkey % 5 = 0 then 'labeling' when s_suppkey % 3 = 0 then 'instance' else 'semantic' end as model_class,
case when s_suppkey % 3 = 0 then ['SEG'] else ['T2w', 'CT'] end as modality, cast(s_nationkey as int) as available_folds from supplier where s_suppkey % 7 <> 3""")
def s10(s, d):
    """A configuration file for each supplier; every seventh is broken JSON and is left out, a quarter lie below a folder of plans."""
    supplier = s.read.parquet(f"{d}/supplier.parquet")
    key = F.col("s_suppkey").cast("string")
    plans = F.when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("nnUNetPlans__"), key, F.lit("/"))).otherwise("")
    fields = F.struct(
        F.concat(F.lit("Model"), key).alias("log_name"),
        F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("SEG"))).otherwise(F.array(F.lit("T2w"), F.lit("CT"))).alias("modality"),
        F.when(F.col("s_suppkey") % 5 == 0, "classifier").otherwise("unet").alias("modeltype"),
        F.col("s_nationkey").cast("int").alias("available_folds"),
    )
    body = F.to_json(fields)
    files = supplier.select(F.concat(F.lit("Model"), key, F.lit("/"), plans, F.lit("inference_config.json")).alias("path"), F.when(F.col("s_suppkey") % 7 == 3, F.left(body, F.lit(9))).otherwise(body).alias("body"))
    root = fresh_path(s, "models")
    vl.write_files(files, root)
    found = ct.read_model_configs(s, root)
    folder = F.lower(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    return found.select(folder.alias("folder"), "log_name", "model_id", "model_class", "modality", "available_folds")


@register("s17_debug_tap", ctes("vox", "select 'semantic' as stage, scan_id, count(*) as voxels from vox group by all union all select 'instances', scan_id, count(*) from vox where inst > 0 group by all"))
def s17(s, d):
    """Two named intermediates, counted from what the tap has written."""
    path, vox = fresh_path(s, "tap"), view(s, d, "vox")
    tap = ct.DebugTap(path)
    sem = tap("semantic")(vox.select(*vx.KEY, "sem"))
    sem.join(tap("instances")(vox.filter("inst > 0").select(*vx.KEY, "inst")), vx.KEY)
    kept = [s.read.parquet(f"{path}/{name}").groupBy("scan_id").agg(F.count(F.lit(1)).alias("voxels")).select(F.lit(name).alias("stage"), "scan_id", "voxels") for name in tap.frames]
    return kept[0].unionByName(kept[1])


PARTS = {"corpus": 49, "canal": 61, "endplate": 62, "disc": 100}
VERTEBRAE = {f"C{k}": k for k in range(1, 8)}


@register("p20_resolve_labels", ctes("catalog", f", voc(k, v) as (values {', '.join(map(str, (PARTS | VERTEBRAE).items()))}), w as (select file_id, (['corpus', 'canal', 'endplate', 'disc'])[file_id % 4 + 1] as a, 'C' || (file_id % 7 + 1) as b, cast(file_id % 50 as varchar) as c from catalog) select file_id, x.v as part, y.v as vertebra, cast(c as int) as other from w join voc x on x.k = a join voc y on y.k = b"))
def p20(s, d):
    """Names of parts, names of vertebrae and plain numbers in one map of a file."""
    parts = F.element_at(F.array(*map(F.lit, PARTS)), (F.col("file_id") % 4 + 1).cast("int"))
    names = F.create_map(F.lit("1"), parts, F.lit("2"), F.concat(F.lit("C"), (F.col("file_id") % 7 + 1).cast("string")), F.lit("3"), (F.col("file_id") % 50).cast("string"))
    ids = view(s, d, "catalog").select("file_id", ct.resolve_labels(names, PARTS, VERTEBRAE).alias("ids"))
    return ids.select("file_id", *[F.col("ids")[k].alias(n) for k, n in (("1", "part"), ("2", "vertebra"), ("3", "other"))])


@register("m8_transform_hook", ctes("vox", "select scan_id, p, i, r, case when sem = 42 then 41 else sem end as sem from vox where sem <> 62"))
def m8(s, d):
    """The hook unites both posterior parts and makes endplates background."""
    def hook(sem):
        return sem.withColumn("sem", F.when(F.col("sem") == 42, 41).when(F.col("sem") == 62, 0).otherwise(F.col("sem")))

    return pl.apply_hook(view(s, d, "vox").select(*vx.KEY, "sem"), hook)
