"""Queries over composite operators and entry pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtable.operators import instances as ins, neighbours as nb, pipelines as pl, regions as rg, voxels as vx
from voxtable.operators.splitting import split_merged
from voxtable.plans.storage import staged_rows as staged
from voxtable.queries.q_neighbours import assigned
from voxtable.registry import register
from voxtable.sources.views import ctes, staged_views, view


def _three():
    """A scorer of three vertebrae by their height in the window, which is 24 voxels tall."""
    def run(batch):
        import numpy as np

        near = batch["i"].to_numpy() - 12
        return np.stack([np.full(len(batch), 0.5), near < -5, abs(near) <= 5, near > 5], axis=1).astype(float)

    return run


def _scan_voxels(vox):
    """Scans with whole bodies: each line along r of a body or a bridge is closed between its ends."""
    vox = vox.select(*vx.KEY, "intensity", "sem")
    lines = vox.filter("sem = 49").groupBy("scan_id", "p", "i").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.max("intensity").alias("intensity"))
    closed = lines.withColumn("r", F.explode(F.sequence("lo", "hi"))).select(*vx.KEY, "intensity", F.lit(49).alias("sem"))
    return vox.unionByName(closed.join(vox.select(*vx.KEY), vx.KEY, "left_anti"))


@register("e3_preprocess", ctes("vox scans", """, lo as (select scan_id, min(intensity) as lo from vox group by scan_id),
b as (select scan_id, k, min(p) - k as p0, max(p) + k as p1, min(i) - k as i0, max(i) + k as i1, min(r) - k as r0, max(r) + k as r1 from vox join lo using (scan_id) join (select scan_id, cast(ceil(2.0 / least(zp, zi, zr)) as int) as k from scans) using (scan_id) where intensity > lo group by scan_id, k),
c as (select vox.* from vox join b using (scan_id) where p between p0 and p1 and i between i0 and i1 and r between r0 and r1), m as (select scan_id, min(intensity) as lo, max(intensity) as hi from c group by scan_id)
select scan_id, p, i, r, sem, round((intensity - lo) * case when hi > 1500 then 1500.0::double / hi else 1 end, 6) as intensity from c join m using (scan_id)"""))
def e3(s, d):
    return pl.preprocess(view(s, d, "vox").drop("inst"), view(s, d, "scans")).withColumn("intensity", F.round("intensity", 6))


@register("e4_clean_semantic", None)
def e4(s, d):
    vox, scans = staged_views(s, d)
    return pl.clean_semantic(vox.select(*vx.KEY, "sem"), scans)


@register("e5_build_instances", None)
def e5(s, d):
    """From the masks of ``vox`` to instances on its grid; every third scan has another zoom."""
    vox, scans = staged_views(s, d)
    return pl.build_instances(staged(_scan_voxels(vox), "scan-voxels"), scans, _three)[0]


@register("i16_i17_merge_predictions", None)
def merge_predictions(s, d):
    return pl.merge_predictions(view(s, d, "preds"), staged_views(s, d)[1], 4)


@register("e6_postprocess", None)
def e6(s, d):
    vox, scans = staged_views(s, d)
    return pl.postprocess(vox, vox.filter("inst > 0"), scans)[1]


@register("e6_endplate_parts", None)
def e6_parts(s, d):
    vox, scans = staged_views(s, d)
    return pl.postprocess(vox, vox.filter("inst > 0"), scans)[0].groupBy("scan_id", "sem").agg(F.count(F.lit(1)).alias("voxels"))


@register("e2_process_scans_centroids", None)
def e2(s, d):
    vox, scans = staged_views(s, d)
    return pl.process_scans(staged(_scan_voxels(vox), "scan-voxels"), scans, _three)["centroids"]


@register("e1_process_dataset_summary", None)
def e1(s, d):
    """A fifth of the scans is finished, and a seventh has no plane that the models know."""
    vox, scans = staged_views(s, d)
    manifest = scans.filter("scan_id % 5 = 4").select("scan_id", F.explode(F.array(*map(F.lit, ("out_spine", "out_vert", "out_snap", "out_ctd")))).alias("name"))
    none = F.lit(None).cast("string")
    catalog = scans.select(F.col("scan_id").alias("file_id"), F.col("scan_id").alias("subject"), F.lit("T2w").alias("format"), F.when(F.col("scan_id") % 7 == 6, "ax").otherwise("sag").alias("acq"), none.alias("seg"), none.alias("label"), none.alias("part"))
    models = s.createDataFrame([("sem", ["T2w"], "sag", ["T2w"]), ("inst", ["T2w"], "sag", ["T2w", "SEG"])], "model_id string, formats array<string>, acquisition string, modality array<string>")
    pairs = s.createDataFrame([("sem", "inst")], "semantic string, instance string")
    return pl.process_dataset(catalog, manifest, staged(_scan_voxels(vox), "scan-voxels"), scans, _three, ["T2w"], ["sag", "ax"], models=models, pairs=pairs)["summary"]


def _flat():
    def run(batch):
        import numpy as np

        out = np.full((len(batch), 40), 0.1)
        out[np.arange(len(batch)), 3 + batch["rw"].to_numpy() + batch["top"].to_numpy()] = 1.0
        return out

    return run


@register("e7_label_cutouts", ctes("cost", "select scan_id, c.rw, cast(c.rw + t.top + 1 as int) as label from (select distinct scan_id, rw from cost) c join (select scan_id, max(w) % 4 as top from cost group by scan_id) t using (scan_id)"))
def e7(s, d):
    """The scorer sees a number of the scan's own patches, which is the class of its first row."""
    cost = view(s, d, "cost")
    top = cost.groupBy("scan_id").agg((F.max("w") % 4).cast("int").alias("top"))
    rows = cost.select("scan_id", "rw").distinct().join(top, "scan_id")
    return pl.label_cutouts(rows, ["scan_id", "rw"], _flat)


def merged_bodies(s, d):
    """The two upper bodies of each scan with a bridge of the disc's voxels between them, lines along r closed."""
    vox = view(s, d, "vox").filter("p < 6 and i < 20 and (i % 10 < 8 or p in (2, 3))")
    lines = vox.groupBy("scan_id", "p", "i").agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    bridge = F.col("i") % 10 >= 8
    lines = lines.select("scan_id", "p", "i", F.when(bridge, F.greatest("lo", F.lit(3))).otherwise(F.col("lo")).alias("lo"), F.when(bridge, F.least("hi", F.lit(4))).otherwise(F.col("hi")).alias("hi")).filter("lo <= hi")
    return lines.withColumn("r", F.explode(F.sequence("lo", "hi"))).select(*vx.KEY, F.lit(1).alias("inst"))


@register("i13_i14_split_merged", None)
def i13(s, d):
    bodies = staged(merged_bodies(s, d), "merged-bodies")
    return split_merged(bodies, bodies.select("scan_id", F.col("inst").alias("target")).distinct(), staged_views(s, d)[1])


@register("i15_corpus_centers", None)
def i15(s, d):
    """Every second scan has the dense label, the others only the border label."""
    vox, scans = staged_views(s, d)
    sem = _scan_voxels(vox).withColumn("sem", F.when((F.col("sem") == 49) & (F.col("scan_id") % 2 == 0), 50).otherwise(F.col("sem")))
    return ins.corpus_centers(staged(sem, "sem"), scans).withColumns({f"c{a}": F.round(f"c{a}", 6) for a in vx.AXES})


@register("t5_bottom_to_top", ctes("vox", ", st as (select scan_id, inst as label, sum(p) / count(*) as cp, sum(i) / count(*) as ci, sum(r) / count(*) as cr, cast(inst = 1 as int) as d from vox where inst > 0 group by all) select scan_id, cast(row_number() over (partition by scan_id order by d desc, ci desc, label desc) as int) as rank, round(cp, 6) as cp, round(ci, 6) as ci, round(cr, 6) as cr from st"))
def t5(s, d):
    st = rg.region_stats(view(s, d, "vox"), "inst").withColumn("_d", (F.col("label") == 1).cast("int"))
    return ins.bottom_to_top(st).withColumns({f"c{a}": F.round(f"c{a}", 6) for a in vx.AXES})


@register("i18_attach_ivd_endplates", ctes("vox", """, st as (select scan_id, inst as label, sum(i) / count(*) as ci from vox where inst > 0 group by all),
dk as (select distinct scan_id, sem, i from vox where sem in (62, 100)),
own as (select scan_id, sem, i, (select max_by(label, ci) from st where st.scan_id = dk.scan_id and st.ci < dk.i) as base from dk)
select scan_id, p, i, r, inst from vox where inst > 0 union all select scan_id, p, i, r, cast(base + case sem when 100 then 100 else 200 end as int) from vox join own using (scan_id, sem, i)"""))
def i18(s, d):
    """Each slice of discs or endplates is one component in these tables."""
    vox = view(s, d, "vox")
    return ins.attach_ivd_endplates(vox, vox.filter("inst > 0"))


@register("i22_label_instances", None)
def i22(s, d):
    """Each of the four instances of a scan has the mean of a quarter of the scan's score rows; the arch stands for the dens."""
    vox = view(s, d, "vox")
    rows = view(s, d, "cost").groupBy("scan_id", (F.col("rw") % 4).alias("rw"), "cls").agg((F.sum("w") / F.count(F.lit(1)) / 1000.0).alias("w"))
    rows = rows.groupBy("scan_id", "rw").agg(F.transform(F.array_sort(F.collect_list(F.struct("cls", "w"))), lambda x: x["w"]).alias("a"))
    heads = rows.select("scan_id", "rw", F.slice("a", 1, 3).alias("region"), F.col("a").alias("vert"), F.slice("a", 1, 12).alias("grp"), F.lit(1.0).alias("visible"), F.slice("a", 13, 6).alias("vertrel"), F.slice("a", 19, 2).alias("vt13"))
    return ins.label_instances(vox.filter("inst > 0"), heads, c1=True, sem=vox, scans=view(s, d, "scans"), corpus=(49,), dens=41)


@register("i24_reconcile", ctes("vox", assigned("sem in (41, 42, 49)", "inst > 0 and p > 1") + " select * from given"))
def i24(s, d):
    vox, scans = staged_views(s, d)
    return ins.reconcile(vox, vox.filter("inst > 0 and p > 1"), scans)[0]


@register("a21_endplate_coverage", ctes("vox", ", n as (select a.scan_id, count(*) as n, count(b.p) as k from vox a left join vox b on b.scan_id = a.scan_id and b.p = a.p and b.r = a.r and b.i = a.i - 1 and b.inst > 0 where a.sem = 62 group by a.scan_id) select scan_id, round(100 * k / n, 6) as per_cent from n"))
def a21(s, d):
    """Coverage after the first round: an endplate's voxel is reached from the slice above it."""
    vox = view(s, d, "vox")
    plates = vox.filter("sem = 62").withColumn("inst", F.expr("cast(201 + i div 10 as int)"))
    split = nb.split_endplates(vox.filter("inst > 0").select(*vx.KEY, "inst"), plates, view(s, d, "scans"), rounds=1)
    return ins.endplate_coverage(split, plates)
