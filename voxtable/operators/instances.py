"""Splitting of merged bodies, attachment of discs and endplates, naming of instances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from voxtable.functions.labels import CLASSES, L5, T11, T12
from voxtable.functions import units as un
from voxtable.operators import labelling as la, neighbours as nb, regions as rg, voxels as vx
from voxtable.operators.splitting import split_merged
from voxtable.operators.voxels import AXES, KEY
from voxtable.plans.storage import staged_rows as staged

#: Label of the dens in the semantic mask, where a model has one.
DENS = 51


def corpus_centers(
    sem: DataFrame,
    scans: DataFrame,
    body: int = 49,
    disc: int = 100,
    ratio: float = 1.5,
    dens: int | None = DENS,
    dense: int = 50,
    plate: int = 62,
    cleaning_mm3: float = 0.0,
) -> DataFrame:
    """Centres of vertebral bodies, bottom to top: scan_id, rank, cp, ci, cr.

    Where a scan has the ``dense`` label, its components are the bodies and components of
    ``dens`` come last in height order, so first after the reversal. Elsewhere the border
    label ``body`` is eroded twice (18-connected) and, with ``cleaning_mm3``, components
    under that volume (40 reference voxels at least) are deleted. Where discs, endplates
    among them, and bodies don't alternate, the largest of the bodies around that stands
    out by volume is split. Scans without a body have no row.
    """
    own = sem.filter(F.col("sem").isin(body, dense)).select(*KEY, "sem")
    has = staged(own.filter(F.col("sem") == dense).select("scan_id").distinct(), "dense-scans")
    border = nb.erode(own.join(has, "scan_id", "left_anti"), "sem", 2, 2)
    if cleaning_mm3 > 0:
        volume = F.col("zp") * F.col("zi") * F.col("zr")
        size = F.greatest(F.floor(cleaning_mm3 / volume), un.mm3_to_voxels(F.lit(un.reference_voxels(40)), F.array("zp", "zi", "zr")))
        border = nb.clean_artifacts(staged(border, "border"), "sem", scans.select("scan_id", F.lit(body).alias("label"), size.alias("size")), scans, only_delete=True)
    bodies = staged(own.filter(F.col("sem") == dense).unionByName(border.select(*KEY, "sem")).withColumn("sem", F.lit(body)), "bodies")
    bodies = nb.components(bodies, "sem", 3)
    names = bodies.select("scan_id", "comp").distinct().withColumn("inst", F.row_number().over(W.partitionBy("scan_id").orderBy("comp")))
    bodies = staged(bodies.join(names, ["scan_id", "comp"]).select(*KEY, "inst"), "bodies")
    stats = rg.region_stats(bodies, "inst").select("scan_id", F.lit("body").alias("kind"), F.col("label").cast("long").alias("label"), "ci", "voxels")
    discs = nb.components(sem.filter(F.col("sem").isin(disc, plate)).select(*KEY, F.lit(disc).alias("sem")), "sem", 3).groupBy("scan_id", F.col("comp").alias("label")).agg((F.sum(F.col("i").cast("long")) / F.count(F.lit(1))).alias("ci"), F.count(F.lit(1)).alias("voxels"))
    entries = stats.unionByName(discs.select("scan_id", F.lit("disc").alias("kind"), "label", "ci", "voxels"))
    checked = staged(rg.alternation_check(entries.join(scans.select("scan_id", "zi"), "scan_id"), 7.5 / F.col("zi")), "alternation").filter("not dropped")
    # Labels of discs are moved apart from those of bodies, so that the order is total.
    order = checked.select("scan_id", F.when(F.col("kind") == "disc", -1 - F.col("label")).otherwise(F.col("label")).alias("label"), "ci", "voxels", "anomaly", (F.col("kind") == "body").alias("is_body"))
    odd = order.filter("anomaly").select("scan_id", "label")
    flagged = rg.neighbour_volume_outlier(order, ratio=ratio, of="is_body").join(odd, ["scan_id", "label"], "left_semi")
    flagged = staged(flagged.select("scan_id", F.col("target").cast("int").alias("target")).distinct(), "flagged")
    fixed = bodies if flagged.isEmpty() else staged(split_merged(bodies, flagged, scans), "bodies")
    centres = rg.region_stats(fixed, "inst").select("scan_id", F.col("label").cast("long").alias("label"), *[f"c{a}" for a in AXES], F.lit(0).alias("_d"))
    if dens is not None:
        extra = nb.components(sem.filter(F.col("sem") == dens).select(*KEY, "sem").join(has, "scan_id", "left_semi"), "sem", 3)
        extra = extra.groupBy("scan_id", F.col("comp").alias("label")).agg(*[(F.sum(F.col(a).cast("long")) / F.count(F.lit(1))).alias(f"c{a}") for a in AXES], F.lit(1).alias("_d"))
        centres = centres.unionByName(extra)
    return bottom_to_top(centres)


def bottom_to_top(centres: DataFrame) -> DataFrame:
    """Order by height with dens components appended, then reversed."""
    order = W.partitionBy("scan_id").orderBy(F.desc("_d"), F.desc("ci"), F.desc("label"))
    return centres.withColumn("rank", F.row_number().over(order)).select("scan_id", "rank", *[f"c{a}" for a in AXES])


def attach_ivd_endplates(vox: DataFrame, inst: DataFrame, disc: int = 100, plate: int = 62, corpus: int | None = None) -> DataFrame:
    """Discs as 100 + X and endplates as 200 + X, X the vertebra above; a disc above all gets the lowest label less 1.

    With ``corpus`` a vertebra's height is that of its voxels of that label, 0 if it has none.
    """
    verts = rg.region_stats(inst, "inst").select("scan_id", "label", "ci")
    if corpus is not None:
        own = inst.join(vox.filter(F.col("sem") == corpus).select(*KEY), KEY, "left_semi")
        heights = rg.region_stats(own, "inst").select("scan_id", "label", F.col("ci").alias("_ci"))
        verts = verts.join(heights, ["scan_id", "label"], "left").select("scan_id", "label", F.coalesce("_ci", F.lit(0.0)).alias("ci"))
    # Each table is read several times; as one plan all would be some hundred steps, which the driver keeps and compiles.
    verts = staged(verts, "heights")
    out = inst.select(*KEY, "inst")
    for sem, base in ((disc, 100), (plate, 200)):
        comps = staged(nb.components(vox.filter(F.col("sem") == sem).select(*KEY, "sem"), "sem", 3), "attached")
        names = comps.select("scan_id", "comp").distinct().withColumn("label", F.row_number().over(W.partitionBy("scan_id").orderBy("comp")))
        comps = comps.join(staged(names, "attached-names"), ["scan_id", "comp"])
        middle = comps.groupBy("scan_id", "label").agg((F.sum(F.col("i").cast("long")) / F.count(F.lit(1))).alias("ci"))
        at = rg.asof_lower(middle, verts)
        owner = F.when(F.col("above_all") & F.lit(base == 100), F.col("base") - 1).otherwise(F.col("base"))
        at = staged(at.select("scan_id", "label", (owner + base).cast("int").alias("inst")), "attached-to")
        named = comps.join(at, ["scan_id", "label"]).select(*KEY, "inst")
        out = vx.attach_derived(out, named)
    return out


def endplate_coverage(split: DataFrame, plates: DataFrame) -> DataFrame:
    """Share of endplate voxels that got a part, per scan."""
    n = plates.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"))
    k = split.groupBy("scan_id").agg(F.count(F.lit(1)).alias("k"))
    return n.join(k, "scan_id", "left").select("scan_id", F.round(100 * F.coalesce("k", F.lit(0)) / F.col("n"), 6).alias("per_cent"))


def forced_rows(own: DataFrame, sem: DataFrame, scans: DataFrame, ranked: DataFrame, dens: int, least_mm3: float = 250.0) -> DataFrame:
    """Rows (scan_id, rw, cls) that must be C2, the instance with most dens volume if that is enough, and C1, the label before."""
    marked = own.join(sem.filter(F.col("sem") == dens).select(*KEY), KEY, "left_semi")
    sizes = marked.groupBy("scan_id", F.col("inst").alias("label")).count().join(scans.select("scan_id", (F.col("zp") * F.col("zi") * F.col("zr")).alias("_z")), "scan_id")
    most = sizes.groupBy("scan_id").agg(F.max_by("label", F.struct("count", -F.col("label"))).alias("label"), F.max(F.col("count") * F.col("_z")).alias("_v"))
    second = most.filter(F.col("_v") > least_mm3).select("scan_id", "label", F.lit(1).alias("cls"))
    first = second.filter("label <> 1").select("scan_id", (F.col("label") - 1).alias("label"), F.lit(0).alias("cls"))
    return second.unionByName(first).join(ranked, ["scan_id", "label"]).select("scan_id", "rw", "cls")


def label_instances(
    inst: DataFrame,
    heads: DataFrame,
    c1: bool = False,
    sem: DataFrame | None = None,
    scans: DataFrame | None = None,
    corpus: Sequence[int] = (49, 50, DENS),
    dens: int = DENS,
    anomalies: bool = True,
    boost: float = 1.0,
) -> DataFrame:
    """Rename instances by their decoded labels: fuse heads, decode, fix transitional vertebrae, keep matched ones.

    ``heads`` (scan_id, rw, region, vert, grp, visible; ``vertrel`` and ``vt13`` if there are);
    rows count instances from top to bottom: those of 1..25 and 28 that have a voxel of
    ``corpus`` where ``sem`` is given. With ``c1`` the row with most dens is forced to be C2
    and the label before it C1 (this needs ``sem`` and ``scans``); if C2 is found, C1 is not
    and the lowest label is unmatched, that one becomes C1. Without ``anomalies`` T11 is
    never left out and T12 never repeated.
    """
    own = inst if sem is None else inst.join(sem.filter(F.col("sem").isin(*corpus)).select(*KEY), KEY, "left_semi")
    ranked = rg.ordered_by_height(rg.region_stats(own, "inst").filter(F.col("label").between(1, 25) | (F.col("label") == 28)), "_k").select("scan_id", "label", (F.col("_k") - 1).alias("rw"))
    forced = forced_rows(own, sem, scans, ranked, dens) if c1 and sem is not None and scans is not None else None
    cost = la.head_fusion(heads, boost, forced=forced).select("scan_id", "rw", F.posexplode(F.transform("cost", lambda x: -x)).alias("cls", "w"))
    paths = la.decode_sequence(
        cost,
        classes=CLASSES,
        start=0 if c1 else 1,
        rel=la.relative_costs(heads) if "vertrel" in heads.columns else None,
        t13=la.t13_costs(heads) if "vt13" in heads.columns else None,
        repeat=(T12, L5) if anomalies else (L5,),
        skip=(T11,) if anomalies else (),
    )
    labels = la.fix_transitional(la.exploded(paths))
    names = ranked.join(labels, ["scan_id", "rw"]).select("scan_id", ranked["label"].alias("inst"), labels["label"].alias("new_label"))
    if c1:
        has = lambda x: F.max(F.col("new_label") == x)
        ready = names.groupBy("scan_id").agg(has(1).alias("_1"), has(2).alias("_2")).filter("_2 and not _1")
        lowest = inst.groupBy("scan_id").agg(F.min("inst").alias("inst")).join(ready.select("scan_id"), "scan_id")
        names = names.unionByName(lowest.join(names, ["scan_id", "inst"], "left_anti").withColumn("new_label", F.lit(1)))
    return inst.join(names, ["scan_id", "inst"]).select(*KEY, F.col("new_label").alias("inst"))


def reconcile(sem: DataFrame, inst: DataFrame, scans: DataFrame, vertebra: Sequence[int] = (41, 42, 49), fill: bool = False) -> tuple[DataFrame, DataFrame]:
    """Instances and semantic mask made to cover each other."""
    vert = sem.filter(F.col("sem").isin(*vertebra))
    own = vx.apply_mask(inst, vert)
    if fill:
        own = nb.infect(own, "inst", vx.missing_voxels(vert, own), scans)
    got, deleted = nb.assign_missing(vert, own, scans)
    return vx.apply_mask(got, vert), vx.missing_voxels(sem, deleted)
