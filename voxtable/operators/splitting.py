"""Splitting of merged bodies: seeds by erosion, fronts that grow until they touch, a plane at the contact.

All flagged regions of a cohort go through the same rounds; a region leaves them as soon as
its own question is answered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from voxtable.operators import neighbours as nb, regions as rg
from voxtable.operators.voxels import AXES, KEY
from voxtable.plans.storage import staged_rows as staged

REGION = ["scan_id", "inst"]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _two_largest(comps: DataFrame) -> DataFrame:
    """Seeds of the regions with several components: KEY, inst, side by size."""
    top = staged(nb.largest_components(comps, "inst", 2), "seed-sizes")
    apart = top.filter("rank = 2").select(*REGION)
    sides = top.join(apart, REGION, "left_semi").select(*REGION, "comp", F.col("rank").alias("side"))
    return comps.join(sides, [*REGION, "comp"]).select(*KEY, "inst", "side")


def halved(core: DataFrame, whole: DataFrame) -> DataFrame:
    """Seeds of regions that wear away without falling apart: KEY, inst, side.

    ``core`` is what was left last, ``whole`` what was left a round before. The core grows
    inside of the whole until it is half of it; the seeds are the largest component of the
    core (side 1) and of the rest (side 2). Regions without a rest have no row.
    """
    total = staged(whole.groupBy(*REGION).agg(F.count(F.lit(1)).alias("n")), "halves-total")
    state, done = staged(core.select(*KEY, "inst"), "halves"), []
    while True:
        n = state.groupBy(*REGION).agg(F.count(F.lit(1)).alias("k")).join(total, REGION)
        ready = staged(n.select(*REGION, (F.col("k") * 2 >= F.col("n")).alias("ready"), "k"), "halves-sizes")
        done.append(state.join(ready.filter("ready"), REGION, "left_semi"))
        open_ = state.join(ready.filter("not ready"), REGION, "left_semi").withColumn("_one", F.lit(1))
        mask = whole.join(ready.filter("not ready"), REGION, "left_semi")
        grown = staged(nb.dilate(open_, "_one", None, 1, 3, mask=mask, keys=REGION).select(*KEY, "inst"), "halves")
        # A core that can't grow any more, as the rest doesn't touch it, has no halves.
        more = grown.groupBy(*REGION).agg(F.count(F.lit(1)).alias("k2")).join(ready, REGION).filter("k2 > k")
        state = staged(grown.join(more.select(*REGION), REGION, "left_semi"), "halves")
        if state.isEmpty():
            break
    core = _union(done)
    rest = whole.join(core.select(*REGION).distinct(), REGION, "left_semi").join(core.select(*KEY, "inst"), [*KEY, "inst"], "left_anti")
    both = staged(core.select(*KEY, "inst", F.lit(1).alias("side")).unionByName(rest.select(*KEY, "inst", F.lit(2).alias("side"))), "halves-both")
    comps = nb.components(both.withColumn("_one", F.lit(1)), "_one", 3, keys=(*REGION, "side"))
    sizes = comps.groupBy(*REGION, "side", "comp").agg(F.count(F.lit(1)).alias("n"))
    first = sizes.withColumn("_k", F.row_number().over(W.partitionBy(*REGION, "side").orderBy(F.desc("n"), "comp"))).filter("_k = 1")
    seeds = comps.join(first.select(*REGION, "side", "comp"), [*REGION, "side", "comp"]).select(*KEY, "inst", "side")
    two = seeds.groupBy(*REGION).agg(F.max("side").alias("_m")).filter("_m = 2").select(*REGION)
    return staged(seeds.join(two, REGION, "left_semi"), "halves-seeds")


def separating_parts(vox: DataFrame, most: int = 10, connectivity: int = 3) -> DataFrame:
    """Two seeds of each region (KEY, inst): KEY, inst, side (1 the larger, 2 the second).

    A region is eroded until it has several components, the two largest of which are its
    seeds; it may stay in one piece ``most`` times. If it wears away instead, what was left
    before is cut in halves (``halved``). Regions for which neither works have no row.
    """
    state = before = staged(vox.select(*KEY, "inst"), "separate")
    found = []
    for _ in range(most + 1):
        eroded = staged(nb.erode(state, "inst", 1, connectivity), "separate")
        left = staged(eroded.select(*REGION).distinct(), "separate-left")
        gone = staged(state.join(left, REGION, "left_anti"), "separate-gone")
        if not gone.isEmpty():
            found.append(halved(gone, before))
        seeds = staged(_two_largest(nb.components(eroded, "inst", 3)), "separate-seeds")
        found.append(seeds)
        before, state = state, staged(eroded.join(seeds.select(*REGION).distinct(), REGION, "left_anti"), "separate")
        if state.isEmpty():
            break
    return _union(found)


def contacts(seeds: DataFrame, scans: DataFrame, connectivity: int = 3) -> DataFrame:
    """Where the two fronts of each region meet first: KEY, inst.

    Both seeds grow by one voxel, then the first and the second in turn, each region until
    its own fronts share a voxel. The fronts grow over everything in the scan.
    """
    own = [*KEY, "inst"]
    fronts = staged(nb.dilate(seeds.withColumn("_one", F.lit(1)), "_one", scans, 1, connectivity, keys=(*REGION, "side")), "fronts")
    found, turn = [], 1
    while True:
        one, two = (fronts.filter(F.col("side") == k).select(*own) for k in (1, 2))
        met = staged(one.join(two, own, "left_semi"), "contacts")
        found.append(met)
        open_ = staged(fronts.join(met.select(*REGION).distinct(), REGION, "left_anti"), "fronts")
        if open_.isEmpty():
            break
        moved = nb.dilate(open_.filter(F.col("side") == turn), "_one", scans, 1, connectivity, keys=(*REGION, "side"))
        fronts = staged(moved.select(*open_.columns).unionByName(open_.filter(F.col("side") != turn)), "fronts")
        turn = 3 - turn
    return _union(found)


def _centres(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*[(F.sum(F.col(a).cast("long")) / F.count(F.lit(1))).alias(f"{name}{a}") for a in AXES])


def split_plane(vox: DataFrame, seeds: DataFrame, met: DataFrame, scans: DataFrame) -> DataFrame:
    """``vox`` (KEY, inst) with ``side``: 1 on and above the plane, 2 below it.

    The plane stands on the centre of the contact, at a right angle to the line between the
    centres of the seeds. It is drawn as one voxel per line along the axis that it faces
    most, clipped to the scan, and each column of a region takes the side from its lowest
    plane voxel on upwards (``running_min_fill``).
    """
    sides = _centres(seeds, [*REGION, "side"], "s")
    normal = sides.groupBy(*REGION).agg(*[(F.max(F.when(F.col("side") == 1, F.col(f"s{a}"))) - F.max(F.when(F.col("side") == 2, F.col(f"s{a}")))).alias(f"n_{a}") for a in AXES])
    plane = normal.join(_centres(met, REGION, "c"), REGION)
    shift = -(F.col("cp") * F.col("n_p") + F.col("ci") * F.col("n_i") + F.col("cr") * F.col("n_r"))
    size = [F.abs(F.col(f"n_{a}")) for a in AXES]
    axis = F.when((size[0] >= size[1]) & (size[0] >= size[2]), 0).when(size[1] >= size[2], 1).otherwise(2)
    plane = staged(plane.withColumns({"_shift": shift, "_axis": axis}).join(scans.select("scan_id", *[f"n{a}" for a in AXES]), "scan_id"), "planes")
    drawn = []
    for k, a in enumerate(AXES):
        d1, d2 = (x for x in AXES if x != a)
        mine = plane.filter(F.col("_axis") == k)
        lines = vox.select(*REGION, *[x for x in (d1, d2) if x != "i"]).distinct().join(mine, REGION)
        if "i" in (d1, d2):  # the plane may stand lower or higher than the region itself
            lines = lines.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ni") - 1)))
        at = (-F.col(f"n_{d1}") * F.col(d1) - F.col(f"n_{d2}") * F.col(d2) - F.col("_shift")) / F.col(f"n_{a}")
        at = F.greatest(F.lit(0.0), F.least(at, (F.col(f"n{a}") - 1).cast("double"))).cast("int")
        drawn.append(lines.withColumn(a, at).select(*KEY, "inst", F.lit(1).alias("v"), F.lit(False).alias("own")))
    body = vox.join(plane.select(*REGION), REGION, "left_semi").select(*KEY, "inst", F.lit(2).alias("v"), F.lit(True).alias("own"))
    filled = rg.running_min_fill(_union([body, *drawn]), "v", "side", "i", keys=REGION, upwards=True)
    return filled.filter("own").select(*KEY, "inst", "side")


def split_merged(bodies: DataFrame, flagged: DataFrame, scans: DataFrame) -> DataFrame:
    """Give the half below the plane of every flagged body (scan_id, target) a label of its own, above the scan's largest.

    Bodies that can't be split stay as they are.
    """
    part = staged(bodies.join(flagged.select("scan_id", F.col("target").alias("inst")).distinct(), REGION, "left_semi"), "flagged-bodies")
    seeds = staged(separating_parts(part), "seeds")
    halves = staged(split_plane(part, seeds, contacts(seeds, scans), scans).filter("side = 2"), "lower-halves")
    top = bodies.groupBy("scan_id").agg(F.max("inst").alias("_top"))
    new = halves.select(*REGION).distinct().join(top, "scan_id")
    new = new.withColumn("_to", F.col("_top") + F.row_number().over(W.partitionBy("scan_id").orderBy("inst")))
    moved = halves.join(new.select(*REGION, "_to"), REGION).select(*KEY, "_to")
    return bodies.join(moved, KEY, "left").withColumn("inst", F.coalesce("_to", "inst").cast("int")).drop("_to")
