"""Neighbourhoods, morphology and connected components of voxel tables.

Neighbours are found in cubes of voxels with a halo (``blocks``) or by equi-joins on shifted
keys that start with ``scan_id``, never by comparing pairs. Components are contracted inside
of cubes before the fixed point on what crosses their borders; their id is the smallest
packed key, so results don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from voxtable.operators import blocks as bl
from voxtable.operators.blocks import offsets
from voxtable.operators.voxels import AXES, KEY
from voxtable.plans.components import connected_components as graph_components
from voxtable.plans.storage import drop_staged, small_side, staged_rows as staged


def shifted(vox: DataFrame, connectivity: int, half: bool = False) -> DataFrame:
    """Every voxel once per neighbour place, which becomes its key."""
    steps = F.array(*[F.struct(*[F.lit(x).alias(a) for a, x in zip(AXES, o, strict=True)]) for o in offsets(connectivity, half)])
    out = vox.withColumn("_o", F.explode(steps))
    return out.withColumns({a: F.col(a) + F.col(f"_o.{a}") for a in AXES}).drop("_o")


def _kind(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def _places(at: np.ndarray) -> dict[str, np.ndarray]:
    return {a: at[:, k].astype(np.int32) for k, a in enumerate(AXES)}


def _of_kind(df: DataFrame, source: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.col(col).cast(_kind(source, col)))


def neighbours(vox: DataFrame, col: str, connectivity: int) -> DataFrame:
    """Rows (KEY, col, other): labelled voxels with the label of each labelled neighbour."""
    steps = offsets(connectivity)

    def run(layers, corner, _):
        dense = bl.cube(layers[0], 1)
        own, at, other = bl.inner(dense, 1), [], []
        for s in steps:
            near = dense[tuple(slice(1 + x, 1 + x + bl.BLOCK) for x in s)]
            both = (own != bl.ABSENT) & (near != bl.ABSENT)
            at.append(np.argwhere(both))
            other.append(near[both])
        at = np.concatenate(at)
        return {**_places(at + corner + 1), col: own[tuple(at.T)], "other": np.concatenate(other)}

    out = bl.by_block([(vox, col)], ["scan_id"], 1, run, f"p int, i int, r int, {col} long, other long")
    return _of_kind(out, vox, col).withColumn("other", F.col("other").cast(_kind(vox, col)))


def contact_area(vox: DataFrame, col: str, connectivity: int = 1) -> DataFrame:
    """Adjacent voxel pairs between two labels a < b; every pair is met once."""
    moved = shifted(vox.select(*KEY, F.col(col).alias("b")), connectivity, half=True)
    pairs = vox.select(*KEY, F.col(col).alias("a")).join(moved, KEY).filter("a <> b")
    return pairs.groupBy("scan_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("faces"))


def in_frame(vox: DataFrame, scans: DataFrame) -> DataFrame:
    out = vox.join(scans.select("scan_id", *[f"n{a}" for a in AXES]), "scan_id")
    for a in AXES:
        out = out.filter((F.col(a) >= 0) & (F.col(a) < F.col(f"n{a}")))
    return out.drop(*[f"n{a}" for a in AXES])


def _grown(vox: DataFrame, col: str, n: int, connectivity: int, keys: Sequence[str], scans: DataFrame | None, mask: DataFrame | None, new_only: bool = False) -> DataFrame:
    """One pass of at most HALO rounds of growth; with ``new_only`` only what was added."""
    steps, block = offsets(connectivity), bl.WIDE

    def run(layers, corner, shape):
        if not len(layers[0][0]):
            return {**_places(np.empty((0, 3))), col: np.empty(0, np.int64)}
        window = bl.window_of(layers[0][0], n, block)
        if len(layers) == 2:
            box = np.stack(np.unravel_index(layers[1][0], (block + 2 * n,) * 3))
            box = np.stack([box.min(axis=1), box.max(axis=1)]) if box.size else np.array([[0] * 3, [-1] * 3])
        else:
            box = np.stack([-corner, np.array(shape) - 1 - corner])
        window = bl.clipped(window, layers[0][0], box, n, block)
        dense = bl.cube(layers[0], n, window, block)
        if len(layers) == 2:
            allowed = bl.cube(layers[1], n, window, block) != bl.ABSENT
        else:
            allowed = bl.in_shape(corner, shape, window)
        out = bl.grow(dense, allowed, steps, n)
        keep = out != bl.ABSENT
        if new_only:
            keep &= dense == bl.ABSENT
        at = np.argwhere(keep) + [w.start for w in window]
        own = ((at >= n) & (at < n + block)).all(axis=1)
        return {**_places(at[own] + corner), col: out[keep][own]}

    layers = [(vox, col)] if mask is None else [(vox, col), (mask, None)]
    return _of_kind(bl.by_block(layers, keys, n, run, f"p int, i int, r int, {col} long", None if mask is not None else scans, block), vox, col)


def dilate(vox: DataFrame, col: str, scans: DataFrame, n: int = 1, connectivity: int = 1, mask: DataFrame | None = None, keys: Sequence[str] = ("scan_id",)) -> DataFrame:
    """Grow labels by ``n`` rounds inside the scan, or inside the mask; the smallest label wins a contested voxel.

    ``keys`` that hold more than the scan grow apart from one another.
    """
    state, left = vox.select(*keys, *AXES, col), n
    while left > 0:
        step = min(left, bl.HALO)
        state = _grown(state, col, step, connectivity, keys, scans, mask)
        left -= step
        if left:
            state = staged(state, "dilate")
    return state


def erode(vox: DataFrame, col: str, n: int = 1, connectivity: int = 1) -> DataFrame:
    """Keep voxels all of whose neighbours have their label; the border of the scan counts as outside."""
    state, left, steps, block = vox.select(*KEY, col), n, offsets(connectivity), bl.WIDE
    while left > 0:
        k = min(left, bl.HALO)

        def run(layers, corner, _, k=k):
            window = bl.window_of(layers[0][0], k, block)  # what is beyond holds nothing, as the places that shrink away at its ends
            out = bl.shrink(bl.cube(layers[0], k, window, block), steps, k)
            keep = out != bl.ABSENT
            at = np.argwhere(keep) + [w.start for w in window]
            own = ((at >= k) & (at < k + block)).all(axis=1)
            return {**_places(at[own] + corner), col: out[keep][own]}

        state = _of_kind(bl.by_block([(state, col)], ["scan_id"], k, run, f"p int, i int, r int, {col} long", block=block), vox, col)
        left -= k
        if left:
            state = staged(state, "erode")
    return state


def infect(labels: DataFrame, col: str, missing: DataFrame, scans: DataFrame, connectivity: int = 1) -> DataFrame:
    """Grow labels into the missing voxels until nothing changes.

    A pass makes HALO rounds; the next one starts at what the last one added, as older
    voxels have given all they could.
    """
    own = labels.select(*KEY, col)
    open_, front, done = missing.select(*KEY).join(labels.select(*KEY), KEY, "left_anti"), own, [own]
    while True:
        step = staged(_grown(front, col, bl.HALO, connectivity, ["scan_id"], scans, open_, new_only=True), "infect")
        if step.isEmpty():
            break
        done.append(step)
        open_, front = staged(open_.join(step.select(*KEY), KEY, "left_anti"), "infect-open"), step
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def place_key(p, i, r):
    """One orderable key per place; indices are under 2**20, the packing of cubes raises where they aren't."""
    return F.shiftleft(p.cast("long"), 2 * bl.BITS) + F.shiftleft(i.cast("long"), bl.BITS) + r.cast("long")


def components(vox: DataFrame, col: str, connectivity: int = 1, keys: Sequence[str] = ("scan_id",)) -> DataFrame:
    """Rows (keys, p, i, r, col, comp): connected components within each label.

    ``comp`` is the smallest packed place of the component. Voxels are united inside of
    cubes first, halo included, so a voxel near a border has a part in several cubes. These
    parts are the edges of a much smaller graph, for which rounds of joins are made; parts
    that don't reach a border with another cube are components by themselves and take no
    part in it. A place may have several labels.
    """
    ks, block = list(keys), bl.WIDE
    steps = [s for s in offsets(connectivity, half=True) if s != (0, 0, 1)]  # runs along r are united by their order
    edge = block + 2
    wide = edge + 1  # a spare place after each line, so that steps beyond a cube's side meet nothing

    def run(layers, corner, _):
        at, value = layers[0]
        place = np.stack(np.unravel_index(at, (edge,) * 3), axis=1).astype(np.int64)
        names, which = np.unique(value, return_inverse=True)
        key = which * (wide + 1) ** 3 + (place[:, 0] * wide + place[:, 1]) * wide + place[:, 2]
        key, first = np.unique(key, return_index=True)
        place, value = place[first], value[first]
        starts = np.concatenate([[True], np.diff(key) != 1])
        line, starts = np.cumsum(starts) - 1, np.flatnonzero(starts)
        u, v = [], []
        for s in steps:
            want = key + (s[0] * wide + s[1]) * wide + s[2]
            there = np.minimum(np.searchsorted(key, want), len(key) - 1)
            met = np.flatnonzero(key[there] == want)
            a, b = line[met], line[there[met]]
            new = np.concatenate([[True], (np.diff(a) != 0) | (np.diff(b) != 0)])[: len(a)]
            u.append(a[new])
            v.append(b[new])
        root = bl.roots(len(starts), np.concatenate(u), np.concatenate(v))[line]
        own = ((place >= 1) & (place <= block)).all(axis=1)
        rim = (((place <= 1) & (corner >= 0)) | (place >= block)).any(axis=1)  # below the first cube there is none
        open_ = np.zeros(len(starts), bool)
        open_[root[rim]] = True
        packed = bl.pack(place + corner)
        return {**_places(place + corner), col: value, "part": packed[starts[root]], "own": own, "rim": rim, "open": open_[root]}

    parts = staged(_of_kind(bl.by_block([(vox, col)], ks, 1, run, f"p int, i int, r int, {col} long, part long, own boolean, rim boolean, open boolean", block=block), vox, col), "parts")
    node = lambda c: F.struct(*ks, col, F.col(c).alias("id"))
    shared = parts.filter("rim").groupBy(*ks, *AXES, col).agg(F.min("part").alias("low"), F.collect_set("part").alias("all")).filter(F.size("all") > 1)
    edges = staged(shared.select(*ks, col, "low", F.explode("all").alias("part")).filter("low <> part").distinct(), "part-edges")
    whole = parts.filter("own").select(*ks, *AXES, col, F.col("part").alias("comp"))
    if edges.isEmpty():
        return whole
    roots = graph_components(edges.select(node("part").alias("u"), node("low").alias("v")))
    roots = staged(roots.select(*[F.col(f"node.{k}").alias(k) for k in [*ks, col]], F.col("node.id").alias("part"), F.col("root.id").alias("comp")), "roots")
    named = parts.filter("own and open").join(small_side(roots), [*ks, col, "part"], "left").select(*ks, *AXES, col, F.coalesce("comp", "part").alias("comp"))
    closed = parts.filter("own and not open").select(*ks, *AXES, col, F.col("part").alias("comp"))
    return staged(named.unionByName(closed), "components")


def component_stats(comps: DataFrame, col: str) -> DataFrame:
    """Voxels, centre cut to integers and box per component, ranked by height within the label."""
    ends = [f(a).alias(f"{a}{n}") for a in AXES for n, f in ((0, F.min), (1, F.max))]
    middle = [F.floor(F.sum(F.col(a).cast("long")) / F.count(F.lit(1))).cast("int").alias(f"c{a}") for a in AXES]
    out = comps.groupBy("scan_id", col, "comp").agg(F.count(F.lit(1)).alias("voxels"), *middle, *ends)
    return out.withColumn("rank", F.row_number().over(W.partitionBy("scan_id", col).orderBy("ci", "comp")))


def largest_components(comps: DataFrame, col: str, k: int) -> DataFrame:
    """The k largest components of every label with their rank by size; ties go to the smaller id."""
    sizes = comps.groupBy("scan_id", col, "comp").agg(F.count(F.lit(1)).alias("voxels"))
    return sizes.withColumn("rank", F.row_number().over(W.partitionBy("scan_id", col).orderBy(F.desc("voxels"), "comp"))).filter(F.col("rank") <= k)


def runs_along_r(vox: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs of voxels along r: (keys, p, i, r0, r1)."""
    row = W.partitionBy(*keys, "p", "i").orderBy("r")
    return vox.select(*keys, *AXES).withColumn("_g", F.col("r") - F.row_number().over(row)).groupBy(*keys, "p", "i", "_g").agg(F.min("r").alias("r0"), F.max("r").alias("r1")).drop("_g")


def holes(vox: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs (keys, p, i, s, e) of background that doesn't reach the border of its label's box (6-connected).

    Background is the complement of runs: only a gap between two runs of one line can be
    part of a hole. A gap that meets a line without voxels, or reaches beyond the ends of
    the next line, is outside, and so is what is connected with it. No box is made dense:
    rows are in proportion to runs.
    """
    ks = list(keys)
    runs = staged(runs_along_r(vox, ks), "hole-runs")
    line = W.partitionBy(*ks, "p", "i").orderBy("r0")
    gaps = runs.withColumn("_n", F.lead("r0").over(line)).filter("_n is not null").select(*ks, "p", "i", (F.col("r1") + 1).alias("s"), (F.col("_n") - 1).alias("e"))
    lines = runs.groupBy(*ks, "p", "i").agg(F.min("r0").alias("f"), F.max("r1").alias("l"))
    step = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(i).alias("i")) for p, i in ((-1, 0), (1, 0), (0, -1), (0, 1))])
    key = lambda p, i, s: place_key(F.col(p), F.col(i), F.col(s))
    gaps = staged(gaps.withColumn("id", key("p", "i", "s")), "hole-gaps")
    moved = gaps.withColumn("_o", F.explode(step)).select(*ks, "id", "s", "e", (F.col("p") + F.col("_o.p")).alias("p"), (F.col("i") + F.col("_o.i")).alias("i"))
    moved = staged(moved, "hole-steps")
    near = moved.join(lines, [*ks, "p", "i"], "left")
    out = staged(near.filter(F.col("f").isNull() | (F.col("s") < F.col("f")) | (F.col("e") > F.col("l"))).select(*ks, "id").distinct(), "hole-outside")
    # Gaps that are outside by themselves need no components: what touches one is outside with all it is connected with.
    other = gaps.select(*ks, "p", "i", F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("id").alias("id2"))
    met = moved.join(out, [*ks, "id"], "left_anti").join(other, [*ks, "p", "i"]).filter("s <= e2 and s2 <= e").select(*ks, "id", "id2")
    met = staged(met.join(out.select(*ks, F.col("id").alias("id2"), F.lit(True).alias("gone")), [*ks, "id2"], "left"), "hole-edges")
    node = lambda c: F.struct(*ks, F.col(c).alias("id"))
    roots = graph_components(met.filter("gone is null and id < id2").select(node("id").alias("u"), node("id2").alias("v")))
    roots = staged(roots.select(*[F.col(f"node.{k}").alias(k) for k in ks], F.col("node.id").alias("id"), F.col("root.id").alias("root")), "hole-roots")
    inner = gaps.join(out, [*ks, "id"], "left_anti").join(roots, [*ks, "id"], "left").withColumn("root", F.coalesce("root", "id"))
    lost = met.filter("gone").select(*ks, "id").distinct().join(roots, [*ks, "id"], "left").select(*ks, F.coalesce("root", "id").alias("root")).distinct()
    return inner.join(lost, [*ks, "root"], "left_anti").select(*ks, "p", "i", "s", "e")


def fill_holes(vox: DataFrame, col: str, labels: Sequence[int] | None = None) -> DataFrame:
    """Per label, background inside its box that doesn't reach the box's border takes the label.

    Where several labels could fill a voxel the smallest does; labelled voxels stay. With
    ``labels`` only these are filled.
    """
    own = vox.select(*KEY, col)
    part = own.filter(F.col(col) > 0 if labels is None else F.col(col).isin(*labels))
    fill = holes(part, ["scan_id", col]).select("scan_id", "p", "i", F.explode(F.sequence("s", "e")).alias("r"), col).groupBy(*KEY).agg(F.min(col).alias(col))
    return own.unionByName(fill.join(own.select(*KEY), KEY, "left_anti"))


def nonzero_box(vox: DataFrame, channels: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The box of where any channel isn't zero, holes filled: (boxes, runs outside of it).

    Boxes have scan_id, p0 .. r1. The second table (scan_id, p, i, s, e, mark -1) lists the
    cells of the box that are neither non-zero nor inside a hole as runs along r; a line
    without a voxel is one run.
    """
    some = F.lit(False)
    for c in channels:
        some = some | F.coalesce(F.col(c) != 0, F.lit(False))
    mask = staged(vox.filter(some).select(*KEY).distinct(), "nonzero")
    full = staged(fill_holes(mask.withColumn("_one", F.lit(1)), "_one").select(*KEY), "nonzero-full")
    boxes = staged(full.groupBy("scan_id").agg(*[f(a).alias(f"{a}{n}") for a in AXES for n, f in ((0, F.min), (1, F.max))]), "nonzero-boxes")
    lines = boxes.withColumn("p", F.explode(F.sequence("p0", "p1"))).withColumn("i", F.explode(F.sequence("i0", "i1"))).select("scan_id", "p", "i", F.col("r0").alias("lo"), F.col("r1").alias("hi"))
    runs = runs_along_r(full, ["scan_id"]).groupBy("scan_id", "p", "i").agg(F.array_sort(F.collect_list(F.struct("r0", "r1"))).alias("w"))
    found = lines.join(runs, ["scan_id", "p", "i"], "left").withColumn("w", F.coalesce("w", F.array().cast("array<struct<r0:int,r1:int>>")))
    starts = F.concat(F.array("lo"), F.transform("w", lambda x: x["r1"] + 1))
    ends = F.concat(F.transform("w", lambda x: x["r0"] - 1), F.array("hi"))
    gaps = found.withColumn("g", F.explode(F.arrays_zip(starts.alias("s"), ends.alias("e")))).select("scan_id", "p", "i", F.col("g.s").alias("s"), F.col("g.e").alias("e"), F.lit(-1).alias("mark"))
    return boxes, gaps.filter("s <= e")


def clean_artifacts(vox: DataFrame, col: str, sizes: DataFrame, scans: DataFrame, only_delete: bool = False, factor: float = 0.1) -> DataFrame:
    """Components (6-connected) smaller than their label's ``size`` are deleted or take the majority label around.

    ``sizes`` (label, size), with scan_id if they differ by scan. The ring around a component counts every place, labelled or
    not; with at most int(ring * factor) labelled neighbours it is deleted. Neighbours are
    read from the mask as it was. Scans without a background voxel are unchanged.
    """
    comps = components(vox, col, 1)
    n = comps.groupBy("scan_id", col, "comp").agg(F.count(F.lit(1)).alias("voxels"))
    small = n.join(sizes.withColumnRenamed("label", col), [c for c in ("scan_id", col) if c == col or c in sizes.columns]).filter(F.col("voxels") < F.col("size")).select("scan_id", col, "comp")
    filled = vox.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n")).join(scans, "scan_id").filter(F.col("n") < F.col("np").cast("long") * F.col("ni") * F.col("nr")).select("scan_id")
    small = small_side(staged(small.join(filled, "scan_id", "left_semi"), "small"))
    if only_delete:
        return comps.join(small, ["scan_id", col, "comp"], "left_anti").filter(F.col(col) > 0).select(*KEY, col)
    part = comps.join(small, ["scan_id", col, "comp"])
    around = in_frame(shifted(part, 1), scans).select(*KEY, F.col(col).alias("own"), "comp").distinct()
    around = around.join(vox.select(*KEY, F.col(col).alias("other")), KEY, "left").filter(F.col("other").isNull() | (F.col("other") != F.col("own")))
    votes = around.groupBy("scan_id", "own", "comp", "other").agg(F.count(F.lit(1)).alias("k"))
    known = F.col("other").isNotNull()
    fate = votes.groupBy("scan_id", "own", "comp").agg(F.sum("k").alias("ring"), F.sum(F.when(known, F.col("k")).otherwise(0)).alias("near"), F.min_by("other", F.when(known, F.struct(-F.col("k"), F.col("other")))).alias("to"))
    fate = fate.withColumn("to", F.when(F.col("near") <= F.floor(F.col("ring") * factor), F.lit(0)).otherwise(F.coalesce("to", F.lit(0))))
    fate = small.withColumnRenamed(col, "own").join(fate, ["scan_id", "own", "comp"], "left").select("scan_id", F.col("own").alias(col), "comp", F.coalesce("to", F.lit(0)).alias("to"))
    out = comps.join(small_side(staged(fate, "fate")), ["scan_id", col, "comp"], "left").withColumn(col, F.coalesce("to", col))
    return out.filter(F.col(col) > 0).select(*KEY, col)


def bounding_box_clean(vox: DataFrame, col: str, scans: DataFrame, margin: int, grow: bool = False) -> DataFrame:
    """Keep what lies in the box of the largest component (26-connected), widened by ``margin``.

    With ``grow`` the boxes of overlapping components are taken in until none is left.
    """
    comps = components(vox.select(*KEY, F.lit(1).alias("_one")), "_one", 3)
    stats = component_stats(comps, "_one")
    ends = {f"{a}{n}": F.col(f"{a}{n}") + (margin if n else -margin) for a in AXES for n in (0, 1)}
    boxes = stats.withColumns(ends).select("scan_id", "comp", "voxels", *ends)
    boxes = staged(boxes, "boxes") if grow else boxes
    kept = boxes.withColumn("_rn", F.row_number().over(W.partitionBy("scan_id").orderBy(F.desc("voxels"), "comp"))).filter("_rn = 1").drop("_rn")
    while grow:
        frame = kept.groupBy("scan_id").agg(*[f(f"{a}{n}").alias(f"k{a}{n}") for a in AXES for n, f in ((0, F.min), (1, F.max))])
        more = boxes.join(kept.select("scan_id", "comp"), ["scan_id", "comp"], "left_anti").join(frame, "scan_id")
        for a in AXES:
            more = more.filter((F.col(f"{a}0") <= F.col(f"k{a}1")) & (F.col(f"k{a}0") <= F.col(f"{a}1")))
        more = staged(more.select(*kept.columns), "boxes-more")
        if more.isEmpty():
            break
        kept = staged(kept.unionByName(more), "boxes-kept")
    frame = kept.groupBy("scan_id").agg(*[f(f"{a}{n}").alias(f"{a}{n}") for a in AXES for n, f in ((0, F.min), (1, F.max))])
    out = vox.join(small_side(staged(frame, "boxes")), "scan_id")  # a row a scan, so that voxels aren't shuffled for it
    for a in AXES:
        out = out.filter(F.col(a).between(F.col(f"{a}0"), F.col(f"{a}1")))
    return out.select(*vox.columns)


def trim_to_canal(vox: DataFrame, col: str, scans: DataFrame, canal: Sequence[int] = (60, 61), margin_mm: float = 64.0, keep: int = 26) -> DataFrame:
    """Drop what lies over ``margin_mm`` above or below the canal, but for the sacrum; scans without canal stay."""
    ends = vox.filter(F.col(col).isin(*canal)).groupBy("scan_id").agg(F.min("i").alias("lo"), F.max("i").alias("hi")).join(scans.select("scan_id", "zi"), "scan_id")
    ends = ends.select("scan_id", (F.col("lo") - margin_mm / F.col("zi")).alias("lo"), (F.col("hi") + margin_mm / F.col("zi")).alias("hi"))
    out = vox.join(small_side(staged(ends, "canal")), "scan_id", "left")
    return out.filter(F.col("lo").isNull() | F.col("i").between(F.col("lo"), F.col("hi")) | (F.col(col) == keep)).select(*vox.columns)


def assign_missing(sem: DataFrame, inst: DataFrame, scans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Give semantic voxels without an instance one: (instances, places deleted from the semantic mask).

    Instances grow twice inside the semantic mask. Components (18-connected) still
    uncovered take the majority label of their surroundings in rounds until nothing
    changes; those that touch no instance are deleted.
    """
    state = staged(dilate(inst, "inst", scans, 2, 1, mask=sem), "assigned")
    missing = staged(sem.select(*KEY).join(state.select(*KEY), KEY, "left_anti").withColumn("_m", F.lit(1)), "missing")
    comps = components(missing, "_m", 2).drop("_m")
    while True:
        ring = shifted(comps, 1).select(*KEY, "comp").distinct().join(state, KEY)
        votes = ring.groupBy("scan_id", "comp", "inst").agg(F.count(F.lit(1)).alias("k")).groupBy("scan_id", "comp").agg(F.min_by("inst", F.struct(-F.col("k"), "inst")).alias("inst"))
        votes = staged(votes, "votes")
        if votes.isEmpty():
            break
        won = comps.join(votes, ["scan_id", "comp"]).select(*KEY, "inst")
        new = staged(state.unionByName(won), "assigned")
        comps = staged(comps.join(votes, ["scan_id", "comp"], "left_anti"), "missing")
        drop_staged(state)
        state = new
    return state, comps.select(*KEY)


def reassign_dominant(sem: DataFrame, inst: DataFrame, labels: Sequence[int]) -> DataFrame:
    """Each component of the given labels takes the instance that holds most of it, if clearly the most."""
    from voxtable.operators.regions import dominant

    part = sem.filter(F.col("sem").isin(*labels)).select(*KEY, "sem")
    comps = components(part, "sem", 1)
    met = comps.join(inst.select(*KEY, "inst"), KEY, "left").groupBy("scan_id", "sem", "comp", F.coalesce("inst", F.lit(0)).alias("b")).agg(F.count(F.lit(1)).alias("voxels"))
    best = dominant(met, ["scan_id", "sem", "comp"])
    won = comps.join(best, ["scan_id", "sem", "comp"]).select(*KEY, F.col("b").alias("_to"))
    out = inst.select(*KEY, "inst").join(won, KEY, "full_outer").withColumn("inst", F.coalesce("_to", "inst"))
    return out.filter("inst > 0").select(*KEY, "inst")


def fix_posterior(vox: DataFrame, labels: Sequence[int] = (41, 42), last: int = 25) -> DataFrame:
    """Second and third largest parts of an instance move to the one other instance in their box.

    Only parts made of posterior labels alone count, and only boxes (widened by one voxel)
    with exactly one other instance.
    """
    own = vox.filter(F.col("inst").between(1, last))
    comps = components(own.select(*KEY, "inst"), "inst", 1)
    top = largest_components(comps, "inst", 3).filter("rank > 1").select("scan_id", "inst", "comp")
    parts = staged(comps.join(top, ["scan_id", "inst", "comp"]).join(vox.select(*KEY, "sem"), KEY), "parts")
    pure = parts.groupBy("scan_id", "inst", "comp").agg(F.bool_and(F.col("sem").isin(*labels)).alias("pure"), *[(f(a) + d).alias(f"{a}{n}") for a in AXES for n, f, d in ((0, F.min, -1), (1, F.max, 1))]).filter("pure")
    # Blocks of 8 heights make the box join an equi-join.
    blocks = pure.withColumn("_b", F.explode(F.sequence(F.floor(F.col("i0") / 8), F.floor(F.col("i1") / 8))))
    other = own.select("scan_id", *AXES, F.col("inst").alias("other"), F.floor(F.col("i") / 8).alias("_b"))
    met = blocks.join(other, ["scan_id", "_b"]).filter(F.col("other") != F.col("inst"))
    for a in AXES:
        met = met.filter(F.col(a).between(F.col(f"{a}0"), F.col(f"{a}1")))
    one = met.groupBy("scan_id", "inst", "comp").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).filter("lo = hi").select("scan_id", "inst", "comp", F.col("lo").alias("_to"))
    moved = parts.join(one, ["scan_id", "inst", "comp"]).select(*KEY, "_to")
    return vox.join(moved, KEY, "left").withColumn("inst", F.coalesce("_to", "inst")).drop("_to")


def merge_top_split(vox: DataFrame, scans: DataFrame, volume_ratio: float = 0.5, least_faces: float = 20.0) -> DataFrame:
    """Merge the topmost instance into the next if it is small and both touch widely.

    ``least_faces`` counts faces at the reference zoom.
    """
    from voxtable.functions.units import REFERENCE_ZOOM, area_to_voxels, zoom_volume  # noqa: F401
    from voxtable.operators.regions import region_stats

    stats = region_stats(vox.filter("inst > 0"), "inst")
    ranked = stats.withColumn("rank", F.row_number().over(W.partitionBy("scan_id").orderBy("ci", "label"))).filter("rank <= 2")
    top = ranked.groupBy("scan_id").agg(*[F.max(F.when(F.col("rank") == k, F.col(c))).alias(f"{c}{k}") for k in (1, 2) for c in ("label", "voxels")])
    top = top.filter("label2 is not null").filter(F.col("voxels1") < volume_ratio * F.col("voxels2"))
    faces = contact_area(vox.filter("inst > 0"), "inst").join(scans, "scan_id")
    mm2 = least_faces * (REFERENCE_ZOOM[0] * REFERENCE_ZOOM[1] * REFERENCE_ZOOM[2]) ** (2 / 3)
    wide = faces.filter(F.col("faces") > area_to_voxels(F.lit(mm2), F.array("zp", "zi", "zr")))
    pick = top.join(wide.select("scan_id", "a", "b"), "scan_id").filter((F.least("label1", "label2") == F.col("a")) & (F.greatest("label1", "label2") == F.col("b"))).select("scan_id", "label1", "label2")
    return vox.join(small_side(staged(pick, "top-split")), "scan_id", "left").withColumn("inst", F.when(F.col("inst") == F.col("label1"), F.col("label2")).otherwise(F.col("inst"))).drop("label1", "label2")


def split_endplates(inst: DataFrame, endplates: DataFrame, scans: DataFrame, rounds: int = 14) -> DataFrame:
    """Endplate voxels (KEY, inst = 200 + vertebra) as inferior (of that vertebra) or superior (of the next).

    In each round all vertebrae grow by one voxel: a voxel of an endplate that its own
    vertebra reaches is inferior, one that the vertebra below reaches is superior. Stops
    when nothing more is reached. Returns KEY, inst, part.
    """
    order = W.partitionBy("scan_id").orderBy("inst")
    above = inst.select("scan_id", "inst").distinct().withColumn("prev", F.lag("inst").over(order))
    above = staged(above, "endplates-above")
    # Plates are few of the voxels: they look around for the front, so that the front isn't copied to all sides.
    plates = in_frame(endplates.select(*KEY, (F.col("inst") - 200).alias("owner")), scans)
    own = [F.col(a).alias(f"_{a}") for a in AXES]
    front = inst.select(*KEY, "inst")
    left, done = staged(plates, "endplates-left"), []
    for _ in range(rounds):
        around = shifted(left.select(*KEY, "owner", *own), 1).join(front, KEY).join(small_side(above), ["scan_id", "inst"])
        hit = around.select("scan_id", *[F.col(f"_{a}").alias(a) for a in AXES], "owner", "inst", "prev").filter((F.col("owner") == F.col("inst")) | (F.col("owner") == F.col("prev")))
        hit = hit.groupBy(*KEY, "owner").agg(F.max((F.col("owner") == F.col("inst")).cast("int")).alias("_own"), F.min("inst").alias("inst"))
        hit = staged(hit, "endplates")
        if hit.isEmpty():
            break
        done.append(hit.select(*KEY, (F.col("owner") + 200).alias("inst"), F.when(F.col("_own") == 1, "inferior").otherwise("superior").alias("part")))
        left = staged(left.join(hit.select(*KEY), KEY, "left_anti"), "endplates-left")
        front = hit.select(*KEY, "inst")
    out = done[0] if done else endplates.select(*KEY, "inst", F.lit(None).cast("string").alias("part")).limit(0)
    for more in done[1:]:
        out = out.unionByName(more)
    return out
