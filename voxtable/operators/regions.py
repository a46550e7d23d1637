"""Sizes, centres, boxes and orders of labelled regions.

Sums are of integers and are divided once at the end, so results don't depend on how
rows are dealt. Aggregates are partial before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voxtable.operators.voxels import AXES, KEY

LABEL = ["scan_id", "label"]


def labelled(vox: DataFrame, col: str) -> DataFrame:
    return vox.filter(F.col(col) > 0).withColumn("label", F.col(col))


def labels_present(vox: DataFrame, col: str) -> DataFrame:
    return labelled(vox, col).groupBy("scan_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def region_stats(vox: DataFrame, col: str, keys: Sequence[str] = ("scan_id",)) -> DataFrame:
    """Voxels, centre and box per label, in one aggregation."""
    sums = [F.sum(F.col(a).cast("long")).alias(f"_s{a}") for a in AXES]
    ends = [f(a).alias(f"{a}{n}") for a in AXES for n, f in ((0, F.min), (1, F.max))]
    out = labelled(vox, col).groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("voxels"), *sums, *ends)
    return out.withColumns({f"c{a}": F.col(f"_s{a}") / F.col("voxels") for a in AXES}).drop(*[f"_s{a}" for a in AXES])


def volumes(vox: DataFrame, col: str, scans: DataFrame) -> DataFrame:
    """Voxels and mm3 per label."""
    n = labelled(vox, col).groupBy(*LABEL).agg(F.count(F.lit(1)).alias("voxels"))
    return n.join(scans, "scan_id").select(*LABEL, "voxels", F.round(F.col("voxels") * F.col("zp") * F.col("zi") * F.col("zr"), 6).alias("mm3"))


def center_of_mass(vox: DataFrame, col: str) -> DataFrame:
    return region_stats(vox, col).select(*LABEL, *[f"c{a}" for a in AXES])


def center_or_zero(vox: DataFrame, col: str, wanted: DataFrame) -> DataFrame:
    """Centres of the ``wanted`` (scan_id, label), 0 where there is no voxel."""
    return center_of_mass(vox, col).join(wanted, LABEL, "right").fillna(0.0, [f"c{a}" for a in AXES])


def bounding_box(vox: DataFrame, col: str, scans: DataFrame, margin: int = 0) -> DataFrame:
    """Boxes widened by ``margin`` and clipped to the scan; the centre is start + size // 2."""
    b = region_stats(vox, col).join(scans.select("scan_id", *[f"n{a}" for a in AXES]), "scan_id")
    ends = {}
    for a in AXES:
        ends[f"{a}0"] = F.greatest(F.col(f"{a}0") - margin, F.lit(0))
        ends[f"{a}1"] = F.least(F.col(f"{a}1") + margin, F.col(f"n{a}") - 1)
    b = b.withColumns(ends)
    middle = [F.expr(f"cast({a}0 + (({a}1 - {a}0 + 1) div 2) as int)").alias(f"m{a}") for a in AXES]
    return b.select(*LABEL, *ends, *middle)


def ordered_by_height(stats: DataFrame, out: str = "rank", offset: int = 0) -> DataFrame:
    """Rank regions from top to bottom by centre height, then label."""
    return stats.withColumn(out, F.row_number().over(W.partitionBy("scan_id").orderBy("ci", "label")) + offset)


def relabel_dense(vox: DataFrame, col: str) -> DataFrame:
    """Labels numbered from 1 in ascending order within each scan."""
    found = labelled(vox, col).select(*LABEL).distinct()
    new = found.withColumn("new_label", F.row_number().over(W.partitionBy("scan_id").orderBy("label")))
    return vox.join(new.withColumnRenamed("label", col), ["scan_id", col]).withColumn(col, F.col("new_label")).drop("new_label")


def majority_label(votes: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Most frequent label that isn't 0; the smallest on ties."""
    n = votes.filter(F.col(col) != 0).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*keys).agg(F.min_by(col, F.struct(-F.col("_n"), F.col(col))).alias(col), F.max("_n").alias("votes"))


def overlap(a: DataFrame, b: DataFrame, a_col: str, b_col: str) -> DataFrame:
    """Voxels in common per pair of labels; places that ``b`` lacks count as its label 0."""
    joined = a.select(*KEY, F.col(a_col).alias("a")).join(b.select(*KEY, F.col(b_col).alias("b")), KEY, "left")
    return joined.groupBy("scan_id", "a", F.coalesce("b", F.lit(0)).alias("b")).agg(F.count(F.lit(1)).alias("voxels"))


def dominant(pairs: DataFrame, keys: Sequence[str], factor: float = 0.5) -> DataFrame:
    """Of overlaps (keys, b, voxels): the label to reassign to, if the largest times ``factor`` exceeds the second.

    Background counts as a candidate; a single candidate changes nothing. Returns keys, b.
    """
    order = W.partitionBy(*keys).orderBy(F.desc("voxels"), "b")
    top = pairs.withColumns({"_rn": F.row_number().over(order), "_second": F.lead("voxels").over(order)})
    return top.filter((F.col("_rn") == 1) & F.col("_second").isNotNull() & (F.col("voxels") * factor > F.col("_second"))).select(*keys, "b")


def dice(pairs: DataFrame, a_sizes: DataFrame, b_sizes: DataFrame) -> DataFrame:
    """2 |a b| / (|a| + |b|) of overlaps (scan_id, a, b, voxels); sizes have (scan_id, label, voxels)."""
    a = a_sizes.select("scan_id", F.col("label").alias("a"), F.col("voxels").alias("_a"))
    b = b_sizes.select("scan_id", F.col("label").alias("b"), F.col("voxels").alias("_b"))
    return pairs.join(a, ["scan_id", "a"]).join(b, ["scan_id", "b"]).select("scan_id", "a", "b", (2 * F.col("voxels") / (F.col("_a") + F.col("_b"))).alias("dice"))


def coverage_gap(sem: DataFrame, inst: DataFrame, n_vert: DataFrame) -> DataFrame:
    """Vertebra voxels without an instance, in mean vertebrae, to 3 digits; warn above 0.5."""
    s = sem.groupBy("scan_id").agg(F.count(F.lit(1)).alias("s"))
    t = inst.groupBy("scan_id").agg(F.count(F.lit(1)).alias("t"))
    gap = F.bround((F.col("s") - F.coalesce("t", F.lit(0))) / (F.col("s") / F.col("n")), 3)
    return s.join(t, "scan_id", "left").join(n_vert, "scan_id").select("scan_id", gap.alias("gap")).withColumn("warn", F.col("gap") > 0.5)


def slice_extent(vox: DataFrame, col: str, threshold: float) -> DataFrame:
    """First and last height whose slice has a value above the threshold."""
    top = vox.groupBy("scan_id", "i").agg(F.max(col).alias("m")).filter(F.col("m") > threshold)
    return top.groupBy("scan_id").agg(F.min("i").alias("first_i"), F.max("i").alias("last_i"))


def sample_per_class(vox: DataFrame, col: str, most: int = 10_000, share: float = 0.01, seed: int = 1234) -> DataFrame:
    """A seeded sample without replacement: max(min(most, n), ceil(share n)) voxels per class.

    Voxels are ranked by a hash in two steps, so no task sorts a whole class: the hash's
    threshold for slightly more than the sample comes first, then the exact rank.
    """
    h = F.xxhash64(F.lit(seed), *KEY, col)
    keyed = vox.withColumn("_h", F.shiftrightunsigned(h, 1))
    sizes = keyed.groupBy("scan_id", col).agg(F.count(F.lit(1)).alias("_n"))
    want = F.greatest(F.least(F.lit(most), F.col("_n")), F.ceil(F.col("_n") * share))
    sizes = sizes.withColumn("_want", want)
    near = keyed.join(sizes, ["scan_id", col]).filter(F.col("_h") <= (F.col("_want") + 6 * F.sqrt("_want") + 30) / F.col("_n") * float(2**63))
    order = W.partitionBy("scan_id", col).orderBy("_h", *KEY)
    return near.withColumn("_rn", F.row_number().over(order)).filter("_rn <= _want").select(*vox.columns)


def centroids(vox: DataFrame) -> DataFrame:
    """One point per (instance, semantic label), derived instances left out; instance 26 gives its body."""
    own = vox.filter((F.col("inst") > 0) & ~(F.col("inst").between(100, 133) | F.col("inst").between(200, 233)))
    sums = [(F.sum(F.col(a).cast("long")) / F.count(F.lit(1))).alias(f"c{a}") for a in AXES]
    return own.groupBy("scan_id", F.col("inst").alias("vert"), F.when(F.col("inst") == 26, 50).otherwise(F.col("sem")).alias("subreg")).agg(*sums)


def neighbour_volume_outlier(stats: DataFrame, span: int = 5, least: int = 2, ratio: float = 1.5, of: str | None = None) -> DataFrame:
    """For each region, the largest of up to ``span`` neighbours above and below, if it stands out.

    ``stats`` (scan_id, label, ci, voxels). Returns the target and the ratio of its volume
    to the others' mean, where more than ``least`` others exist and the ratio is exceeded.
    With ``of``, a boolean column, only the marked entries count as neighbours, but all
    take part in the order.
    """
    order = W.partitionBy("scan_id").orderBy("ci", "label")
    item = F.struct(F.col("voxels").alias("v"), (-F.row_number().over(order)).alias("at"), F.col("label").alias("label"))
    before, after = order.rowsBetween(-span, -1), order.rowsBetween(1, span)
    with_items = stats.withColumn("_all", item).withColumn("_x", F.col("_all") if of is None else F.when(F.col(of), F.col("_all")))
    near = with_items.withColumn("_n", F.concat(F.collect_list("_x").over(before), F.collect_list("_x").over(after)))
    near = near.withColumn("_top", F.array_max("_n")).withColumn("_sum", F.aggregate("_n", F.lit(0).cast("long"), lambda a, x: a + x["v"]))
    others = F.size("_n") - 1
    diff = F.col("_top.v") / ((F.col("_sum") - F.col("_top.v")) / others)
    return near.filter(others > least).withColumn("ratio", diff).filter(F.col("ratio") > ratio).select("scan_id", "label", F.col("_top.label").alias("target"), "ratio")


def alternation_check(entries: DataFrame, same_height: Column) -> DataFrame:
    """Discs and bodies in height order must alternate; ``entries`` (scan_id, kind, label, ci).

    An entry of the kind of the next one is an anomaly if the scan has discs; closer than
    ``same_height`` voxels (an expression) it is to be dropped.
    """
    scan = W.partitionBy("scan_id")
    order = scan.orderBy("ci", "kind", "label")
    out = entries.withColumns({"_k": F.lead("kind").over(order), "_h": F.lead("ci").over(order), "_d": F.max((F.col("kind") == "disc").cast("int")).over(scan)})
    out = out.withColumn("anomaly", F.coalesce((F.col("kind") == F.col("_k")) & (F.col("_d") == 1), F.lit(False)))
    drop = F.col("anomaly") & (F.abs(F.col("_h") - F.col("ci")) < same_height)
    return out.withColumn("dropped", drop).drop("_k", "_h", "_d")


def spine_angle(stats: DataFrame, angle) -> DataFrame:
    """Angle at every region between the line from its upper to its lower neighbour and the first axis."""
    order = W.partitionBy("scan_id").orderBy("ci", "label")
    step = [F.coalesce(F.lead(f"c{a}").over(order), F.col(f"c{a}")) - F.coalesce(F.lag(f"c{a}").over(order), F.col(f"c{a}")) for a in AXES]
    return stats.withColumns({f"_d{k}": s for k, s in enumerate(step)}).withColumn("angle", angle(F.col("_d0"), F.col("_d1"), F.col("_d2"), F.lit(1.0), F.lit(0.0), F.lit(0.0))).drop("_d0", "_d1", "_d2")


def asof_lower(points: DataFrame, bases: DataFrame) -> DataFrame:
    """For each point the base with the greatest height strictly below it, else the scan's lowest base.

    Both have (scan_id, label, ci). One sort over the union of both instead of comparing
    all pairs; on equal heights of bases the smallest label wins. Returns scan_id, label,
    base, base_ci, above_all.
    """
    lowest = bases.groupBy("scan_id", "ci").agg(F.min("label").alias("base"))
    first = lowest.groupBy("scan_id").agg(F.min(F.struct("ci", "base")).alias("_first"))
    both = points.select("scan_id", "ci", "label", F.lit(None).cast("struct<ci:double,base:int>").alias("_b")).unionByName(
        lowest.select("scan_id", "ci", F.lit(None).cast("int").alias("label"), F.struct(F.col("ci").alias("ci"), F.col("base").cast("int").alias("base")).alias("_b"))
    )
    # Points stand before bases of the same height, so that only lower bases precede them.
    below = W.partitionBy("scan_id").orderBy("ci", F.col("_b").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    hit = both.withColumn("_hit", F.max("_b").over(below)).filter("label is not null")
    out = hit.join(first, "scan_id").withColumn("_use", F.coalesce("_hit", "_first"))
    return out.select("scan_id", "label", F.col("_use.base").alias("base"), F.col("_use.ci").alias("base_ci"), F.col("_hit").isNull().alias("above_all"))


def relative_overlap(new: DataFrame, claimed: DataFrame, keys: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Share of each group's voxels in ``new`` that are in ``claimed`` as well."""
    hit = claimed.select(*keys).distinct().withColumn("_hit", F.lit(1))
    joined = new.select(*dict.fromkeys([*keys, *group])).distinct().join(hit, list(keys), "left")
    return joined.groupBy(*group).agg((F.count("_hit") / F.count(F.lit(1))).alias("share"))


def duplicate_assignments(verts: DataFrame, assigned: DataFrame, first: int = 1) -> DataFrame:
    """Vertebrae (scan_id, label) with several discs or none; the topmost label may have none. ``assigned`` (scan_id, base)."""
    own = assigned.select("scan_id", F.col("base").alias("label"), F.lit(1).alias("_one"))
    n = verts.select("scan_id", "label").join(own, ["scan_id", "label"], "left").groupBy("scan_id", "label").agg(F.count("_one").alias("discs"))
    return n.filter(((F.col("discs") == 0) & (F.col("label") != first)) | (F.col("discs") > 1))


def box_overlap(a: DataFrame, b: DataFrame, margin: int = 0, block: int = 16) -> DataFrame:
    """Pairs (scan_id, a, b) of labels whose boxes meet on all axes, borders included, with a margin of height.

    Boxes meet in blocks of height, so only boxes of about the same height are compared.
    """
    cut = lambda c: F.floor(c / block).cast("int")
    sides = [f"{x}{n}" for x in AXES for n in (0, 1)]
    left = a.select("scan_id", F.col("label").alias("a"), *sides, F.explode(F.sequence(cut(F.col("i0") - margin), cut(F.col("i1") + margin))).alias("_k"))
    right = b.select("scan_id", F.col("label").alias("b"), *[F.col(c).alias(f"o{c}") for c in sides], F.explode(F.sequence(cut(F.col("i0")), cut(F.col("i1")))).alias("_k"))
    out = left.join(right, ["scan_id", "_k"])
    for x in AXES:
        m = margin if x == "i" else 0
        out = out.filter((F.col(f"{x}0") - m <= F.col(f"o{x}1")) & (F.col(f"o{x}0") - m <= F.col(f"{x}1")))
    return out.select("scan_id", "a", "b").distinct()


def running_min_fill(vox: DataFrame, value: str, out: str = "filled", axis: str = "i", keys: Sequence[str] = ("scan_id",), upwards: bool = False) -> DataFrame:
    """Each line along ``axis`` takes over the least value met so far, from its end on if ``upwards``."""
    line = [a for a in AXES if a != axis]
    order = [F.desc(axis) if upwards else F.asc(axis), F.asc(value)]
    w = W.partitionBy(*keys, *line).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return vox.withColumn(out, F.min(value).over(w))
