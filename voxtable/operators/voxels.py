"""Remaps, masks, crops and grids of voxel tables keyed by (scan_id, p, i, r).

An absent row is label 0. Scan metadata is one row per scan with shape (np, ni, nr) and
zoom (zp, zi, zr) in mm.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

KEY = ["scan_id", "p", "i", "r"]
AXES = ["p", "i", "r"]


def extract_label(vox: DataFrame, col: str, labels: Sequence[int], keep_label: bool = False) -> DataFrame:
    """Voxels of the labels; their value becomes 1 unless ``keep_label``."""
    out = vox.filter(F.col(col).isin(*labels))
    return out if keep_label else out.withColumn(col, F.lit(1))


def map_labels(vox: DataFrame, col: str, mapping: Mapping[int, int]) -> DataFrame:
    """Labels outside of the map stay; a label mapped to 0 loses its voxels."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return vox.withColumn(col, F.coalesce(F.element_at(table, F.col(col)), F.col(col))).filter(F.col(col) != 0)


def map_labels_by(vox: DataFrame, col: str, table: DataFrame, keys: Sequence[str] = ("scan_id",)) -> DataFrame:
    """As ``map_labels``, by a table (keys, label, new_label)."""
    t = table.select(*keys, F.col("label").alias(col), "new_label")
    return vox.join(t, [*keys, col], "left").withColumn(col, F.coalesce("new_label", col)).drop("new_label").filter(F.col(col) != 0)


def apply_mask(vox: DataFrame, mask: DataFrame) -> DataFrame:
    """Voxels whose place is in the mask."""
    return vox.join(mask.select(*KEY), KEY, "left_semi")


def override_where(vox: DataFrame, col: str, where: Column, value: int) -> DataFrame:
    return vox.withColumn(col, F.when(where, F.lit(value)).otherwise(F.col(col)))


def normalize_range(vox: DataFrame, col: str = "intensity", low: float = 0.0, high: float = 1500.0) -> DataFrame:
    """Shift each scan's minimum to ``low``, and scale down where its maximum is above ``high``."""
    ends = vox.groupBy("scan_id").agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    scale = F.when(F.col("_hi") > high, high / F.col("_hi")).otherwise(1.0)
    return vox.join(ends, "scan_id").withColumn(col, (F.col(col) - F.col("_lo") + low) * scale).drop("_lo", "_hi")


def zscore_nonzero(vox: DataFrame, keys: Sequence[str], col: str = "intensity") -> DataFrame:
    """Standardise by mean and population deviation of the values that are not zero, per patch."""
    stats = vox.filter(F.col(col) != 0).groupBy(*keys).agg(F.avg(col).alias("_m"), F.stddev_pop(col).alias("_s"))
    z = F.when((F.col(col) != 0) & (F.col("_s") > 0), (F.col(col) - F.col("_m")) / F.col("_s")).otherwise(F.lit(0.0))
    return vox.join(stats, list(keys), "left").withColumn(col, z).drop("_m", "_s")


def box(vox: DataFrame, keys: Sequence[str] = ("scan_id",)) -> DataFrame:
    """Least and greatest index of each axis: p0, p1, i0, i1, r0, r1."""
    return vox.groupBy(*keys).agg(*[f(a).alias(f"{a}{n}") for a in AXES for n, f in ((0, F.min), (1, F.max))])


def crop_to_box(vox: DataFrame, foreground: DataFrame, scans: DataFrame, margin: Column | int = 0) -> DataFrame:
    """Voxels inside the foreground's box, widened by ``margin`` voxels (an expression over scans) and clipped."""
    b = box(foreground).join(scans.withColumn("_m", F.lit(margin) if isinstance(margin, int) else margin), "scan_id")
    ends = [f(F.col(f"{a}{n}") + s * F.col("_m"), edge).alias(f"_{a}{n}") for a in AXES for n, s, f, edge in ((0, -1, F.greatest, F.lit(0)), (1, 1, F.least, F.col(f"n{a}") - 1))]
    cut = b.select("scan_id", *ends)
    inside = vox.join(cut, "scan_id")
    for a in AXES:
        inside = inside.filter(F.col(a).between(F.col(f"_{a}0"), F.col(f"_{a}1")))
    return inside.drop(*[f"_{a}{n}" for a in AXES for n in (0, 1)])


def uncrop(frame: DataFrame, cropped: DataFrame, corner: DataFrame) -> DataFrame:
    """Write a crop back: ``corner`` (scan_id, p0, p1, i0, i1, r0, r1) replaces what was inside of it.

    Voxels of ``cropped`` count from the corner.
    """
    inside = [F.col(a).between(F.col(f"{a}0"), F.col(f"{a}1")) for a in AXES]
    outside = frame.join(corner, "scan_id", "left").filter(~F.coalesce(inside[0] & inside[1] & inside[2], F.lit(False))).select(*frame.columns)
    moved = cropped.join(corner, "scan_id").withColumns({a: (F.col(a) + F.col(f"{a}0")).cast("int") for a in AXES})
    return outside.unionByName(moved.select(*frame.columns))


def pad(vox: DataFrame, n: int) -> DataFrame:
    return vox.withColumns({a: F.col(a) + n for a in AXES})


def unpad(vox: DataFrame, scans: DataFrame, n: int) -> DataFrame:
    """Take the padding off; ``scans`` has the shape without it."""
    out = vox.withColumns({a: F.col(a) - n for a in AXES}).join(scans.select("scan_id", *[f"n{a}" for a in AXES]), "scan_id")
    for a in AXES:
        out = out.filter((F.col(a) >= 0) & (F.col(a) < F.col(f"n{a}")))
    return out.select(*vox.columns)


def pad_edge(vox: DataFrame, scans: DataFrame, n: int, axis: str = "r") -> DataFrame:
    """Pad along one axis and repeat the border slices."""
    size = F.col(f"n{axis}")
    place = F.when(size == 1, F.sequence(F.lit(0), F.lit(2 * n))).when(F.col(axis) == 0, F.sequence(F.lit(0), F.lit(n))).when(F.col(axis) == size - 1, F.sequence(F.col(axis) + n, F.col(axis) + 2 * n)).otherwise(F.array(F.col(axis) + n))
    out = vox.join(scans.select("scan_id", f"n{axis}"), "scan_id").withColumn("_at", F.explode(place))
    return out.withColumn(axis, F.col("_at")).select(*vox.columns)


def reorient(vox: DataFrame, scans: DataFrame, source: str = "PIR", target: str = "LAS") -> DataFrame:
    """Move voxels from one orientation to another: axes are permuted, opposite letters flipped.

    Columns p, i, r hold the first, second and third axis of the orientation.
    """
    pairs = ("LR", "PA", "SI")
    of = lambda c: next(k for k, pair in enumerate(pairs) if c in pair)
    moved = {}
    for j, letter in enumerate(target):
        k = next(k for k, c in enumerate(source) if of(c) == of(letter))
        moved[AXES[j]] = F.col(AXES[k]) if source[k] == letter else F.col(f"n{AXES[k]}") - 1 - F.col(AXES[k])
    return vox.join(scans.select("scan_id", *[f"n{a}" for a in AXES]), "scan_id").withColumns(moved).select(*vox.columns)


def resample_nearest(vox: DataFrame, scans: DataFrame, zoom: Mapping[str, float]) -> DataFrame:
    """Nearest voxel of the source for each voxel of a grid with the new zoom; new shape is rounded half to even."""
    sized = scans.select("scan_id", *[F.col(f"n{a}").alias(f"n{a}") for a in AXES], *[F.bround(F.col(f"n{a}") * F.col(f"z{a}") / zoom[a], 0).cast("int").alias(f"m{a}") for a in AXES])
    out = vox
    for a in AXES:
        grid = sized.select("scan_id", f"n{a}", f"m{a}", F.explode(F.sequence(F.lit(0), F.col(f"m{a}") - 1)).alias("_to"))
        grid = grid.select("scan_id", "_to", F.least(F.floor((F.col("_to") + 0.5) * F.col(f"n{a}") / F.col(f"m{a}")), F.col(f"n{a}") - 1).cast("int").alias(a))
        out = out.join(grid, ["scan_id", a]).withColumn(a, F.col("_to")).drop("_to")
    return out.select(*vox.columns)


def nonzero_coordinates(vox: DataFrame, col: str) -> DataFrame:
    return vox.filter(F.col(col) > 0).orderBy(F.desc(col), *KEY)


def slice_axis(vox: DataFrame, scans: DataFrame, axis: str, index: int, forward: bool = True) -> DataFrame:
    """One slice, counted from the other end if not ``forward``."""
    size = scans.select("scan_id", F.col(f"n{axis}").alias("_n"))
    at = F.lit(index) if forward else F.col("_n") - 1 - index
    return vox.join(size, "scan_id").filter(F.col(axis) == at).drop("_n")


def cast_intensity(vox: DataFrame, col: str = "intensity", low: int = 0, high: int = 255) -> DataFrame:
    """To integers of a range; values are rescaled linearly only in scans that overflow it."""
    ends = vox.groupBy("scan_id").agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    over = (F.col("_lo") < low) | (F.col("_hi") > high)
    span = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1)
    value = F.when(over, F.floor((F.col(col) - F.col("_lo")) * (high - low) / span + low)).otherwise(F.floor(col))
    return vox.join(ends, "scan_id").withColumn(col, value.cast("long")).drop("_lo", "_hi")


def minimal_type(low: Column, high: Column) -> Column:
    """Name of the smallest integer type that holds [low, high]."""
    kinds = [("uint8", 0, 255), ("int8", -128, 127), ("uint16", 0, 65535), ("int16", -32768, 32767), ("uint32", 0, 2**32 - 1), ("int32", -(2**31), 2**31 - 1)]
    out = F.lit("int64")
    for name, a, b in reversed(kinds):
        out = F.when((low >= a) & (high <= b), name).otherwise(out)
    return out


def keep_range_or(vox: DataFrame, col: str, ranges: DataFrame, keep: int = 26) -> DataFrame:
    """Voxels with height in their scan's [lo, hi], and those of label ``keep`` anywhere."""
    return vox.join(ranges, "scan_id").filter(F.col("i").between(F.col("lo"), F.col("hi")) | (F.col(col) == keep)).drop("lo", "hi")


def missing_voxels(sem: DataFrame, inst: DataFrame) -> DataFrame:
    return sem.join(inst.select(*KEY), KEY, "left_anti")


def strip_derived(vox: DataFrame, col: str = "inst") -> DataFrame:
    """Without the reserved labels of discs (100..133) and endplates (200..233)."""
    return vox.filter(~(F.col(col).between(100, 133) | F.col(col).between(200, 233)))


def attach_derived(inst: DataFrame, derived: DataFrame) -> DataFrame:
    """Union of two tables (KEY, inst); instances win where both have a voxel."""
    return inst.select(*KEY, "inst").unionByName(derived.join(inst.select(*KEY), KEY, "left_anti").select(*KEY, "inst"))
