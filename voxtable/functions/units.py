"""Voxel sizes, zooms and thresholds as column expressions.

Zooms are arrays of doubles in mm; rounding is half to even throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Zoom at which thresholds are written down. Fixed value.
REFERENCE_ZOOM = (0.75, 0.75, 1.65)


def zoom_volume(zoom: Column) -> Column:
    return F.aggregate(zoom, F.lit(1.0), lambda a, z: a * z)


def mm3_to_voxels(mm3: Column, zoom: Column, least: int = 1) -> Column:
    """Voxels of a volume, at least ``least``."""
    return F.greatest(F.bround(mm3 / zoom_volume(zoom), 0), F.lit(float(least))).cast("long")


def area_to_voxels(mm2: Column, zoom: Column, least: int = 1) -> Column:
    """Faces of an area; the mean face is the volume to the power 2/3."""
    return F.greatest(F.bround(mm2 / F.pow(zoom_volume(zoom), F.lit(2 / 3)), 0), F.lit(float(least))).cast("long")


def mm_to_voxels(mm: Column, zoom: Column, least: int = 0) -> Column:
    """Steps of a length along the finest axis."""
    return F.greatest(F.bround(mm / F.array_min(zoom), 0), F.lit(float(least))).cast("long")


def mm_to_voxels_axis(mm: Column, zoom: Column, axis: int) -> Column:
    """Fractional steps of a length along one axis."""
    return mm / zoom[axis]


def reference_voxels(n: float) -> float:
    """mm3 of ``n`` voxels at the reference zoom."""
    return n * REFERENCE_ZOOM[0] * REFERENCE_ZOOM[1] * REFERENCE_ZOOM[2]


def recommended_zoom(zoom: Column, low: Column, high: Column) -> Column:
    """Each axis clamped into [low, high]; where ``high`` is null, ``low`` itself."""
    clamped = F.zip_with(F.zip_with(zoom, low, lambda z, a: F.greatest(z, a)), high, lambda z, b: F.least(z, b))
    return F.when(high.isNull(), low).otherwise(clamped)


def same_zoom(a: Column, b: Column) -> Column:
    """Whether no axis differs by 1e-4 or more."""
    return F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: d < 1e-4)


def scaled_threshold(voxels: Column, resolution: Column) -> Column:
    """A threshold in mm3 from voxels at ``resolution``, cut to an integer."""
    return (voxels * zoom_volume(resolution)).cast("int")


def orientation_opposite(code: Column) -> Column:
    return F.translate(code, "LRPAIS", "RLAPSI")


def scan_dims(shape: Column) -> Column:
    """Shape padded to four axes with 1."""
    return F.slice(F.concat(shape, F.array_repeat(F.lit(1).cast("int"), 4)), 1, 4)


def angle_between(ax: Column, ay: Column, az: Column, bx: Column, by: Column, bz: Column) -> Column:
    """Degrees between two vectors, signed by their cross product's sum; collinear ones count as positive."""
    norm = lambda x, y, z: F.sqrt(x * x + y * y + z * z)
    cos = (ax * bx + ay * by + az * bz) / (norm(ax, ay, az) * norm(bx, by, bz))
    cross = (ay * bz - az * by) + (az * bx - ax * bz) + (ax * by - ay * bx)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))) * F.when(cross < 0, -1.0).otherwise(1.0)


def one_hot(label: Column, n: int) -> Column:
    """0/1 array of ``n``; labels outside of it count as 0."""
    inside = F.when((label >= 0) & (label < n), label).otherwise(F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda x: (x == inside).cast("int"))


def argmax_class(scores: Column) -> Column:
    """Index of the first maximum."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def zip_strict(a: Column, b: Column) -> Column:
    """``arrays_zip`` that fails on arrays of unequal lengths."""
    return F.when(F.size(a) == F.size(b), F.arrays_zip(a.alias("a"), b.alias("b"))).otherwise(F.raise_error(F.lit("arrays of unequal lengths")))
