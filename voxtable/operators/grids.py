"""The grid that a model works on, and the way back.

What was done to each scan (orientation, padding, zoom, crop) is a row of a table, so a whole
cohort goes there and back in a few joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxtable.functions.units import recommended_zoom
from voxtable.operators import voxels as vx
from voxtable.operators.voxels import AXES, KEY
from voxtable.plans.storage import small_side, staged_rows as staged

#: Letters of the working orientation with their opposites. Fixed values.
LETTERS = (("P", "A"), ("I", "S"), ("R", "L"))
#: Margin around the mask, 5 voxels at the reference zoom. Fixed value.
MARGIN_MM = 5 * 0.75


def _ints(df: DataFrame, prefix: str, of) -> list[Column]:
    return [of(a).cast("int").alias(f"{prefix}{a}") for a in AXES]


def resize_nearest(vox: DataFrame, sizes: DataFrame) -> DataFrame:
    """Nearest voxel on a grid of another shape; ``sizes``: scan_id, from_p .. from_r, to_p .. to_r."""
    out = vox.join(sizes, "scan_id")
    for a in AXES:
        # Places of the new grid around those of the old voxel, of which those stay whose nearest voxel it is.
        n, m = F.col(f"from_{a}"), F.col(f"to_{a}")
        first = F.greatest(F.floor(F.col(a) * m / n - 0.5) - 1, F.lit(0)).cast("int")
        last = F.least(F.when(F.col(a) < n - 1, F.ceil((F.col(a) + 1) * m / n - 0.5) + 1).otherwise(m - 1), m - 1).cast("int")
        near = out.filter(F.col(a).between(0, n - 1) & (first <= last)).withColumn("_to", F.explode(F.sequence(first, last)))
        out = near.filter(F.least(F.floor((F.col("_to") + 0.5) * n / m), n - 1) == F.col(a)).withColumn(a, F.col("_to")).drop("_to")
    return out.select(*vox.columns)


def model_grid(scans: DataFrame, low: Column, high: Column, pad: int = 0) -> DataFrame:
    """What reorientation, padding and rescaling do to each scan, staged; the crop isn't in it yet.

    ``scans`` have np .. nr, zp .. zr and perhaps ``orientation`` (three letters for the axes
    p, i, r as they are stored; absent or null: PIR). ``low`` and ``high`` bound the zoom of
    the model. Columns: n (shape), k (stored axis, from 1) and f (flipped) for each working
    axis, o (shape turned), q (padded), m (rescaled), t (zoom there), z (zoom turned).
    """
    code = F.coalesce(F.col("orientation"), F.lit("PIR")) if "orientation" in scans.columns else F.lit("PIR")
    out = scans.select("scan_id", *_ints(scans, "n", lambda a: F.col(f"n{a}")), *[F.col(f"z{a}").alias(f"_z{a}") for a in AXES], code.alias("_code"))
    for a, (letter, opposite) in zip(AXES, LETTERS, strict=True):
        out = out.withColumns({f"k{a}": F.greatest(F.instr("_code", letter), F.instr("_code", opposite)), f"f{a}": F.instr("_code", letter) == 0})
    pick = lambda prefix, a: F.element_at(F.array(*[f"{prefix}{x}" for x in AXES]), F.col(f"k{a}"))
    out = out.withColumns({f"o{a}": pick("n", a) for a in AXES} | {f"z{a}": pick("_z", a) for a in AXES})
    out = out.withColumns({f"q{a}": F.col(f"o{a}") + 2 * pad for a in AXES})
    zoom = recommended_zoom(F.array(*[f"z{a}" for a in AXES]), low, high)
    out = out.withColumns({f"t{a}": zoom[j] for j, a in enumerate(AXES)}).withColumn("pad", F.lit(pad))
    out = out.withColumns({f"m{a}": F.greatest(F.bround(F.col(f"q{a}") * F.col(f"z{a}") / F.col(f"t{a}"), 0).cast("int"), F.lit(1)) for a in AXES})
    return small_side(staged(out.drop(*[f"_z{a}" for a in AXES], "_code"), "grid"))


def to_model_grid(vox: DataFrame, grid: DataFrame, margin_mm: float = MARGIN_MM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(voxels on the model's grid, its scans, the grid with the crop's corner c): all staged.

    Turned to the working orientation, padded by repeated borders, rescaled to the nearest
    voxel and cropped to what there is plus a margin. Scans without a voxel are left out.
    """
    turn = grid.select("scan_id", *[f"{x}{a}" for x in ("k", "f", "o") for a in AXES])
    place = lambda a: F.element_at(F.array(*AXES), F.col(f"k{a}"))
    moved = {a: F.when(F.col(f"f{a}"), F.col(f"o{a}") - 1 - place(a)).otherwise(place(a)) for a in AXES}
    out = vox.join(turn, "scan_id").withColumns(moved).select(*vox.columns)
    pad = grid.select("pad").head()
    if pad and pad[0]:
        shape = grid.select("scan_id", *[F.col(f"o{a}").alias(f"n{a}") for a in AXES])
        for a in AXES:
            out = vx.pad_edge(out, shape, pad[0], a)
    out = staged(resize_nearest(out, grid.select("scan_id", *[F.col(f"q{a}").alias(f"from_{a}") for a in AXES], *[F.col(f"m{a}").alias(f"to_{a}") for a in AXES])), "model-grid")
    dist = F.ceil(margin_mm / F.least(*[f"t{a}" for a in AXES])).cast("int")
    box = vx.box(out).join(grid, "scan_id").withColumn("_d", dist)
    ends = {f"c{a}": F.greatest(F.col(f"{a}0") - F.col("_d"), F.lit(0)) for a in AXES} | {f"e{a}": F.least(F.col(f"{a}1") + F.col("_d"), F.col(f"m{a}") - 1) for a in AXES}
    full = small_side(staged(box.withColumns(ends).select(*grid.columns, *ends), "grid"))
    corner = full.select("scan_id", *[f"c{a}" for a in AXES])
    cut = staged(out.join(corner, "scan_id").withColumns({a: F.col(a) - F.col(f"c{a}") for a in AXES}).select(*vox.columns), "model-grid")
    scans = full.select("scan_id", *[(F.col(f"e{a}") - F.col(f"c{a}") + 1).alias(f"n{a}") for a in AXES], *[F.col(f"t{a}").alias(f"z{a}") for a in AXES])
    return cut, small_side(staged(scans, "model-scans")), full


def from_model_grid(vox: DataFrame, grid: DataFrame) -> DataFrame:
    """Back to the stored grid of every scan: crop, zoom, padding and orientation undone."""
    corner = grid.select("scan_id", *[f"c{a}" for a in AXES])
    out = vox.join(corner, "scan_id").withColumns({a: F.col(a) + F.col(f"c{a}") for a in AXES}).select(*vox.columns)
    out = resize_nearest(out, grid.select("scan_id", *[F.col(f"m{a}").alias(f"from_{a}") for a in AXES], *[F.col(f"q{a}").alias(f"to_{a}") for a in AXES]))
    turn = grid.select("scan_id", "pad", *[f"{x}{a}" for x in ("k", "f", "o") for a in AXES])
    out = out.join(turn, "scan_id").withColumns({a: F.col(a) - F.col("pad") for a in AXES})
    for a in AXES:
        out = out.filter((F.col(a) >= 0) & (F.col(a) < F.col(f"o{a}")))
    back = {a: F.when(F.col(f"f{a}"), F.col(f"o{a}") - 1 - F.col(a)).otherwise(F.col(a)) for a in AXES}
    stored = {}
    for j, a in enumerate(AXES):
        stored[a] = F.coalesce(*[F.when(F.col(f"k{x}") == j + 1, back[x]) for x in AXES])
    return out.withColumns(stored).select(*vox.columns)
