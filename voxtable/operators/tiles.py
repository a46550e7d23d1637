"""Tile plans, weights and the hooks for a user's scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import product
from math import exp

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from voxtable.functions.units import argmax_class
from voxtable.operators.voxels import AXES, KEY
from voxtable.plans.storage import small_side, staged_rows


def tile_starts(size: Column, tile: int, step: float = 0.5) -> Column:
    """Starts of tiles along one axis, evenly spread from end to end."""
    span = F.greatest(size, F.lit(tile)) - tile
    n = F.ceil(span / (tile * step)) + 1
    at = F.when(n > 1, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda k: F.bround(k * (span / (n - 1)), 0).cast("int"))).otherwise(F.array(F.lit(0)))
    return at


def tile_grid(scans: DataFrame, tile: Sequence[int], step: float = 0.5) -> DataFrame:
    """All tiles of every scan: scan_id, p0, i0, r0 and padded shape."""
    out = scans
    for a, t in zip(AXES, tile, strict=True):
        out = out.withColumn(f"{a}0", F.explode(tile_starts(F.col(f"n{a}"), t, step)))
    pads = [F.greatest(F.col(f"n{a}"), F.lit(t)).alias(f"pad_{a}") for a, t in zip(AXES, tile, strict=True)]
    return out.select("scan_id", *[f"{a}0" for a in AXES], *pads)


def slice_grid(scans: DataFrame, tile: Sequence[int], step: float = 0.5, axis: str = "p") -> DataFrame:
    """Two-dimensional tiles for each slice of an axis."""
    return tile_grid(scans, [1 if a == axis else t for a, t in zip(AXES, tile, strict=True)], step)


def tile_assign(vox: DataFrame, scans: DataFrame, tile: Sequence[int], step: float = 0.5) -> DataFrame:
    """Every voxel with each tile that covers it; starts are filtered per axis, so no tile table is joined."""
    out = vox.join(scans.select("scan_id", *[f"n{a}" for a in AXES]), "scan_id")

    def covers(a: str, t: int) -> Callable[[Column], Column]:
        return lambda s: (s <= F.col(a)) & (F.col(a) < s + t)

    for a, t in zip(AXES, tile, strict=True):
        out = out.withColumn(f"{a}0", F.explode(F.filter(tile_starts(F.col(f"n{a}"), t, step), covers(a, t))))
    return out.drop(*[f"n{a}" for a in AXES])


def gaussian_weight(size: int, sigma: float = 1 / 8) -> list[float]:
    """Weights along one axis of a tile, scaled to a peak of 1; zeros become the least weight above 0."""
    s, mid = size * sigma, size // 2
    w = [exp(-((k - mid) ** 2) / (2 * s * s)) for k in range(size)]
    top = max(w)
    w = [x / top for x in w]
    least = min(x for x in w if x > 0)
    return [x or least for x in w]


def with_weight(assigned: DataFrame, tile: Sequence[int], sigma: float = 1 / 8) -> DataFrame:
    """Add the separable Gaussian weight of a voxel's place in its tile; the tables have tile-size entries."""
    weight = None
    for a, t in zip(AXES, tile, strict=True):
        w = F.element_at(F.array(*map(F.lit, gaussian_weight(t, sigma))), F.col(a) - F.col(f"{a}0") + 1)
        weight = w if weight is None else weight * w
    return assigned.withColumn("weight", weight)


def score(df: DataFrame, keys: Sequence[str], make_predict: Callable[[], Callable[[pd.DataFrame], np.ndarray]], value: str = "scores") -> DataFrame:
    """Apply a user's scorer: it is made once per task and maps a batch of rows to a matrix of scores."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = make_predict()
        for batch in batches:
            out = batch[list(keys)].copy()
            out[value] = list(np.asarray(predict(batch), dtype=float))
            yield out

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in keys)
    return df.mapInPandas(run, f"{fields}, {value} array<double>").select(*keys, value)


def cutout(vox: DataFrame, centers: DataFrame, size: Sequence[int]) -> DataFrame:
    """Windows around centres (scan_id, com_idx, p, i, r): voxels counted from the window's corner.

    A range join, made an equi-join by blocks of the window's height.
    """
    h = size[1]
    c = centers.select("scan_id", "com_idx", *[(F.col(a) - s // 2).alias(f"{a}0") for a, s in zip(AXES, size, strict=True)])
    c = c.withColumn("_b", F.explode(F.sequence(F.floor(F.col("i0") / h), F.floor((F.col("i0") + h - 1) / h))))
    out = vox.withColumn("_b", F.floor(F.col("i") / h)).join(c, ["scan_id", "_b"])
    for a, s in zip(AXES, size, strict=True):
        out = out.filter((F.col(a) >= F.col(f"{a}0")) & (F.col(a) < F.col(f"{a}0") + s))
    return out.select("scan_id", "com_idx", *[(F.col(a) - F.col(f"{a}0")).alias(a) for a in AXES], *[x for x in vox.columns if x not in KEY])


def slide_to_foreground(centers: DataFrame, foreground: DataFrame, scans: DataFrame, step: int = 5) -> DataFrame:
    """Move a centre down in steps until it stands on a foreground voxel; if it never does it stays."""
    tries = centers.join(scans.select("scan_id", "ni"), "scan_id").withColumn("_k", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"cast((ni - 1 - i) div {step} as int)")))))
    at = tries.select("scan_id", "com_idx", "p", (F.col("i") + F.col("_k") * step).alias("i"), "r", "_k")
    hit = foreground.select(*KEY).join(small_side(staged_rows(at, "slides")), KEY).groupBy("scan_id", "com_idx").agg(F.min("_k").alias("_k"))
    return centers.join(hit, ["scan_id", "com_idx"], "left").withColumn("i", (F.col("i") + F.coalesce("_k", F.lit(0)) * step).cast("int")).drop("_k")


#: Pole of the cubic B-spline's prefilter.
POLE = 3**0.5 - 2


def spline_coefficients(cube: np.ndarray) -> np.ndarray:
    """Coefficients of the cubic B-spline through the values, mirrored at the borders, axis by axis."""
    out = cube.astype(float)
    for axis in range(out.ndim):
        a = np.moveaxis(out, axis, 0)
        n = len(a)
        if n == 1:
            continue
        c = 6 * a
        turn = np.concatenate([np.arange(n), np.arange(n - 2, 0, -1)])  # one period of the mirrored line
        weights = POLE ** np.arange(len(turn)) / (1 - POLE ** len(turn))
        c0 = np.tensordot(weights, c[turn], axes=1)
        up = np.empty_like(c)
        up[0] = c0
        for k in range(1, n):
            up[k] = c[k] + POLE * up[k - 1]
        down = np.empty_like(c)
        down[-1] = POLE / (POLE**2 - 1) * (up[-1] + POLE * up[-2])
        for k in range(n - 2, -1, -1):
            down[k] = POLE * (down[k + 1] - up[k])
        out = np.moveaxis(down, 0, axis)
    return out


def _taps(x: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The four places and weights of a cubic B-spline at ``x`` on a line of ``n`` values."""
    low = np.floor(x).astype(int)
    t = x - low
    weights = ((1 - t) ** 3 / 6, (4 - 6 * t**2 + 3 * t**3) / 6, (1 + 3 * t + 3 * t**2 - 3 * t**3) / 6, t**3 / 6)
    period = max(1, 2 * (n - 1))
    places = [np.abs((low + k - 1 + n - 1) % period - (n - 1)) if n > 1 else np.zeros_like(low) for k in range(4)]
    return list(zip(places, weights, strict=True))


def spline_values(coefficients: np.ndarray, at: Sequence[np.ndarray]) -> np.ndarray:
    """Values of the spline at places (one array an axis); 0 outside of the cube."""
    taps = [_taps(x, n) for x, n in zip(at, coefficients.shape, strict=True)]
    inside = np.logical_and.reduce([(x >= 0) & (x <= n - 1) for x, n in zip(at, coefficients.shape, strict=True)])
    out = np.zeros(at[0].shape)
    for (p, wp), (i, wi), (r, wr) in product(*taps):
        out += wp * wi * wr * coefficients[p, i, r]
    return np.where(inside, out, 0.0)


def rotated_patches(patches: DataFrame, size: Sequence[int], cubic: bool = False) -> DataFrame:
    """Rotate each patch (scan_id, com_idx, p, i, r, value, angle) about its middle in the p-i plane and crop it.

    Masks take the nearest voxel; with ``cubic`` images are interpolated by a cubic
    B-spline, prefiltered and mirrored at the borders, and are 0 outside of the patch. One
    task per patch, whose size is bounded.
    """
    def turn(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.deg2rad(pdf["angle"].iloc[0])
        n = [int(pdf[x].max()) + 1 for x in AXES]
        cube = np.zeros(n)
        cube[tuple(pdf[x].to_numpy() for x in AXES)] = pdf["value"]
        p, i, r = np.indices(size)
        cp, ci, cr = [(m - 1) / 2 for m in n]
        dp, di = p - (size[0] - 1) / 2, i - (size[1] - 1) / 2
        at = [np.cos(a) * dp - np.sin(a) * di + cp, np.sin(a) * dp + np.cos(a) * di + ci, r - (size[2] - 1) / 2 + cr]
        if cubic:
            value = spline_values(spline_coefficients(cube), at)
        else:
            near = [np.rint(x).astype(int) for x in at]
            inside = np.logical_and.reduce([(x >= 0) & (x < m) for x, m in zip(near, n, strict=True)])
            value = np.zeros(size)
            value[inside] = cube[tuple(x[inside] for x in near)]
        where = np.nonzero(value)
        out = pd.DataFrame({x: w.astype("int32") for x, w in zip(AXES, where, strict=True)} | {"value": value[where]})
        return out.assign(scan_id=pdf["scan_id"].iloc[0], com_idx=pdf["com_idx"].iloc[0])[["scan_id", "com_idx", *AXES, "value"]]

    kinds = {f.name: f.dataType.simpleString() for f in patches.schema}
    return patches.groupBy("scan_id", "com_idx").applyInPandas(turn, f"scan_id {kinds['scan_id']}, com_idx {kinds['com_idx']}, p int, i int, r int, value double")


def scores_to_mask(scored: DataFrame, keys: Sequence[str], corners: DataFrame | None = None, axes: Sequence[str] = ("p", "i", "r")) -> DataFrame:
    """Best class of each voxel, background left out, put back into the whole frame.

    ``corners`` (scan_id, p, i, r): where each scan's crop box starts; ``axes``: the axes that the
    score's p, i and r are, undone here. The first of equal scores wins.
    """
    out = scored.select(*keys, argmax_class(F.col("scores")).alias("cls")).filter("cls > 0")
    others = [k for k in keys if k not in ("p", "i", "r")]
    out = out.select(*others, *[F.col(a).alias(to) for a, to in zip(("p", "i", "r"), axes, strict=True)], "cls")
    if corners is not None:
        start = corners.select("scan_id", *[F.col(a).alias(f"_{a}") for a in ("p", "i", "r")])
        out = out.join(start, "scan_id").select(*others, *[(F.col(a) + F.col(f"_{a}")).cast("int").alias(a) for a in ("p", "i", "r")], "cls")
    return out.select(*keys, "cls")
