"""Centre lines and points of discs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from voxtable.operators.voxels import KEY


def centerline(points: DataFrame, per_point: int = 8) -> DataFrame:
    """8 n vertices (rounded half to even), evenly spread in height through n points (scan_id, x, y, z).

    x and z are interpolated between the two points around a height.
    """
    w = W.partitionBy("scan_id").orderBy("y", "x", "z")
    ends = points.groupBy("scan_id").agg(F.count(F.lit(1)).alias("_n"), F.min("y").alias("_lo"), F.max("y").alias("_hi"))
    legs = points.withColumns({"x2": F.lead("x").over(w), "y2": F.lead("y").over(w), "z2": F.lead("z").over(w), "_leg": F.row_number().over(w)}).filter("y2 is not null")
    line = ends.filter("_n > 1").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") * per_point - 1)))
    line = line.withColumn("h", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("k") / (F.col("_n") * per_point - 1))
    met = line.join(legs, "scan_id").filter((F.col("h") >= F.col("y")) & (F.col("h") <= F.col("y2")) & (F.col("y2") > F.col("y")))
    met = met.withColumn("_rn", F.row_number().over(W.partitionBy("scan_id", "k").orderBy("_leg"))).filter("_rn = 1")
    t = (F.col("h") - F.col("y")) / (F.col("y2") - F.col("y"))
    at = lambda a: F.bround(F.col(a) + (F.col(f"{a}2") - F.col(a)) * t, 0).cast("int").alias(a)
    return met.select("scan_id", F.col("k").cast("int").alias("k"), at("x"), F.bround("h", 0).cast("int").alias("y"), at("z"))


def nearest_on_line(points: DataFrame, line: DataFrame, keys: list[str]) -> DataFrame:
    """Nearest vertex of the scan's line to each point (scan_id, keys, x, y, z): its index and squared distance.

    A line has 8 vertices a disc, so a point meets a bounded number of rows.
    """
    v = line.select("scan_id", "k", *[F.col(a).alias(f"_{a}") for a in "xyz"])
    d = sum(((F.col(a) - F.col(f"_{a}")) * (F.col(a) - F.col(f"_{a}")) for a in "xyz"), F.lit(0))
    met = points.join(v, "scan_id").withColumn("_d", d)
    return met.groupBy("scan_id", *keys, "x", "y", "z").agg(F.min_by("k", F.struct("_d", "k")).alias("k"), F.min("_d").alias("d2"))


def disc_points(vox: DataFrame, line: DataFrame, col: str = "disc") -> DataFrame:
    """Of every disc's bounding box the voxel closest to the line; first in scan order on ties."""
    voxels = vox.select("scan_id", col, F.col("p").alias("x"), F.col("i").alias("y"), F.col("r").alias("z"))
    near = nearest_on_line(voxels, line, [col])
    return near.groupBy("scan_id", col).agg(F.min(F.struct("d2", "x", "y", "z")).alias("m")).select("scan_id", col, "m.x", "m.y", "m.z", "m.d2")


def insert_disc2(points: DataFrame) -> DataFrame:
    """Add disc 2 at disc 3's place and the middle height of discs 1 and 3, where both exist."""
    one = points.filter("disc = 1").select("scan_id", F.col("y").alias("_y1"))
    two = points.filter("disc = 3").join(one, "scan_id").select("scan_id", F.lit(2).alias("disc"), "x", F.floor((F.col("y") + F.col("_y1")) / 2).cast("int").alias("y"), "z")
    return points.select("scan_id", "disc", "x", "y", "z").unionByName(two)


def top_voxel(vox: DataFrame, col: str) -> DataFrame:
    """Topmost voxel of each label; first in scan order on ties."""
    return vox.groupBy("scan_id", col).agg(F.min(F.struct("i", "p", "r")).alias("m")).select("scan_id", col, F.col("m.p").alias("x"), F.col("m.i").alias("y"), F.col("m.r").alias("z"))


__all__ = ["KEY", "centerline", "disc_points", "insert_disc2", "nearest_on_line", "top_voxel"]
