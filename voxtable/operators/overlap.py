"""Competing three-region predictions: coupling, merging, agreement metrics.

Predictions are rows (scan_id, com_idx, lab 0..2, p, i, r). The instance of a prediction
row's region is com_idx + lab.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from voxtable.operators.voxels import KEY
from voxtable.plans.storage import staged_rows as staged

PRED = ["scan_id", "com_idx", "lab"]


def band_pairs(preds: DataFrame, band: int = 2) -> DataFrame:
    """Dice of each existing prediction with those of other centres at most ``band`` away.

    An equi-join on the voxel; only co-covered voxels meet, at most 3 (2 band + 1) a voxel.
    """
    sizes = staged(preds.groupBy(*PRED).agg(F.count(F.lit(1)).alias("n")), "pred-sizes")
    other = preds.select(*KEY, F.col("com_idx").alias("com2"), F.col("lab").alias("lab2"))
    met = preds.join(other, KEY).filter((F.col("com_idx") != F.col("com2")) & (F.abs(F.col("com_idx") - F.col("com2")) <= band))
    both = met.groupBy(*PRED, "com2", "lab2").agg(F.count(F.lit(1)).alias("both"))
    second = sizes.select("scan_id", F.col("com_idx").alias("com2"), F.col("lab").alias("lab2"), F.col("n").alias("n2"))
    return both.join(sizes, PRED).join(second, ["scan_id", "com2", "lab2"]).select(*PRED, "com2", "lab2", (2 * F.col("both") / (F.col("n") + F.col("n2"))).alias("dice"))


def best_two_partners(pairs: DataFrame, least: float = 0.3) -> DataFrame:
    """The two partners of highest dice, first candidate on ties, kept above ``least``."""
    order = W.partitionBy(*PRED).orderBy(F.desc("dice"), "com2", "lab2")
    return pairs.withColumn("rank", F.row_number().over(order)).filter((F.col("rank") <= 2) & (F.col("dice") > least))


def couple_predictions(preds: DataFrame, band: int = 2, least: float = 0.3) -> DataFrame:
    """Couples (scan_id, rank, members sorted, agreement): an anchor with its partners.

    Equal couples of several anchors become one with the mean agreement. They are ranked
    by (size + 1) times agreement, the earlier anchor first on ties.
    """
    partners = best_two_partners(band_pairs(preds, band), least).groupBy(*PRED).agg(
        F.collect_list(F.struct(F.col("com2").alias("com_idx"), F.col("lab2").alias("lab"))).alias("_p"), F.sum("dice").alias("_s"), F.count(F.lit(1)).alias("_k")
    )
    anchors = preds.select(*PRED).distinct().join(partners, PRED, "left")
    me = F.array(F.struct(F.col("com_idx"), F.col("lab")))
    members = F.array_sort(F.concat(me, F.coalesce("_p", F.array().cast("array<struct<com_idx:bigint,lab:int>>"))))
    couples = anchors.select("scan_id", members.alias("members"), F.coalesce(F.round(F.col("_s") / F.col("_k"), 9), F.lit(0.0)).alias("_a"), F.struct("com_idx", "lab").alias("_at"))
    merged = couples.groupBy("scan_id", "members").agg(F.round(F.avg("_a"), 6).alias("agreement"), F.min("_at").alias("_at"))
    score = (F.size("members") + 1) * F.col("agreement")
    order = W.partitionBy("scan_id").orderBy(F.desc(score), "_at", "members")
    return merged.withColumn("rank", F.row_number().over(order)).select("scan_id", "rank", "members", "agreement")


def merge_couples(preds: DataFrame, couples: DataFrame, claimed: float = 0.6) -> DataFrame:
    """Instance voxels (KEY, inst) of the couples, taken greedily in rank order.

    A couple's voxels have support of two members; of one if it has two members or fewer,
    or if its agreement is under 0.3 + 0.15 (4 - size). It is skipped if more than
    ``claimed`` of them are taken, else it claims the free ones. The decision needs only
    counts: voxels are summed by the set of ranks that cover them, the greedy rule folds
    over ranks on these counts per scan, and a voxel goes to its lowest accepted rank.
    """
    size = F.size("members")
    support = F.when((size <= 2) | (F.col("agreement") < 0.3 + 0.15 * (4 - size)), 1).otherwise(2)
    member = couples.select("scan_id", "rank", support.alias("_need"), F.explode("members").alias("m")).select("scan_id", "rank", "_need", "m.com_idx", "m.lab")
    cover = preds.join(member, PRED).groupBy(*KEY, "rank", "_need").agg(F.count(F.lit(1)).alias("_k")).filter("_k >= _need")
    signed = staged(cover.groupBy(*KEY).agg(F.array_sort(F.collect_set("rank")).alias("sig")), "signatures")
    counts = signed.groupBy("scan_id", "sig").agg(F.count(F.lit(1)).alias("n"))
    scans = counts.groupBy("scan_id").agg(F.collect_list(F.struct("sig", "n")).alias("sigs")).join(couples.groupBy("scan_id").agg(F.max("rank").alias("_last")), "scan_id")

    def total(sigs, keep):
        return F.aggregate(F.filter(sigs, keep), F.lit(0).cast("long"), lambda a, x: a + x["n"])

    def step(accepted, k):
        mine = total(F.col("sigs"), lambda x: F.array_contains(x["sig"], k))
        gone = total(F.col("sigs"), lambda x: F.array_contains(x["sig"], k) & F.arrays_overlap(x["sig"], accepted))
        return F.when((mine > 0) & (gone <= mine * claimed), F.concat(accepted, F.array(k))).otherwise(accepted)

    taken = scans.select("scan_id", F.aggregate(F.sequence(F.lit(1), F.col("_last")), F.array().cast("array<int>"), step).alias("acc"))
    place = signed.join(taken, "scan_id").withColumn("_r", F.array_min(F.array_intersect("sig", "acc"))).filter("_r is not null")
    return place.select(*KEY, F.array_position("acc", F.col("_r")).cast("int").alias("inst"))


def dice_per_class(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Dice per (scan_id, cls) of two label tables (KEY, cls); absent rows are background."""
    t = truth.select(*KEY, F.col("cls").alias("t"))
    joined = t.join(pred.select(*KEY, F.col("cls").alias("q")), KEY, "full_outer")
    a = joined.filter("t is not null").groupBy("scan_id", F.col("t").alias("cls")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("t") == F.col("q")).alias("both"))
    b = joined.filter("q is not null").groupBy("scan_id", F.col("q").alias("cls")).agg(F.count(F.lit(1)).alias("m"))
    out = a.join(b, ["scan_id", "cls"], "full_outer").fillna(0, ["n", "m", "both"])
    return out.select("scan_id", "cls", (2 * F.col("both") / (F.col("n") + F.col("m"))).alias("dice"))


def mean_dice(per_class: DataFrame) -> DataFrame:
    return per_class.groupBy("scan_id").agg(F.avg("dice").alias("mean_dice"), F.avg(F.when(F.col("cls") > 0, F.col("dice"))).alias("foreground_dice"))


def soft_dice(scores: DataFrame, classes: int, smooth: float = 1.0, do_bg: bool = True, batch: bool = False) -> DataFrame:
    """Mean of 2 sum(xy) / (sum(x) + sum(y) + smooth) over classes; ``scores`` (scan_id, x array, truth).

    The denominator is at least 1e-8; with ``batch`` sums run over all scans.
    """
    long = scores.select("scan_id", "truth", F.posexplode("x").alias("cls", "v"))
    long = long if do_bg else long.filter("cls > 0")
    hit = (F.col("truth") == F.col("cls")).cast("double")
    keys = ["cls"] if batch else ["scan_id", "cls"]
    per = long.groupBy(*keys).agg(F.sum(F.col("v") * hit).alias("xy"), F.sum("v").alias("sx"), F.sum(hit).alias("sy"))
    d = 2 * F.col("xy") / F.greatest(F.lit(1e-8), F.col("sx") + F.col("sy") + smooth)
    per = per.withColumn("d", d)
    return per.agg(F.avg("d").alias("soft_dice")) if batch else per.groupBy("scan_id").agg(F.avg("d").alias("soft_dice"))


def fold_mean(logits: DataFrame) -> DataFrame:
    """Mean over folds of (KEY, cls, fold, w)."""
    return logits.groupBy(*KEY, "cls").agg(F.avg("w").alias("w"))


def mirror_mean(logits: DataFrame, scans: DataFrame) -> DataFrame:
    """Mean over mirrored variants; ``logits`` (KEY, mp, mi, mr: whether mirrored, cls, w) are flipped back first."""
    back = logits.join(scans.select("scan_id", "np", "ni", "nr"), "scan_id")
    back = back.withColumns({a: F.when(F.col(f"m{a}"), F.col(f"n{a}") - 1 - F.col(a)).otherwise(F.col(a)) for a in ("p", "i", "r")})
    return back.groupBy(*KEY, "cls").agg(F.avg("w").alias("w"))


def tile_blend(tiles: DataFrame) -> DataFrame:
    """Weighted mean sum(weight w) / sum(weight) of (KEY, cls, weight, w) over overlapping tiles."""
    return tiles.groupBy(*KEY, "cls").agg((F.sum(F.col("weight") * F.col("w")) / F.sum("weight")).alias("w"))
