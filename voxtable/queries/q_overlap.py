"""Queries over competing predictions, agreement metrics, tiles and points."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtable.operators import overlap as ov, points as pt, regions as rg, tiles as tl, voxels as vx
from voxtable.registry import register
from voxtable.sources.views import ctes, view

PAIRS = """, sz as (select scan_id, com_idx, lab, count(*) as n from preds group by all),
pr as (select a.scan_id, a.com_idx, a.lab, b.com_idx as com2, b.lab as lab2, count(*) as both_ from preds a join preds b on a.scan_id = b.scan_id and a.p = b.p and a.i = b.i and a.r = b.r and a.com_idx <> b.com_idx and abs(a.com_idx - b.com_idx) <= 2 group by all),
dc as (select pr.*, 2 * both_ / (x.n + y.n) as dice from pr join sz x on x.scan_id = pr.scan_id and x.com_idx = pr.com_idx and x.lab = pr.lab join sz y on y.scan_id = pr.scan_id and y.com_idx = com2 and y.lab = lab2),
t2 as (select *, cast(row_number() over (partition by scan_id, com_idx, lab order by dice desc, com2, lab2) as int) as rank from dc)
"""


@register("j8_band_pairs", ctes("preds", PAIRS + "select scan_id, com_idx, cast(lab as bigint) as lab, com2, cast(lab2 as bigint) as lab2, round(dice, 6) as dice from dc"))
def j8(s, d):
    return ov.band_pairs(view(s, d, "preds")).withColumns({"dice": F.round("dice", 6), "lab": F.col("lab").cast("long"), "lab2": F.col("lab2").cast("long")})


@register("t2_best_two_partners", ctes("preds", PAIRS + "select scan_id, com_idx, cast(lab as bigint) as lab, com2, cast(lab2 as bigint) as lab2, rank from t2 where rank <= 2 and dice > 0.3"))
def t2(s, d):
    return ov.best_two_partners(ov.band_pairs(view(s, d, "preds"))).drop("dice").withColumns({"lab": F.col("lab").cast("long"), "lab2": F.col("lab2").cast("long")})


COUPLES = PAIRS + """, pa as (select scan_id, com_idx, lab, list({'c': com2, 'l': lab2}) as ps, sum(dice) as s, count(*) as k from t2 where rank <= 2 and dice > 0.3 group by all),
an as (select sz.scan_id, list_sort([sz.com_idx * 10 + sz.lab] || coalesce([x.c * 10 + x.l for x in ps], [])) as members, coalesce(round(s / k, 9), 0) as a, sz.com_idx * 10 + sz.lab as at_ from sz left join pa using (scan_id, com_idx, lab)),
cp as (select scan_id, members, round(avg(a), 6) as agreement, min(at_) as at_ from an group by all)
"""


@register("i16_couple_predictions", ctes("preds", COUPLES + "select scan_id, cast(row_number() over (partition by scan_id order by (len(members) + 1) * agreement desc, at_, members) as int) as rank, [cast(m as bigint) for m in members] as members, agreement from cp"))
def i16(s, d):
    out = ov.couple_predictions(view(s, d, "preds"))
    return out.withColumn("members", F.transform("members", lambda m: (m["com_idx"] * 10 + m["lab"]).cast("long")))


@register("t3_rank_couples", ctes("preds", COUPLES + "select scan_id, len(members) as size, round(max((len(members) + 1) * agreement), 5) as best from cp group by all"))
def t3(s, d):
    out = ov.couple_predictions(view(s, d, "preds"))
    size = F.size("members")
    return out.groupBy("scan_id", size.cast("long").alias("size")).agg(F.round(F.max((size + 1) * F.col("agreement")), 5).alias("best"))


@register("i17_merge_couples", None)
def i17(s, d):
    preds = view(s, d, "preds")
    return ov.merge_couples(preds, ov.couple_predictions(preds))


PC = """, a as (select scan_id, truth as cls, count(*) as n, count(*) filter (truth = pred) as b from seg_pair group by all), q as (select scan_id, pred as cls, count(*) as m from seg_pair where pred > 0 group by all),
pc as (select scan_id, cls, 2 * coalesce(b, 0) / (coalesce(n, 0) + coalesce(m, 0)) as dice from a full join q using (scan_id, cls))
"""


def _per_class(s, d):
    pair = view(s, d, "seg_pair")
    return ov.dice_per_class(pair.select(*vx.KEY, F.col("truth").alias("cls")), pair.filter("pred > 0").select(*vx.KEY, F.col("pred").alias("cls")))


@register("a9_dice_per_class", ctes("seg_pair", PC + "select scan_id, cls, round(dice, 6) as dice from pc"))
def a9(s, d):
    return _per_class(s, d).withColumn("dice", F.round("dice", 6))


@register("a9_mean_dice", ctes("seg_pair", PC + "select scan_id, round(avg(dice), 6) as mean_dice, round(avg(dice) filter (cls > 0), 6) as foreground_dice from pc group by scan_id"))
def a9m(s, d):
    return ov.mean_dice(_per_class(s, d)).select("scan_id", F.round("mean_dice", 6).alias("mean_dice"), F.round("foreground_dice", 6).alias("foreground_dice"))


SOFT = ", sc as (select scan_id, sem % 3 as truth, [intensity / 3000.0::double, p / 24.0::double, i / 80.0::double] as x from vox), lg as (select scan_id, truth, unnest([0, 1, 2]) as cls, unnest(x) as v from sc), pe as (select {k} cls, 2 * sum(case when truth = cls then v else 0 end) / greatest(1e-8, sum(v) + sum(cast(truth = cls as int)) + 1) as d from lg {w} group by {k} cls) select {k} round(avg(d), 6) as soft_dice from pe {g}"


def _soft(s, d):
    return view(s, d, "vox").select("scan_id", (F.col("sem") % 3).alias("truth"), F.array(F.col("intensity") / 3000.0, F.col("p") / 24.0, F.col("i") / 80.0).alias("x"))


@register("a10_soft_dice", ctes("vox", SOFT.format(k="scan_id,", w="where cls > 0", g="group by scan_id")))
def a10(s, d):
    return ov.soft_dice(_soft(s, d), 3, do_bg=False).withColumn("soft_dice", F.round("soft_dice", 6))


@register("a10_soft_dice_batch", ctes("vox", SOFT.format(k="", w="", g="")))
def a10b(s, d):
    return ov.soft_dice(_soft(s, d), 3, batch=True).withColumn("soft_dice", F.round("soft_dice", 6))


@register("a13_fold_mean", ctes("vox", ", f as (select scan_id, p, i, r, unnest([0, 1]) as cls, intensity from vox) select scan_id, p, i, r, cls, round((intensity + intensity * 2 + 7 + cls * 3) / 2, 6) as w from f"))
def a13(s, d):
    x = view(s, d, "vox").withColumn("cls", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("fold", F.explode(F.array(F.lit(0), F.lit(1))))
    w = F.when(F.col("fold") == 0, F.col("intensity")).otherwise(F.col("intensity") * 2 + 7 + F.col("cls") * 3)
    return ov.fold_mean(x.select(*vx.KEY, "cls", "fold", w.alias("w"))).withColumn("w", F.round("w", 6))


@register("a14_mirror_mean", ctes("vox scans", ", m as (select scan_id, p, i, r, intensity as w from vox union all select scan_id, p, ni - 1 - i, r, intensity from vox join scans using (scan_id)) select scan_id, p, i, r, 0 as cls, round(avg(w), 6) as w from m group by all"))
def a14(s, d):
    x = view(s, d, "vox").withColumn("mi", F.explode(F.array(F.lit(False), F.lit(True))))
    x = x.select(*vx.KEY, F.lit(False).alias("mp"), "mi", F.lit(False).alias("mr"), F.lit(0).alias("cls"), F.col("intensity").alias("w"))
    return ov.mirror_mean(x, view(s, d, "scans")).withColumn("w", F.round("w", 6))


TILE = (6, 16, 4)


def _starts(n: str, t: int) -> str:
    c = f"cast(ceil((greatest({n}, {t}) - {t}) / ({t} * 0.5::double)) as int)"
    return f"case when {c} > 0 then [cast(round_even(k * ((greatest({n}, {t}) - {t}) / greatest({c}, 1)), 0) as int) for k in range({c} + 1)] else [0] end"


@register("m1_tile_steps", ctes("scans", f"select scan_id, {_starts('ni + scan_id % 7', 16)} as starts from scans"))
def m1(s, d):
    return view(s, d, "scans").select("scan_id", tl.tile_starts(F.col("ni") + F.col("scan_id") % 7, 16).alias("starts"))


@register("m2_tile_grid", ctes("scans", f", x as (select *, unnest({_starts('np', 6)}) as p0 from scans), y as (select *, unnest({_starts('ni', 16)}) as i0 from x) select scan_id, p0, i0, unnest({_starts('nr', 4)}) as r0, greatest(np, 6) as pad_p, greatest(ni, 16) as pad_i, greatest(nr, 4) as pad_r from y"))
def m2(s, d):
    return tl.tile_grid(view(s, d, "scans"), TILE)


@register("m3_gaussian_weight", ctes("scans", ", k as (select scan_id, unnest(range(16)) as k from scans) select scan_id, cast(k as int) as k, round(exp(-(k - 8) * (k - 8) / 8.0::double), 6) as weight from k"))
def m3(s, d):
    return view(s, d, "scans").select("scan_id", F.posexplode(F.array(*map(F.lit, tl.gaussian_weight(16)))).alias("k", "weight")).withColumn("weight", F.round("weight", 6))


ASSIGN = f""", tp as materialized (select scan_id, unnest({_starts('np', 6)}) as p0 from scans), ti as materialized (select scan_id, unnest({_starts('ni', 16)}) as i0 from scans), tr as materialized (select scan_id, unnest({_starts('nr', 4)}) as r0 from scans),
asg as (select vox.*, p0, i0, r0 from vox join tp on tp.scan_id = vox.scan_id and p between p0 and p0 + 5 join ti on ti.scan_id = vox.scan_id and i between i0 and i0 + 15 join tr on tr.scan_id = vox.scan_id and r between r0 and r0 + 3)
"""


@register("m4_tile_assign", ctes("vox scans", ASSIGN + "select scan_id, p0, i0, r0, count(*) as voxels, cast(sum(intensity) as bigint) as total from asg group by all"))
def m4(s, d):
    return tl.tile_assign(view(s, d, "vox"), view(s, d, "scans"), TILE).groupBy("scan_id", "p0", "i0", "r0").agg(F.count(F.lit(1)).alias("voxels"), F.sum("intensity").alias("total"))


@register("a15_tile_blend", ctes("vox scans", ASSIGN + """, g as (select scan_id, p, i, r, intensity + p0 as w, exp(-(p - p0 - 3) * (p - p0 - 3) / (2 * 0.75 * 0.75)::double) * exp(-(i - i0 - 8) * (i - i0 - 8) / 8.0::double) * exp(-(r - r0 - 2) * (r - r0 - 2) / 0.5::double) as g from asg)
select scan_id, p, i, r, 0 as cls, round(sum(w * g) / sum(g), 5) as w from g group by all"""))
def a15(s, d):
    t = tl.with_weight(tl.tile_assign(view(s, d, "vox"), view(s, d, "scans"), TILE), TILE)
    return ov.tile_blend(t.select(*vx.KEY, F.lit(0).alias("cls"), "weight", (F.col("intensity") + F.col("p0")).alias("w"))).withColumn("w", F.round("w", 5))


def _threshold():
    def predict(batch):
        import numpy as np

        x = batch["intensity"].to_numpy(dtype=float) / 1500
        return np.stack([1 - x, x], axis=1)

    return predict


@register("m5_m7_score_to_mask", ctes("vox", "select scan_id, p, i, r, cast(intensity > 750 as int) as cls from vox where intensity > 750"))
def m5(s, d):
    scored = tl.score(view(s, d, "vox").select(*vx.KEY, "intensity"), vx.KEY, _threshold)
    return tl.scores_to_mask(scored, vx.KEY)


@register("m7_scores_to_mask", ctes("vox", "select scan_id, p + 2 as r, i + 3 as i, r + 1 as p, 1 as cls from vox where intensity > 750"))
def m7(s, d):
    """The score's axes are r, i, p; its crop starts at (1, 3, 2)."""
    scored = tl.score(view(s, d, "vox").select(*vx.KEY, "intensity"), vx.KEY, _threshold)
    corners = view(s, d, "scans").select("scan_id", F.lit(1).alias("p"), F.lit(3).alias("i"), F.lit(2).alias("r"))
    return tl.scores_to_mask(scored, vx.KEY, corners, ("r", "i", "p"))


@register("m6_rotated_patches", None)
def m6(s, d):
    vox = view(s, d, "vox").filter("inst > 0")
    cut = tl.cutout(vox.select(*vx.KEY, F.col("sem").alias("value")), _centers(s, d), (12, 12, 8))
    return tl.rotated_patches(cut.withColumn("angle", F.col("com_idx") * 15.0), (10, 10, 8))


def _centers(s, d):
    st = rg.region_stats(view(s, d, "vox"), "inst")
    return st.select("scan_id", F.col("label").alias("com_idx"), *[F.floor(f"c{a}").cast("int").alias(a) for a in vx.AXES])


CUT = ", ce as (select scan_id, inst as com_idx, cast(floor(sum(p) / count(*)) as int) as cp, cast(floor(sum(i) / count(*)) as int) as ci, cast(floor(sum(r) / count(*)) as int) as cr from vox where inst > 0 group by all)"


@register("j9_cutout", ctes("vox", CUT + " select v.scan_id, com_idx, p - cp + 4 as p, i - ci + 6 as i, r - cr + 2 as r, sem from vox v join ce using (scan_id) where p >= cp - 4 and p < cp + 4 and i >= ci - 6 and i < ci + 6 and r >= cr - 2 and r < cr + 2"))
def j9(s, d):
    return tl.cutout(view(s, d, "vox").select(*vx.KEY, "sem"), _centers(s, d), (8, 12, 4))


@register("j9_slide", ctes("vox scans", CUT + """, t as (select ce.*, ni, unnest(range(0, (ni - 1 - ci) // 5 + 1)) as k from ce join scans using (scan_id)),
h as (select t.scan_id, com_idx, min(k) as k from t join vox v on v.scan_id = t.scan_id and v.p = cp and v.i = ci + 5 * t.k and v.r = cr and v.sem = 42 group by all)
select ce.scan_id, ce.com_idx, cp as p, cast(ci + 5 * coalesce(k, 0) as int) as i, cr as r from ce left join h using (scan_id, com_idx)"""))
def j9s(s, d):
    return tl.slide_to_foreground(_centers(s, d), view(s, d, "vox").filter("sem = 42"), view(s, d, "scans"))


@register("m9_cutout_relabel", ctes("vox", "select scan_id, p, i, r, cast(case sem when 41 then 1 when 42 then 2 when 49 then 9 when 61 then 11 when 62 then 12 else sem end as int) as sem from vox where sem <> 100"))
def m9(s, d):
    return vx.map_labels(view(s, d, "vox").select(*vx.KEY, "sem"), "sem", {41: 1, 42: 2, 49: 9, 61: 11, 62: 12, 100: 0})


@register("a19_nonzero_box", ctes("vox", ", b as (select scan_id, min(p) as p0, max(p) as p1, min(i) as i0, max(i) as i1, min(r) as r0, max(r) as r1 from vox where intensity > 1400 or inst = 2 group by scan_id) select scan_id, p0, p1, i0, i1, r0, r1 from b"))
def a19(s, d):
    return vx.box(view(s, d, "vox").filter("intensity > 1400 or inst = 2"))


DISC = """, dk as (select scan_id, cast(i // 10 + 3 as int) as disc, p, i, r from vox where sem = 100), dp as (select scan_id, disc, cast(floor(sum(p) / count(*)) as int) as x, cast(floor(sum(i) / count(*)) as int) as y, cast(floor(sum(r) / count(*)) as int) as z from dk group by all)
, lg as (select *, lead(x) over w as x2, lead(y) over w as y2, lead(z) over w as z2, count(*) over (partition by scan_id) as n, min(y) over (partition by scan_id) as lo, max(y) over (partition by scan_id) as hi from dp window w as (partition by scan_id order by y, x, z)),
ln as (select scan_id, k, lo + (hi - lo) * k / (n * 8 - 1) as h, n from (select distinct scan_id, n, lo, hi, unnest(range(0, n * 8)) as k from lg)),
li as materialized (select scan_id, cast(k as int) as k, cast(round_even(x + (x2 - x) * ((h - y) / (y2 - y)), 0) as int) as x, cast(round_even(h, 0) as int) as y, cast(round_even(z + (z2 - z) * ((h - y) / (y2 - y)), 0) as int) as z
  from (select ln.scan_id, k, h, lg.x, lg.y, lg.z, x2, y2, z2, row_number() over (partition by ln.scan_id, k order by lg.y) as rn from ln join lg on lg.scan_id = ln.scan_id and h between lg.y and y2) where rn = 1)
"""


def _discs(s, d):
    return view(s, d, "vox").filter("sem = 100").withColumn("disc", F.expr("cast(i div 10 + 3 as int)"))


def _disc_centres(s, d):
    middle = [F.floor(F.sum(F.col(a).cast("long")) / F.count(F.lit(1))).cast("int").alias(n) for a, n in zip(vx.AXES, "xyz", strict=True)]
    return _discs(s, d).groupBy("scan_id", "disc").agg(*middle)


@register("w13_centerline", ctes("vox", DISC + "select * from li"))
def w13(s, d):
    return pt.centerline(_disc_centres(s, d))


@register("j10_nearest_on_line", ctes("vox", DISC + ", m as (select dp.scan_id, disc, li.k, (dp.x - 2 - li.x) * (dp.x - 2 - li.x) + (dp.y - li.y) * (dp.y - li.y) + (dp.z - li.z) * (dp.z - li.z) as d2 from dp join li using (scan_id)) select scan_id, disc, cast(arg_min(k, struct_pack(a := d2, k := k)) as int) as k, min(d2) as d2 from m group by all"))
def j10(s, d):
    points = _disc_centres(s, d).withColumn("x", F.col("x") - 2)
    return pt.nearest_on_line(points, pt.centerline(_disc_centres(s, d)), ["disc"]).select("scan_id", "disc", "k", "d2")


@register("i23_disc_points", ctes("vox", DISC + """, m as (select dk.scan_id, disc, p, i, r, min((p - li.x) * (p - li.x) + (i - li.y) * (i - li.y) + (r - li.z) * (r - li.z)) as d2 from dk join li using (scan_id) group by all)
select scan_id, disc, p as x, i as y, r as z, d2 from m qualify row_number() over (partition by scan_id, disc order by d2, p, i, r) = 1"""))
def i23(s, d):
    return pt.disc_points(_discs(s, d), pt.centerline(_disc_centres(s, d)))


@register("w16_insert_disc2", ctes("vox", DISC + ", q as (select scan_id, case disc when 4 then 1 else disc end as disc, x, y, z from dp) select * from q union all select a.scan_id, 2, a.x, cast(floor((a.y + b.y) / 2) as int), a.z from q a join q b on a.scan_id = b.scan_id and a.disc = 3 and b.disc = 1"))
def w16(s, d):
    points = _disc_centres(s, d).withColumn("disc", F.when(F.col("disc") == 4, 1).otherwise(F.col("disc")))
    return pt.insert_disc2(points)


@register("i23_top_voxel", ctes("vox", "select scan_id, inst, p as x, i as y, r as z from vox where inst > 0 qualify row_number() over (partition by scan_id, inst order by i, p, r) = 1"))
def i23t(s, d):
    return pt.top_voxel(view(s, d, "vox").filter("inst > 0"), "inst")
