"""Queries over voxel tables: remaps, masks, crops, grids, region statistics and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from voxtable.functions import units as un
from voxtable.operators import regions as rg, voxels as vx
from voxtable.registry import register
from voxtable.sources.views import ctes, view

STATS = """, st as (select scan_id, {col} as label, count(*) as voxels, sum(p) / count(*) as cp, sum(i) / count(*) as ci, sum(r) / count(*) as cr,
  min(p) as p0, max(p) as p1, min(i) as i0, max(i) as i1, min(r) as r0, max(r) as r1 from vox where {col} > 0 group by scan_id, {col})
"""
INST, SEM = STATS.format(col="inst"), STATS.format(col="sem")


@register("flagship_regions", ctes("vox scans", INST + """select scan_id, label, voxels, round(voxels * zp * zi * zr, 6) as mm3, round(cp, 6) as cp, round(ci, 6) as ci, round(cr, 6) as cr,
  p0, p1, i0, i1, r0, r1, cast(row_number() over (partition by scan_id order by st.ci, label) as int) as rank from st join scans using (scan_id)"""))
def flagship_regions(s: SparkSession, d: str) -> DataFrame:
    stats = rg.ordered_by_height(rg.region_stats(view(s, d, "vox"), "inst"))
    out = stats.join(view(s, d, "scans"), "scan_id")
    return out.select("scan_id", "label", "voxels", F.round(F.col("voxels") * F.col("zp") * F.col("zi") * F.col("zr"), 6).alias("mm3"), *[F.round(f"c{a}", 6).alias(f"c{a}") for a in vx.AXES], *[f"{a}{n}" for a in vx.AXES for n in (0, 1)], "rank")


@register("a1_labels_present", ctes("vox", "select scan_id, list_sort(list_distinct(list(sem))) as labels from vox where sem > 0 group by scan_id"))
def a1(s, d):
    return rg.labels_present(view(s, d, "vox"), "sem")


@register("a2_volumes", ctes("vox scans", SEM + "select scan_id, label, voxels, round(voxels * zp * zi * zr, 6) as mm3 from st join scans using (scan_id)"))
def a2(s, d):
    return rg.volumes(view(s, d, "vox"), "sem", view(s, d, "scans"))


@register("a3_center_of_mass", ctes("vox", SEM + "select scan_id, label, round(cp, 6) as cp, round(ci, 6) as ci, round(cr, 6) as cr from st"))
def a3(s, d):
    return rg.center_of_mass(view(s, d, "vox"), "sem").withColumns({f"c{a}": F.round(f"c{a}", 6) for a in vx.AXES})


@register("a3_center_or_zero", ctes("vox", SEM + ", w as (select distinct scan_id, unnest([49, 50, 61]) as label from vox) select scan_id, label, round(coalesce(cp, 0), 6) as cp, round(coalesce(ci, 0), 6) as ci, round(coalesce(cr, 0), 6) as cr from w left join st using (scan_id, label)"))
def a3b(s, d):
    vox = view(s, d, "vox")
    wanted = vox.select("scan_id").distinct().withColumn("label", F.explode(F.array(*map(F.lit, (49, 50, 61)))))
    return rg.center_or_zero(vox, "sem", wanted).withColumns({f"c{a}": F.round(f"c{a}", 6) for a in vx.AXES})


@register("a4_bounding_box", ctes("vox scans", INST + """, b as (select scan_id, label, greatest(p0 - 2, 0) as p0, least(p1 + 2, np - 1) as p1, greatest(i0 - 2, 0) as i0, least(i1 + 2, ni - 1) as i1,
  greatest(r0 - 2, 0) as r0, least(r1 + 2, nr - 1) as r1 from st join scans using (scan_id))
select *, p0 + (p1 - p0 + 1) // 2 as mp, i0 + (i1 - i0 + 1) // 2 as mi, r0 + (r1 - r0 + 1) // 2 as mr from b"""))
def a4(s, d):
    return rg.bounding_box(view(s, d, "vox"), "inst", view(s, d, "scans"), 2)


@register("a11_coverage_gap", ctes("vox", """, s as (select scan_id, count(*) as s, count(*) filter (inst > 0) as t, count(distinct inst) filter (inst > 0) as n from vox where sem in (41, 42, 49, 62) group by scan_id),
g as (select scan_id, round_even((s - t) / (s / n), 3) as gap from s) select scan_id, gap, gap > 0.5 as warn from g"""))
def a11(s, d):
    vox = view(s, d, "vox").filter(F.col("sem").isin(41, 42, 49, 62))
    n = vox.filter("inst > 0").groupBy("scan_id").agg(F.count_distinct("inst").alias("n"))
    return rg.coverage_gap(vox, vox.filter("inst > 0"), n)


@register("a12_relative_overlap", ctes("preds", """, v as (select distinct scan_id, p, i, r, com_idx from preds),
o as (select a.scan_id, a.com_idx, count(*) as n, count(b.p) as claimed from v a left join (select distinct scan_id, p, i, r, com_idx + 1 as com_idx from preds) b using (scan_id, p, i, r, com_idx) group by all)
select scan_id, com_idx, round(claimed / n, 6) as share from o"""))
def a12(s, d):
    v = view(s, d, "preds").select(*vx.KEY, "com_idx").distinct()
    before = v.select(*vx.KEY, (F.col("com_idx") + 1).alias("com_idx"))
    return rg.relative_overlap(v, before, [*vx.KEY, "com_idx"], ["scan_id", "com_idx"]).withColumn("share", F.round("share", 6))


@register("a16_centroids", ctes("vox", """select scan_id, inst as vert, case when inst = 26 then 50 else sem end as subreg, round(sum(p) / count(*), 6) as cp, round(sum(i) / count(*), 6) as ci, round(sum(r) / count(*), 6) as cr
from vox where inst > 0 and inst not between 100 and 133 and inst not between 200 and 233 group by all"""))
def a16(s, d):
    return rg.centroids(view(s, d, "vox")).withColumns({f"c{a}": F.round(f"c{a}", 6) for a in vx.AXES})


@register("a17_slice_extent", ctes("vox", "select scan_id, min(i) as first_i, max(i) as last_i from (select scan_id, i, max(intensity) as m from vox group by all) where m > 1480 group by scan_id"))
def a17(s, d):
    return rg.slice_extent(view(s, d, "vox"), "intensity", 1480)


@register("a18_sample_per_class", None)
def a18(s, d):
    return rg.sample_per_class(view(s, d, "vox").drop("intensity", "inst"), "sem", most=20, share=0.05)


@register("a20_duplicate_assignments", ctes("vox", INST + """, dc as (select scan_id, i as label, sum(i) / count(*) as ci from vox where sem = 100 group by all),
m as (select dc.scan_id, dc.label, coalesce((select max_by(st.label, st.ci) from st where st.scan_id = dc.scan_id and st.ci < dc.ci), (select min_by(st.label, st.ci) from st where st.scan_id = dc.scan_id)) as base from dc)
select st.scan_id, st.label, count(m.label) as discs from st left join m on m.scan_id = st.scan_id and m.base = st.label group by all having (count(m.label) = 0 and st.label <> 1) or count(m.label) > 1"""))
def a20(s, d):
    vox = view(s, d, "vox")
    discs = vox.filter("sem = 100").groupBy("scan_id", F.col("i").alias("label")).agg((F.sum(F.col("i").cast("long")) / F.count(F.lit(1))).alias("ci"))
    verts = rg.region_stats(vox, "inst").select("scan_id", "label", "ci")
    return rg.duplicate_assignments(verts, rg.asof_lower(discs, verts))


@register("j6_asof_lower", ctes("vox", INST + """, dc as (select scan_id, i as label, sum(i) / count(*) as ci from vox where sem = 100 group by all)
select dc.scan_id, dc.label, coalesce((select max_by(st.label, st.ci) from st where st.scan_id = dc.scan_id and st.ci < dc.ci), (select min_by(st.label, st.ci) from st where st.scan_id = dc.scan_id)) as base,
  not exists (select 1 from st where st.scan_id = dc.scan_id and st.ci < dc.ci) as above_all from dc"""))
def j6(s, d):
    vox = view(s, d, "vox")
    discs = vox.filter("sem = 100").groupBy("scan_id", F.col("i").alias("label")).agg((F.sum(F.col("i").cast("long")) / F.count(F.lit(1))).alias("ci"))
    return rg.asof_lower(discs, rg.region_stats(vox, "inst").select("scan_id", "label", "ci")).drop("base_ci")


@register("p1_extract_label", ctes("vox", "select scan_id, p, i, r, intensity, 1 as sem, inst from vox where sem in (41, 42)"))
def p1(s, d):
    return vx.extract_label(view(s, d, "vox"), "sem", (41, 42))


@register("p2_map_labels", ctes("vox", "select scan_id, p, i, r, intensity, case sem when 41 then 1 when 42 then 1 else sem end as sem, inst from vox where sem <> 61"))
def p2(s, d):
    return vx.map_labels(view(s, d, "vox"), "sem", {41: 1, 42: 1, 61: 0})


@register("p3_apply_mask", ctes("vox", "select scan_id, p, i, r, inst from vox where inst > 0 and sem in (49, 41)"))
def p3(s, d):
    vox = view(s, d, "vox")
    return vx.apply_mask(vox.filter("inst > 0").select(*vx.KEY, "inst"), vox.filter(F.col("sem").isin(49, 41)))


@register("p4_override_where", ctes("vox", "select scan_id, p, i, r, intensity, case when inst = 4 then 26 else sem end as sem, inst from vox"))
def p4(s, d):
    return vx.override_where(view(s, d, "vox"), "sem", F.col("inst") == 4, 26)


@register("p5_normalize_range", ctes("vox", """, m as (select scan_id, min(intensity) as lo, max(intensity) as hi from vox group by scan_id)
select scan_id, p, i, r, round((intensity - lo) * case when hi > 1000 then 1000.0::double / hi else 1 end, 6) as intensity from vox join m using (scan_id)"""))
def p5(s, d):
    return vx.normalize_range(view(s, d, "vox").select(*vx.KEY, "intensity"), high=1000.0).withColumn("intensity", F.round("intensity", 6))


@register("p6_zscore_nonzero", ctes("vox", """, m as (select scan_id, inst, avg(intensity) as m, stddev_pop(intensity) as s from vox where intensity <> 0 group by all)
select scan_id, inst, p, i, r, round(case when intensity <> 0 and s > 0 then (intensity - m) / s else 0 end, 6) as intensity from vox left join m using (scan_id, inst)"""))
def p6(s, d):
    return vx.zscore_nonzero(view(s, d, "vox").select(*vx.KEY, "inst", "intensity"), ["scan_id", "inst"]).withColumn("intensity", F.round("intensity", 6))


@register("p7_foreground_box", ctes("vox", "select scan_id, min(p) as p0, max(p) as p1, min(i) as i0, max(i) as i1, min(r) as r0, max(r) as r1 from vox where intensity > 1200 group by scan_id"))
def p7(s, d):
    return vx.box(view(s, d, "vox").filter("intensity > 1200"))


@register("p8_crop_to_box", ctes("vox scans", """, b as (select scan_id, min(p) - k as p0, max(p) + k as p1, min(i) - k as i0, max(i) + k as i1, min(r) - k as r0, max(r) + k as r1
  from vox join (select scan_id, cast(ceil(1.5 / least(zp, zi, zr)) as int) as k from scans) using (scan_id) where inst = 2 group by scan_id, k)
select scan_id, p, i, r, sem from vox join b using (scan_id) where p between p0 and p1 and i between i0 and i1 and r between r0 and r1"""))
def p8(s, d):
    vox = view(s, d, "vox")
    margin = F.ceil(1.5 / F.least("zp", "zi", "zr")).cast("int")
    return vx.crop_to_box(vox, vox.filter("inst = 2"), view(s, d, "scans"), margin).select(*vx.KEY, "sem")


@register("p9_uncrop", ctes("vox", """, b as (select scan_id, min(p) as p0, max(p) as p1, min(i) as i0, max(i) as i1, min(r) as r0, max(r) as r1 from vox where inst = 2 group by scan_id)
select scan_id, p, i, r, case when inst = 2 then 99 else sem end as sem from vox left join b using (scan_id)
where inst = 2 or not coalesce(p between p0 and p1 and i between i0 and i1 and r between r0 and r1, false)"""))
def p9(s, d):
    vox = view(s, d, "vox")
    part = vox.filter("inst = 2")
    corner = vx.box(part)
    crop = part.join(corner, "scan_id").select("scan_id", *[(F.col(a) - F.col(f"{a}0")).alias(a) for a in vx.AXES], F.lit(99).alias("sem"))
    return vx.uncrop(vox.select(*vx.KEY, "sem"), crop, corner)


@register("p10_pad_edge", ctes("vox scans", "select scan_id, p, i, unnest(case when r = 0 then range(0, 3) when r = nr - 1 then range(r + 2, r + 5) else [r + 2] end)::int as r, sem from vox join scans using (scan_id)"))
def p10(s, d):
    return vx.pad_edge(view(s, d, "vox").select(*vx.KEY, "sem"), view(s, d, "scans"), 2)


@register("p10_unpad", ctes("vox scans", "select scan_id, p, i, r, sem from vox"))
def p10b(s, d):
    vox = view(s, d, "vox").select(*vx.KEY, "sem")
    return vx.unpad(vx.pad(vox, 3), view(s, d, "scans"), 3)


@register("p11_reorient", ctes("vox scans", "select scan_id, r0 as p, i0 as i, p0 as r, sem from (select scan_id, nr - 1 - r as r0, np - 1 - p as i0, ni - 1 - i as p0, sem from vox join scans using (scan_id))"))
def p11(s, d):
    return vx.reorient(view(s, d, "vox").select(*vx.KEY, "sem"), view(s, d, "scans"), "PIR", "LAS")


@register("p12_orientation_opposite", ctes("scans", "select scan_id, translate(case scan_id % 3 when 0 then 'PIR' when 1 then 'LAS' else 'RPI' end, 'LRPAIS', 'RLAPSI') as opposite from scans"))
def p12(s, d):
    code = F.when(F.col("scan_id") % 3 == 0, "PIR").when(F.col("scan_id") % 3 == 1, "LAS").otherwise("RPI")
    return view(s, d, "scans").select("scan_id", un.orientation_opposite(code).alias("opposite"))


@register("p13_resample_nearest", ctes("vox scans", """, z as (select scan_id, np, ni, nr, cast(round_even(np * zp / 0.8::double, 0) as int) as mp, cast(round_even(ni * zi / 0.8::double, 0) as int) as mi, cast(round_even(nr * zr / 0.8::double, 0) as int) as mr from scans),
g as (select scan_id, unnest(range(0, mp)) as p2, np, mp, ni, mi, nr, mr from z),
h as (select *, unnest(range(0, mi)) as i2 from g), k as (select *, unnest(range(0, mr)) as r2 from h)
select k.scan_id, p2::int as p, i2::int as i, r2::int as r, sem from k join vox on vox.scan_id = k.scan_id and vox.p = least(floor((p2 + 0.5::double) * np / mp), np - 1)
  and vox.i = least(floor((i2 + 0.5::double) * ni / mi), ni - 1) and vox.r = least(floor((r2 + 0.5::double) * nr / mr), nr - 1)"""))
def p13(s, d):
    return vx.resample_nearest(view(s, d, "vox").select(*vx.KEY, "sem"), view(s, d, "scans"), {"p": 0.8, "i": 0.8, "r": 0.8})


@register("p14_recommended_zoom", ctes("scans", "select scan_id, [least(greatest(zp, 0.78::double), 1.0::double), least(greatest(zi, 0.78::double), 1.0::double), least(greatest(zr, 0.78::double), 1.2::double)] as zoom from scans"))
def p14(s, d):
    low, high = F.array(*map(F.lit, (0.78, 0.78, 0.78))), F.array(*map(F.lit, (1.0, 1.0, 1.2)))
    return view(s, d, "scans").select("scan_id", un.recommended_zoom(F.array("zp", "zi", "zr"), low, high).alias("zoom"))


@register("p15_same_zoom", ctes("scans", "select a.scan_id, b.scan_id as other, abs(a.zp - b.zp) < 1e-4 and abs(a.zi - b.zi) < 1e-4 and abs(a.zr - b.zr) < 1e-4 as same from scans a join scans b on b.scan_id = a.scan_id + 1"))
def p15(s, d):
    a = view(s, d, "scans").select("scan_id", F.array("zp", "zi", "zr").alias("z"))
    b = a.select((F.col("scan_id") - 1).alias("scan_id"), F.col("scan_id").alias("other"), F.col("z").alias("z2"))
    return a.join(b, "scan_id").select("scan_id", "other", un.same_zoom(F.col("z"), F.col("z2")).alias("same"))


@register("p16_to_p19_units", ctes("scans", """, z as (select *, zp * zi * zr as v from scans), t as (select scan_id, zp, zi, zr, v, unnest([1.0, 2.5, 27.84375, 150.0])::double as t from z)
select scan_id, t, cast(greatest(round_even(t / v, 0), 1) as bigint) as voxels, cast(greatest(round_even(t / power(v, 2.0::double / 3), 0), 1) as bigint) as faces,
  cast(greatest(round_even(t / least(zp, zi, zr), 0), 0) as bigint) as steps, round(t / zi, 6) as axis_steps, cast(trunc(t * v) as int) as scaled from t"""))
def p16(s, d):
    z = F.array("zp", "zi", "zr")
    t = view(s, d, "scans").withColumn("t", F.explode(F.array(*map(F.lit, (1.0, 2.5, 27.84375, 150.0)))))
    return t.select("scan_id", "t", un.mm3_to_voxels(F.col("t"), z).alias("voxels"), un.area_to_voxels(F.col("t"), z).alias("faces"), un.mm_to_voxels(F.col("t"), z).alias("steps"), F.round(un.mm_to_voxels_axis(F.col("t"), z, 1), 6).alias("axis_steps"), un.scaled_threshold(F.col("t"), z).alias("scaled"))


@register("p31_nonzero_coordinates", ctes("vox", "select scan_id, p, i, r, inst from vox where inst > 0"))
def p31(s, d):
    return vx.nonzero_coordinates(view(s, d, "vox").select(*vx.KEY, "inst"), "inst")


@register("p32_slice_axis", ctes("vox scans", "select scan_id, p, i, r, sem from vox join scans using (scan_id) where i = ni - 1 - 5"))
def p32(s, d):
    return vx.slice_axis(view(s, d, "vox").select(*vx.KEY, "sem"), view(s, d, "scans"), "i", 5, forward=False)


@register("p33_cast_intensity", ctes("vox", """, m as (select scan_id, min(intensity) as lo, max(intensity) as hi from vox group by scan_id)
select scan_id, p, i, r, cast(case when lo < 0 or hi > 255 then floor((intensity - lo) * 255 / (case when hi > lo then hi - lo else 1 end) + 0) else floor(intensity) end as bigint) as intensity from vox join m using (scan_id)"""))
def p33(s, d):
    return vx.cast_intensity(view(s, d, "vox").select(*vx.KEY, "intensity"))


@register("p33_minimal_type", ctes("vox", """, m as (select scan_id, sem, min(intensity) as lo, max(intensity) as hi from vox group by all)
select scan_id, sem, case when lo >= 0 and hi <= 255 then 'uint8' when lo >= 0 and hi <= 65535 then 'uint16' end as dtype from m"""))
def p33b(s, d):
    m = view(s, d, "vox").groupBy("scan_id", "sem").agg(F.min("intensity").alias("lo"), F.max("intensity").alias("hi"))
    return m.select("scan_id", "sem", vx.minimal_type(F.col("lo"), F.col("hi")).alias("dtype"))


@register("p39_scan_dims", ctes("scans", "select scan_id, [np, ni, nr, 1] as shape from scans"))
def p39(s, d):
    return view(s, d, "scans").select("scan_id", un.scan_dims(F.array("np", "ni", "nr")).alias("shape"))


@register("u1_missing_voxels", ctes("vox", "select scan_id, p, i, r, sem from vox where inst = 0"))
def u1(s, d):
    vox = view(s, d, "vox")
    return vx.missing_voxels(vox.select(*vx.KEY, "sem"), vox.filter("inst > 0"))


@register("u2_attach_derived", ctes("vox", "select scan_id, p, i, r, case when inst > 0 then inst when sem = 100 then 100 + i // 10 else 200 + i // 10 end as inst from vox where inst > 0 or sem in (62, 100)"))
def u2(s, d):
    vox = view(s, d, "vox")
    part = F.when(F.col("sem") == 100, F.expr("cast(100 + i div 10 as int)")).otherwise(F.expr("cast(200 + i div 10 as int)"))
    return vx.attach_derived(vox.filter("inst > 0"), vox.filter("sem in (62, 100)").withColumn("inst", part))


@register("u3_keep_sacrum", ctes("vox", """, b as (select scan_id, min(i) + 8 as lo, max(i) - 8 as hi from vox where sem = 61 group by scan_id)
select scan_id, p, i, r, sem from vox join b using (scan_id) where i between lo and hi or sem = 100"""))
def u3(s, d):
    vox = view(s, d, "vox").select(*vx.KEY, "sem")
    b = vox.filter("sem = 61").groupBy("scan_id").agg((F.min("i") + 8).alias("lo"), (F.max("i") - 8).alias("hi"))
    return vx.keep_range_or(vox, "sem", b, keep=100)


@register("u4_drop_deleted", ctes("vox", "select scan_id, p, i, r, sem from vox where not (sem = 62 and r < 3)"))
def u4(s, d):
    vox = view(s, d, "vox").select(*vx.KEY, "sem")
    return vx.missing_voxels(vox, vox.filter("sem = 62 and r < 3"))


@register("u5_strip_derived", ctes("vox", "select scan_id, p, i, r, sem as inst from vox where sem not between 100 and 133"))
def u5(s, d):
    return vx.strip_derived(view(s, d, "vox").select(*vx.KEY, F.col("sem").alias("inst")))


@register("u6_zero_unmatched", ctes("vox", INST + ", m as (select scan_id, label, row_number() over (partition by scan_id order by ci, label) + 1 as new_label from st where voxels % 3 <> 0) select scan_id, p, i, r, cast(new_label as int) as inst from vox join m using (scan_id) where inst = label"))
def u6(s, d):
    vox = view(s, d, "vox").select(*vx.KEY, "inst")
    m = rg.ordered_by_height(rg.region_stats(vox, "inst").filter("voxels % 3 <> 0"), "new_label", 1).select("scan_id", F.col("label").alias("inst"), "new_label")
    return vox.join(m, ["scan_id", "inst"]).select(*vx.KEY, F.col("new_label").alias("inst"))


@register("w1_label_top_to_bottom", ctes("vox", INST + "select scan_id, label, cast(row_number() over (partition by scan_id order by ci, label) + 2 as int) as new_label from st"))
def w1(s, d):
    return rg.ordered_by_height(rg.region_stats(view(s, d, "vox"), "inst"), "new_label", 2).select("scan_id", "label", "new_label")


@register("w2_relabel_dense", ctes("vox", "select scan_id, p, i, r, cast(dense_rank() over (partition by scan_id order by sem) as int) as sem from vox where sem > 0"))
def w2(s, d):
    return rg.relabel_dense(view(s, d, "vox").select(*vx.KEY, "sem"), "sem").select(*vx.KEY, "sem")


ENTRIES = INST + """, e as (select scan_id, 'body' as kind, label, ci from st union all select scan_id, 'disc', cast(100 + i // 10 as int), sum(i) / count(*) from vox where sem = 100 and i <> 19 group by scan_id, i)
"""


def _entries(s, d):
    vox = view(s, d, "vox")
    bodies = rg.region_stats(vox, "inst").select("scan_id", F.lit("body").alias("kind"), "label", "ci")
    discs = vox.filter("sem = 100 and i <> 19").groupBy("scan_id", "i").agg((F.sum(F.col("i").cast("long")) / F.count(F.lit(1))).alias("ci"))
    return bodies.unionByName(discs.select("scan_id", F.lit("disc").alias("kind"), F.expr("cast(100 + i div 10 as int)").alias("label"), "ci"))


@register("w3_alternation_check", ctes("vox scans", ENTRIES + """, l as (select e.*, zi, lead(kind) over w as k, lead(ci) over w as h, bool_or(kind = 'disc') over (partition by scan_id) as d from e join scans using (scan_id) window w as (partition by scan_id order by ci, kind, label))
select scan_id, kind, label, coalesce(kind = k and d, false) as anomaly, coalesce(kind = k and d, false) and abs(h - ci) < 7.5::double / zi as dropped from l"""))
def w3(s, d):
    e = _entries(s, d).join(view(s, d, "scans").select("scan_id", "zi"), "scan_id")
    return rg.alternation_check(e, F.lit(7.5) / F.col("zi")).select("scan_id", "kind", "label", "anomaly", F.coalesce("dropped", F.lit(False)).alias("dropped"))


@register("w4_neighbour_volume_outlier", ctes("vox", """, st as (select scan_id, i as label, sum(i) / count(*) as ci, count(*) as voxels from vox where sem = 49 group by all),
o as (select *, row_number() over (partition by scan_id order by ci, label) as k from st),
n as (select a.scan_id, a.label, count(*) as n, sum(b.voxels) as s, max(b.voxels) as top, arg_min(b.label, struct_pack(v := -b.voxels, k := b.k)) as target from o a join o b on a.scan_id = b.scan_id and b.k between a.k - 5 and a.k + 5 and a.k <> b.k group by all)
select scan_id, label, target, round(top / ((s - top) / (n - 1)), 6) as ratio from n where n - 1 > 2 and top / ((s - top) / (n - 1)) > 1.2"""))
def w4(s, d):
    st = view(s, d, "vox").filter("sem = 49").groupBy("scan_id", F.col("i").alias("label")).agg((F.sum(F.col("i").cast("long")) / F.count(F.lit(1))).alias("ci"), F.count(F.lit(1)).alias("voxels"))
    return rg.neighbour_volume_outlier(st, ratio=1.2).withColumn("ratio", F.round("ratio", 6))


@register("w5_spine_angle", ctes("vox", INST + """, n as (select scan_id, label, coalesce(lead(cp) over w, cp) - coalesce(lag(cp) over w, cp) as x, coalesce(lead(ci) over w, ci) - coalesce(lag(ci) over w, ci) as y, coalesce(lead(cr) over w, cr) - coalesce(lag(cr) over w, cr) as z from st window w as (partition by scan_id order by ci, label))
select scan_id, label, round(degrees(acos(x / sqrt(x * x + y * y + z * z))) * case when z - y < 0 then -1 else 1 end, 5) as angle from n"""))
def w5(s, d):
    return rg.spine_angle(rg.region_stats(view(s, d, "vox"), "inst"), un.angle_between).select("scan_id", "label", F.round("angle", 5).alias("angle"))


@register("w14_running_min_fill", ctes("vox", ", m as (select scan_id, p, r, i, min(intensity) as x from vox group by all) select scan_id, p, r, i, min(x) over (partition by scan_id, p, r order by i rows unbounded preceding) as filled from m"))
def w14(s, d):
    return rg.running_min_fill(view(s, d, "vox"), "intensity").select("scan_id", "p", "r", "i", "filled")


@register("a6_majority_label", ctes("vox", ", n as (select scan_id, inst, sem, count(*) as n from vox where sem <> 0 group by all) select scan_id, inst, arg_min(sem, struct_pack(a := -n, b := sem)) as sem, max(n) as votes from n group by all"))
def a6(s, d):
    return rg.majority_label(view(s, d, "vox"), ["scan_id", "inst"], "sem")


@register("j3_sem_inst_overlap", ctes("vox", "select scan_id, sem as a, inst as b, count(*) as voxels from vox group by all"))
def j3(s, d):
    vox = view(s, d, "vox")
    return rg.overlap(vox, vox.filter("inst > 0"), "sem", "inst")


@register("a7_dominant_overlap", ctes("vox", ", c as (select scan_id, i // 4 as a, inst as b, count(*) as n from vox where sem in (41, 42) or sem = 62 group by all), k as (select *, row_number() over (partition by scan_id, a order by n desc, b) as rn, lead(n) over (partition by scan_id, a order by n desc, b) as n2 from c) select scan_id, a, b from k where rn = 1 and n2 is not null and n * 0.8 > n2"))
def a7(s, d):
    vox = view(s, d, "vox").filter("sem in (41, 42) or sem = 62").withColumn("k", F.expr("cast(i div 4 as int)"))
    return rg.dominant(rg.overlap(vox, vox.filter("inst > 0"), "k", "inst"), ["scan_id", "a"], factor=0.8)


@register("a8_dice", ctes("seg_pair", """, a as (select scan_id, truth as a, count(*) as n from seg_pair group by all), b as (select scan_id, pred as b, count(*) as n from seg_pair where pred > 0 group by all),
o as (select scan_id, truth as a, pred as b, count(*) as n from seg_pair where pred > 0 group by all)
select scan_id, o.a, o.b, round(2 * o.n / (a.n + b.n), 6) as dice from o join a using (scan_id, a) join b using (scan_id, b)"""))
def a8(s, d):
    pair = view(s, d, "seg_pair")
    size = lambda c: rg.labelled(pair, c).groupBy("scan_id", "label").agg(F.count(F.lit(1)).alias("voxels"))
    return rg.dice(rg.overlap(pair, pair.filter("pred > 0"), "truth", "pred").filter("b > 0"), size("truth"), size("pred")).withColumn("dice", F.round("dice", 6))
