"""Queries over neighbourhoods, morphology and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtable.operators import neighbours as nb, regions as rg, voxels as vx
from voxtable.registry import register
from voxtable.sources.views import ctes, staged_views, view


def _offsets(k: int, half: bool = False) -> str:
    return ", ".join(f"({p}, {i}, {r})" for p, i, r in nb.offsets(k, half))


#: Components by reachability over runs along r; 6-connected.
RUNS = """, g as (select {keys}, p, i, r, {col} as lab, r - row_number() over (partition by {keys}, {col}, p, i order by r) as k from {table}),
runs as materialized (select {keys}, lab, p, i, min(r) r0, max(r) r1, (cast(p as bigint) << 40) + (cast(i as bigint) << 20) + min(r) id, count(*) n from g group by {keys}, lab, p, i, k),
e as materialized (
  select a.scan_id, a.lab, a.id s, b.id d from runs a join runs b on a.scan_id = b.scan_id and a.lab = b.lab and b.p = a.p + 1 and b.i = a.i and a.r0 <= b.r1 and b.r0 <= a.r1
  union all
  select a.scan_id, a.lab, a.id, b.id from runs a join runs b on a.scan_id = b.scan_id and a.lab = b.lab and b.p = a.p and b.i = a.i + 1 and a.r0 <= b.r1 and b.r0 <= a.r1{more}),
un as materialized (select * from e union all select scan_id, lab, d, s from e),
reach(scan_id, lab, id, root) as (
  select scan_id, lab, id, id from runs
  union select q.scan_id, q.lab, un.d, q.root from reach q join un on un.scan_id = q.scan_id and un.lab = q.lab and un.s = q.id where q.root < un.d),
cc as materialized (select scan_id, lab, id, min(root) comp from reach group by all),
cv as materialized (select runs.scan_id, runs.p, runs.i, unnest(range(r0, r1 + 1))::int as r, runs.lab, cc.comp from runs join cc using (scan_id, lab, id))
"""


def runs(table: str, col: str, connectivity: int = 1) -> str:
    more = ""
    if connectivity == 2:  # neighbours with one further step along r, and diagonals in p and i
        more = """
  union all select a.scan_id, a.lab, a.id, b.id from runs a join runs b on a.scan_id = b.scan_id and a.lab = b.lab and ((b.p = a.p + 1 and b.i = a.i) or (b.p = a.p and b.i = a.i + 1)) and a.r0 <= b.r1 + 1 and b.r0 <= a.r1 + 1
  union all select a.scan_id, a.lab, a.id, b.id from runs a join runs b on a.scan_id = b.scan_id and a.lab = b.lab and b.p = a.p + 1 and abs(b.i - a.i) = 1 and a.r0 <= b.r1 and b.r0 <= a.r1"""
    if connectivity == 3:
        more = """
  union all select a.scan_id, a.lab, a.id, b.id from runs a join runs b on a.scan_id = b.scan_id and a.lab = b.lab and (b.p, b.i) > (a.p, a.i) and abs(b.p - a.p) <= 1 and abs(b.i - a.i) <= 1 and a.r0 <= b.r1 + 1 and b.r0 <= a.r1 + 1"""
    return RUNS.format(keys="scan_id", col=col, table=table, more=more)


SPARSE = ", sp as (select * from vox where (p * 7 + i * 3 + r * 5) % 4 <> 0)"


def _sparse(s, d):
    return view(s, d, "vox").filter("(p * 7 + i * 3 + r * 5) % 4 <> 0")


@register("j4_contact_area", ctes("vox", f", o(dp, di, dr) as (values {_offsets(1, True)}) select a.scan_id, least(a.sem, b.sem) as a, greatest(a.sem, b.sem) as b, count(*) as faces from vox a, o, vox b where a.scan_id = b.scan_id and b.p = a.p + dp and b.i = a.i + di and b.r = a.r + dr and a.sem <> b.sem group by all"))
def j4(s, d):
    return nb.contact_area(view(s, d, "vox"), "sem")


for _k, _n in ((1, 6), (2, 18), (3, 26)):

    def j5(s, d, k=_k):
        return nb.neighbours(view(s, d, "vox"), "sem", k).groupBy("scan_id", "sem", "other").agg(F.count(F.lit(1)).alias("pairs"))

    register(f"j5_neighbors_{_n}", ctes("vox", f", o(dp, di, dr) as (values {_offsets(_k)}) select a.scan_id, a.sem, b.sem as other, count(*) as pairs from vox a, o, vox b where a.scan_id = b.scan_id and b.p = a.p + dp and b.i = a.i + di and b.r = a.r + dr group by all"))(j5)

    def i1(s, d, k=_k):
        comps = nb.components(_sparse(s, d), "sem", k)
        return comps.groupBy("scan_id", "sem", "comp").agg(F.count(F.lit(1)).alias("voxels"))

    register(f"i1_components_{_n}", ctes("vox", SPARSE + runs("sp", "sem", _k) + "select scan_id, lab as sem, comp, count(*) as voxels from cv group by all"))(i1)


DILATE = f""", o(dp, di, dr) as (values {_offsets(1)}), src as (select scan_id, p, i, r, inst from vox where inst > 0),
d1 as (select scan_id, p + dp as p, i + di as i, r + dr as r, min(inst) as inst from src, o group by all),
x1 as (select * from src union all select d1.* from d1 anti join src using (scan_id, p, i, r) {{cond}})
"""
FRAME = "where p between 0 and 11 and i between 0 and 39 and r between 0 and 7"


@register("i2_dilate", ctes("vox", DILATE.format(cond=FRAME) + f""", d2 as (select scan_id, p + dp as p, i + di as i, r + dr as r, min(inst) as inst from x1, o group by all)
select * from x1 union all select d2.* from d2 anti join x1 using (scan_id, p, i, r) {FRAME}"""))
def i2(s, d):
    return nb.dilate(view(s, d, "vox").filter("inst > 0"), "inst", view(s, d, "scans"), 2)


@register("i2_dilate_masked", ctes("vox", DILATE.format(cond="semi join vox using (scan_id, p, i, r)") + "select * from x1"))
def i2m(s, d):
    vox = view(s, d, "vox")
    return nb.dilate(vox.filter("inst > 0"), "inst", view(s, d, "scans"), 1, mask=vox)


@register("i3_erode", ctes("vox", f""", o(dp, di, dr) as (values {_offsets(1)}), n as (select a.scan_id, a.p, a.i, a.r, a.inst, count(*) as n from vox a, o, vox b where a.inst > 0 and b.inst = a.inst and a.scan_id = b.scan_id and b.p = a.p + dp and b.i = a.i + di and b.r = a.r + dr group by all)
select scan_id, p, i, r, inst from n where n = 6"""))
def i3(s, d):
    return nb.erode(view(s, d, "vox").filter("inst > 0"), "inst", 1)


@register("a5_component_stats", ctes("vox", SPARSE + runs("sp", "sem") + """, st as (select scan_id, lab as sem, comp, count(*) as voxels, cast(floor(sum(p) / count(*)) as int) as cp, cast(floor(sum(i) / count(*)) as int) as ci, cast(floor(sum(r) / count(*)) as int) as cr, min(p) as p0, max(p) as p1, min(i) as i0, max(i) as i1, min(r) as r0, max(r) as r1 from cv group by all)
select *, cast(row_number() over (partition by scan_id, sem order by ci, comp) as int) as rank from st"""))
def a5(s, d):
    return nb.component_stats(nb.components(_sparse(s, d), "sem", 1), "sem")


@register("t1_largest_components", ctes("vox", SPARSE + runs("sp", "sem") + ", st as (select scan_id, lab as sem, comp, count(*) as voxels from cv group by all), k as (select *, cast(row_number() over (partition by scan_id, sem order by voxels desc, comp) as int) as rank from st) select * from k where rank <= 3"))
def t1(s, d):
    return nb.largest_components(nb.components(_sparse(s, d), "sem", 1), "sem", 3)


@register("i4_fill_holes", ctes("vox", """, b as (select scan_id, inst, min(p) p0, max(p) p1, min(i) i0, max(i) i1, min(r) r0, max(r) r1 from vox where inst > 0 group by all),
g1 as (select *, unnest(range(p0, p1 + 1))::int as p from b), g2 as (select *, unnest(range(i0, i1 + 1))::int as i from g1), g3 as (select *, unnest(range(r0, r1 + 1))::int as r from g2),
hole as materialized (select scan_id, inst, p, i, r, p in (p0, p1) or i in (i0, i1) or r in (r0, r1) as edge from g3 anti join (select * from vox where inst > 0) v using (scan_id, inst, p, i, r))
""" + runs("hole", "inst") + """, inner_ as (select cv.scan_id, lab, comp from cv join hole on hole.scan_id = cv.scan_id and hole.inst = lab and hole.p = cv.p and hole.i = cv.i and hole.r = cv.r group by all having not bool_or(edge)),
f as (select scan_id, p, i, r, min(lab) as inst from cv semi join inner_ using (scan_id, lab, comp) group by all)
select scan_id, p, i, r, inst from vox where inst > 0 union all select * from f anti join (select * from vox where inst > 0) v using (scan_id, p, i, r)"""))
def i4(s, d):
    return nb.fill_holes(staged_views(s, d)[0].filter("inst > 0"), "inst")


A19 = """, m as (select distinct scan_id, p, i, r, 1 as one from vox where intensity > 1000 or inst = 2),
b as (select scan_id, min(p) p0, max(p) p1, min(i) i0, max(i) i1, min(r) r0, max(r) r1 from m group by all),
g1 as (select *, unnest(range(p0, p1 + 1))::int as p from b), g2 as (select *, unnest(range(i0, i1 + 1))::int as i from g1), g3 as (select *, unnest(range(r0, r1 + 1))::int as r from g2),
hole as materialized (select scan_id, 1 as one, p, i, r, p in (p0, p1) or i in (i0, i1) or r in (r0, r1) as edge from g3 anti join m using (scan_id, p, i, r))
""" + runs("hole", "one") + """, outer_ as (select cv.scan_id, comp from cv join hole using (scan_id, p, i, r) group by all having bool_or(edge)),
cells as (select scan_id, p, i, r, r - row_number() over (partition by scan_id, p, i order by r) as k from cv semi join outer_ using (scan_id, comp))
select scan_id, p, i, cast(min(r) as int) as s, cast(max(r) as int) as e, -1 as mark from cells group by scan_id, p, i, k"""


@register("a19_outside_in_box", ctes("vox", A19))
def a19_outside(s, d):
    """Two channels: bright voxels, and those of the second instance."""
    vox = view(s, d, "vox").select(*vx.KEY, (F.col("intensity") > 1000).cast("int").alias("bright"), (F.col("inst") == 2).cast("int").alias("second"))
    return nb.nonzero_box(vox, ["bright", "second"])[1]


def _infected(rounds: int) -> str:
    """Growth into the voxels without an instance, round by round; a round that finds nothing changes nothing."""
    out = f", o(dp, di, dr) as (values {_offsets(1)}), x0 as materialized (select scan_id, p, i, r, inst from vox where inst > 0)"
    for k in range(rounds):
        out += f""", x{k + 1} as materialized (select * from x{k} union all select g.* from (
  select scan_id, p + dp as p, i + di as i, r + dr as r, min(inst) as inst from x{k}, o group by all) g
  semi join (select * from vox where inst = 0) v using (scan_id, p, i, r) anti join x{k} using (scan_id, p, i, r))"""
    return f"{out} select scan_id, p, i, r, inst from x{rounds}"


@register("i5_infect", ctes("vox", _infected(14)))
def i5(s, d):
    vox, scans = staged_views(s, d)
    return nb.infect(vox.filter("inst > 0"), "inst", vox.filter("inst = 0"), scans)


CLEAN = """, small as materialized (select scan_id, lab, comp from cv group by all having count(*) < case lab when 41 then 12 when 62 then 20 else 0 end),
o(dp, di, dr) as (values {offsets}),
ring as (select distinct cv.scan_id, lab, comp, p + dp as p, i + di as i, r + dr as r from cv semi join small using (scan_id, lab, comp), o),
near as (select ring.*, sp.sem as other from ring left join sp using (scan_id, p, i, r) where ring.p between 0 and 11 and ring.i between 0 and 39 and ring.r between 0 and 7 and (sp.sem is null or sp.sem <> lab)),
cnt as (select scan_id, lab, comp, count(*) as ring, count(other) as n from near group by all),
win as (select scan_id, lab, comp, arg_min(other, struct_pack(a := -k, b := other)) as to_ from (select scan_id, lab, comp, other, count(*) as k from near where other is not null group by all) group by all),
fate as (select scan_id, lab, comp, case when n is null or n <= floor(ring * 0.1) then 0 else coalesce(to_, 0) end as to_ from small left join cnt using (scan_id, lab, comp) left join win using (scan_id, lab, comp))
select cv.scan_id, p, i, r, coalesce(to_, lab) as sem from cv left join fate using (scan_id, lab, comp) where coalesce(to_, lab) > 0"""


@register("i6_clean_artifacts", ctes("vox", SPARSE + runs("sp", "sem") + CLEAN.format(offsets=_offsets(1))))
def i6(s, d):
    sizes = s.createDataFrame([(41, 12), (62, 20)], "label int, size long")
    return nb.clean_artifacts(_sparse(s, d).select(*vx.KEY, "sem"), "sem", sizes, view(s, d, "scans"))


BLOBS = ", sp as (select *, 1 as one from vox where (i < 14 and p < 5) or (i > 20 and i < 26 and p > 6) or (i > 32 and p > 7 and r > 3))"
BOXES = ", st as (select scan_id, comp, count(*) as n, min(p) - 1 as p0, max(p) + 1 as p1, min(i) - 1 as i0, max(i) + 1 as i1, min(r) - 1 as r0, max(r) + 1 as r1 from cv group by all), top as (select * from st qualify row_number() over (partition by scan_id order by n desc, comp) = 1)"


@register("i7_bounding_box_clean", ctes("vox", BLOBS + runs("sp", "one", 3) + BOXES + "select sp.scan_id, p, i, r, sem from sp join top using (scan_id) where p between p0 and p1 and i between i0 and i1 and r between r0 and r1"))
def i7(s, d):
    vox = view(s, d, "vox").filter("(i < 14 and p < 5) or (i > 20 and i < 26 and p > 6) or (i > 32 and p > 7 and r > 3)").select(*vx.KEY, "sem")
    return nb.bounding_box_clean(vox, "sem", view(s, d, "scans"), 1)


@register("i7_bounding_box_grow", None)
def i7g(s, d):
    vox = view(s, d, "vox").filter("(i < 14 and p < 5) or (i > 20 and i < 26 and p > 6) or (i > 32 and p > 7 and r > 3)").select(*vx.KEY, "sem")
    return nb.bounding_box_clean(vox, "sem", view(s, d, "scans"), 3, grow=True)


@register("i8_trim_to_canal", ctes("vox scans", """, c as (select scan_id, min(i) - 6.0::double / zi as lo, max(i) + 6.0::double / zi as hi from vox join scans using (scan_id) where sem = 61 and i between 12 and 25 and scan_id % 4 <> 3 group by scan_id, zi)
select scan_id, p, i, r, sem from vox left join c using (scan_id) where (sem <> 61 or (i between 12 and 25 and scan_id % 4 <> 3)) and (lo is null or i between lo and hi or sem = 100)"""))
def i8(s, d):
    vox = view(s, d, "vox").filter("sem <> 61 or (i between 12 and 25 and scan_id % 4 <> 3)").select(*vx.KEY, "sem")
    return nb.trim_to_canal(vox, "sem", view(s, d, "scans"), canal=(61,), margin_mm=6.0, keep=100)


def assigned(mask: str, start: str, rounds: int = 6) -> str:
    """Two rounds of growth in the mask, then components in rounds; a round without votes changes nothing."""
    out = f""", o(dp, di, dr) as (values {_offsets(1)}), sm as (select scan_id, p, i, r, inst from vox where {mask}), y0 as materialized (select * from sm where {start})"""
    for k in (0, 1):
        out += f""", y{k + 1} as materialized (select * from y{k} union all select g.* from (select scan_id, p + dp as p, i + di as i, r + dr as r, min(inst) as inst from y{k}, o group by all) g
  semi join sm using (scan_id, p, i, r) anti join y{k} using (scan_id, p, i, r))"""
    out += ", ms as materialized (select scan_id, p, i, r, 1 as one from sm anti join y2 using (scan_id, p, i, r))" + runs("ms", "one", 2)
    out += ", s0 as (select * from y2), c0 as (select scan_id, p, i, r, comp from cv)"
    for k in range(rounds):
        out += f""",
v{k} as materialized (select scan_id, comp, arg_min(inst, struct_pack(a := -n, b := inst)) as inst from (
  select q.scan_id, comp, inst, count(*) as n from (select distinct scan_id, p + dp as p, i + di as i, r + dr as r, comp from c{k}, o) q
  join s{k} s on s.scan_id = q.scan_id and s.p = q.p and s.i = q.i and s.r = q.r group by all) group by scan_id, comp),
s{k + 1} as materialized (select * from s{k} union all select c.scan_id, p, i, r, inst from c{k} c join v{k} using (scan_id, comp)),
c{k + 1} as materialized (select * from c{k} anti join v{k} using (scan_id, comp))"""
    return f"{out}, given as (select * from s{rounds}), deleted as (select scan_id, p, i, r, 0 as inst from c{rounds})"


@register("i9_assign_missing", ctes("vox", assigned("sem <> 100", "inst > 0 and p > 1") + " select * from given union all select * from deleted"))
def i9(s, d):
    vox, scans = staged_views(s, d)
    vox = vox.filter("sem <> 100")
    inst, deleted = nb.assign_missing(vox, vox.filter("inst > 0 and p > 1"), scans)
    return inst.unionByName(deleted.withColumn("inst", F.lit(0)))


@register("i10_fix_articular", ctes("vox", ", sp as (select * from vox where sem in (41, 42) and (p + i + r) % 5 <> 0)" + runs("sp", "sem") + """, n as (select scan_id, lab, comp, case when (i + r) % 3 = 0 then 0 when p > 9 and i % 10 < 2 and inst > 1 then inst - 1 else inst end as b, count(*) as n from cv join (select scan_id, p, i, r, inst from vox) v using (scan_id, p, i, r) group by all),
k as (select *, row_number() over (partition by scan_id, lab, comp order by n desc, b) as rn, lead(n) over (partition by scan_id, lab, comp order by n desc, b) as n2 from n),
best as (select scan_id, lab, comp, b as to_ from k where rn = 1 and n2 is not null and n * 0.5 > n2),
won as (select scan_id, p, i, r, to_ from cv join best using (scan_id, lab, comp)),
x as (select scan_id, p, i, r, case when (i + r) % 3 = 0 then 0 when p > 9 and i % 10 < 2 and inst > 1 then inst - 1 else inst end as inst from vox)
select scan_id, p, i, r, coalesce(to_, inst) as inst from x left join won using (scan_id, p, i, r) where coalesce(to_, inst) > 0"""))
def i10(s, d):
    vox = view(s, d, "vox")
    inst = vox.withColumn("inst", F.expr("case when (i + r) % 3 = 0 then 0 when p > 9 and i % 10 < 2 and inst > 1 then inst - 1 else inst end")).filter("inst > 0")
    return nb.reassign_dominant(vox.filter("sem in (41, 42) and (p + i + r) % 5 <> 0"), inst, (41, 42))


I11 = """, v as (select * from (select scan_id, p, i, r, sem, case when p >= 10 and i % 10 = 0 and i > 0 then cast(i // 10 as int) else inst end as inst from vox) where inst > 0)""" + runs("v", "inst") + """,
k as (select *, row_number() over (partition by scan_id, lab order by n desc, comp) as rn from (select scan_id, lab, comp, count(*) as n from cv group by all)),
pt as (select cv.scan_id, cv.p, cv.i, cv.r, lab, comp, sem from cv join k using (scan_id, lab, comp) join v using (scan_id, p, i, r) where rn in (2, 3)),
bx as (select scan_id, lab, comp, min(p) - 1 as p0, max(p) + 1 as p1, min(i) - 1 as i0, max(i) + 1 as i1, min(r) - 1 as r0, max(r) + 1 as r1 from pt group by all having bool_and(sem in (41, 42))),
one as (select bx.scan_id, lab, comp, min(inst) as to_ from bx join v on v.scan_id = bx.scan_id and inst <> lab and p between p0 and p1 and i between i0 and i1 and r between r0 and r1 group by all having min(inst) = max(inst)),
mv as (select scan_id, p, i, r, to_ from pt join one using (scan_id, lab, comp))
select scan_id, p, i, r, coalesce(to_, inst) as inst from v left join mv using (scan_id, p, i, r)"""


@register("i11_fix_posterior", ctes("vox", I11))
def i11(s, d):
    vox = view(s, d, "vox").withColumn("inst", F.expr("case when p >= 10 and i % 10 = 0 and i > 0 then cast(i div 10 as int) else inst end"))
    return nb.fix_posterior(vox.filter("inst > 0")).select(*vx.KEY, "inst")


@register("i12_merge_top_split", ctes("vox scans", f""", v as (select scan_id, p, i, r, case when inst = 1 and i > 1 then 2 else inst end as inst from vox where inst > 0 and sem = 49 and not i between 8 and 9),
t as (select scan_id, inst as label, count(*) as n, sum(i) / count(*) as ci from v group by all), k as (select *, row_number() over (partition by scan_id order by ci, label) as rn from t),
top as (select a.scan_id, a.label as l1, b.label as l2 from k a join k b on a.scan_id = b.scan_id and a.rn = 1 and b.rn = 2 where a.n < 0.5 * b.n),
o(dp, di, dr) as (values {_offsets(1, True)}),
f as (select a.scan_id, least(a.inst, b.inst) as a, greatest(a.inst, b.inst) as b, count(*) as faces from v a, o, v b where a.scan_id = b.scan_id and b.p = a.p + dp and b.i = a.i + di and b.r = a.r + dr and a.inst <> b.inst group by all),
pick as (select top.* from top join f on f.scan_id = top.scan_id and f.a = least(l1, l2) and f.b = greatest(l1, l2) join scans s on s.scan_id = top.scan_id
  where f.faces > greatest(round_even(20.0::double * power(0.75::double * 0.75 * 1.65, 2.0::double / 3) / power(zp * zi * zr, 2.0::double / 3), 0), 1))
select v.scan_id, p, i, r, case when inst = l1 then l2 else inst end as inst from v left join pick using (scan_id)"""))
def i12(s, d):
    v = view(s, d, "vox").filter("inst > 0 and sem = 49 and not i between 8 and 9").withColumn("inst", F.expr("case when inst = 1 and i > 1 then 2 else inst end"))
    return nb.merge_top_split(v.select(*vx.KEY, "inst"), view(s, d, "scans"))


def _endplate_rounds(rounds: int) -> str:
    out = f""", o(dp, di, dr) as (values {_offsets(1)}),
ab as (select scan_id, inst, lag(inst) over (partition by scan_id order by inst) as prev from (select distinct scan_id, inst from vox where inst > 0)),
f0 as (select scan_id, p, i, r, inst from vox where inst > 0), l0 as (select scan_id, p, i, r, cast(1 + i // 10 as int) as owner from vox where sem = 62)"""
    for k in range(rounds):
        out += f""",
h{k} as materialized (select l.scan_id, l.p, l.i, l.r, owner, max(case when owner = ab.inst then 1 else 0 end) as own, min(ab.inst) as inst
  from l{k} l join (select distinct scan_id, p + dp as p, i + di as i, r + dr as r, inst from f{k}, o) q on q.scan_id = l.scan_id and q.p = l.p and q.i = l.i and q.r = l.r
  join ab on ab.scan_id = l.scan_id and ab.inst = q.inst where owner = ab.inst or owner = prev group by all),
f{k + 1} as (select scan_id, p, i, r, inst from h{k}), l{k + 1} as materialized (select * from l{k} anti join h{k} using (scan_id, p, i, r))"""
    return out + " union all ".join(f" select scan_id, p, i, r, owner + 200 as inst, case own when 1 then 'inferior' else 'superior' end as part from h{k}" for k in range(rounds))


@register("i19_split_endplates", ctes("vox", _endplate_rounds(14)))
def i19(s, d):
    vox, scans = staged_views(s, d)
    plates = vox.filter("sem = 62").withColumn("inst", F.expr("cast(201 + i div 10 as int)"))
    return nb.split_endplates(vox.filter("inst > 0").select(*vx.KEY, "inst"), plates, scans)


@register("j7_box_overlap", ctes("vox", ", st as (select scan_id, inst as label, min(p) p0, max(p) p1, min(i) i0, max(i) i1, min(r) r0, max(r) r1 from vox where inst > 0 group by all) select a.scan_id, a.label as a, b.label as b from st a join st b on a.scan_id = b.scan_id and a.label < b.label and a.p0 <= b.p1 and b.p0 <= a.p1 and a.r0 <= b.r1 and b.r0 <= a.r1 and a.i0 - 3 <= b.i1 and b.i0 - 3 <= a.i1"))
def j7(s, d):
    st = rg.region_stats(view(s, d, "vox"), "inst")
    return rg.box_overlap(st, st, margin=3).filter("a < b")
