"""Queries over labels, classifier heads and label sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtable.functions import labels as lb, units as un
from voxtable.operators import labelling as la, targets as tg
from voxtable.registry import register
from voxtable.sources.views import ctes, view

GROUP = "[" + ", ".join(str(g) for c in range(24) for g, m in enumerate(lb.GROUPS) if c in m) + "]"
LABELS = "select distinct label from subject_labels"


@register("p26_label_to_class", ctes("subject_labels", f", l as ({LABELS} union all select 28) select label, cast(case when label = 28 then 18 else least(23, label - 1) end as int) as cls, cast(case when label = 28 then 19 when label <= 19 then label - 1 else least(25, label) end as int) as exact from l"))
def p26(s, d):
    l = view(s, d, "subject_labels").select(F.col("label").cast("int")).distinct().union(s.range(1).select(F.lit(28)))
    return l.select("label", lb.label_to_class(F.col("label")).alias("cls"), lb.label_to_exactclass(F.col("label")).alias("exact"))


@register("p27_p28_region_and_group", ctes("subject_labels", f", c as (select subject, label, least(23, label - 1) as c from subject_labels) select subject, label, cast(case when c < 7 then 0 when c < 19 then 1 else 2 end as int) as region, ({GROUP})[c + 1] as grp from c"))
def p27(s, d):
    c = lb.label_to_class(F.col("label"))
    return view(s, d, "subject_labels").select("subject", "label", lb.region_of(c).alias("region"), lb.group_of(c).alias("grp"))


@register("p29_label_to_vertrel", ctes("subject_labels", """, m as (select subject, case when max(label) >= 18 then max(case when label between 8 and 19 then label end) end as b, case when max(label) >= 23 then max(case when label between 23 and 25 then label end) end as l from subject_labels group by subject)
select subject, label, cast(case when label = 7 then 1 when label = 8 then 2 when label = b then 3 when label = 20 then 4 when label = l then 5 else 0 end as int) as rel from subject_labels join m using (subject)"""))
def p29(s, d):
    rows = view(s, d, "subject_labels").withColumn("actual", F.col("label"))
    return rows.join(tg.label_boundaries(rows), "subject").select("subject", "label", lb.label_to_vertrel(F.col("label"), F.col("last_bwk"), F.col("last_lwk")).alias("rel"))


BINARY = ("True", "true", "1", "wahr", "Wahr", "Ja", "ja", "-", "1?", "False", "false", "0", "falsch", "Falsch", "Nein", "nein", "yes", "no", "0?", "JA", "maybe")


@register("p25_parse_binary", ctes("catalog", f", v as (select file_id, ({list(BINARY)})[file_id % {len(BINARY)} + 1] as v from catalog) select file_id, case when v in ('True', 'true', '1', 'wahr', 'Wahr', 'Ja', 'ja', '-', '1?') then [1, 0] when v in ('False', 'false', '0', 'falsch', 'Falsch', 'Nein', 'nein') then [0, 1] end as flag from v"))
def p25(s, d):
    v = F.element_at(F.array(*map(F.lit, BINARY)), (F.col("file_id") % len(BINARY) + 1).cast("int"))
    return view(s, d, "catalog").select("file_id", lb.parse_binary(v).alias("flag"))


@register("p22_one_hot", ctes("subject_labels", ", l as (select subject, label, case when label % 9 < 6 then label % 9 else 0 end as k from subject_labels) select subject, label, [cast(k = x as int) for x in range(6)] as hot from l"))
def p22(s, d):
    return view(s, d, "subject_labels").select("subject", "label", un.one_hot(F.col("label") % 9, 6).alias("hot"))


@register("p23_argmax_class", ctes("cost", "select scan_id, rw, cast(arg_min(cls, struct_pack(a := -w, c := cls)) as int) as cls from cost group by all"))
def p23(s, d):
    rows = view(s, d, "cost").groupBy("scan_id", "rw").agg(F.array_sort(F.collect_list(F.struct("cls", "w"))).alias("x"))
    return rows.select("scan_id", "rw", un.argmax_class(F.transform("x", lambda v: v["w"])).alias("cls"))


@register("p24_softmax", ctes("cost", "select scan_id, rw, cls, round(exp(w / 500.0::double) / sum(exp(w / 500.0::double)) over (partition by scan_id, cls), 6) as w from cost"))
def p24(s, d):
    return la.softmax_rows(view(s, d, "cost"), 500.0).withColumn("w", F.round("w", 6))


@register("p30_disc_map", ctes("vox", ", l as (select distinct scan_id, case when sem = 100 then 102 + i // 10 when i = 0 then 2 end as label from vox) select scan_id, cast(label as int) as label, cast(case when label = 2 then 1 when label between 102 and 124 then label - 99 end as int) as disc from l where label is not null"))
def p30(s, d):
    label = F.expr("case when sem = 100 then cast(102 + i div 10 as int) when i = 0 then 2 end")
    return view(s, d, "vox").select("scan_id", label.alias("label")).distinct().filter("label is not null").withColumn("disc", lb.disc_map(F.col("label")))


@register("p34_flatten", ctes("cost", "select scan_id, list(w order by rw, cls) as ws from cost group by scan_id"))
def p34(s, d):
    return la.flattened(view(s, d, "cost"), ["scan_id"], ["rw", "cls"], "w", "ws")


@register("p35_angle_between", ctes("vox", ", m as (select scan_id, inst, avg(p) + 1 as x, avg(i) + 1 as y, avg(r) + 1 as z from vox where inst > 0 group by all) select scan_id, inst, round(degrees(acos(y / sqrt(x * x + y * y + z * z))) * case when (x - z) < 0 then -1 else 1 end, 5) as angle from m"))
def p35(s, d):
    m = view(s, d, "vox").filter("inst > 0").groupBy("scan_id", "inst").agg(*[(F.avg(a) + 1).alias(n) for a, n in (("p", "x"), ("i", "y"), ("r", "z"))])
    zero = F.lit(0.0)
    return m.select("scan_id", "inst", F.round(un.angle_between(F.col("x"), F.col("y"), F.col("z"), zero, F.lit(1.0), zero), 5).alias("angle"))


@register("p36_broadcast_scores", ctes("cost", f""", m as (select scan_id, rw, list(w order by cls) as a from cost group by all)
select scan_id, rw, [a[case when c < 7 then 1 when c < 19 then 2 else 3 end] for c in range(24)] as by_region, [a[({GROUP})[c + 1] + 1] for c in range(24)] as by_group from m"""))
def p36(s, d):
    m = view(s, d, "cost").groupBy("scan_id", "rw").agg(F.transform(F.array_sort(F.collect_list(F.struct("cls", "w"))), lambda x: x["w"]).alias("a"))
    return m.select("scan_id", "rw", lb.region_broadcast(F.col("a")).alias("by_region"), lb.group_expand(F.col("a")).alias("by_group"))


@register("p37_subject_block", ctes("anomalies", "select subject, cast(substr(cast(subject as varchar), 1, 3) as int) as block, t11 or t13 as transitional from anomalies"))
def p37(s, d):
    return view(s, d, "anomalies").select("subject", lb.subject_block(F.col("subject")).alias("block"), (F.col("t11") | F.col("t13")).alias("transitional"))


@register("p38_zip_strict", ctes("scans", "select scan_id, unnest([0, 1, 2]) as axis, unnest([np, ni, nr]) as a, unnest([zp, zi, zr]) as b from scans"))
def p38(s, d):
    return view(s, d, "scans").select("scan_id", F.posexplode(un.zip_strict(F.array("np", "ni", "nr"), F.array("zp", "zi", "zr"))).alias("axis", "x")).select("scan_id", "axis", "x.a", "x.b")


ACTUAL = """, act0 as (select subject, label, cast(case when t11 and label between 19 and 25 then label + 1 when t13 and not t11 and label = 20 then 28 when t13 and not t11 and label between 21 and 25 then label - 1 else label end as int) as actual, coalesce(remove, false) as rm from subject_labels left join anomalies using (subject)),
act as (select subject, label, actual, rm or (bool_or(actual = 28) over w and not bool_or(actual = 19) over w) as removed from act0 window w as (partition by subject)),
bd as (select subject, case when max(actual) >= 18 then max(case when actual between 8 and 19 or actual = 28 then actual end) end as last_bwk, case when max(actual) >= 23 then max(case when actual between 23 and 25 then actual end) end as last_lwk,
  case when bool_or(actual = 18) and not bool_or(actual = 19) and bool_or(actual = 20) then [17, 18, 20, 21] when bool_or(actual = 28) then [19, 28, 20, 21] else [18, 19, 20, 21] end as double_entries from act group by subject)
"""


def _actual(s, d):
    return tg.apply_anomalies(view(s, d, "subject_labels").withColumn("label", F.col("label").cast("int")), view(s, d, "anomalies"))


@register("j11_apply_anomalies", ctes("subject_labels anomalies", ACTUAL + "select subject, cast(label as int) as label, actual, removed from act"))
def j11(s, d):
    return _actual(s, d)


@register("j14_label_boundaries", ctes("subject_labels anomalies", ACTUAL + "select * from bd"))
def j14(s, d):
    return tg.label_boundaries(_actual(s, d))


ENTRY = ACTUAL + f""", en as (select subject, actual, cast(case when actual = 7 then 1 when actual = 8 then 2 when actual = last_bwk then 3 when actual = 20 then 4 when actual = last_lwk then 5 else 0 end as int) as vert_rel,
  cast(case when actual = 28 then 18 else least(23, actual - 1) end as int) as vert_exact, cast(case when actual = 28 then 19 when actual <= 19 then actual - 1 else least(25, actual) end as int) as vert_exact2, cast(actual = 28 as int) as vert_t13, '0' as vert_cut from act join bd using (subject)),
ent as (select *, ({GROUP})[vert_exact + 1] as vert_group, cast(case when vert_exact < 7 then 0 when vert_exact < 19 then 1 else 2 end as int) as vert_region from en)
"""


@register("j12_vert_entries", ctes("subject_labels anomalies", ENTRY + "select * from ent"))
def j12(s, d):
    return tg.vert_entries(_actual(s, d))


@register("j13_objective_vectors", ctes("subject_labels anomalies", ENTRY + "select subject, actual, [cast(vert_region = x as int) for x in range(3)] || [cast(vert_rel = x as int) for x in range(6)] || [0, 1] as objective, 11 as channels from ent"))
def j13(s, d):
    return tg.objective_vectors(tg.vert_entries(_actual(s, d)), ["REGION", "VERTREL", "FULLYVISIBLE"], together=True)


HEADS = ", hd as (select scan_id, rw, list(w / 1000.0::double order by cls) as a from cost group by all)"


def _heads(s, d):
    return view(s, d, "cost").groupBy("scan_id", "rw").agg(F.transform(F.array_sort(F.collect_list(F.struct("cls", "w"))), lambda x: x["w"] / 1000.0).alias("a"))


def _smooth(values: str, sigma: float, radius: int, blocks: str) -> str:
    """SQL for one smoothed array; ``blocks`` gives the first and last index of the block of c."""
    terms = " + ".join(f"{values}[greatest(({blocks})[1], least(({blocks})[2], c + {k})) + 1] * {w!r}::double" for k, w in zip(range(-radius, radius + 1), la.kernel(sigma, radius), strict=True))
    return f"[{terms} for c in range(24)]"


REGIONS = "case when c < 7 then [0, 6] when c < 19 then [7, 18] else [19, 23] end"


@register("w6_gauss_classes", ctes("cost", HEADS + f", sm as (select scan_id, rw, {_smooth('a', 0.85, 2, REGIONS)} as v from hd) select scan_id, rw, [round(x / (list_sum(v) + 1e-8::double), 6) for x in v] as v from sm"))
def w6(s, d):
    return _heads(s, d).select("scan_id", "rw", F.transform(la.prepare_vert(F.col("a")), lambda x: F.round(x, 6)).alias("v"))


def _rows(col: str, sigma: float, radius: int, edge: str) -> str:
    out = []
    for k, w in zip(range(-radius, radius + 1), la.kernel(sigma, radius), strict=True):
        beyond = "0" if edge == "constant" else f"{'first_value' if k < 0 else 'last_value'}({col}) over (partition by scan_id order by rw rows between unbounded preceding and unbounded following)"
        out.append(f"coalesce({'lag' if k < 0 else 'lead'}({col}, {abs(k)}) over (partition by scan_id order by rw), {beyond}) * {w!r}::double")
    return " + ".join(out)


ONE = ", one as (select scan_id, rw, w / 1000.0::double as v from cost where cls = 3)"


@register("w7_gauss_instances", ctes("cost", ONE + f" select scan_id, rw, round({_rows('v', 0.75, 1, 'nearest')}, 6) as v from one"))
def w7(s, d):
    one = view(s, d, "cost").filter("cls = 3").select("scan_id", "rw", (F.col("w") / 1000.0).alias("v"))
    return la.gauss_rows(one, "v", "s", 0.75, 1, ["scan_id"], ["rw"]).select("scan_id", "rw", F.round("s", 6).alias("v"))


@register("w8_visible_weight", ctes("cost", ONE + f", sm as (select scan_id, rw, {_rows('v', 0.8, 2, 'constant')} as v from one) select scan_id, rw, round(greatest(0, least(1, 1 - (1 - round_even(v, 3)) * 0.5)), 6) as weight from sm"))
def w8(s, d):
    one = view(s, d, "cost").filter("cls = 3").select("scan_id", "rw", (F.col("w") / 1000.0).alias("v"))
    return la.visible_weight(one, "v", "weight", 0.5).select("scan_id", "rw", F.round("weight", 6).alias("weight"))


REL = ", rel as (select scan_id, rw, cls as col, w / 20000.0::double as w from cost where cls < 6), tot as (select *, sum(w) over (partition by scan_id, col) + 1e-8::double as t from rel)"


def _rel(s, d):
    return view(s, d, "cost").filter("cls < 6").select("scan_id", "rw", F.col("cls").alias("col"), (F.col("w") / 20000.0).alias("w"))


@register("w9_normalize_rel", ctes("cost", REL + " select scan_id, rw, col, round(case when col = 0 then w when t > 1 then w / t when t < 1 then w / (1 + t) else w end, 6) as w from tot"))
def w9(s, d):
    return la.normalize_columns_rel(_rel(s, d)).withColumn("w", F.round("w", 6))


@register("w10_normalize_t13", ctes("cost", REL + " select scan_id, rw, col, round(case when col = 0 then w else w / t end, 6) as w from tot where col < 2"))
def w10(s, d):
    return la.normalize_columns_t13(_rel(s, d).filter("col < 2")).withColumn("w", F.round("w", 6))


@register("i20_head_fusion", ctes("cost", HEADS + ONE + f""", vs as (select scan_id, rw, greatest(0, least(1, 1 - (1 - round_even({_rows('v', 0.8, 2, 'constant')}, 3)))) as vw from one),
x as (select scan_id, rw, a, [a[case when c < 7 then 1 when c < 19 then 2 else 3 end] for c in range(24)] as rg, [a[({GROUP})[c + 1] + 1] for c in range(24)] as gp from hd),
y as (select scan_id, rw, {_smooth('rg', 0.75, 1, '[0, 23]')} as rg, {_smooth('a', 0.85, 2, REGIONS)} as vt, {_smooth('gp', 0.85, 2, REGIONS)} as gp from x),
z as (select scan_id, rw, [rg[c + 1] / (list_sum(rg) + 1e-8::double) * 1.1 + vt[c + 1] / (list_sum(vt) + 1e-8::double) * 0.9 + gp[c + 1] / (list_sum(gp) + 1e-8::double) * 0.8 for c in range(24)] as m from y),
n as (select scan_id, rw, [q / (list_sum(m) + 1e-8::double) for q in m] as m from z)
select scan_id, rw, [round(m[c + 1] * case when list_position(m, list_max(m)) = 2 then 3 else 1 end * vw, 6) for c in range(24)] as cost from n join vs using (scan_id, rw)"""))
def i20(s, d):
    h = _heads(s, d)
    heads = h.select("scan_id", "rw", F.slice("a", 1, 3).alias("region"), F.col("a").alias("vert"), F.slice("a", 1, 12).alias("grp"), F.col("a")[3].alias("visible"))
    return la.head_fusion(heads).select("scan_id", "rw", F.transform("cost", lambda x: F.round(x, 6)).alias("cost"))


#: The cheapest legal path to each class of each row; ``stay`` tells whether the class was entered by staying.
PATHS = """, c as (select scan_id, rw, cls, -w as w from cost), n as (select scan_id, max(rw) + 1 as steps from cost group by scan_id),
walk(scan_id, rw, cls, stay, total) as (
  select scan_id, rw, cls, false, cast(w as bigint) from c where rw = 0
  union all
  select k.scan_id, c.rw, c.cls, c.cls = k.cls, cast(min(k.total + c.w) as bigint) from walk k join c on c.scan_id = k.scan_id and c.rw = k.rw + 1
    and (c.cls = k.cls + 1 or (c.cls = k.cls and k.cls in (18, 23) and not k.stay) or (c.cls = k.cls + 2 and k.cls = 17))
  group by k.scan_id, c.rw, c.cls, c.cls = k.cls)
"""


@register("i21_decode_sequence", ctes("cost", PATHS + "select scan_id, cast(min(total) as double) as cost from walk join n using (scan_id) where rw = steps - 1 group by scan_id"))
def i21(s, d):
    cost = view(s, d, "cost").withColumn("w", -F.col("w"))
    return la.decode_sequence(cost).select("scan_id", "cost")


@register("i21_decoded_path_cost", ctes("cost", PATHS + "select scan_id, cast(min(total) as bigint) as total, cast(any_value(steps) as int) as steps from walk join n using (scan_id) where rw = steps - 1 group by scan_id"))
def i21b(s, d):
    """The decoded path's own costs add up to the minimum."""
    cost = view(s, d, "cost").withColumn("w", -F.col("w"))
    path = la.exploded(la.decode_sequence(cost))
    return path.join(cost, ["scan_id", "rw", "cls"]).groupBy("scan_id").agg(F.sum("w").alias("total"), F.count(F.lit(1)).cast("int").alias("steps"))


@register("t4_argmin_first", ctes("cost", "select scan_id, rw, min(w) as w, cast(arg_min(cls, struct_pack(a := w, c := cls)) as int) as cls from cost group by all"))
def t4(s, d):
    return la.argmin_first(view(s, d, "cost"), ["scan_id", "rw"])


@register("t6_path_in_row_order", ctes("cost", "select scan_id, list(cls order by rw) as path from (select scan_id, rw, cast(arg_min(cls, struct_pack(a := w, c := cls)) as int) as cls from cost group by all) group by scan_id"))
def t6(s, d):
    return la.path_in_row_order(t4(s, d))


SEQ = ", sq as (select subject as scan_id, row_number() over (partition by subject order by label) - 1 as rw, label - 1 as c from subject_labels), s2 as (select scan_id, rw, cast(case when scan_id % 3 = 0 and c > 18 then c - 1 when scan_id % 3 = 1 and c = 24 then 23 else c end as int) as cls from sq where not (scan_id % 3 <> 1 and c = 24))"


def _paths(s, d):
    from pyspark.sql import Window as W

    sq = view(s, d, "subject_labels").select(F.col("subject").alias("scan_id"), (F.row_number().over(W.partitionBy("subject").orderBy("label")) - 1).alias("rw"), (F.col("label") - 1).alias("c"))
    cls = F.when((F.col("scan_id") % 3 == 0) & (F.col("c") > 18), F.col("c") - 1).when((F.col("scan_id") % 3 == 1) & (F.col("c") == 24), 23).otherwise(F.col("c"))
    return sq.filter("not (scan_id % 3 <> 1 and c = 24)").select("scan_id", "rw", cls.cast("int").alias("cls"))


FIXED = SEQ + """, fx as (select scan_id, rw, cls, coalesce(lag(cls) over w = cls, false) as again, lead(cls) over w is null as last_ from s2 window w as (partition by scan_id order by rw)),
lab as (select scan_id, rw, cast(case when again and cls = 18 then 28 when again and last_ and cls = 23 then 25 else cls + 1 end as int) as label from fx)
"""


@register("w11_fix_transitional", ctes("subject_labels", FIXED + "select * from lab"))
def w11(s, d):
    return la.fix_transitional(_paths(s, d))


@register("w12_valid_sequence", ctes("subject_labels", FIXED + ", st as (select scan_id, label, lag(label) over (partition by scan_id order by rw) as b from lab) select scan_id, bool_and(b is null or label = b + 1 or (label = 20 and b in (18, 28))) as valid from st group by scan_id"))
def w12(s, d):
    return la.valid_sequence(la.fix_transitional(_paths(s, d)))


SIZES = [len(g) for g in lb.GROUPS]
HEAD0 = [g[0] for g in lb.GROUPS]


@register("w15_group_sequence", ctes("subject_labels", f""", g0 as (select subject as scan_id, row_number() over (partition by subject order by label) - 1 as rw, ({GROUP})[label] as grp from subject_labels where label < 25),
g1 as (select *, count(*) over (partition by scan_id, grp) as n, row_number() over (partition by scan_id, grp order by rw) - 1 as k, min(rw) over (partition by scan_id, grp) > 0 as before_, max(rw) over (partition by scan_id, grp) < max(rw) over (partition by scan_id) as after_ from g0)
select scan_id, rw, grp, cast(case when n = ({SIZES})[grp + 1] or before_ then ({HEAD0})[grp + 1] + k when after_ then ({HEAD0})[grp + 1] + ({SIZES})[grp + 1] - n + k end as int) as cls from g1"""))
def w15(s, d):
    from pyspark.sql import Window as W

    rows = view(s, d, "subject_labels").filter("label < 25")
    g = rows.select(F.col("subject").alias("scan_id"), (F.row_number().over(W.partitionBy("subject").orderBy("label")) - 1).alias("rw"), lb.group_of(F.col("label").cast("int") - 1).alias("grp"))
    return la.group_sequence_to_class(g)
