"""Queries over file catalogs, models and run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtable.registry import register
from voxtable.sources import catalog as ct
from voxtable.sources.views import ctes, view

PATHS = """, pa as (select file_id, 'data/sub-' || subject || '/anat/sub-' || subject || coalesce('_acq-' || acq, '') || '_run-' || file_id || coalesce('_seg-' || seg, '') || '_' || format || '.nii.gz' as path from catalog)
"""


def _paths(s, d):
    c = view(s, d, "catalog")
    sub = F.concat(F.lit("sub-"), F.col("subject").cast("string"))
    opt = lambda k, v: F.coalesce(F.concat(F.lit(f"_{k}-"), F.col(v)), F.lit(""))
    return c.select("file_id", F.concat(F.lit("data/"), sub, F.lit("/anat/"), sub, opt("acq", "acq"), F.lit("_run-"), F.col("file_id").cast("string"), opt("seg", "seg"), F.lit("_"), F.col("format"), F.lit(".nii.gz")).alias("path"))


@register("s2_parse_entities", ctes("catalog", "select file_id, cast(subject as varchar) as sub, acq, cast(file_id as varchar) as run, seg, format, 'nii.gz' as filetype from catalog"))
def s2(s, d):
    entities, fmt, kind = ct.parse_entities(F.col("path"))
    e = _paths(s, d).select("file_id", entities.alias("e"), fmt.alias("format"), kind.alias("filetype"))
    return e.select("file_id", *[F.col("e")[k].alias(k) for k in ("sub", "acq", "run", "seg")], "format", "filetype")


#: Entities that the catalog view lacks, by file: extension, lesions, chunk and part of the T2w files.
MORE = {
    "filetype": "case when file_id % 11 = 0 then 'json' else 'nii.gz' end",
    "lesions": "case when file_id % 13 = 0 then 'x' end",
    "chunk": "case when file_id % 3 = 0 then 'LWS' when file_id % 3 = 1 then 'HWS' end",
    "part2": "case file_id % 4 when 0 then 'inphase' when 1 then 'outphase' end",
}
MORE_SQL = ", more as (select *, " + ", ".join(f"{x} as {k}" for k, x in MORE.items()) + " from catalog) "


def _more(s, d):
    return view(s, d, "catalog").withColumns({k: F.expr(x) for k, x in MORE.items()})


@register("s3_select_scans", ctes("catalog", MORE_SQL + "select file_id, subject, format, acq, part from more where filetype = 'nii.gz' and seg is null and format in ('T2w', 'dixon') and (format <> 'dixon' or part = 'inphase') and lesions is null and label is null and (acq is null or acq in ('sag', 'iso'))"))
def s3(s, d):
    return ct.select_scans(_more(s, d), ("T2w", "dixon"), ("sag", "iso")).select("file_id", "subject", "format", "acq", "part")


@register("s4_family_pick", ctes("catalog", MORE_SQL + ", r as (select *, case when part2 = 'inphase' then 1 when part2 is null then 2 end as r from more where format = 'T2w' and chunk = 'LWS' and filetype = 'nii.gz') select subject, arg_min(file_id, struct_pack(a := r, b := file_id)) as file_id, cast(min(r) as int) as choice from r where r is not null group by subject"))
def s4(s, d):
    return ct.family_pick(_more(s, d).withColumn("part", F.col("part2")))


OUT_SQL = """, x as (select path, regexp_extract(path, '^(.*/)[^/]*$', 1) || 'derivatives' as base, format as f, regexp_replace(regexp_extract(path, '([^/]+)_[^_/]*$', 1), '_seg-[^_]*', '') || '_mod-' || format || '_seg-' as stem from pa join catalog using (file_id)),
o(name, raw, file) as (values ('out_spine', '', 'spine_msk.nii.gz'), ('out_spine_raw', 'output_raw_', 'spine-raw_msk.nii.gz'), ('out_vert', '', 'vert_msk.nii.gz'), ('out_vert_raw', 'output_raw_', 'vert-raw_msk.nii.gz'),
  ('out_unc', 'output_raw_', 'spine_uncertainty.nii.gz'), ('out_logits', 'output_raw_', 'spine_logit.npz'), ('out_snap', '', 'spine_snp.png'), ('out_snap2', '', 'spine_snp.png'), ('out_ctd', '', 'spine_ctd.json'),
  ('out_vibeseg', '', 'VIBESeg-100_msk.nii.gz'), ('out_debug', 'debug_', null), ('out_raw', 'output_raw_', null))
select path, name, base || case when raw <> '' then '/' || raw || f else '' end || coalesce('/' || stem || file, '') as output from x, o"""


@register("s11_derive_outputs", ctes("catalog", PATHS + OUT_SQL))
def s11(s, d):
    return ct.derive_outputs(_paths(s, d))


@register("s12_disc_output_name", ctes("catalog", PATHS + "select file_id, replace(path, '.nii.gz', '_discs.nii.gz') as path from pa"))
def s12(s, d):
    return _paths(s, d).select("file_id", ct.disc_output_name(F.col("path"), "_discs").alias("path"))


MANIFEST = ", mf as (select file_id as scan_id, unnest(['out_spine', 'out_vert', 'out_snap', 'out_ctd']) as name, unnest([0, 1, 2, 3]) as k from catalog), have as (select * from mf where (scan_id + k) % 5 <> 0)"


def _manifest(s, d, names):
    rows = F.posexplode(F.array(*map(F.lit, names)))
    return view(s, d, "catalog").select(F.col("file_id").alias("scan_id"), rows.alias("k", "name")).filter("(scan_id + k) % 5 <> 0").drop("k")


@register("s13_resume_filter", ctes("catalog", MANIFEST + " select file_id as scan_id, coalesce(n, 0) = 4 and file_id % 9 <> 0 as done from catalog left join (select scan_id, count(*) as n from have group by all) h on h.scan_id = file_id"))
def s13(s, d):
    scans = view(s, d, "catalog").select(F.col("file_id").alias("scan_id"))
    return ct.resume_filter(scans, _manifest(s, d, ("out_spine", "out_vert", "out_snap", "out_ctd")), scans.filter("scan_id % 9 = 0"))


def _plan_sql(instance):
    return ctes("catalog", f""", h as (select file_id as scan_id, [(file_id + k) % 5 = 0 for k in range(5)] as m from catalog)
select scan_id, m[1] as run_semantic, {instance} as run_instance, m[1] or m[2] or m[3] as run_cleanup, m[1] or m[2] or m[3] or m[4] as run_centroid, m[1] or m[2] or m[3] or m[4] or m[5] as run_snapshot from h""")


def _plan(s, d, **options):
    scans = view(s, d, "catalog").select(F.col("file_id").alias("scan_id"))
    return ct.stage_plan(scans, _manifest(s, d, ct.STAGES).withColumnRenamed("name", "stage"), **options)


@register("s14_stage_plan", _plan_sql("m[2]"))
def s14(s, d):
    return _plan(s, d)


@register("s14_stage_plan_cascade", _plan_sql("m[1] or m[2]"))
def s14b(s, d):
    """A new semantic mask also redoes the instances."""
    return _plan(s, d, cascade=True)


@register("s15_run_summary", ctes("run_log", "select subject, count(*) as seen, count(*) filter (errcode = 'OK') as ok, count(*) filter (errcode = 'ALL_DONE') as all_done, count(*) filter (errcode not in ('OK', 'ALL_DONE')) as failed, coalesce(list_sort(list_distinct(list(errcode) filter (errcode not in ('OK', 'ALL_DONE')))), []) as codes from run_log group by subject"))
def s15(s, d):
    return ct.run_summary(view(s, d, "run_log"), ["subject"])


@register("s15_subjects_without_runs", "select c_custkey as subject from customer where c_custkey not in (select user_id from events)")
def s15b(s, d):
    subjects = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("subject"))
    return ct.subjects_without_runs(subjects, view(s, d, "run_log"))


@register("s16_timing_summary", ctes("run_log", "select errcode, round(min(seconds), 6) as min_s, round(max(seconds), 6) as max_s, round(avg(seconds), 4) as avg_s from run_log group by errcode"))
def s16(s, d):
    t = ct.timing_summary(view(s, d, "run_log"))
    return t.select("errcode", F.round("min_s", 6).alias("min_s"), F.round("max_s", 6).alias("max_s"), F.round("avg_s", 4).alias("avg_s"))


@register("s18_provenance", ctes("scans", "select scan_id, 'a2' as model_semantic, '0.5' as step, '1.0' as version from scans"))
def s18(s, d):
    out = ct.provenance(view(s, d, "scans").select("scan_id"), {"semantic": "a2"}, {"step": 0.5}, "1.0", "2024-01-01")
    return out.select("scan_id", *[F.col("info")[k].alias(k) for k in ("model_semantic", "step", "version")])


@register("p21_modality_keys", ctes("catalog", """, k(modality, keys) as (values ('CT', ['CT', 'ct']), ('SEG', ['msk', 'seg']), ('T1w', ['T1w', 't1', 'T1', 'T1c']), ('T2w', ['T2w', 'dixon', 'mr', 't2', 'T2', 'T2c']), ('Vibe', ['t1dixon', 'vibe', 'mevibe', 'GRE']), ('MPR', ['mpr', 'MPR', 'Mpr'])),
a(plane, planes) as (values ('ax', ['axial', 'ax', 'axl']), ('cor', ['coronal', 'cor']), ('sag', ['sagittal', 'sag']), ('iso', ['iso', 'ISO']))
select file_id, modality, plane, keys, planes from catalog join k on modality = (['CT', 'SEG', 'T1w', 'T2w', 'Vibe', 'MPR'])[file_id % 6 + 1] join a on plane = (['ax', 'cor', 'sag', 'iso'])[file_id // 6 % 4 + 1]"""))
def p21(s, d):
    pick = lambda words, at: F.element_at(F.array(*map(F.lit, words)), (at + 1).cast("int"))
    c = view(s, d, "catalog").select("file_id", pick(("CT", "SEG", "T1w", "T2w", "Vibe", "MPR"), F.col("file_id") % 6).alias("modality"), pick(("ax", "cor", "sag", "iso"), F.expr("file_id div 6") % 4).alias("plane"))
    return ct.modality_keys(c).withColumn("planes", ct.acq_keys(F.col("plane")))


MODELS = [("m1", ["T2w", "dixon"], "sag"), ("m2", ["ct"], "ax"), ("m3", ["T1w", "T2w"], "sag"), ("m4", ["T2w"], "sag")]


@register("j1_model_pair_compat", ctes("catalog", f", m(id, f, a) as (values {', '.join(map(str, MODELS))}), u as (select subject, format, min(acq) as acq from catalog where acq is not null group by all), g as (select subject as id, list(distinct format) as f, min(acq) as a from u group by subject) select g.id as semantic, m.id as instance, len(list_filter(g.f, lambda x: not list_contains(m.f, x))) = 0 and g.a = m.a as compatible from g, m"))
def j1(s, d):
    own = view(s, d, "catalog").filter("acq is not null").groupBy(F.col("subject").cast("string").alias("model_id")).agg(F.collect_set("format").alias("modality"), F.min("acq").alias("acquisition"))
    given = s.createDataFrame(MODELS, "model_id string, modality array<string>, acquisition string")
    pairs = own.select(F.col("model_id").alias("semantic"), F.explode(F.array(*[F.lit(m[0]) for m in MODELS])).alias("instance"))
    return ct.model_pair_compat(own.unionByName(given), pairs).withColumn("semantic", F.col("semantic").cast("long"))


@register("j2_scan_model_compat", ctes("catalog", PATHS + rf""", m(model_id, f, a) as (values {', '.join(map(str, MODELS))}),
k(a, allowed) as (values ('ax', ['axial', 'ax', 'axl', 'iso']), ('cor', ['coronal', 'cor', 'iso']), ('sag', ['sagittal', 'sag', 'iso'])),
c as (select catalog.*, case when file_id % 17 = 0 then regexp_replace(path, '/([^/]*)$', '/debug_T2w/\1') else path end as path, (['sag', 'ax', 'iso'])[file_id % 3 + 1] as plane from catalog join pa using (file_id)),
r as (select file_id, model_id, list_filter([case when not list_contains(f, format) then 'format' end, case when seg is not null then 'seg' end, case when acq is not null and not list_contains(allowed, acq) then 'acq' end, case when label is not null then 'label (ignored)' end,
  case when contains(string_split(path, '/')[-1], 'debug') or contains(string_split(path, '/')[-2], 'debug') then 'debug' end, case when not list_contains(allowed, plane) then 'plane' end], lambda x: x is not null) as reasons from c, m join k using (a))
select file_id, model_id, len(list_filter(reasons, lambda x: not ends_with(x, '(ignored)'))) = 0 as compatible, reasons from r"""))
def j2(s, d):
    models = s.createDataFrame(MODELS, "model_id string, formats array<string>, acquisition string")
    path = F.when(F.col("file_id") % 17 == 0, F.regexp_replace("path", r"/([^/]*)$", "/debug_T2w/$1")).otherwise(F.col("path"))
    plane = F.element_at(F.array(*map(F.lit, ("sag", "ax", "iso"))), (F.col("file_id") % 3 + 1).cast("int"))
    scans = view(s, d, "catalog").join(_paths(s, d).withColumn("path", path), "file_id").withColumn("plane", plane)
    return ct.scan_model_compat(scans, models, ignore=("label",))
