"""Scan, voxel, score and catalog tables derived from the given tables.

One text serves both engines: ``{lineitem}`` and the like stand for a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from voxtable.plans.storage import enough_partitions, honest_sizes, small_side, staged_rows

VIEWS = {
    # Four stacked vertebrae with holes in a 12 x 40 x 8 grid: body 49, canal 61, posterior 41 and 42, endplate 62, disc 100.
    "vox": """
select scan_id, p, i, r, intensity,
  case when i % 10 = 9 then 100 when i % 10 = 8 then 62 when p < 6 then 49
       when p < 8 then 61 when p < 10 then 41 else 42 end as sem,
  case when i % 10 < 8 and (p < 6 or p >= 8) then cast(floor(i / 10.0) as int) + 1 else 0 end as inst
from (select cast(floor(l_suppkey / 10.0) as int) as scan_id, cast(l_partkey % 12 as int) as p,
        cast(l_orderkey % 40 as int) as i,
        cast((l_linenumber + cast(floor(l_extendedprice) as bigint)) % 8 as int) as r,
        max(cast(floor(l_extendedprice) as bigint) % 1500) as intensity
      from {lineitem} group by 1, 2, 3, 4) raw""",
    "scans": """
select scan_id, 12 as np, 40 as ni, 8 as nr,
  cast(case scan_id % 3 when 0 then 0.75 when 1 then 0.8 else 1.5 end as double) as zp,
  cast(case scan_id % 3 when 0 then 0.75 when 1 then 0.8 else 1.5 end as double) as zi,
  cast(case scan_id % 3 when 0 then 1.65 when 1 then 0.8 else 1.5 end as double) as zr
from (select distinct scan_id from vox) s""",
    "preds": """
select v.scan_id, c.r_regionkey as com_idx, v.inst - c.r_regionkey as lab, v.p, v.i, v.r
from vox v join {region} c on v.inst - c.r_regionkey between 0 and 2 and c.r_regionkey < 4
where v.inst > 0 and (v.p * 31 + v.i * 17 + v.r * 7 + c.r_regionkey * 13) % 10 < 9""",
    "cost": """
select cast(floor(e.vec_id / 20.0) as int) as scan_id, cast(e.vec_id % 20 as int) as rw, n.n_nationkey as cls,
  cast(floor((cast(<element_at>(e.embedding, n.n_nationkey + 1) as double) + cast(1 as double)) * 1000) as bigint) as w
from {embeddings} e cross join {nation} n where n.n_nationkey < 24""",
    "catalog": """
select o_orderkey as file_id, o_custkey as subject,
  case o_orderkey % 6 when 0 then 'T2w' when 1 then 'T1w' when 2 then 'ct' when 3 then 'dixon' when 4 then 'msk' else 'PD' end as format,
  case o_custkey % 5 when 0 then 'sag' when 1 then 'ax' when 2 then 'cor' when 3 then 'iso' end as acq,
  case when o_orderkey % 7 = 0 then 'spine' end as seg,
  case when o_orderkey % 11 = 0 then '6' end as label,
  case when o_orderkey % 6 = 3 then case when o_orderkey % 4 = 1 then 'inphase' else 'water' end end as part
from {orders}""",
    "run_log": """
select event_id, user_id as subject, value as seconds, ts,
  case event_type when 'click' then 'OK' when 'view' then 'ALL_DONE' when 'signup' then 'COMPATIBILITY'
       when 'purchase' then 'EMPTY' else 'UNKNOWN' end as errcode
from {events}""",
    "subject_labels": """
select c.c_custkey as subject, n.n_nationkey + 1 as label
from {customer} c join {nation} n
  on n.n_nationkey + 1 between c.c_custkey % 8 + 1 and least(25, c.c_custkey % 8 + 10 + c.c_custkey % 12)""",
    "anomalies": """
select c_custkey as subject, c_custkey % 17 = 0 as t11, c_custkey % 19 = 0 and c_custkey % 17 <> 0 as t13,
  c_custkey % 101 = 0 as remove
from {customer}""",
    "seg_pair": """
select scan_id, p, i, r, sem as truth,
  case when (p + i + r) % 13 = 0 then 0 when (p + 2 * i + r) % 11 = 0 then 61 else sem end as pred
from vox""",
}
NEEDS = {"scans": ["vox"], "preds": ["vox"], "seg_pair": ["vox"]}


def _closure(names: str) -> list[str]:
    out: list[str] = []
    for name in names.split():
        out += [n for n in [*NEEDS.get(name, []), name] if n not in out]
    return out


def ctes(names: str, body: str) -> str:
    """SQL for the other engine: the views as common table expressions before ``body``.

    ``body`` starts with ``select``, or with a comma and further expressions.
    """
    parts = [f"{n} as ({re.sub(r'<element_at>', 'list_extract', re.sub(r'[{](\w+)[}]', r'\1', VIEWS[n]))})" for n in _closure(names)]
    return "with recursive " + ",\n".join(parts) + "\n" + body


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame."""
    honest_sizes(spark)
    todo = _closure(name)
    if "vox" in todo:  # at most one voxel a row; Parquet's footers know how many there are
        enough_partitions(spark, spark.read.parquet(f"{sf_dir}/lineitem.parquet").count())
    tables = lambda text: re.sub(r"[{](\w+)[}]", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", text).replace("<element_at>", "element_at")
    parts = [f"{n} as ({tables(VIEWS[n])})" for n in todo]
    return spark.sql("with " + ",\n".join(parts) + f"\nselect * from {name}")


def staged_views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``vox`` and its ``scans``, made once: queries that read them in many steps don't derive them again in each."""
    vox = staged_rows(view(spark, sf_dir, "vox"), "vox")
    return vox, small_side(staged_rows(spark.sql(VIEWS["scans"].replace("from vox", "from {vox}"), vox=vox), "scans"))
