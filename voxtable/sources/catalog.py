"""Catalogs of files, models and runs."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: What each modality and acquisition is called in file names. Fixed values.
MODALITY_KEYS = {
    "CT": ["CT", "ct"],
    "SEG": ["msk", "seg"],
    "T1w": ["T1w", "t1", "T1", "T1c"],
    "T2w": ["T2w", "dixon", "mr", "t2", "T2", "T2c"],
    "Vibe": ["t1dixon", "vibe", "mevibe", "GRE"],
    "MPR": ["mpr", "MPR", "Mpr"],
}
ACQUISITION_KEYS = {"ax": ["axial", "ax", "axl"], "cor": ["coronal", "cor"], "sag": ["sagittal", "sag"], "iso": ["iso", "ISO"]}
UNSUPPORTED = ("PD", "FLAIR")
#: Outputs of a scan: name, whether in the folder of raw outputs, segmentation, format and extension. Fixed values.
OUTPUTS = [
    ("out_spine", False, "spine", "msk", "nii.gz"),
    ("out_spine_raw", True, "spine-raw", "msk", "nii.gz"),
    ("out_vert", False, "vert", "msk", "nii.gz"),
    ("out_vert_raw", True, "vert-raw", "msk", "nii.gz"),
    ("out_unc", True, "spine", "uncertainty", "nii.gz"),
    ("out_logits", True, "spine", "logit", "npz"),
    ("out_snap", False, "spine", "snp", "png"),
    ("out_ctd", False, "spine", "ctd", "json"),
    ("out_vibeseg", False, "VIBESeg-100", "msk", "nii.gz"),
]
STAGES = ("semantic", "instance", "cleanup", "centroid", "snapshot")


def scan_catalog(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Paths below a root, sorted; only names and sizes are read, not the files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length").orderBy("path")


def parse_entities(path: Column) -> tuple[Column, Column, Column]:
    """Entity map, format and file type of a path: names split at ``_``, pairs at ``-``, the last token is the format."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    stem, kind = F.regexp_extract(name, r"^([^.]*)", 1), F.regexp_extract(name, r"^[^.]*\.(.*)$", 1)
    tokens = F.split(stem, "_")
    pairs = F.transform(F.filter(tokens, lambda t: t.contains("-")), lambda t: F.struct(F.substring_index(t, "-", 1).alias("k"), F.regexp_extract(t, r"^[^-]*-(.*)$", 1).alias("v")))
    first = F.filter(pairs, lambda x, i: ~F.exists(F.slice(F.transform(pairs, lambda p: p["k"]), 1, i), lambda k: k == x["k"]))
    return F.map_from_entries(first), F.element_at(tokens, -1), kind


def _entity(catalog: DataFrame, name: str) -> Column:
    """An entity's column; a table without it has files without it."""
    return F.col(name) if name in catalog.columns else F.lit(None).cast("string")


def select_scans(catalog: DataFrame, formats: Sequence[str], acqs: Sequence[str], ignore_filter: bool = False) -> DataFrame:
    """Files to process: images that are no segmentation, of an allowed format, of an allowed acquisition or none.

    Dixon files count only if in phase; files with a lesions or label entity do not, nor
    does the subject "unsorted". With ``ignore_filter`` only file type and segmentation
    are tested. ``filetype`` is tested where the table has it.
    """
    image = F.col("filetype") == "nii.gz" if "filetype" in catalog.columns else F.lit(True)
    out = catalog.filter(image & F.col("seg").isNull())
    if ignore_filter:
        return out
    phase = (F.col("format") != "dixon") | F.coalesce(F.col("part") == "inphase", F.lit(False))
    out = out.filter((F.col("subject").cast("string") != "unsorted") & F.col("format").isin(*formats) & phase)
    out = out.filter(F.col("label").isNull() & _entity(catalog, "lesions").isNull())
    return out.filter(F.col("acq").isNull() | F.col("acq").isin(*acqs))


def family_pick(catalog: DataFrame, family: Sequence[str] = ("subject",), chunk: str = "LWS") -> DataFrame:
    """One T2w file of the chunk for each family: an in-phase one first, else one without a part; others have none."""
    rank = F.when(F.col("part") == "inphase", 1).when(F.col("part").isNull(), 2)
    image = F.col("filetype") == "nii.gz" if "filetype" in catalog.columns else F.lit(True)
    ranked = catalog.filter(image & (F.col("format") == "T2w") & (F.col("chunk") == chunk)).withColumn("_r", rank).filter("_r is not null")
    return ranked.groupBy(*family).agg(F.min_by("file_id", F.struct("_r", "file_id")).alias("file_id"), F.min("_r").alias("choice"))


def find_paths(spark: SparkSession, root: str, glob: str, suppress: bool = False) -> DataFrame:
    """Sorted matches of a pattern below a root; a warning if there is none, unless ``suppress``."""
    out = scan_catalog(spark, root, glob).select("path")
    if not suppress and out.isEmpty():
        warnings.warn(f"no path matches {glob} below {root}", UserWarning, stacklevel=2)
    return out


def find_model(spark: SparkSession, root: str, folder: str) -> str:
    """The folder of that name below a root: right below it, else its only match at any depth, else the path below the root.

    Folders are known by the files that they hold.
    """
    root = root.rstrip("/")
    inside = scan_catalog(spark, root).select(F.regexp_extract("path", rf"^(.*/\Q{folder}\E)/", 1).alias("folder")).filter("folder <> ''").distinct()
    found = [r.folder for r in inside.orderBy("folder").limit(1000).collect()]
    direct = [f for f in found if f.endswith(f"{root.split('://')[-1].removeprefix('file:')}/{folder}")]
    return direct[0] if direct else found[0] if len(found) == 1 else f"{root}/{folder}"


def derive_outputs(catalog: DataFrame, path: str = "path", folder: str = "derivatives", snapshot_folder: str | None = None) -> DataFrame:
    """The twelve output paths of each scan, long form: path, name, output.

    The scan's own format becomes its ``mod`` entity; raw outputs stand in
    ``output_raw_<format>``, ``out_debug`` and ``out_raw`` are folders. ``out_snap2`` is the
    snapshot in ``snapshot_folder``, or the snapshot itself.
    """
    stem = F.regexp_extract(F.col(path), r"([^/.]+)[^/]*$", 1)
    # The parts are columns before the rows are made, so that expressions over them aren't evaluated again for each row.
    parts = catalog.select(
        F.col(path).alias("path"),
        F.regexp_extract(stem, r"([^_]*)$", 1).alias("_kind"),
        F.regexp_replace(F.regexp_replace(stem, r"_[^_]*$", ""), r"_(seg|mod)-[^_]*", "").alias("_name"),
        F.concat(F.regexp_replace(F.col(path), r"[^/]+$", ""), F.lit(folder)).alias("_base"),
    )
    kind, name, base = F.col("_kind"), F.col("_name"), F.col("_base")
    raw = F.concat(base, F.lit("/output_raw_"), kind)
    file = lambda seg, fmt, ext: F.concat(name, F.lit("_mod-"), kind, F.lit(f"_seg-{seg}_{fmt}.{ext}"))
    rows = [(n, F.concat_ws("/", raw if deep else base, file(seg, fmt, ext))) for n, deep, seg, fmt, ext in OUTPUTS]
    rows += [("out_snap2", F.concat_ws("/", F.lit(snapshot_folder) if snapshot_folder else base, file("spine", "snp", "png")))]
    rows += [("out_debug", F.concat(base, F.lit("/debug_"), kind)), ("out_raw", raw)]
    out = parts.select("path", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.alias("output")) for n, c in rows])).alias("o"))
    return out.select("path", "o.name", "o.output")


def disc_output_name(path: Column, suffix: str) -> Column:
    """Insert a suffix before the compound extension, wherever that extension occurs."""
    ext = F.regexp_extract(path, r"(\.nii\.gz|\.[^./]+)$", 1)
    return F.when(ext == "", F.concat(path, F.lit(suffix))).otherwise(F.replace(path, ext, F.concat(F.lit(suffix), ext)))


def resume_filter(scans: DataFrame, manifest: DataFrame, override: DataFrame | None = None, snapshot_folder: bool = False) -> DataFrame:
    """Scans (scan_id) with ``done``: all outputs of ``manifest`` (scan_id, name) exist and no override asks for more."""
    need = ["out_spine", "out_vert", "out_snap", "out_ctd"] + ["out_snap2"] * snapshot_folder
    have = manifest.filter(F.col("name").isin(*need)).groupBy("scan_id").agg(F.count_distinct("name").alias("_n"))
    out = scans.join(have, "scan_id", "left").withColumn("done", F.coalesce("_n", F.lit(0)) == len(need)).drop("_n")
    if override is not None:
        forced = override.select("scan_id", F.lit(True).alias("_o")).distinct()
        out = out.join(forced, "scan_id", "left").withColumn("done", F.col("done") & F.col("_o").isNull()).drop("_o")
    return out


def stage_plan(scans: DataFrame, manifest: DataFrame, override: Sequence[str] = (), cascade: bool = False) -> DataFrame:
    """Which stages run: a missing or overridden output, or an earlier stage that runs.

    ``manifest`` (scan_id, stage). With ``cascade`` a new semantic mask also redoes the
    instances; without, only later stages follow.
    """
    have = manifest.groupBy("scan_id").pivot("stage", list(STAGES)).agg(F.lit(True))
    out, earlier = scans.join(have, "scan_id", "left"), F.lit(False)
    runs = []
    for stage in STAGES:
        own = F.col(stage).isNull() | F.lit(stage in override)
        run = own if stage == "semantic" or (stage == "instance" and not cascade) else own | earlier
        runs.append(run.alias(f"run_{stage}"))
        earlier = earlier | run
    return out.select("scan_id", *runs)


def run_summary(run_log: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Seen, OK, ALL_DONE and failed runs with the number of failures by code."""
    ok, done = F.count_if(F.col("errcode") == "OK"), F.count_if(F.col("errcode") == "ALL_DONE")
    bad = ~F.col("errcode").isin("OK", "ALL_DONE")
    return run_log.groupBy(*keys).agg(F.count(F.lit(1)).alias("seen"), ok.alias("ok"), done.alias("all_done"), F.count_if(bad).alias("failed"), F.array_sort(F.collect_set(F.when(bad, F.col("errcode")))).alias("codes"))


def subjects_without_runs(subjects: DataFrame, run_log: DataFrame) -> DataFrame:
    return subjects.select("subject").distinct().join(run_log.select("subject"), "subject", "left_anti")


def timing_summary(run_log: DataFrame, keys: Sequence[str] = ("errcode",)) -> DataFrame:
    return run_log.groupBy(*keys).agg(F.min("seconds").alias("min_s"), F.max("seconds").alias("max_s"), F.avg("seconds").alias("avg_s"))


def provenance(points: DataFrame, models: dict[str, str], params: dict[str, object], version: str, time: str) -> DataFrame:
    """Add a map of strings that says which models and parameters made the points."""
    facts = {"version": version, "time": time} | {f"model_{k}": v for k, v in models.items()} | {k: str(v) for k, v in params.items()}
    return points.withColumn("info", F.map_from_arrays(F.array(*map(F.lit, facts)), F.array(*map(F.lit, facts.values()))))


def modality_keys(names: DataFrame, name_col: str = "modality") -> DataFrame:
    """Synonyms of each modality; unsupported ones are an error."""
    table = F.create_map(*[x for k, v in MODALITY_KEYS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    keys = F.when(F.col(name_col).isin(*UNSUPPORTED), F.raise_error(F.concat(F.lit("unsupported modality "), F.col(name_col))).cast("array<string>")).otherwise(F.element_at(table, F.col(name_col)))
    return names.withColumn("keys", keys)


def acq_keys(acq: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in ACQUISITION_KEYS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), acq)


#: Inference configurations; labels and unknown fields as in the files.
MODEL_SCHEMA = "log_name string, modality array<string>, acquisition string, model_expected_orientation array<string>, resolution_range array<array<double>>, modeltype string, labels map<string,string>, cutout_size array<int>, available_folds int, inference_augmentation boolean, default_step_size double, expected_labels array<string>"


def read_model_configs(spark: SparkSession, root: str) -> DataFrame:
    """Every ``inference_config.json`` below a root; files that don't parse are left out.

    ``model_id`` is the folder in lower case, its parent if the folder names plans; ``model_class``
    is labeling for classifiers, instance for models of segmentations, else semantic.
    """
    raw = spark.read.schema(MODEL_SCHEMA + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).option("pathGlobFilter", "inference_config.json").json(root)
    path = F.col("_metadata.file_path")
    folder, parent = F.element_at(F.split(path, "/"), -2), F.element_at(F.split(path, "/"), -3)
    kind = F.when(F.col("modeltype") == "classifier", "labeling").when(F.array_contains("modality", "SEG"), "instance").otherwise("semantic")
    found = raw.withColumn("model_id", F.lower(F.when(folder.contains("nnUNetPlans"), parent).otherwise(folder)))
    return found.withColumn("model_class", kind).filter(F.col("_corrupt_record").isNull() & F.col("log_name").isNotNull()).drop("_corrupt_record")


def resolve_labels(labels: Column, *vocabularies: dict[str, int]) -> Column:
    """Values of a name map as ids: by the vocabularies in turn, else as an integer, else an error."""
    def one(k: Column, v: Column) -> Column:
        tries = [F.element_at(F.create_map(*[F.lit(x) for kv in voc.items() for x in kv]), v) for voc in vocabularies]
        return F.coalesce(*tries, v.try_cast("int"), F.raise_error(F.concat(F.lit("unknown label "), v)).cast("int"))

    return F.transform_values(labels, one)


def model_pair_compat(models: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (semantic, instance) of models with whether the second covers the first's modalities and plane."""
    side = lambda p: models.select(F.col("model_id").alias(p), F.col("modality").alias(f"_m_{p}"), F.col("acquisition").alias(f"_a_{p}"))
    out = pairs.join(side("semantic"), "semantic").join(side("instance"), "instance")
    ok = (F.size(F.array_except("_m_semantic", "_m_instance")) == 0) & (F.col("_a_semantic") == F.col("_a_instance"))
    return out.select("semantic", "instance", ok.alias("compatible"))


def scan_model_compat(scans: DataFrame, models: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Every scan with every model: whether it may be used and the reasons against it.

    ``models`` (model_id, formats array, acquisition). A scan fits the model's acquisition by
    any of its names, if it is isotropic or says nothing; the plane that its array shows
    (``plane``, where the table has it) must agree as well, and debug files (by name or
    folder of ``path``) never fit. Ignored reasons are kept with a mark and don't count.
    The result is the product of both tables; Spark broadcasts the models if they are few.
    """
    met = scans.crossJoin(models.select("model_id", "formats", F.concat(acq_keys(F.col("acquisition")), F.array(F.lit("iso"))).alias("_acqs")))
    plane, path = _entity(scans, "plane"), _entity(scans, "path")
    tests = {
        "format": ~F.array_contains("formats", F.col("format")),
        "seg": F.col("seg").isNotNull(),
        "acq": F.col("acq").isNotNull() & ~F.array_contains("_acqs", F.col("acq")),
        "label": F.col("label").isNotNull(),
        "debug": path.rlike(r"debug[^/]*(/[^/]*)?$"),
        "plane": plane.isNotNull() & ~F.array_contains("_acqs", plane),
    }
    reasons = F.array_compact(F.array(*[F.when(t, F.lit(f"{k} (ignored)" if k in ignore and k not in ("debug", "plane") else k)) for k, t in tests.items()]))
    out = met.withColumn("reasons", reasons)
    return out.withColumn("compatible", ~F.exists("reasons", lambda r: ~r.endswith("(ignored)"))).select("file_id", "model_id", "compatible", "reasons")


def write_masks(vox: DataFrame, path: str) -> None:
    """Masks as Parquet, a folder per scan, heights together so that box filters prune."""
    vox.repartition("scan_id").sortWithinPartitions("scan_id", "i").write.mode("overwrite").partitionBy("scan_id").parquet(path)


POI_SCHEMA = "scan_id int, vert int, subreg int, x double, y double, z double, info map<string,string>"


def write_poi(points: DataFrame, path: str) -> None:
    points.write.mode("overwrite").json(path)


def read_poi(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POI_SCHEMA).json(path)


def write_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").option("compression", "zstd").parquet(path)


class DebugTap:
    """Keeps named intermediates and writes them on request."""

    def __init__(self, path: str | None = None):
        self.path, self.frames = path, {}

    def __call__(self, name: str):
        def keep(df: DataFrame) -> DataFrame:
            self.frames[name] = df
            if self.path:
                df.write.mode("overwrite").parquet(f"{self.path}/{name}")
            return df

        return keep
