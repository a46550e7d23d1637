"""Entry pipelines: one job for the scans of a whole cohort.

Every stage takes and returns tables keyed by ``scan_id``. Scans that fail a stage get an
``errcode`` and take no part in later ones, while the others go on.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from voxtable.functions import units as un
from voxtable.operators import grids as gr, instances as ins, neighbours as nb, overlap as ov, regions as rg, tiles as tl, voxels as vx
from voxtable.operators.voxels import AXES, KEY
from voxtable.plans.storage import small_side, staged_rows as staged

#: Labels whose small components are deleted, and those whose holes are filled. Fixed values.
SMALL_LABELS = (41, 42, 43, 44, 45, 46, 47, 48, 49, 61, 100)
HOLE_LABELS = (49, 61, 100, 60)
#: Labels that are vertebrae, sacrum (instance 26), dens (instance 2), endplate and its parts once it is split.
VERTEBRA = (40, 41, 42, 43, 44, 45, 46, 47, 48, 49, 50, 51)
SACRUM, SACRUM_INSTANCE, DENS, C2 = 26, 26, 51, 2
PLATE, PARTS = 62, {"superior": 52, "inferior": 53}
#: Voxels at the reference zoom under which a component is small, and instances are at least. Fixed values.
SMALL, LEAST = 30, 40


def preprocess(vox: DataFrame, scans: DataFrame, normalize: bool = True, margin_mm: float = 2.0, pad: int = 0) -> DataFrame:
    """Crop to what is above the minimum, then normalise the range; with ``pad`` borders are repeated along r."""
    low = vox.groupBy("scan_id").agg(F.min("intensity").alias("_lo"))
    bright = vox.join(low, "scan_id").filter(F.col("intensity") > F.col("_lo"))
    out = vx.crop_to_box(vox, bright, scans, F.ceil(margin_mm / F.least("zp", "zi", "zr")).cast("int")).select(*vox.columns)
    out = vx.normalize_range(out) if normalize else out
    return vx.pad_edge(out, scans, pad) if pad else out


def _zoom(scans: DataFrame):
    return F.array("zp", "zi", "zr")


def clean_semantic(sem: DataFrame, scans: DataFrame, margin: int = 5, canal=(60, 61), small: Sequence[int] = SMALL_LABELS, holes: Sequence[int] = HOLE_LABELS) -> DataFrame:
    """Trim to the canal, delete small components, clean by the largest component's box, fill holes.

    Components of the labels ``small`` under 30 reference voxels, by each scan's zoom, are
    deleted and never relabelled; holes are filled in the labels ``holes``.
    """
    out = nb.trim_to_canal(sem, "sem", scans, canal)
    size = un.mm3_to_voxels(F.lit(un.reference_voxels(SMALL)), _zoom(scans))
    sizes = scans.select("scan_id", F.explode(F.array(*map(F.lit, small))).alias("label"), size.alias("size"))
    out = staged(nb.clean_artifacts(staged(out, "clean"), "sem", sizes, scans, only_delete=True), "clean")
    boxed = lambda x: nb.bounding_box_clean(nb.trim_to_canal(x, "sem", scans, canal), "sem", scans, margin)
    once = staged(boxed(out), "clean")
    # The first pass can remove what spoilt the box; scans from which it took nothing stay as they are in a second one.
    size = lambda x, n: x.groupBy("scan_id").agg(F.count(F.lit(1)).alias(n))
    odd = staged(size(once, "n").join(size(out, "m"), "scan_id").filter("n <> m").select("scan_id"), "clean-again")
    if odd.isEmpty():
        out = once
    else:
        odd = small_side(odd)
        again = boxed(staged(once.join(odd, "scan_id", "left_semi"), "clean"))
        out = staged(again.unionByName(once.join(odd, "scan_id", "left_anti")), "clean")
    return nb.fill_holes(out, "sem", holes)


@dataclass(frozen=True)
class InstanceModel:
    """What is known of a model that finds three vertebrae in a window around a body's centre."""

    cutout: tuple[int, int, int] = (12, 24, 8)
    low_zoom: tuple[float, float, float] = (0.75, 0.75, 0.75)
    high_zoom: tuple[float, float, float] = (1.65, 1.65, 1.65)
    pad: int = 0
    cleaning_mm3: float = 0.0
    vertebra_mm3: float = 0.0
    mapping: Mapping[int, int] = field(default_factory=lambda: {41: 1, 42: 2, 43: 3, 44: 4, 45: 5, 46: 6, 47: 7, 48: 8, 49: 9, 50: 9, 51: 9, 26: 0})


def predict(sem: DataFrame, centers: DataFrame, make_predict: Callable, size=(12, 24, 8)) -> DataFrame:
    """Predictions of a user's scorer over windows: (scan_id, com_idx, lab, p, i, r).

    The scorer maps rows (p, i, r in the window, sem) to scores of nothing and three regions.
    """
    centers = small_side(centers)
    cut = tl.cutout(sem, centers, size)
    keys = ["scan_id", "com_idx", "p", "i", "r"]
    scored = tl.score(cut, keys, make_predict)
    lab = (F.array_position("scores", F.array_max("scores")) - 2).cast("int")
    corner = centers.select("scan_id", "com_idx", *[(F.col(a) - s // 2).alias(f"_{a}") for a, s in zip("pir", size, strict=True)])
    out = scored.withColumn("lab", lab).filter("lab >= 0").join(corner, ["scan_id", "com_idx"])
    return out.select("scan_id", "com_idx", "lab", *[(F.col(a) + F.col(f"_{a}")).cast("int").alias(a) for a in "pir"])


def merge_predictions(preds: DataFrame, scans: DataFrame, size: DataFrame | int) -> DataFrame:
    """Couple and merge competing predictions, clean small pieces, fill and number the instances.

    ``size``: the voxels a piece needs, for all scans or as a table (scan_id, size).
    """
    preds = staged(preds, "preds")
    merged = staged(ov.merge_couples(preds, staged(ov.couple_predictions(preds), "couples")), "merged")
    labels = merged.select("scan_id", F.col("inst").alias("label")).distinct()
    labels = labels.withColumn("size", F.lit(size).cast("long")) if isinstance(size, int) else labels.join(size, "scan_id")
    cleaned = staged(nb.clean_artifacts(merged, "inst", labels, scans), "merged")
    return rg.relabel_dense(nb.fill_holes(cleaned, "inst"), "inst").select(*KEY, "inst")


def build_instances(sem: DataFrame, scans: DataFrame, make_predict: Callable, model: InstanceModel = InstanceModel()) -> tuple[DataFrame, DataFrame]:
    """From semantic masks to instances on the same grid: (KEY, inst) and codes (scan_id, errcode) of scans without.

    Masks go to the model's grid (``grids``), the centres of their bodies are found, and
    the scorer sees a window of relabelled voxels around each centre, moved down to where
    there is a voxel. Its predictions are coupled and merged, and what comes of it goes back
    to the stored grid. Scans without a body label are EMPTY, those in which no centre or
    prediction was found UNKNOWN.
    """
    grid = gr.model_grid(scans, F.array(*map(F.lit, model.low_zoom)), F.array(*map(F.lit, model.high_zoom)), model.pad)
    cut, own, grid = gr.to_model_grid(sem.select(*KEY, "sem"), grid)
    empty = scans.select("scan_id").join(sem.filter("sem = 49 or sem = 50").select("scan_id").distinct(), "scan_id", "left_anti")
    empty = small_side(staged(empty, "empty"))
    cut = staged(cut.join(empty, "scan_id", "left_anti"), "model-grid")
    centres = ins.corpus_centers(cut, own, cleaning_mm3=model.cleaning_mm3)
    places = [F.floor(f"c{a}").cast("int").alias(a) for a in AXES]
    centres = staged(centres.select("scan_id", (F.col("rank") - 1).cast("long").alias("com_idx"), *places), "centres")
    relabelled = staged(vx.map_labels(vx.extract_label(cut, "sem", list(model.mapping), keep_label=True), "sem", model.mapping), "relabelled")
    moved = staged(tl.slide_to_foreground(centres, relabelled, own), "centres")
    preds = staged(predict(relabelled, moved, make_predict, model.cutout), "predictions")
    zoom = _zoom(own)
    least = F.greatest(F.floor(model.vertebra_mm3 / un.zoom_volume(zoom)), un.mm3_to_voxels(F.lit(un.reference_voxels(LEAST)), zoom))
    merged = staged(merge_predictions(preds, own, own.select("scan_id", least.alias("size"))), "instances")
    back = staged(gr.from_model_grid(merged, grid), "instances")
    lost = scans.select("scan_id").join(empty, "scan_id", "left_anti").join(back.select("scan_id").distinct(), "scan_id", "left_anti")
    codes = empty.withColumn("errcode", F.lit("EMPTY")).unionByName(lost.withColumn("errcode", F.lit("UNKNOWN")))
    return back, staged(codes, "codes")


def postprocess(sem: DataFrame, inst: DataFrame, scans: DataFrame, fill: bool = False, offset: int = 0, heads: DataFrame | None = None, **naming) -> tuple[DataFrame, DataFrame]:
    """Reconcile, repair, order and name the instances, then attach discs and endplates: (semantic, instances).

    Articular parts go to the instance that clearly holds most of them; both masks are made
    to cover each other; a split top vertebra is merged where there are discs; posterior
    parts are repaired; instances are numbered from top to bottom (after ``offset``) and,
    with ``heads`` (see ``label_instances``, which gets ``naming``), named by their decoded
    labels. The sacrum becomes instance 26 and the dens part of 2. Discs and endplates
    follow the bodies' heights; endplates are split into an upper and a lower part, which
    the semantic mask shows as well. Rows are sparse and keep their places, so cropping
    before and putting back after would change nothing.
    """
    sem = staged(sem.select(*KEY, "sem"), "post-sem")
    own = vx.apply_mask(inst, sem).select(*KEY, "inst")
    for label in (45, 46, 47, 48):
        if not sem.filter(F.col("sem") == label).isEmpty():
            own = staged(nb.reassign_dominant(sem, own, (label,)), "post")
    own, sem2 = ins.reconcile(sem, own, scans, VERTEBRA, fill)
    own, sem2 = staged(own, "post"), staged(sem2, "post-sem")
    with_discs = small_side(staged(sem2.filter("sem = 100").select("scan_id").distinct(), "with-discs"))
    merged = nb.merge_top_split(own.join(with_discs, "scan_id", "left_semi"), scans)
    own = staged(merged.select(*own.columns).unionByName(own.join(with_discs, "scan_id", "left_anti")), "post")
    own = staged(nb.fix_posterior(own.join(sem2.select(*KEY, "sem"), KEY)).select(*KEY, "inst"), "post")
    names = rg.ordered_by_height(rg.region_stats(own, "inst"), "new_label", offset).select("scan_id", F.col("label").alias("inst"), "new_label")
    own = staged(own.join(names, ["scan_id", "inst"]).select(*KEY, F.col("new_label").cast("int").alias("inst")), "post")
    if heads is not None:
        own = staged(ins.label_instances(own, heads, sem=sem2, scans=scans, **naming).select(*KEY, F.col("inst").cast("int")), "post")
    forced = sem2.filter(F.col("sem").isin(SACRUM, DENS)).select(*KEY, F.when(F.col("sem") == SACRUM, SACRUM_INSTANCE).otherwise(C2).alias("inst"))
    own = staged(own.join(forced.select(*KEY), KEY, "left_anti").unionByName(forced), "post")
    full = staged(ins.attach_ivd_endplates(sem2, own, plate=PLATE, corpus=49), "post-full")
    verts, plates = full.filter("inst < 40"), full.filter("inst between 201 and 233")
    split = staged(nb.split_endplates(verts, plates, scans), "post-plates")
    part = split.select(*KEY, F.when(F.col("part") == "superior", PARTS["superior"]).otherwise(PARTS["inferior"]).alias("_part"))
    sem3 = sem2.join(part, KEY, "left").select(*KEY, F.when(F.col("sem") == PLATE, F.coalesce("_part", "sem")).otherwise(F.col("sem")).alias("sem"))
    return staged(sem3, "post-sem"), full


def apply_hook(sem: DataFrame, hook: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A user's function on the semantic masks: it may change labels, add and drop voxels, but keeps the columns.

    Other columns that it returns are left out; a missing one is an error. Voxels that it
    labels 0 or null are background and leave.
    """
    out = sem.transform(hook)
    missing = [c for c in (*KEY, "sem") if c not in out.columns]
    if missing:
        raise ValueError(f"the hook has to return the columns {missing}")
    return out.select(*KEY, F.col("sem").cast("int").alias("sem")).filter("sem <> 0")


class Routes:
    """Which scans are still on their way, and the code of each one that has failed."""

    def __init__(self, scans: DataFrame):
        self.alive = staged(scans.select("scan_id").distinct(), "alive")
        self.failed: list[DataFrame] = []

    def keep(self, good: DataFrame, code: str) -> None:
        """Scans that are not in ``good`` (scan_id) leave with the code."""
        bad = staged(self.alive.join(good.select("scan_id").distinct(), "scan_id", "left_anti").select("scan_id", F.lit(code).alias("errcode")), "failed")
        self.leave(bad)

    def leave(self, bad: DataFrame) -> None:
        """``bad`` (scan_id, errcode) leave."""
        self.failed.append(bad.join(self.alive, "scan_id", "left_semi"))
        self.alive = staged(self.alive.join(bad.select("scan_id"), "scan_id", "left_anti"), "alive")

    def of(self, df: DataFrame) -> DataFrame:
        return df.join(self.alive, "scan_id", "left_semi")

    def log(self) -> DataFrame:
        out = self.alive.withColumn("errcode", F.lit("OK"))
        for bad in self.failed:
            out = out.unionByName(bad.select("scan_id", "errcode"))
        return staged(out, "run-log")


def process_scans(
    vox: DataFrame,
    scans: DataFrame,
    make_predict: Callable,
    model: InstanceModel = InstanceModel(),
    hook: Callable[[DataFrame], DataFrame] | None = None,
    compatible: DataFrame | None = None,
    sinks: str | None = None,
    tap: Callable[[str], Callable[[DataFrame], DataFrame]] | None = None,
    **post,
) -> dict[str, DataFrame]:
    """Crop, clean, build instances, reconcile, name and measure, for all scans; and the run log.

    ``vox`` (KEY, intensity, sem). Codes: COMPATIBILITY for scans that ``compatible``
    (scan_id, compatible) excludes or doesn't know, SHAPE where the declared shape isn't
    positive or voxels lie outside of it, EMPTY where nothing is left after cropping or
    cleaning or there is no body, UNKNOWN where no instance is found, else OK. ``sinks``: a
    folder for masks and centroids; ``coverage`` warns of scans whose vertebra voxels have
    no instance (``coverage_gap``); ``tap`` keeps named intermediates (``DebugTap``);
    ``post`` goes to ``postprocess``.
    """
    from voxtable.sources import catalog as ct

    keep = tap or (lambda name: lambda df: df)
    routes = Routes(scans)
    if compatible is not None:
        routes.keep(compatible.filter("compatible"), "COMPATIBILITY")
    inside = F.lit(True)
    for a in AXES:
        inside = inside & F.col(a).between(0, F.col(f"n{a}") - 1)
    shaped = scans.filter(" and ".join(f"n{a} > 0" for a in AXES))
    outside = vox.join(scans.select("scan_id", *[f"n{a}" for a in AXES]), "scan_id").filter(~inside).select("scan_id").distinct()
    routes.keep(shaped.select("scan_id").join(outside, "scan_id", "left_anti"), "SHAPE")
    vox = staged(routes.of(vox), "routed")  # read by every step of the cropping
    cropped = staged(preprocess(vox, scans).select(*KEY, "sem"), "cropped").filter("sem > 0")
    routes.keep(cropped, "EMPTY")
    sem = staged(clean_semantic(routes.of(cropped), scans), "sem")
    sem = keep("sem_raw")(staged(apply_hook(sem, hook), "sem") if hook else sem)
    routes.keep(sem, "EMPTY")
    sem = staged(routes.of(sem), "sem")
    inst, codes = build_instances(sem, routes.of(scans), make_predict, model)
    routes.leave(codes)
    inst = keep("inst_raw")(staged(routes.of(inst), "inst"))
    one_body = routes.of(sem).withColumn("sem", F.when(F.col("sem") == 50, 49).otherwise(F.col("sem")))
    sem, full = postprocess(one_body, inst, scans, **post)
    own = sem.filter(F.col("sem").isin(*VERTEBRA))
    n_vert = inst.groupBy("scan_id").agg(F.count_distinct("inst").alias("n"))
    gap = staged(rg.coverage_gap(own, vx.apply_mask(full.filter("inst < 40"), own), n_vert), "coverage")
    points = staged(rg.centroids(full.join(sem.select(*KEY, "sem"), KEY)), "centroids")
    if sinks:
        ct.write_masks(sem, f"{sinks}/semantic")
        ct.write_masks(full, f"{sinks}/instances")
        points.write.mode("overwrite").json(f"{sinks}/centroids")
    return {"semantic": sem, "instances": full, "centroids": points, "coverage": gap, "run_log": routes.log()}


def process_dataset(
    catalog: DataFrame,
    manifest: DataFrame,
    vox: DataFrame,
    scans: DataFrame,
    make_predict: Callable,
    formats: Sequence[str],
    acqs: Sequence[str],
    models: DataFrame | None = None,
    pairs: DataFrame | None = None,
    ignore: Sequence[str] = (),
    families: Sequence[str] | None = None,
    **more,
) -> dict[str, DataFrame]:
    """Select files, skip finished ones, process the others in one plan and log all.

    ``catalog`` (file_id = scan_id, entities). With ``families`` one file of each family is
    taken. ``models`` (model_id, formats, acquisition, modality): a scan needs to fit every
    one of them, and ``pairs`` (semantic, instance) of models have to fit each other, or all
    scans that aren't finished leave with COMPATIBILITY; ``ignore`` names reasons that don't
    count, and "pair". Each scan of the plan has its stages in ``plan``. ``more`` goes to
    ``process_scans``.
    """
    from voxtable.sources import catalog as ct

    chosen = ct.select_scans(catalog, formats, acqs)
    if families is not None:
        chosen = chosen.join(ct.family_pick(chosen, families).select("file_id"), "file_id", "left_semi")
    chosen = staged(chosen, "chosen")
    state = ct.resume_filter(scans.join(chosen.select(F.col("file_id").alias("scan_id")).distinct(), "scan_id", "left_semi"), manifest)
    state = staged(state, "resume")
    todo = staged(state.filter("not done").drop("done"), "todo")
    compatible = None
    if models is not None:
        fits = ct.scan_model_compat(chosen, models, ignore).groupBy(F.col("file_id").alias("scan_id")).agg(F.bool_and("compatible").alias("compatible"))
        if pairs is not None and "pair" not in ignore:
            broken = not ct.model_pair_compat(models, pairs).filter("not compatible").isEmpty()
            fits = fits.withColumn("compatible", F.col("compatible") & F.lit(not broken))
        compatible = staged(fits, "compatible")
    out = process_scans(todo.select("scan_id").join(vox, "scan_id").select(*vox.columns), todo, make_predict, compatible=compatible, **more)
    done = state.filter("done").select("scan_id", F.lit("ALL_DONE").alias("errcode"))
    out["run_log"] = out["run_log"].unionByName(done)
    out["summary"] = ct.run_summary(out["run_log"])
    out["plan"] = ct.stage_plan(todo.select("scan_id"), manifest.select("scan_id", F.col("name").alias("stage")))
    return out


def label_cutouts(patches: DataFrame, keys: list[str], make_predict: Callable, boost: float = 3.0, cervical_skip: bool = True) -> DataFrame:
    """Score prepared patches (scan_id, rw, ...), fuse the scores and decode each scan's labels.

    The scorer gives 3 scores for regions, 24 for vertebrae, 12 for groups and visibility,
    and 6 for the relative head if there are 46 in all. With these and ``cervical_skip`` a
    class of the cervical region may be skipped.
    """
    from voxtable.operators import labelling as la

    heads = staged(tl.score(patches, keys, make_predict), "patch-scores")
    s = F.col("scores")
    split = heads.select(*keys, F.slice(s, 1, 3).alias("region"), F.slice(s, 4, 24).alias("vert"), F.slice(s, 28, 12).alias("grp"), s[39].alias("visible"), F.when(F.size(s) > 40, F.slice(s, 41, 6)).alias("vertrel"))
    fused = la.head_fusion(split, boost)
    cost = fused.select("scan_id", "rw", F.posexplode(F.transform("cost", lambda x: -x)).alias("cls", "w"))
    first = split.select(F.size("vertrel").alias("n")).head()
    rel = la.relative_costs(split) if first and first[0] == 6 else None
    return la.fix_transitional(la.exploded(la.decode_sequence(cost, rel=rel, skip_regions=(0,) if cervical_skip and rel is not None else ())))
