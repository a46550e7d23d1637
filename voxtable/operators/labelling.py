"""Scores of classifier heads, their smoothing and fusion, and decoding of label sequences.

A scan's instances are few (a spine has some thirty vertebrae), so per-scan arrays are
bounded; all scans are decoded in one job with one shuffle by scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import exp

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voxtable.functions.labels import CLASSES, L5, REGION_STARTS, T11, T12, group_expand, region_broadcast, region_of

TINY = 1e-8
#: Score of a class that a row is forced to have; rows to each side that the relative head is smoothed over.
FORCED, REL_RADIUS = 1e6, 1


def kernel(sigma: float, radius: int) -> list[float]:
    w = [exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often it stands in the result."""
    return F.transform(F.array(value), use)[0]


def gauss_array(values: Column, sigma: float, radius: int, blocks: Sequence[tuple[int, int]]) -> Column:
    """Smooth an array within each block [start, end); beyond a block its end values go on."""
    weights = kernel(sigma, radius)

    def block(v: Column, start: int, end: int) -> Column:
        at = F.sequence(F.lit(start), F.lit(end - 1))
        term = lambda j, k: v[F.greatest(F.lit(start), F.least(F.lit(end - 1), j + (k - radius)))] * F.lit(weights[k])
        return F.transform(at, lambda j: sum((term(j, k) for k in range(1, len(weights))), term(j, 0)))

    return bound(values, lambda v: F.concat(*[block(v, a, b) for a, b in blocks]))


def normalised(values: Column) -> Column:
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x) + TINY
    summed = bound(values, lambda v: F.struct(v.alias("v"), total(v).alias("t")))
    return bound(summed, lambda s: F.transform(s["v"], lambda x: x / s["t"]))


def region_blocks(regionwise: bool = True) -> list[tuple[int, int]]:
    return list(zip(REGION_STARTS, [*REGION_STARTS[1:], CLASSES], strict=True)) if regionwise else [(0, CLASSES)]


def prepare_vert(scores: Column, sigma: float = 0.85, radius: int = 2, regionwise: bool = True) -> Column:
    return normalised(gauss_array(scores, sigma, radius, region_blocks(regionwise)))


def prepare_group(scores: Column, sigma: float = 0.85, radius: int = 2, regionwise: bool = True) -> Column:
    return prepare_vert(group_expand(scores), sigma, radius, regionwise)


def prepare_region(scores: Column, sigma: float = 0.75, radius: int = 1) -> Column:
    return normalised(gauss_array(region_broadcast(scores), sigma, radius, [(0, CLASSES)]))


def gauss_rows(df: DataFrame, col: str, out: str, sigma: float, radius: int, keys: Sequence[str], order: Sequence[str], edge: str = "nearest") -> DataFrame:
    """Smooth a column along the rows of each group; beyond the ends 0 (``constant``) or the end values."""
    w = W.partitionBy(*keys).orderBy(*order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    weights, total = kernel(sigma, radius), None
    for k, weight in zip(range(-radius, radius + 1), weights, strict=True):
        v = F.lag(col, -k).over(w) if k < 0 else F.lead(col, k).over(w)
        beyond = F.lit(0.0) if edge == "constant" else (F.first(col).over(whole) if k < 0 else F.last(col).over(whole))
        term = (F.col(col) if k == 0 else F.coalesce(v, beyond)) * weight
        total = term if total is None else total + term
    return df.withColumn(out, total)


def visible_weight(df: DataFrame, col: str, out: str, strength: float = 1.0, sigma: float = 0.8, radius: int = 2) -> DataFrame:
    """Weight of an instance by how visible it is; a missing head counts as 1 but is smoothed all the same."""
    filled = df.withColumn("_v", F.coalesce(F.col(col), F.lit(1.0)))
    smooth = gauss_rows(filled, "_v", "_s", sigma, radius, ["scan_id"], ["rw"], edge="constant")
    weight = 1 - (1 - F.bround("_s", 3)) * strength
    return smooth.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight))).drop("_v", "_s")


def normalize_columns_rel(df: DataFrame, value: str = "w") -> DataFrame:
    """Relative scores (scan_id, rw, col, value): columns but 0 divided by their sum, or by 1 + sum below 1."""
    total = F.sum(value).over(W.partitionBy("scan_id", "col")) + TINY
    scaled = F.when(total > 1, F.col(value) / total).when(total < 1, F.col(value) / (1 + total)).otherwise(F.col(value))
    return df.withColumn(value, F.when(F.col("col") == 0, F.col(value)).otherwise(scaled))


def normalize_columns_t13(df: DataFrame, value: str = "w") -> DataFrame:
    total = F.sum(value).over(W.partitionBy("scan_id", "col")) + TINY
    return df.withColumn(value, F.when(F.col("col") == 0, F.col(value)).otherwise(F.col(value) / total))


def softmax_rows(df: DataFrame, temperature: float, value: str = "w") -> DataFrame:
    """Softmax down the rows of each class."""
    e = F.exp(F.col(value) / temperature)
    return df.withColumn(value, e / F.sum(e).over(W.partitionBy("scan_id", "cls")))


def head_fusion(heads: DataFrame, boost: float = 3.0, weights: Sequence[float] = (1.1, 0.9, 0.8), forced: DataFrame | None = None) -> DataFrame:
    """Cost vectors from heads (scan_id, rw, region, vert, grp, visible), arrays but ``visible``.

    A weighted sum of the prepared heads is normalised; a vector whose best class is the
    second vertebra is boosted, and visibility scales the whole. Rows of ``forced``
    (scan_id, rw, cls) have FORCED for their class and 0 for the others.
    """
    every = F.sequence(F.lit(0), F.lit(CLASSES - 1))
    parts = F.struct(prepare_region(F.col("region")).alias("r"), prepare_vert(F.col("vert")).alias("v"), prepare_group(F.col("grp")).alias("g"))
    mixed = bound(parts, lambda s: F.transform(every, lambda c: s["r"][c] * weights[0] + s["v"][c] * weights[1] + s["g"][c] * weights[2]))
    best = bound(normalised(mixed), lambda m: F.struct(m.alias("m"), (F.array_position(m, F.array_max(m)) == 2).alias("second")))
    sized = visible_weight(heads, "visible", "_w")
    cost = bound(best, lambda s: F.transform(s["m"], lambda x: x * F.when(s["second"], boost).otherwise(1.0) * F.col("_w")))
    out = sized.withColumn("cost", cost).select("scan_id", "rw", "cost")
    if forced is None:
        return out
    own = F.transform(every, lambda c: F.when(c == F.col("_c"), FORCED).otherwise(0.0))
    out = out.join(forced.select("scan_id", "rw", F.col("cls").alias("_c")), ["scan_id", "rw"], "left")
    return out.select("scan_id", "rw", F.when(F.col("_c").isNull(), F.col("cost")).otherwise(own).alias("cost"))


def relative_costs(heads: DataFrame, col: str = "vertrel", weight: float = 0.6, sigma: float = 0.6, radius: int = REL_RADIUS) -> DataFrame:
    """Costs (scan_id, rw, col, w) of the decoder from the relative head (scan_id, rw, array): smoothed down the rows, columns normalised."""
    rows = heads.select("scan_id", "rw", F.posexplode(col).alias("col", "v"))
    smooth = gauss_rows(rows, "v", "s", sigma, radius, ["scan_id", "col"], ["rw"])
    rows = smooth.select("scan_id", "rw", "col", F.when(F.col("col") == 0, F.col("v")).otherwise(F.col("s")).alias("w"))
    return normalize_columns_rel(rows).withColumn("w", F.col("w") * -weight)


def t13_costs(heads: DataFrame, col: str = "vt13", weight: float = 0.4) -> DataFrame:
    """Costs (scan_id, rw, w) of a second T12 from the T13 head (scan_id, rw, array of two)."""
    rows = heads.select("scan_id", "rw", F.posexplode(col).alias("col", "w"))
    return normalize_columns_t13(rows).filter("col = 1").select("scan_id", "rw", (F.col("w") * -weight).alias("w"))


def decode_sequence(
    cost: DataFrame,
    classes: int = CLASSES,
    rel: DataFrame | None = None,
    regions: Sequence[int] = REGION_STARTS,
    t13: DataFrame | None = None,
    repeat: Sequence[int] = (T12, L5),
    skip: Sequence[int] = (T11,),
    skip_regions: Sequence[int] = (),
    repeat_cost: float = 0.0,
    skip_cost: float = 0.0,
    skip_region_cost: float = 0.0,
    start: int = 0,
) -> DataFrame:
    """Cheapest legal class sequence per scan: ``scan_id, cost, path``.

    ``cost`` (scan_id, rw, cls, w), dense; ``rel`` (scan_id, rw, col, w) with two columns a
    region: 2k if the row is the first class of region k, 2k + 1 if the next row is in a
    later region; ``t13`` (scan_id, rw, w) is paid by the second of two T12. From row to
    row the class rises by one; classes of ``repeat`` may stay once, classes of ``skip``
    and those in ``skip_regions`` may rise by two. Of equal costs the option named first
    wins, then the lowest first class. Rows are folded from the last to the first; the
    state is, by class and by whether it was entered as the first of two, cost and path,
    so that "at most twice" is exact.
    """
    if skip_regions and rel is None:
        raise ValueError("skipping by region needs relative costs")
    row = F.array_sort(F.collect_list(F.struct("cls", F.col("w").cast("double").alias("w"))))
    rows = cost.groupBy("scan_id", "rw").agg(F.transform(row, lambda x: x["w"]).alias("c"))
    width = 2 * len(regions)
    zeros = F.array_repeat(F.lit(0.0), width)
    if rel is not None:
        wide = rel.groupBy("scan_id", "rw").agg(F.map_from_entries(F.collect_list(F.struct("col", F.col("w").cast("double")))).alias("_m"))
        rows = rows.join(wide, ["scan_id", "rw"], "left").withColumn("x", F.when(F.col("_m").isNull(), zeros).otherwise(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.coalesce(F.element_at("_m", j), F.lit(0.0))))).drop("_m")
    else:
        rows = rows.withColumn("x", zeros)
    if t13 is not None:
        rows = rows.join(t13.select("scan_id", "rw", F.col("w").cast("double").alias("t")), ["scan_id", "rw"], "left")
    else:
        rows = rows.withColumn("t", F.lit(0.0))
    scans = rows.groupBy("scan_id").agg(F.sort_array(F.collect_list(F.struct("rw", "c", "x", F.coalesce("t", F.lit(0.0)).alias("t"))), asc=False).alias("rows"))
    ends = [*regions[1:], classes]
    lit_array = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<int>")
    every = F.sequence(F.lit(0), F.lit(classes - 1))
    nothing = F.struct(F.lit(float("inf")).alias("cost"), F.lit(0).alias("pick"), F.array().cast("array<int>").alias("path"))
    starts_region = lambda c: F.array_contains(lit_array(list(regions[1:])), c)

    def paid(r: Column, c: Column) -> Column:
        k = region_of(c, regions)
        return r["c"][c] + F.when(starts_region(c), r["x"][2 * k]).otherwise(0.0)

    def at(state: Column, c: Column) -> Column:
        return F.when((c >= 0) & (c < classes), state[c]).otherwise(nothing)

    def option(state: Column, r: Column, c: Column, to: Column, extra: Column, pick: int) -> Column:
        s = at(state, to)
        later = region_of(to, regions) > region_of(c, regions)
        last = F.when(later, r["x"][2 * region_of(c, regions) + 1]).otherwise(0.0)
        return F.struct((s["cost"] + extra + last + paid(r, c)).alias("cost"), F.lit(pick).alias("pick"), F.concat(F.array(c), s["path"]).alias("path"))

    def fold(state: Column, r: Column) -> Column:
        """state: free (any way on), single (way on without staying), and the next row's T13 cost."""

        def step(c: Column, stay: bool) -> Column:
            k = region_of(c, regions)
            two = c + 2
            may_skip = F.array_contains(lit_array(list(skip)), c)
            may_region = F.array_contains(lit_array(list(skip_regions)), k) & (c != F.element_at(lit_array([e - 2 for e in ends]), k + 1))
            out = [option(state["free"], r, c, c + 1, F.lit(0.0), 0)]
            if stay and repeat:
                out.append(F.when(F.array_contains(lit_array(list(repeat)), c), option(state["single"], r, c, c, F.lit(float(repeat_cost)) + F.when(c == T12, state["t"]).otherwise(0.0), 1)))
            out.append(F.when(may_skip, option(state["free"], r, c, two, F.lit(float(skip_cost)), 2)))
            if skip_regions:
                out.append(F.when(may_region, option(state["free"], r, c, two, F.lit(float(skip_region_cost)), 3)))
            return F.array_min(F.array_compact(F.array(*out)))

        leaf = F.transform(every, lambda c: F.struct(paid(r, c).alias("cost"), F.lit(0).alias("pick"), F.array(c).alias("path")))
        first = F.size(state["free"]) == 0
        free = F.when(first, leaf).otherwise(F.transform(every, lambda c: step(c, True)))
        single = F.when(first, leaf).otherwise(F.transform(every, lambda c: step(c, False)))
        return F.struct(free.alias("free"), single.alias("single"), r["t"].alias("t"))

    kind = "array<struct<cost:double,pick:int,path:array<int>>>"
    begin = F.struct(F.array().cast(kind).alias("free"), F.array().cast(kind).alias("single"), F.lit(0.0).alias("t"))
    table = F.aggregate("rows", begin, fold)["free"]
    best = F.array_min(F.transform(F.slice(table, start + 1, classes), lambda s, i: F.struct(s["cost"].alias("cost"), i.alias("i"), s["path"].alias("path"))))
    return scans.select("scan_id", best.alias("b")).select("scan_id", F.col("b.cost").alias("cost"), F.col("b.path").alias("path"))


def exploded(paths: DataFrame) -> DataFrame:
    """Decoded paths as rows (scan_id, rw, cls)."""
    return paths.select("scan_id", F.posexplode("path").alias("rw", "cls"))


def fix_transitional(path: DataFrame) -> DataFrame:
    """Classes (scan_id, rw, cls) to labels: the second of two T12 is 28, of two L5 at the end 25; others are class + 1."""
    w = W.partitionBy("scan_id").orderBy("rw")
    again = F.coalesce(F.lag("cls").over(w) == F.col("cls"), F.lit(False))
    marked = path.withColumns({"_again": again, "_last": F.lead("cls").over(w).isNull()})
    t13 = F.col("_again") & (F.col("cls") == T12)
    first = F.sum(t13.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)) == 1
    label = F.when(t13 & first, 28).when(F.col("_again") & F.col("_last") & (F.col("cls") == L5), 25).otherwise(F.col("cls") + 1)
    return marked.withColumn("label", label.cast("int")).select("scan_id", "rw", "label")


def valid_sequence(labels: DataFrame, strict: bool = True) -> DataFrame:
    """Whether each scan's labels rise by one, or go 28 to 20, or 18 to 20; ``strict=False`` also takes 19 to 28."""
    w = W.partitionBy("scan_id").orderBy("rw")
    prev = F.lag("label").over(w)
    ok = prev.isNull() | (F.col("label") == prev + 1) | ((F.col("label") == 20) & prev.isin(18, 28))
    ok = ok if strict else ok | ((prev == 19) & (F.col("label") == 28))
    return labels.withColumn("_ok", ok).groupBy("scan_id").agg(F.bool_and("_ok").alias("valid"))


def group_sequence_to_class(groups: DataFrame) -> DataFrame:
    """Exact classes for a sequence of groups (scan_id, rw, grp), top to bottom.

    A whole group is taken in order. Of a partial one at the end the members count from
    its top, of one at the start from its bottom; in the middle it is an error. A sequence
    of one partial group stays null.
    """
    from voxtable.functions.labels import GROUPS

    part, scan = W.partitionBy("scan_id", "grp"), W.partitionBy("scan_id")
    sizes = F.element_at(F.array(*[F.lit(len(g)) for g in GROUPS]), F.col("grp") + 1)
    heads = F.element_at(F.array(*[F.lit(g[0]) for g in GROUPS]), F.col("grp") + 1)
    out = groups.withColumns({"_n": F.count(F.lit(1)).over(part), "_k": F.row_number().over(part.orderBy("rw")) - 1, "_size": sizes, "_head": heads})
    out = out.withColumns({"_before": F.min("rw").over(part) > F.min("rw").over(scan), "_after": F.max("rw").over(part) < F.max("rw").over(scan)})
    top = F.col("_head") + F.col("_k")
    value = (
        F.when(F.col("_n") == F.col("_size"), top)
        .when(F.col("_before") & F.col("_after"), F.raise_error(F.lit("partial group in the middle of a sequence")).cast("int"))
        .when(F.col("_before"), top)
        .when(F.col("_after"), F.col("_head") + F.col("_size") - F.col("_n") + F.col("_k"))
    )
    return out.select("scan_id", "rw", "grp", value.cast("int").alias("cls"))


def argmin_first(df: DataFrame, keys: Sequence[str], value: str = "w", index: str = "cls") -> DataFrame:
    """Least value of each group and the first index that has it."""
    return df.groupBy(*keys).agg(F.min(value).alias(value), F.min_by(index, F.struct(value, index)).cast("int").alias(index))


def path_in_row_order(df: DataFrame, keys: Sequence[str] = ("scan_id",), row: str = "rw", value: str = "cls", out: str = "path") -> DataFrame:
    """The values of each group as one array in the order of the rows."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(row, value))), lambda x: x[value]).alias(out))


def flattened(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Values nested by the columns of ``order``, outermost first, as one array, depth first."""
    nested = df
    for depth in range(len(order), 0, -1):
        nested = path_in_row_order(nested, [*keys, *order[: depth - 1]], order[depth - 1], value if depth == len(order) else out, out)
        if depth < len(order):
            nested = nested.withColumn(out, F.flatten(out))
    return nested
