"""Anomaly overrides and label targets of annotated subjects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voxtable.functions import labels as lb
from voxtable.functions.units import one_hot


def apply_anomalies(labels: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Labels (subject, label) with ``actual`` and ``removed``.

    ``anomalies`` (subject, t11, t13, remove and, if there is one, label_override): T11
    shifts 19..25 up by one; T13 makes 20 to 28 and shifts 21..25 down; an override gives
    labels by sorted place, 28 standing between 19 and 20. Subjects with 28 but without 19
    are removed too.
    """
    a = anomalies if "label_override" in anomalies.columns else anomalies.withColumn("label_override", F.lit(None).cast("array<int>"))
    joined = labels.join(a.select("subject", "t11", "t13", F.col("remove").alias("_remove"), "label_override"), "subject", "left")
    place = F.row_number().over(W.partitionBy("subject").orderBy(F.when(F.col("label") == 28, 19.5).otherwise(F.col("label").cast("double"))))
    moved = (
        F.when(F.col("label_override").isNotNull(), F.get("label_override", place - 1))
        .when(F.col("t11") & F.col("label").between(19, 25), F.col("label") + 1)
        .when(~F.coalesce("t11", F.lit(False)) & F.col("t13") & (F.col("label") == 20), 28)
        .when(~F.coalesce("t11", F.lit(False)) & F.col("t13") & F.col("label").between(21, 25), F.col("label") - 1)
        .otherwise(F.col("label"))
    )
    out = joined.withColumn("actual", moved.cast("int"))
    subject = W.partitionBy("subject")
    has = lambda v: F.max((F.col("actual") == v).cast("int")).over(subject) == 1
    return out.withColumn("removed", F.coalesce("_remove", F.lit(False)) | (has(28) & ~has(19))).select("subject", "label", "actual", "removed")


def label_boundaries(actual: DataFrame) -> DataFrame:
    """Per subject: last thoracic and last lumbar label, and the labels that get double entries."""
    col = F.col("actual")
    top = F.max(col)
    g = actual.groupBy("subject").agg(
        F.when(top >= 18, F.max(F.when(((col > 7) & (col <= 19)) | (col == 28), col))).alias("last_bwk"),
        F.when(top >= 23, F.max(F.when((col > 22) & (col < 26), col))).alias("last_lwk"),
        F.collect_set(col).alias("_all"),
    )
    has = lambda v: F.array_contains("_all", v)
    double = F.when(has(18) & ~has(19) & has(20), F.array(*map(F.lit, (17, 18, 20, 21)))).when(has(28), F.array(*map(F.lit, (19, 28, 20, 21)))).otherwise(F.array(*map(F.lit, (18, 19, 20, 21))))
    return g.withColumn("double_entries", double).drop("_all")


def vert_entries(actual: DataFrame) -> DataFrame:
    """All targets of each annotated vertebra."""
    joined = actual.join(label_boundaries(actual), "subject")
    a = F.col("actual")
    cls = lb.label_to_class(a)
    return joined.select(
        "subject",
        "actual",
        lb.label_to_vertrel(a, F.col("last_bwk"), F.col("last_lwk")).alias("vert_rel"),
        cls.alias("vert_exact"),
        lb.label_to_exactclass(a).alias("vert_exact2"),
        lb.group_of(cls).alias("vert_group"),
        lb.region_of(cls).alias("vert_region"),
        (a == 28).cast("int").alias("vert_t13"),
        F.lit("0").alias("vert_cut"),
    )


#: Targets: column and number of channels. Fixed values.
TARGETS = {"REGION": ("vert_region", 3), "VERT": ("vert_exact", 24), "VERTEX": ("vert_exact2", 26), "VT13": ("vert_t13", 2), "VERTREL": ("vert_rel", 6), "VERTGRP": ("vert_group", 12), "FULLYVISIBLE": ("vert_cut", 2)}


def objective_vectors(entries: DataFrame, targets: Sequence[str], together: bool = False) -> DataFrame:
    """One-hot vectors of the targets, as columns or concatenated in ``objective``; a missing column is an error."""
    lacking = [TARGETS[t][0] for t in targets if TARGETS[t][0] not in entries.columns]
    if lacking:
        raise ValueError(f"columns {lacking} are missing")

    def vector(t: str) -> Column:
        col, n = TARGETS[t]
        return lb.parse_binary(F.col(col)) if t == "FULLYVISIBLE" else one_hot(F.col(col), n)

    cols = [vector(t) for t in targets]
    keep = [c for c in ("subject", "actual") if c in entries.columns]
    if together:
        return entries.select(*keep, F.concat(*cols).alias("objective"), F.lit(sum(TARGETS[t][1] for t in targets)).alias("channels"))
    return entries.select(*keep, *[c.alias(t) for c, t in zip(cols, targets, strict=True)])
