"""Vertebra vocabularies and label arithmetic as column expressions and small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Members of the twelve groups (classes 0..23), first class of each region,
# spellings of yes and no as text (true and false themselves, 1 and 0 among them).
GROUPS = [[0, 1], [2, 3, 4], [5, 6], [7, 8], [9, 10], [11, 12, 13], [14, 15], [16, 17], [18], [19, 20], [21, 22], [23]]
REGION_STARTS = (0, 7, 19)
TRUE_WORDS = ("True", "true", "1", "wahr", "Wahr", "Ja", "ja", "-", "1?")
FALSE_WORDS = ("False", "false", "0", "falsch", "Falsch", "Nein", "nein")
CLASSES, T11, T12, L5 = 24, 17, 18, 23


def label_to_class(label: Column) -> Column:
    """Class 0..23 of a label; 28 (T13) counts as T12."""
    return F.when(label == 28, T12).otherwise(F.least(F.lit(L5), label - 1)).cast("int")


def label_to_exactclass(label: Column) -> Column:
    """Class 0..25 with places of their own for T13 and L6."""
    return F.when(label == 28, 19).when(label <= 19, label - 1).otherwise(F.least(F.lit(25), label)).cast("int")


def region_of(cls: Column, starts=REGION_STARTS) -> Column:
    """Index of the region a class belongs to."""
    return (F.size(F.filter(F.array(*map(F.lit, starts)), lambda s: s <= cls)) - 1).cast("int")


def group_of(cls: Column) -> Column:
    table = [g for c in range(CLASSES) for g, members in enumerate(GROUPS) if c in members]
    return F.element_at(F.array(*map(F.lit, table)), cls + 1)


def label_to_vertrel(label: Column, last_bwk: Column, last_lwk: Column) -> Column:
    """0 nothing, 1 last HWK, 2 first BWK, 3 last BWK, 4 first LWK, 5 last LWK; the first that fits."""
    return F.when(label == 7, 1).when(label == 8, 2).when(label == last_bwk, 3).when(label == 20, 4).when(label == last_lwk, 5).otherwise(0)


def parse_binary(value: Column) -> Column:
    """[1, 0] for yes, [0, 1] for no, null for anything else."""
    word = value.cast("string")
    return F.when(word.isin(*TRUE_WORDS), F.array(F.lit(1), F.lit(0))).when(word.isin(*FALSE_WORDS), F.array(F.lit(0), F.lit(1)))


def disc_map(label: Column) -> Column:
    """Disc numbers: 2 is 1, 102..124 are 3..25; others are null."""
    return F.when(label == 2, 1).when(label.between(102, 124), label - 99)


def subject_block(subject: Column) -> Column:
    """First three digits of a subject's number."""
    return F.substring(subject.cast("string"), 1, 3).cast("int")


def vocabulary(spark: SparkSession) -> DataFrame:
    """Dimension table (cls, grp, region) of the 24 classes."""
    ids = spark.range(CLASSES).select(F.col("id").cast("int").alias("cls"))
    return ids.select("cls", group_of(F.col("cls")).alias("grp"), region_of(F.col("cls")).alias("region"))


def region_broadcast(regions: Column) -> Column:
    """A score per region copied to each of the 24 classes."""
    return F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda c: regions[region_of(c)])


def group_expand(groups: Column) -> Column:
    """A score per group copied to each of its classes."""
    table = F.array(*[F.lit(g) for c in range(CLASSES) for g, members in enumerate(GROUPS) if c in members])
    return F.transform(table, lambda g: groups[g])
