"""Exact deduplication by content hash with a comparison of the bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voxtable.functions.text import ascii_lower
from voxtable.plans.skew import skew_join
from voxtable.plans.storage import packed, small_side, staged, unpacked


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs.select(F.col(id_col).alias("_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_t"))
    return text.select("_id", F.unhex(F.md5(F.col("_t"))).alias("_h"), F.unhex(F.sha2(F.col("_t"), 256)).alias("_sha"), "_t")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal if identical after lower-casing A-Z; a null text is empty. Rows are
    grouped by a 128-bit hash together with the text itself: the aggregation compares
    whole keys byte by byte, so texts with colliding hashes stay apart, and each task
    sends one row per distinct text, however many copies it read. The row with the
    smallest id of a group stays (``keep="largest"``: the largest). Null ids rank behind
    all others; rows that repeat both id and text count alike in ``kept``. An empty table
    gives an empty result; other columns are ignored.
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    base = _hashed(docs, id_col, text_col)
    rows = staged(base.select("_id", "_h", "_sha"), "exact-rows")
    texts = base.groupBy("_h", "_t").agg(pick("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.first("_sha").alias("_sha"))
    groups = staged(texts.drop("_t"), "exact-groups")
    if groups.groupBy("_h", "_sha").count().filter("count > 1").limit(1).count():
        # Different texts agree in both hashes: the rows find their group by the text itself.
        joined = base.drop("_sha").join(texts.drop("_h", "_sha"), "_t").join(rows.select("_h", "_sha").distinct(), "_h")
    else:
        joined = skew_join(rows, groups, ["_h", "_sha"], "group_size")
    return joined.select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """``docs`` with one row of every group of equal texts, all columns as they were.

    Of rows that repeat both id and text one stays too. Only ids and hashes are shuffled
    unless rows to drop outnumber the broadcast bound.
    """
    report = staged(exact_groups(docs, id_col, text_col, keep), "exact-report")
    key = [F.col(id_col).alias("_k"), F.unhex("text_sha256").alias("_s")]
    sha = F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256))
    rows = packed(docs, _id=F.col(id_col), _sha=sha)
    gone = small_side(staged(report.filter(~F.col("kept")).select(*key).distinct(), "exact-gone"))
    same = lambda side: rows["_id"].eqNullSafe(side["_k"]) & (rows["_sha"] == side["_s"])
    left = rows.join(gone, same(gone), "left_anti")
    twice = staged(report.filter("kept").groupBy(*key).count().filter("count > 1").drop("count"), "exact-twice")
    if twice.isEmpty():
        return unpacked(left)
    once = left.join(twice, same(twice), "left_semi").dropDuplicates(["_id", "_sha"])
    return unpacked(left.join(twice, same(twice), "left_anti").unionByName(once))
