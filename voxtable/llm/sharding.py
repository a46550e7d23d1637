"""Sharding by balanced label propagation over documents that share their text.

Documents with equal texts are linked. Each starts in a shard by hash. In every round a
group's copies propose to move to the shard where most of their neighbours are; the
quotas of a shard (its free rows) accept proposals with the largest gain first. As soon
as nothing moves, documents without links fill the shards up, so that the numbers of
rows differ by one at most.

The copies of a group by shard are one array per group, so a round shuffles only the
sums by shard: its cost doesn't grow with the size of the largest group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxtable.plans.skew import running_total, skew_join
from voxtable.plans.storage import drop_staged, staged

ROUNDS, SEED = 12, 29
#: Copies in a group that may move as a whole to a shard where it has none.
SMALL = 64
#: Powers of two of a gain.
GAINS = 63


def _array(values: list[Column]) -> Column:
    return F.array(*values)


def _propagate(state: DataFrame, caps: list[int]) -> DataFrame:
    """State (_g, _n, _c: copies by shard) after balanced label propagation."""
    shards = len(caps)
    for _ in range(ROUNDS):
        loads = state.agg(*[F.sum(F.col("_c")[j]).alias(f"l{j}") for j in range(shards)]).head()
        free = [max(0, caps[j] - (loads[j] or 0)) for j in range(shards)]
        # The goal: of the shards with room, that with most copies; ties by the group's hash.
        rank = [F.when(F.lit(free[j] > 0), F.struct(F.col("_c")[j].alias("c"), F.pmod(F.xxhash64("_g", F.lit(j)), F.lit(1 << 30)).alias("t"), F.lit(j).alias("j"))) for j in range(shards)]
        goal = state.withColumn("_to", F.array_max(F.array_compact(_array(rank)))).filter("_to is not null")
        # Copies in shards with no more neighbours than the goal propose to move there; a small
        # group that is not in one shard yet may move as a whole, if its own shards are full.
        fits = (F.array_max("_c") < F.col("_n")) & (F.col("_n") <= SMALL)
        want = F.transform("_c", lambda c, j: F.when((c > 0) & (j != F.col("_to.j")) & ((c <= F.col("_to.c")) | fits), c).otherwise(F.lit(0).cast("long")))
        goal = goal.withColumn("_want", want).withColumn("_sum", F.aggregate("_want", F.lit(0).cast("long"), lambda a, x: a + x))
        goal = goal.withColumn("_gain", F.floor(F.log2(F.col("_to.c") + 1)).cast("int"))
        asked = goal.filter("_sum > 0").groupBy(F.col("_to.j").alias("j"), "_gain").agg(F.sum("_sum").alias("rows")).collect()
        if not asked:
            break
        accept = [[0.0] * GAINS for _ in range(shards)]
        for row in sorted(asked, key=lambda r: (r["j"], -r["_gain"])):
            got = min(row["rows"], free[row["j"]])
            free[row["j"]] -= got
            accept[row["j"]][row["_gain"]] = got / row["rows"]
        share = state.sparkSession.createDataFrame([(j, g, accept[j][g]) for j in range(shards) for g in range(GAINS) if accept[j][g]], "_j int, _gain int, _share double")
        if share.isEmpty():
            break
        moved = goal.filter("_sum > 0").join(F.broadcast(share), (F.col("_to.j") == F.col("_j")) & (goal["_gain"] == share["_gain"]))
        moved = moved.select("_g", F.col("_to.j").alias("_j"), F.transform("_want", lambda w, j: F.floor(w * F.col("_share") + F.pmod(F.xxhash64("_g", j, F.lit(SEED)), F.lit(1 << 20)) / F.lit(float(1 << 20)) * (F.col("_share") < 1).cast("int")).cast("long")).alias("_m"))
        moved = staged(moved.filter(F.exists("_m", lambda m: m > 0)), "shard-moves")
        if moved.isEmpty():
            break
        taken = F.aggregate("_m", F.lit(0).cast("long"), lambda a, x: a + x)
        after = F.when(F.col("_m").isNull(), F.col("_c")).otherwise(F.transform("_c", lambda c, j: c - F.col("_m")[j] + F.when(j == F.col("_j"), taken).otherwise(0)))
        new = staged(state.join(moved, "_g", "left").select("_g", "_n", after.alias("_c")), "shard-state")
        drop_staged(moved)
        drop_staged(state)
        state = new
    return state


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``id_col, size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the text's UTF-8 bytes plus one; a null text has none and is linked with
    empty texts. The law is ``rows``: numbers of rows differ by at most one. ``slot``
    counts from 0 without gaps in every shard; ``grown_shard`` is null under this law.
    Ids only break ties, so they may be null or repeated; rows equal in id and text are
    interchangeable. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = docs.select(F.col(id_col).alias("_id"), text.alias("_t"))
    rows = staged(
        hashed.select(
            "_id",
            (F.octet_length("_t") + 1).cast("long").alias("size"),
            F.crc32("_t").alias("text_crc32"),
            F.unhex(F.md5("_t")).alias("_g"),
            F.xxhash64(F.lit(SEED), "_t", "_id").alias("_h"),
        ),
        "shard-rows",
    )
    total = rows.count()
    caps = [total // shards + (j < total % shards) for j in range(shards)]
    start = F.pmod("_h", F.lit(shards))
    copies = [F.count_if(start == j).alias(f"c{j}") for j in range(shards)]
    groups = staged(rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), *copies), "shard-groups")
    linked = groups.filter("_n > 1").select("_g", "_n", _array([F.col(f"c{j}") for j in range(shards)]).alias("_c"))
    state = _propagate(staged(linked, "shard-state"), caps)
    # Copies of a group in hash order take its places shard by shard.
    ends = F.transform("_c", lambda c, j: F.aggregate(F.slice("_c", 1, j + 1), F.lit(0).cast("long"), lambda a, x: a + x))
    one = F.lit(1).cast("long")
    sizes = groups.select("_g", "_n")
    mine = skew_join(rows, sizes, ["_g"], "_n")
    ranked = staged(running_total(mine.filter("_n > 1").drop("_n").withColumn("_one", one), ["_g"], "_h", ["_id"], "_one", "_rank"), "shard-ranked")
    placed = skew_join(ranked, staged(state.select("_g", "_n", ends.alias("_ends")), "shard-ends"), ["_g"], "_n")
    placed = placed.withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_rank")))).select("_id", "size", "text_crc32", "_h", "shard", "_one")
    placed = staged(running_total(placed, ["shard"], "_h", ["_id", "size"], "_one", "slot"), "shard-placed")
    cap = F.element_at(_array([F.lit(c) for c in caps]), F.col("shard") + 1)
    kept = placed.filter(F.col("slot") < cap).select("_id", "size", "text_crc32", "shard", "slot")
    held = dict(kept.groupBy("shard").count().collect())
    # The rest fills every shard up to its number of rows.
    rest = mine.filter("_n = 1").select("_id", "size", "text_crc32", "_h").unionByName(placed.filter(F.col("slot") >= cap).select("_id", "size", "text_crc32", "_h"))
    rest = running_total(rest.withColumns({"_one": one, "_all": F.lit(0)}), ["_all"], "_h", ["_id", "size"], "_one", "_rank")
    to, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for j in reversed(range(shards)):
        before = sum(caps[i] - held.get(i, 0) for i in range(j))
        to = F.when(F.col("_rank") < before + caps[j] - held.get(j, 0), j).otherwise(to)
        slot = F.when(F.col("_rank") < before + caps[j] - held.get(j, 0), F.col("_rank") - before + held.get(j, 0)).otherwise(slot)
    filled = rest.select("_id", "size", "text_crc32", to.alias("shard"), slot.alias("slot"))
    out = kept.unionByName(filled)
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
