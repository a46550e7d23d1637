"""Mixing sources to target weights with exact quotas.

Documents of a source are dealt into blocks by a seeded hash. A source whose target is
e.f times its size is taken e times whole; of the rest blocks are taken in the order of
another permutation until the target is reached, the last block in part. The drawn blocks
of all sources are then split among output shards by a tree: each node splits its vector
of block counts by source between its halves with one multivariate hypergeometric draw,
so the quotas are exact and every shard is a random sample of the mix. Shards take
disjoint runs of each source's permuted blocks and are shuffled locally.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voxtable.plans.storage import packed, small_side, staged, unpacked

WORD = r"[^\x20\x09-\x0D]+"
#: Documents in a block, at most 2**BLOCK_BITS blocks a source; words in a shard, at most so many shards.
BLOCK_DOCS, BLOCK_BITS, SHARD_WORDS, MAX_SHARDS = 1000, 16, 1_000_000, 4096
#: The recipe has one row per source; more sources than this are an error, not a mix.
MAX_SOURCES = 100_000


def targets(sizes: Sequence[int], weights: Sequence[float], cap: float) -> list[float]:
    """Shares of the total by weight, none above ``cap`` times its size; the excess is reshared."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in sorted(open_))
        full = [i for i in sorted(open_) if unit * weights[i] > cap * sizes[i]]
        for i in full or sorted(open_):
            out[i] = float(cap * sizes[i]) if full else unit * weights[i]
            left -= out[i]
            open_.discard(i)
    return out


def split_tree(blocks: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source in each shard (shards x sources), sums exact, shard sizes at most one apart."""
    out = np.zeros((shards, len(blocks)), dtype=np.int64)
    todo = [(0, shards, np.asarray(blocks, dtype=np.int64))]
    while todo:
        lo, hi, pool = todo.pop()
        if hi - lo == 1:
            out[lo] = pool
            continue
        mid = (lo + hi) // 2
        total = int(pool.sum())
        draw = np.random.default_rng([seed, lo, hi])
        part = draw.multivariate_hypergeometric(pool, total * (mid - lo) // (hi - lo), method="marginals")
        todo += [(lo, mid, part), (mid, hi, pool - part)]
    return out


def _keyed(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: int) -> dict[str, Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return {
        "_size": F.regexp_count(text, F.lit(WORD)).cast("long"),
        "_h": F.xxhash64(F.lit(seed), F.col(id_col), text),
        "_src": F.col(source_col),
    }


class Mix:
    """The plan of a mix: sources with their targets, and what is drawn of every block."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[float] = (1, 2, 3), cap: int = 3, seed: int = 17):
        self.cols, self.seed = (id_col, source_col, text_col), seed
        spark = docs.sparkSession
        self.rows = staged(docs.withColumns(_keyed(docs, *self.cols, seed)).select(F.col(id_col).alias("_id"), "_src", "_size", "_h"), "mix-rows")
        found = self.rows.groupBy("_src").agg(F.sum("_size").alias("words"), F.count(F.lit(1)).alias("docs")).limit(MAX_SOURCES + 1).collect()
        if len(found) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        found.sort(key=lambda r: (r["_src"] is None, r["_src"] or ""))
        goal = targets([r["words"] for r in found], [weights[i % len(weights)] for i in range(len(found))], cap)
        table = []
        for i, (r, t) in enumerate(zip(found, goal, strict=True)):
            whole = min(cap, int(t // r["words"])) if r["words"] else 0
            bits = min(BLOCK_BITS, max(0, (r["docs"] // BLOCK_DOCS).bit_length()))
            table.append((r["_src"], i, r["words"], t, whole, round(t) - whole * r["words"], bits))
        kind = docs.schema[source_col].dataType.simpleString()
        self.sources = spark.createDataFrame(table, f"_src {kind}, _s int, source_size long, target double, _whole int, _rest long, _bits int")
        self.shards = max(1, min(MAX_SHARDS, -(-sum(r["words"] for r in found) // SHARD_WORDS)))
        self._draw(len(found))

    def _blocked(self, rows: DataFrame) -> DataFrame:
        """``rows`` with their source's row and block; the sources are bounded by MAX_SOURCES."""
        s = F.broadcast(self.sources.withColumnRenamed("_src", "_src2"))
        joined = rows.join(s, rows["_src"].eqNullSafe(s["_src2"])).drop("_src2")
        return joined.withColumn("_block", F.when(F.col("_bits") > 0, F.expr("shiftrightunsigned(_h, 64 - _bits)")).otherwise(F.lit(0).cast("long")))

    def _draw(self, n_sources: int) -> None:
        rows = self._blocked(self.rows)
        facts = ["_s", "_whole", "_rest"]
        blocks = rows.groupBy(*facts, "_block").agg(F.sum("_size").alias("_words"))
        order = W.partitionBy("_s").orderBy(F.xxhash64(F.lit(self.seed + 1), "_s", "_block"), "_block")
        before = F.coalesce(F.sum("_words").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        units = blocks.withColumn("_before", before).withColumn("_pass", F.explode(F.sequence(F.lit(0), F.col("_whole"))))
        room = F.when(F.col("_pass") < F.col("_whole"), F.col("_words")).otherwise(F.least(F.col("_words"), F.col("_rest") - F.col("_before")))
        units = units.withColumn("_take", room).filter("_take > 0")
        rank = F.row_number().over(W.partitionBy("_s").orderBy(F.xxhash64(F.lit(self.seed + 2), "_s", "_block", "_pass"), "_block", "_pass")) - 1
        units = staged(units.select("_s", "_block", "_pass", "_words", "_take", rank.alias("_rank")), "mix-units")
        drawn = dict(units.groupBy("_s").count().collect())
        self.quotas = split_tree([drawn.get(i, 0) for i in range(n_sources)], self.shards, self.seed)
        ends = np.cumsum(self.quotas, axis=0)
        runs = [(int(s), int(k), int(ends[k, s] - self.quotas[k, s]), int(ends[k, s]) - 1) for k in range(self.shards) for s in range(n_sources) if self.quotas[k, s]]
        runs = self.sources.sparkSession.createDataFrame(runs, "_s int, _shard int, _from long, _to long")
        seats = runs.select("_s", "_shard", F.explode(F.sequence("_from", "_to")).alias("_rank"))
        seated = staged(units.join(seats, ["_s", "_rank"]), "mix-seated")
        unit = F.struct("_pass", "_shard", (F.col("_take") < F.col("_words")).alias("cut"))
        #: One row per block that is drawn, with its passes (at most cap + 1).
        self.blocks = staged(seated.groupBy("_s", "_block").agg(F.array_sort(F.collect_list(unit)).alias("_units"), F.max(F.when(F.col("_take") < F.col("_words"), F.col("_take"))).alias("_limit")), "mix-blocks")
        # Words taken of the documents of blocks cut short, at most one block a source.
        cut = rows.join(small_side(self.blocks.filter("_limit is not null").select("_s", "_block", "_limit")), ["_s", "_block"])
        same = cut.groupBy("_s", "_block", "_limit", "_h", "_size").agg(F.count(F.lit(1)).alias("_k"))
        sofar = F.coalesce(F.sum(F.col("_k") * F.col("_size")).over(W.partitionBy("_s", "_block").orderBy("_h", "_size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        part = F.greatest(F.lit(0), F.least(F.col("_size"), F.floor((F.col("_limit") - sofar) / F.col("_k"))))
        self.parts = staged(same.select("_s", F.col("_h").alias("_h"), "_size", part.cast("long").alias("_part")), "mix-parts")

    def place(self, shard: Column, copy: Column) -> Column:
        """Where a copy stands among its shard's: shards are sorted by it."""
        return F.xxhash64(F.lit(self.seed + 3), shard, F.col("_h"), copy)

    def taken(self, rows: DataFrame) -> DataFrame:
        """``rows`` (_src, _size, _h, ...) with ``copies``: pass, shard, words and place of every copy taken, and ``taken``."""
        out = self._blocked(rows)
        out = out.join(small_side(self.blocks.drop("_limit")), ["_s", "_block"], "left")
        out = out.join(small_side(self.parts), ["_s", "_h", "_size"], "left")
        words = lambda u: F.when(u["cut"], F.coalesce(F.col("_part"), F.lit(0))).otherwise(F.col("_size"))
        copies = F.transform(F.coalesce("_units", F.array().cast("array<struct<_pass:int,_shard:int,cut:boolean>>")), lambda u: F.struct(u["_pass"].alias("copy"), u["_shard"].alias("shard"), words(u).cast("long").alias("words"), self.place(u["_shard"], u["_pass"]).alias("place")))
        out = out.withColumn("copies", F.filter(copies, lambda c: c["words"] > 0))
        return out.withColumn("taken", F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"]))


def mix_report(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """One row per document: ``id_col, size, source_size, target, taken, copies``: with every copy's shard and place there.

    Sizes count words; a null text has none. Sources stand in code point order, null last,
    and share the total by the repeating weights. Order and draws depend on the seed, the
    ids and the texts alone, so reruns agree on any cluster; equal rows are taken alike. A source without
    words has target 0. An empty table gives an empty result.
    """
    if docs.isEmpty():
        kind = docs.schema[id_col].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"{id_col} {kind}, size long, source_size long, target double, taken long, copies array<struct<copy:int,shard:int,words:long,place:long>>")
    mix = Mix(docs, id_col, source_col, text_col, **options)
    return mix.taken(mix.rows).select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", "taken", "copies")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row per copy taken, shard by shard, each shuffled.

    A copy taken in part has the first words of its text. Documents not drawn are left out.
    """
    if docs.isEmpty():
        return docs
    mix = Mix(docs, id_col, source_col, text_col, **options)
    rows = mix.taken(packed(docs, **_keyed(docs, id_col, source_col, text_col, mix.seed))).withColumn("_copy", F.explode("copies"))
    text = F.col("_row").getField(text_col)
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    first = F.array_join(F.slice(words, 1, F.col("_copy.words").cast("int")), "")
    text = F.when(F.col("_copy.words") < F.col("_size"), first).otherwise(text)
    dealt = rows.select(
        F.col("_row").withField(text_col, text).alias("_row"),
        F.col("_copy.shard").alias("_shard"),
        F.col("_copy.place").alias("_place"),
    )
    return unpacked(dealt.repartitionById(mix.shards, F.col("_shard")).sortWithinPartitions("_place"))
