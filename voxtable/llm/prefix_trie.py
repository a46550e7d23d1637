"""The prefix trie of conversations, with totals of every subtree by time-forward processing.

A node is a distinct sequence of first turns. It is known by a 128-bit fingerprint, the
exclusive or of hashes of (place, turn), so that all prefixes come from running aggregates
in blocks and a node's parent from its own last turn. Totals then flow upwards: nodes are
sorted externally in reverse level order and every node sends what its subtree holds to
its parent through a priority queue, which spills. Subtrees under a bound of rows are
shards of their own; what lies above them follows, in bands of levels.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from voxtable.plans.skew import skew_join
from voxtable.plans.storage import scratch, small_side, staged

#: Turns of a conversation that are fingerprinted in one window, and ids that are joined to one text.
BLOCK, ID_BLOCK = 1024, 4096
#: Levels above the shards that are processed at a time.
BAND = 1024
#: Messages that a priority queue holds in memory.
QUEUE_ROWS = 200_000

_KEY, _UP = ["k1", "k2"], ["p1", "p2"]


class SpillingQueue:
    """A priority queue of (key, values) that keeps at most ``rows`` entries in memory.

    When it is full, the later half is written as a sorted run; a run is read back in
    parts. Runs are unnamed files, which vanish with the task.
    """

    PART = 1000

    def __init__(self, rows: int = QUEUE_ROWS):
        self.rows, self.heap, self.runs = rows, [], []

    def push(self, key: tuple, values: tuple) -> None:
        heapq.heappush(self.heap, (key, values))
        if len(self.heap) > self.rows:
            self.heap.sort()
            half = len(self.heap) // 2
            self.runs.append(self._run(self.heap[half:]))
            del self.heap[half:]

    def _run(self, entries: list) -> list:
        """A run as [its next entries, last first; the file of the rest]."""
        file = tempfile.TemporaryFile()  # noqa: SIM115
        for at in range(self.PART, len(entries), self.PART):
            pickle.dump(entries[at : at + self.PART][::-1], file)
        file.seek(0)
        return [entries[: self.PART][::-1], file]

    def pop(self, key: tuple) -> Iterator[tuple]:
        """Take out the values of all entries with this key, which must be the least one."""
        while self.heap and self.heap[0][0] == key:
            yield heapq.heappop(self.heap)[1]
        for run in self.runs:
            while run[0] and run[0][-1][0] == key:
                yield run[0].pop()[1]
                if not run[0]:
                    try:
                        run[0] = pickle.load(run[1])
                    except EOFError:
                        run[1].close()
        self.runs = [r for r in self.runs if r[0]]

    def __len__(self) -> int:
        return len(self.heap) + len(self.runs)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(c, idx from 1, digest, bytes): turns in order, null first, then by role and text; staged.

    A null role or text is empty; rows without a conversation's id belong to none. Rows are
    sorted by ranges, so a conversation that holds much of the table is ranked by many tasks.
    """
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), F.col("turn").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    order = ["c", F.asc_nulls_first("turn"), "role", "text"]
    digest = F.sha2(F.concat_ws(":", F.octet_length("role"), "role", "text"), 256)
    ranked = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("c", digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes"), F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_o"))
    ranked = staged(ranked, "trie-order")
    parts = ranked.groupBy("c", "_p").agg(F.min("_o").alias("_m"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("c").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("c", "_p", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_m") + 1).alias("_to"))
    return staged(ranked.join(parts, ["c", "_p"]).select("c", (F.col("_o") + F.col("_to")).alias("idx"), "digest", "bytes"), "trie-turns")


def rebuilt(turns: DataFrame, heads: int = 9, family: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations that share their beginnings: (c, d, length, digest, bytes) and (c, length), both staged.

    Conversation c gets the first h turns of conversation c - c % family (all if it has
    fewer, none if there is none), h the CRC-32 of its decimal id modulo ``heads``, then its
    own turns after its first h. Some may end up without a turn.
    """
    own = staged(turns.groupBy("c").agg(F.count(F.lit(1)).alias("n")), "trie-sizes")
    h = F.crc32(F.col("c").cast("string").cast("binary")) % heads
    first = own.select(F.col("c").alias("base"), F.col("n").alias("_bn"))
    plan = own.withColumns({"h": h, "base": F.col("c") - F.pmod("c", F.lit(family).cast("long"))}).join(first, "base", "left")
    plan = plan.withColumn("taken", F.least("h", F.coalesce("_bn", F.lit(0))))
    plan = staged(plan.select("c", "base", "h", "taken", "n", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "trie-plan")
    borrowed = turns.filter(F.col("idx") < heads).withColumnRenamed("c", "base").join(plan.select("c", "base", "taken", "length"), "base").filter("idx <= taken")
    kept = skew_join(turns.filter(F.col("idx") > h), plan.select("c", "h", "taken", "length", "n"), ["c"], "n")
    rows = borrowed.select("c", F.col("idx").alias("d"), "length", "digest", "bytes").unionByName(kept.select("c", (F.col("idx") - F.col("h") + F.col("taken")).alias("d"), "length", "digest", "bytes"))
    return staged(rows, "trie-rebuilt"), plan.select("c", "length")


def _fingerprints(rows: DataFrame) -> DataFrame:
    """``rows`` with the fingerprint of the prefix that each turn ends (k1, k2) and of the one before it (p1, p2)."""
    own = rows.withColumns({"_b": F.floor((F.col("d") - 1) / BLOCK), "_x1": F.xxhash64("d", "digest"), "_x2": F.xxhash64("digest", F.lit("prefix"), "d")})
    totals = own.filter(F.col("length") > BLOCK).groupBy("c", "_b").agg(*[F.bit_xor(f"_x{k}").alias(f"_s{k}") for k in (1, 2)])
    earlier = W.partitionBy("c").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("c", "_b", *[F.coalesce(F.bit_xor(f"_s{k}").over(earlier), F.lit(0).cast("long")).alias(f"_s{k}") for k in (1, 2)])
    here = W.partitionBy("c", "_b").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    run = own.withColumns({f"_r{k}": F.bit_xor(f"_x{k}").over(here) for k in (1, 2)}).join(totals, ["c", "_b"], "left")
    keys = {f"k{k}": F.col(f"_r{k}").bitwiseXOR(F.coalesce(f"_s{k}", F.lit(0).cast("long"))) for k in (1, 2)}
    return run.withColumns(keys).withColumns({f"p{k}": F.col(f"k{k}").bitwiseXOR(F.col(f"_x{k}")) for k in (1, 2)}).select("c", "d", "length", "digest", "bytes", *_KEY, *_UP)


def _nodes(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row a node: key, parent's key, depth, conv_id, n_convs, own (tokens saved here) and below (turns from here on)."""
    check = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
    of = rows.withColumn("_t", check).groupBy(*_KEY).agg(
        *[F.min(c).alias(c) for c in _UP], F.min("d").alias("depth"), F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("_bytes"),
        F.sum(F.col("length") - F.col("d") + 1).alias("below"), F.min("_t").alias("_t0"), F.max("_t").alias("_t1"), F.max("p1").alias("_p1"), F.max("d").alias("_d1"),
    )
    clash = (F.col("_t0") != F.col("_t1")) | (F.col("p1") != F.col("_p1")) | (F.col("depth") != F.col("_d1"))
    of = of.withColumn("n_convs", F.when(clash, F.raise_error(F.lit("two prefixes have one fingerprint")).cast("long")).otherwise(F.col("n_convs")))
    nodes = of.select(*_KEY, *_UP, "depth", "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("_bytes")).alias("own"), "below")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = lengths.agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("length").alias("below")).filter("n_convs > 0")
    return nodes.unionByName(root.select(*[zero.alias(k) for k in _KEY], *[none.alias(k) for k in _UP], zero.alias("depth"), "conv_id", "n_convs", zero.alias("own"), "below"))


def _end_digests(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """(key, ends_sha256) of nodes where conversations end: SHA-256 of their ids in numerical order, comma-joined.

    Ids are joined to texts in blocks of ID_BLOCK consecutive ids. The digest of several
    blocks is fed with one after the other by a task that holds one at a time.
    """
    zero = F.lit(0).cast("long")
    ends = rows.filter("d = length").select(*_KEY, "c").unionByName(lengths.filter("length = 0").select(*[zero.alias(k) for k in _KEY], "c"))
    texts = ends.groupBy(*_KEY, F.floor(F.col("c") / ID_BLOCK).alias("_b")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x.cast("string")), ",").alias("_s"))
    texts = staged(texts, "trie-ends")
    blocks = staged(texts.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("_n"), F.min("_s").alias("_s")), "trie-end-blocks")
    one = blocks.filter("_n = 1").select(*_KEY, F.sha2("_s", 256).alias("ends_sha256"))

    def feed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, out = None, None, []
        for batch in batches:
            for k1, k2, text in zip(*(batch[x].to_pylist() for x in ("k1", "k2", "_s")), strict=True):
                if (k1, k2) != key:
                    if key:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (k1, k2), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(text.encode())
            if len(out) > 1000:
                yield _batch(out, _KEY, ["ends_sha256"])
                out = []
        if key:
            yield _batch([*out, (*key, digest.hexdigest())], _KEY, ["ends_sha256"])

    several = texts.join(small_side(blocks.filter("_n > 1").select(*_KEY)), _KEY, "left_semi")
    several = several.repartition(*_KEY).sortWithinPartitions(*_KEY, "_b").mapInArrow(feed, "k1 long, k2 long, ends_sha256 string")
    return one.unionByName(several)


def _batch(rows: list[tuple], longs: list[str], texts: list[str] = ()) -> pa.RecordBatch:
    kinds = [pa.int64()] * len(longs) + [pa.string()] * len(texts)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], [*longs, *texts])


def _forward(nodes: DataFrame, queue_rows: int) -> DataFrame:
    """Totals of the nodes of each shard (s1, s2): (key, parent's key, is_top, n_children, n_leaves, saved).

    ``nodes`` have is_top (its parent is outside of the shard) and what has come from other
    shards: children, leaves, below_saved. Within a shard nodes come deepest first; a
    message waits in the queue under its receiver's place in that order.
    """
    names = [*_KEY, *_UP, "is_top", "n_children", "n_leaves", "saved"]
    read = ["s1", "s2", "depth", *_KEY, *_UP, "is_top", "own", "children", "leaves", "below_saved"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, shard = SpillingQueue(queue_rows), None
        for batch in batches:
            out = []
            for s1, s2, depth, k1, k2, p1, p2, top, own, children, leaves, saved in zip(*(batch[x].to_pylist() for x in read), strict=True):
                if (s1, s2) != shard:
                    if len(queue):
                        raise ValueError("a message has not met its node")
                    shard = (s1, s2)
                for c, n, s in queue.pop((-depth, k1, k2)):
                    children, leaves, saved = children + c, leaves + n, saved + s
                leaves, saved = leaves if children else 1, saved + own
                out.append((k1, k2, p1, p2, top, children, leaves, saved))
                if not top:
                    queue.push((1 - depth, p1, p2), (1, leaves, saved))
            if out:
                yield _batch(out, names)
        if len(queue):
            raise ValueError("a message has not met its node")

    level = F.col("depth").desc()
    dealt = nodes.select(*read).repartition("s1", "s2").sortWithinPartitions("s1", "s2", level, *_KEY)
    return dealt.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _messages(done: DataFrame) -> DataFrame:
    """What the tops of shards send to their parents, added up by parent."""
    tops = done.filter("is_top = 1 and p1 is not null")
    return tops.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("below_saved"))


def _totals(nodes: DataFrame, rows: DataFrame, queue_rows: int) -> DataFrame:
    """(key, n_children, n_leaves, saved) of every node, staged."""
    spark = nodes.sparkSession
    zero = F.lit(0).cast("long")
    fields = ("children", "leaves", "below_saved")
    total = nodes.filter("depth = 0").select("below").head()
    limit = max(1, (total[0] if total else 0) // int(spark.conf.get("spark.sql.shuffle.partitions")))
    # A node with more turns than the limit below it is heavy. All others lie in shards of at most that many nodes, whose
    # tops are children of heavy ones; of these a level has fewer than there are partitions. The root is heavy.
    is_heavy = (F.col("below") > limit) | (F.col("depth") == 0)
    heavy = staged(nodes.filter(is_heavy), "trie-heavy")
    # The smallest conversation of a node has the node's prefixes; its first one that isn't heavy is the shard's top.
    light = rows.join(small_side(heavy.select(*_KEY)), _KEY, "left_anti")
    tops = light.groupBy("c").agg(F.min(F.struct("d", *_KEY)).alias("_top")).select(F.col("c").alias("conv_id"), F.col("_top.d").alias("_d"), F.col("_top.k1").alias("s1"), F.col("_top.k2").alias("s2"))
    sharded = nodes.filter(~is_heavy).join(tops, "conv_id").withColumns({"is_top": (F.col("depth") == F.col("_d")).cast("long"), **{c: zero for c in fields}})
    done = [staged(_forward(sharded, queue_rows), "trie-totals")]
    deepest = heavy.agg(F.max("depth")).head()[0]
    for band in range((deepest if deepest is not None else -1) // BAND, -1, -1):
        sent = done[0] if len(done) == 1 else done[0].unionByName(done[-1])
        met = heavy.filter(F.floor(F.col("depth") / BAND) == band).join(_messages(sent), _KEY, "left").fillna(0, list(fields))
        met = met.withColumns({"s1": zero, "s2": zero, "is_top": (F.col("depth") == band * BAND).cast("long")})
        done.append(staged(_forward(met, queue_rows), "trie-totals"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*_KEY, "n_children", "n_leaves", "saved")


def prefix_trie(rows: DataFrame, lengths: DataFrame, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``rows`` (c, d from 1, length, digest, bytes), one a turn, and ``lengths`` (c, length),
    one a conversation, staged both. ``conv_id`` is the smallest member; ``saved_tokens``
    sums, over a node's subtree, the bytes of its last turn for every member but one.
    Without conversations there is no node.
    """
    marked = staged(_fingerprints(rows), "trie-prefixes")
    nodes = staged(_nodes(marked, lengths), "trie-nodes")
    totals = _totals(nodes, marked, queue_rows)
    full = staged(nodes.join(totals, _KEY).join(_end_digests(marked, lengths), _KEY, "left"), "trie-full")
    parents = full.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_w")).filter("_w > 0")
    out = skew_join(full, parents, _UP, "_w", "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """The trie of rebuilt conversations (``ordered_turns``, ``rebuilt``): one row per node, see ``prefix_trie``.

    Null roles and texts are empty, null turns come first, repeated turns count; rows
    without a conversation's id are in none. Extra columns are ignored, an empty table
    gives an empty result.
    """
    with scratch(conversations.sparkSession) as keep:
        rows, lengths = rebuilt(ordered_turns(conversations))
        return keep(staged(prefix_trie(rows, lengths, queue_rows), "trie"))
