"""Near-duplicate detection by bottom-k sketches of word shingles.

One hash function orders all shingles. Two sets of ``n`` shingles or more whose similarity
reaches the threshold ``t`` share a value among the ``n - ceil(t * n) + 1`` smallest of
each, in any order that all sets agree on. So a document posts its bottom-k values with
this k, inverted lists of them generate overlaps, the similarity estimated on the sketch of
the union filters candidates, and the exact similarity of the full sets decides.

Documents with equal sets are one class from the start. A value posted by over ``LIST``
classes at a time is common, and the agreed order is: all others first, by hash, then the
common ones. A class with common values among its smallest reaches further until it has k
values that aren't common, first inside its sketch, then over its full set. Lists of other
values are therefore short; in lists of common ones stand only classes that are made of
common values almost wholly, groups of copies as a rule.

First every member of a list is compared with one member, which joins a group of copies in
linear time; a second round does so for the members of long lists left over. Then the pairs
that are still of different components are compared, in short lists by a join, in long ones
exactly by blocks: full sets of two blocks of about ``BLOCK`` members meet in one task if
some list has members of different components in both, so a pair meets once, however many
lists it shares. A group made of common values whose members aren't linked costs all its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from voxtable.plans.components import connected_components
from voxtable.plans.skew import skew_join
from voxtable.plans.storage import arrow_batches, drop_staged, packed, resident, scratch, small_side, staged, trimmed, unpacked

#: Values for estimates; a value posted by more classes at a time is common; members of a list that is compared by a join.
SKETCH, LIST, SHORT = 128, 32, 64
#: How far below the wanted similarity an estimate may be; values that two similar
#: documents share of their 16 smallest.
MARGIN, SHARED16 = 0.2, 3
#: Members and shingles of a block, about; values that are counted at a time.
BLOCK, BLOCK_SHINGLES, COLUMNS = 128, 1 << 20, 4096
CACHED_WORDS = 100_000


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the shingles of the whole text."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.empty(0, np.int64)
    h = np.fromiter(map(resident("words", _WordHash).__getitem__, tokens), np.uint64, len(tokens))
    width = min(words, len(tokens))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i]
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out >> np.uint64(1)).view(np.int64)


def posted(n: int, per_cent: int) -> int:
    """Two similar sets share one of so many smallest values of each."""
    return n - -(-n * per_cent // 100) + 1


def _shingled(docs: DataFrame, words: int, per_cent: int | None = None) -> DataFrame:
    """``docs`` (_id, _t) as (_id, _n, _d: digest of the set, _sk: sketch, with no ``per_cent`` the full set).

    A sketch has the posted values and a quarter more, ``SKETCH`` at least.
    """

    def kept(s: np.ndarray) -> np.ndarray:
        if per_cent is None:
            return s
        k = posted(len(s), per_cent)
        return s[: max(SKETCH, k + k // 4 + 8)]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingle_set(t, words) for t in part["_t"].to_pylist()]
                digests = [hashlib.md5(s.tobytes()).digest() for s in sets]
                arrays = [part["_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([kept(s) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["_id", "_n", "_d", "_sk"])

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.select("_id", "_t").mapInArrow(build, f"_id {kind}, _n long, _d binary, _sk array<long>")


def _similar_sizes(a: Column, b: Column, per_cent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * per_cent


class _Verifier:
    """Exact similarity of pairs of classes; texts are read again for the candidates alone."""

    def __init__(self, docs: DataFrame, classes: DataFrame, words: int, per_cent: int):
        self.docs, self.classes, self.words, self.per_cent = docs, classes, words, per_cent

    def compared(self, pairs: DataFrame) -> DataFrame:
        """Of ``pairs`` (a, b), distinct, those that are similar."""
        side = lambda k: self.classes.select(F.col("c").alias(k), F.col("_n").alias(f"n{k}"), F.slice("_sk", 1, SKETCH).alias(f"s{k}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").filter(_similar_sizes(F.col("na"), F.col("nb"), self.per_cent))
        likely = staged(both.filter(_estimate("sa", "sb") >= self.per_cent / 100 - MARGIN).select("a", "b"), "near-likely")
        if likely.isEmpty():
            return likely
        sets = self.sets(likely.select(F.col("a").alias("c")).unionByName(likely.select(F.col("b").alias("c"))).distinct())
        full = lambda k: sets.select(F.col("c").alias(k), F.col("_n").alias(f"n{k}"), F.col("_sk").alias(f"s{k}"))
        exact = likely.join(full("a"), "a").join(full("b"), "b")
        inter = F.size(F.array_intersect("sa", "sb"))
        scored = exact.select("a", "b", (inter * 100).alias("i"), (F.col("na") + F.col("nb") - inter).alias("u"))
        out = staged(scored.filter(F.col("i") >= F.col("u") * self.per_cent).select("a", "b"), "near-compared")
        drop_staged(sets)
        return out

    def sets(self, wanted: DataFrame) -> DataFrame:
        """Full sets (c, _n, _sk) of the classes ``wanted`` (c); staged."""
        reps = small_side(staged(wanted.join(self.classes, "c").select("c", "_d", F.col("_rep.i").alias("_ri")), "near-reps"))
        docs = self.docs.join(reps, self.docs["_id"].eqNullSafe(reps["_ri"]), "left_semi")
        with arrow_batches(docs.sparkSession):
            full = _shingled(docs, self.words).join(reps.select("c", "_d"), "_d")
            return staged(full.dropDuplicates(["c"]).select("c", "_n", "_sk"), "near-sets")


def _estimate(a: str, b: str) -> Column:
    """Similarity estimated on the sketch of the union of two sketches."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    return F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union)


class _Reach:
    """The values that every class posts in the order of its own hash, and which of all are common.

    Level 0 are the first ``_k`` values, level 1 the whole sketch, level 2 the full set.
    """

    def __init__(self, check: _Verifier, classes: DataFrame):
        self.check, self.classes = check, classes
        self.tails: list[DataFrame] = []
        self.state = self.common = None
        fresh = classes.select(F.explode(F.slice("_sk", 1, F.col("_k"))).alias("v"))
        while True:
            lists = fresh.groupBy("v").agg(F.count(F.lit(1)).alias("len")).filter(F.col("len") > LIST)
            if self.common is not None:
                lists = lists.unionByName(self.common).groupBy("v").agg(F.max("len").alias("len"))
            self.common = staged(lists, "near-common")
            hits = self.met(self.values()).groupBy("c", "_n", "_k", "reach", "level").agg(F.count(F.lit(1)).alias("hits"))
            up = (F.col("reach") - F.col("hits") < F.col("_k")) & (F.col("reach") < F.col("_n"))
            state = staged(hits.select("c", (F.col("level") + up.cast("int")).alias("level"), "hits", up.alias("up")), "near-state")
            self.state = small_side(state)
            turns = {r["level"] for r in state.filter("up").select("level").distinct().collect()}
            if not turns:
                return
            fresh = classes.join(self.state.filter("up and level = 1"), "c").select(F.explode(F.expr("slice(_sk, _k + 1, size(_sk))")).alias("v"))
            if 2 in turns:
                shown = classes.select("c", "_k", F.size("_sk").alias("_at"))
                tail = check.sets(state.filter("up and level = 2").select("c")).join(shown, "c")
                tail = staged(tail.select("c", "_n", "_k", "_at", F.expr("slice(_sk, _at + 1, size(_sk))").alias("tail")), "near-tails")
                self.tails.append(tail)
                fresh = fresh.unionByName(tail.select(F.explode("tail").alias("v")))

    def values(self) -> DataFrame:
        """All values within reach: (c, _n, _k, reach, level, hits, pos, v)."""
        rows = self.classes
        if self.state is None:
            rows = rows.withColumns({"level": F.lit(0), "hits": F.lit(0).cast("long")})
        else:
            rows = rows.join(self.state.drop("up"), "c", "left").withColumns({"level": F.coalesce("level", F.lit(0)), "hits": F.coalesce("hits", F.lit(0).cast("long"))})
        reach = F.expr("case level when 0 then least(_k, _n) when 1 then size(_sk) else _n end").cast("long")
        head = F.slice("_sk", 1, F.expr("if(level = 0, _k, size(_sk))"))
        out = rows.select("c", "_n", "_k", reach.alias("reach"), "level", "hits", F.posexplode(head).alias("pos", "v"))
        for tail in self.tails:
            more = tail.select("c", "_n", "_k", F.col("_n").alias("reach"), F.lit(2).alias("level"), "_at", F.posexplode("tail").alias("pos", "v"))
            more = more.join(self.state.select("c", "hits"), "c", "left").withColumns({"hits": F.coalesce("hits", F.lit(0).cast("long")), "pos": F.col("pos") + F.col("_at")})
            out = out.unionByName(more.drop("_at"))
        return out

    def met(self, values: DataFrame) -> DataFrame:
        """Those of ``values`` that are common."""
        few = small_side(self.common)
        return values.join(few, "v") if few is not self.common else skew_join(values, self.common, ["v"], "len")


def _lists(check: _Verifier, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of the inverted lists with two members or more, staged: of other values and of common ones.

    (key, c, _n, rank, h, len, pivot, pn, pr), the last three of the list. ``rank``: at most so
    many of the class's values stand before the key in the agreed order; ``h``: common
    values of the class, 0 in lists of other values. A window holds a list of the first
    kind, as a value is posted by at most LIST classes a turn.
    """
    reach = _Reach(check, classes)
    values = reach.values()
    rank = F.greatest(F.lit(0), F.col("pos") - F.col("hits"))
    rare = values.join(small_side(reach.common.select("v")), "v", "left_anti").filter(rank < F.col("_k"))
    whole = W.partitionBy("key")
    rare = rare.select(F.col("v").alias("key"), "c", "_n", rank.cast("int").alias("rank"), F.lit(0).cast("long").alias("h"))
    first = F.min(F.struct("c", "_n", "rank")).over(whole)
    rare = rare.withColumns({"len": F.count(F.lit(1)).over(whole), "first": first}).filter("len > 1")
    rare = rare.select("key", "c", "_n", "rank", "h", "len", F.col("first.c").alias("pivot"), F.col("first._n").alias("pn"), F.col("first.rank").alias("pr"))
    # Classes that have fewer than _k other values post as many common ones as are missing.
    order = F.row_number().over(W.partitionBy("c").orderBy("pos"))
    poor = reach.met(values.filter(F.col("reach") - F.col("hits") < F.col("_k"))).withColumn("nth", order)
    poor = poor.filter(F.col("nth") <= F.col("_k") - F.col("reach") + F.col("hits"))
    poor = staged(poor.select(F.col("v").alias("key"), "c", "_n", F.lit(0).alias("rank"), F.col("hits").alias("h")), "near-poor")
    pivot = F.min_by(F.struct("c", "_n"), F.struct(-F.col("h"), "c"))
    heads = poor.groupBy("key").agg(F.count(F.lit(1)).alias("len"), pivot.alias("first")).filter("len > 1")
    heads = staged(heads.select("key", "len", F.col("first.c").alias("pivot"), F.col("first._n").alias("pn"), F.lit(0).alias("pr")), "near-first")
    poor = skew_join(poor, heads, ["key"], "len")
    return staged(rare, "near-members"), staged(poor, "near-common-members")


def _block_links(per_cent: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Compares all members of one block with those of another: one similar pair for each two components it joins."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        first, second = key[0].as_py(), key[1].as_py()
        names, sets = rows["c"].to_numpy(), rows["_sk"].combine_chunks()
        roots = {c: i for i, c in enumerate(dict.fromkeys(rows["_c"].to_pylist()))}
        root = np.array([roots[c] for c in rows["_c"].to_pylist()])
        block = rows["blk"].to_numpy()
        left, right = np.nonzero(block == first)[0], np.nonzero(block == second)[0]
        size = np.diff(sets.offsets.to_numpy())
        _, code, times = np.unique(sets.flatten().to_numpy(), return_inverse=True, return_counts=True)
        doc = np.repeat(np.arange(len(size)), size)
        doc, code = doc[times[code] > 1], (np.cumsum(times > 1) - 1)[code[times[code] > 1]]
        order = np.argsort(code, kind="stable")
        doc, code = doc[order], code[order]
        both = np.zeros((len(left), len(right)))
        for at in range(0, int((times > 1).sum()), COLUMNS):
            a, b = np.searchsorted(code, (at, at + COLUMNS))
            has = np.zeros((len(size), COLUMNS), np.float32)
            has[doc[a:b], code[a:b] - at] = 1
            both += has[left] @ has[right].T
        union = size[left][:, None] + size[right][None, :] - both
        i, j = np.nonzero((both * 100 >= union * per_cent) & (root[left][:, None] != root[right][None, :]))
        i, j = left[i], right[j]
        low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        _, once = np.unique(low * len(roots) + high, return_index=True)
        top, found = list(range(len(roots))), []
        for at in once.tolist():
            ends = []
            for r in (int(low[at]), int(high[at])):
                while top[r] != r:
                    top[r] = r = top[top[r]]
                ends.append(r)
            if ends[0] != ends[1]:
                top[ends[1]] = ends[0]
                found.append(at)
        return pa.table({k: pa.array([names[v[at]] for at in found], pa.int64()) for k, v in (("a", i), ("b", j))})

    return run


def _block_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks (c, _c, blk) of the members ``rows`` (key, c, _n, _c, len) of long lists, and the pairs (first, second) to compare.

    Members of a component that fills blocks have blocks of their own, others share those of their longest list.
    """
    home = staged(rows.groupBy("c").agg(F.any_value("_n").alias("_n"), F.any_value("_c").alias("_c"), F.max_by("key", F.struct("len", "key")).alias("g")), "near-home")
    parts = staged(home.groupBy("g", "_c").agg(F.count(F.lit(1)).alias("k"), F.sum("_n").alias("s")).withColumn("own", F.col("k") >= BLOCK), "near-parts")
    lists = staged(parts.groupBy("g").agg(F.count(F.lit(1)).alias("w"), *[F.sum(F.when(~F.col("own"), F.col(c))).alias(f"p{c}") for c in "ks"]), "near-parts")
    of = lambda c: F.when(F.col("own"), F.col(c)).otherwise(F.col(f"p{c}"))
    parts = skew_join(parts, lists, ["g"], "w").withColumn("m", F.ceil(F.greatest(of("k") / BLOCK, of("s") / BLOCK_SHINGLES)))
    parts = staged(parts.select("g", "_c", "k", "own", "m"), "near-parts")
    at = F.pmod(F.when(F.col("own"), F.xxhash64("c")).otherwise(F.xxhash64("_c")), F.col("m"))
    blk = F.xxhash64("g", F.when(F.col("own"), F.col("_c")), at).alias("blk")
    home = staged(skew_join(home, parts, ["g", "_c"], "k").select("c", "_c", blk), "near-blocks")
    seats = rows.select("key", "c").join(home, "c").groupBy("key", "blk").agg(F.min("_c").alias("lo"), F.max("_c").alias("hi"))
    seats = staged(seats, "near-seats")
    ordered = [F.least("blk", "blk2").alias("first"), F.greatest("blk", "blk2").alias("second")]
    mixed = seats.filter("lo <> hi").select("key", "blk").join(seats.select("key", F.col("blk").alias("blk2")), "key")
    solo = staged(seats.filter("lo = hi").groupBy("key", "lo").agg(F.collect_list("blk").alias("x")), "near-solo")
    solo = solo.join(solo.toDF("key", "lo2", "x2"), "key").filter("lo < lo2").select(F.explode("x").alias("blk"), "x2").select("blk", F.explode("x2").alias("blk2"))
    pairs = mixed.select(*ordered).unionByName(solo.select(*ordered)).distinct()
    return home, staged(pairs, "near-block-pairs")


def _long_lists(check: _Verifier, rows: DataFrame) -> DataFrame:
    """Similar pairs (a, b) that join components, of all pairs of ``rows`` that share a list; exact."""
    home, pairs = _block_pairs(rows)
    sets = staged(check.sets(home.select("c")).join(home, "c").select("blk", "c", "_c", "_sk"), "near-block-sets")
    meet = pairs.select("first", "second", F.explode(F.array_distinct(F.array("first", "second"))).alias("blk")).join(sets, "blk")
    found = meet.select("first", "second", "blk", "c", "_c", "_sk").groupBy("first", "second").applyInArrow(_block_links(check.per_cent), "a long, b long")
    with arrow_batches(rows.sparkSession):
        found = staged(found, "near-long-links")
    drop_staged(sets)
    return found


def _united(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) with the same components and fewer edges: stars of what meets in a task."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := top.setdefault(x, x)) != x:
                top[x] = x = top[y]
            return x

        for batch in batches:
            for u, v in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), strict=True):
                a, b = find(u), find(v)
                top[max(a, b)] = min(a, b)
        nodes = [x for x in top if find(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["u", "v"])

    return edges.select("u", "v").distinct().mapInArrow(unite, "u long, v long")


class _Joined:
    """Components (c, _c) of the links found so far; new links join components."""

    def __init__(self, spark: SparkSession):
        self.known = spark.createDataFrame([], "c long, _c long")

    def root(self, rows: DataFrame, c: str, out: str) -> DataFrame:
        return rows.join(self.known.toDF(c, out), c, "left").withColumn(out, F.coalesce(out, c))

    def add(self, links: DataFrame) -> bool:
        if links.isEmpty():
            return False
        ends = self.root(self.root(links, "a", "u"), "b", "v")
        above = staged(connected_components(_united(ends)).toDF("_c", "_top"), "near-joined")
        old = self.known.join(above, "_c", "left").select("c", F.coalesce("_top", "_c").alias("_c"))
        new = above.join(self.known.select(F.col("c").alias("_c")), "_c", "left_anti").toDF("c", "_c")
        self.known = staged(old.unionByName(new), "near-known")
        return True


def _components_of(docs: DataFrame, classes: DataFrame, words: int, per_cent: int) -> DataFrame:
    """(c, _c) for all classes that are linked with another."""
    check = _Verifier(docs, classes, words, per_cent)
    rare, common = _lists(check, classes)
    hot = not common.isEmpty()
    ordered = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    def possible(n: str, r: str, n2: str, r2: str) -> Column:
        """Sizes agree, and enough of both sets is left from the key on, should it be the first that they share."""
        least = F.least(F.col(n) - F.col(r), F.col(n2) - F.col(r2)) * (100 + per_cent)
        return _similar_sizes(F.col(n), F.col(n2), per_cent) & (least >= (F.col(n) + F.col(n2)) * per_cent)

    others = rare.unionByName(common) if hot else rare
    others = others.filter((F.col("c") != F.col("pivot")) & possible("_n", "rank", "pn", "pr"))
    star = staged(others.select(*ordered(F.col("c"), F.col("pivot"))).distinct(), "near-star")
    joined = _Joined(docs.sparkSession)
    joined.add(check.compared(star))

    def mixed_common() -> DataFrame:
        """Members of lists of common values with several components."""
        rows = staged(joined.root(common, "c", "_c"), "near-grown")
        mixed = rows.groupBy("key").agg(F.min("_c").alias("lo"), F.max("_c").alias("hi"), F.count(F.lit(1)).alias("_w")).filter("lo <> hi")
        return staged(skew_join(rows, staged(mixed.select("key", "_w"), "near-mixed"), ["key"], "_w").drop("_w"), "near-grown")

    # Short lists: pairs of different components. Most of the 16 smallest values of similar sets agree.
    whole = W.partitionBy("key")
    short = joined.root(rare, "c", "_c").withColumns({"lo": F.min("_c").over(whole), "hi": F.max("_c").over(whole)}).filter("lo <> hi")
    short = short.select("key", "c", "_n", "rank", "_c")
    if hot:
        wide = mixed_common()
        short = short.unionByName(wide.filter(F.col("len") <= SHORT).select("key", "c", "_n", "rank", "_c"))
    small = classes.select("c", F.expr("transform(slice(_sk, 1, 16), x -> cast(x & 32767 as short))").alias("s"))
    short = staged(short.join(small, "c"), "near-short")
    other = short.select(*[F.col(c).alias(f"{c}2") if c != "key" else F.col(c) for c in short.columns])
    alike = (F.least("_n", "_n2") < 16) | (F.size(F.array_intersect("s", "s2")) >= SHARED16)
    pairs = short.join(other, "key").filter((F.col("c") < F.col("c2")) & (F.col("_c") != F.col("_c2")) & possible("_n", "rank", "_n2", "rank2") & alike)
    pairs = pairs.select(F.col("c").alias("a"), F.col("c2").alias("b"))
    if hot:  # A second pivot for the members of long lists that the first one left over.
        wide = wide.filter(F.col("len") > SHORT)
        heads = staged(wide.filter("c = pivot").select("key", F.col("_c").alias("_pc"), F.col("len").alias("_w")), "near-heads")
        left = staged(skew_join(wide, heads, ["key"], "_w").filter("_c <> _pc").select("key", "c", "h"), "near-left")
        pivot = F.min_by("c", F.struct(-F.col("h"), "c")).alias("pivot")
        second = staged(left.groupBy("key").agg(F.count(F.lit(1)).alias("len"), pivot).filter("len > 1"), "near-second")
        pairs = pairs.unionByName(skew_join(left, second, ["key"], "len").filter("c <> pivot").select(*ordered(F.col("c"), F.col("pivot"))))
    rest = staged(pairs.distinct().join(star, ["a", "b"], "left_anti"), "near-rest")
    joined.add(check.compared(rest))
    if hot:  # Long lists: all pairs of different components.
        wide = mixed_common().filter(F.col("len") > SHORT).select("key", "c", "_n", "_c", "len")
        if not wide.isEmpty():
            joined.add(_long_lists(check, wide))
    return joined.known


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, per_cent: int = 80) -> DataFrame:
    """One row per row: ``id_col, n_shingles, component_id, kept``.

    Texts are lower-cased (A-Z) and cut at ASCII white space; a document's set holds its
    distinct shingles of ``words`` words, or all its words if they are fewer. Documents are
    linked if the intersection of their sets is at least ``per_cent`` of the union;
    ``component_id`` is the smallest id reachable. Texts without a word are linked with
    nothing. Null ids rank behind all others, rows of one id and set are one document:
    ``kept`` is true for both. An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    rows, result = _components(texts, words, per_cent)
    none = rows.filter("_n = 0").withColumn("_top", F.col("_id"))
    out = skew_join(rows.filter("_n > 0"), result, ["_d"], "_rows").select("_id", "_n", "_d", "_top").unionByName(none)
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.col("_top").alias("component_id"), F.col("_id").eqNullSafe(F.col("_top")).alias("kept"))


def _components(texts: DataFrame, words: int, per_cent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (_id, _n, _d) and, by set, (_d, _rows, _top: smallest id of the component)."""
    spark = texts.sparkSession
    with scratch(spark) as keep:
        with arrow_batches(spark):
            sketched = staged(_shingled(texts, words, per_cent), "near-sketched")
        rep = F.min(F.struct(F.col("_id").isNull().alias("z"), F.col("_id").alias("i"))).alias("_rep")
        grouped = sketched.filter("_n > 0").groupBy("_d").agg(F.any_value("_n").alias("_n"), F.any_value("_sk").alias("_sk"), rep, F.count(F.lit(1)).alias("_rows"))
        posts = F.expr(f"_n - (_n * {per_cent} + 99) div 100 + 1").cast("int").alias("_k")
        classes = staged(grouped.select(F.monotonically_increasing_id().alias("c"), posts, *grouped.columns), "near-classes")
        rows = keep(staged(sketched.select("_id", "_n", "_d"), "near-rows"))
        drop_staged(sketched)
        roots = _components_of(texts, classes, words, per_cent)
        tied = classes.select("c", "_d", "_rows", F.col("_rep.i").alias("_id")).join(roots.toDF("c", "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
        tops = tied.groupBy("root").agg(F.min("_id").alias("_top"))
        return rows, keep(staged(tied.join(tops, "root").select("_d", "_rows", "_top"), "near-result"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, per_cent: int = 80) -> DataFrame:
    """``docs`` with one row of every component, that of the smallest id; all columns as they were."""
    report = staged(near_duplicates(docs, id_col, text_col, words, per_cent), "near-report")
    gone = small_side(staged(report.filter(~F.col("kept")).select(F.col(id_col).alias("_k")).distinct(), "near-gone"))
    rows = packed(docs, _id=F.col(id_col))
    left = rows.join(gone, rows["_id"].eqNullSafe(gone["_k"]), "left_anti")
    twice = staged(report.filter("kept and n_shingles > 0").groupBy(F.col(id_col).alias("_k")).count().filter("count > 1").drop("count"), "near-twice")
    if twice.isEmpty():
        return unpacked(left)
    same = left["_id"].eqNullSafe(twice["_k"])
    once = left.join(twice, same, "left_semi").dropDuplicates(["_id"])
    return unpacked(left.join(twice, same, "left_anti").unionByName(once))
