"""Exact top-k search in Hamming space by incremental multi-index hashing.

Vectors become binary codes of their signs, of any length: arrays of 64-bit words. Codes are
cut into m segments, so many as cost least in probes and compared codes, and indexed by every segment. A step
probes all values of one segment that differ from the query's in exactly r bits; segments take
turns before r grows. A code not met by the steps up to radius r in segment j (from 0) differs from the
query in at least m r + j + 1 bits: a query is done as soon as its kth verified distance is
smaller. All its nearest codes are found then, for certain, and ties go to the smaller id. Until
then only codes that are at most as far as the kth so far are kept.

The values to probe are made where the queries are, one flipped bit after the other in
ascending order, so nothing that grows with the width of a segment is on the driver or broadcast.
Spark takes them for as few as the queries they are made of; they are counted beforehand, and too
many for a broadcast meet the index by sorting. A pair of codes counts only in the first step and
segment where it meets, which its bits tell without a shuffle.

Equal codes are one entry with their k smallest ids, on the side of the queries too, so a
vector that occurs in a third of the rows costs no more than any other.
"""

from __future__ import annotations

from itertools import accumulate
from math import comb

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voxtable.plans.storage import TASK_ROWS, drop_staged, sorted_side, staged, staged_rows

WORD, SALTS = 64, 64
#: Radii below this are probed in all segments together.
TOGETHER = 3
#: Steps of a radius from there on, each with an equal part of the segments.
TURNS = 8
#: Bits of a segment, about, at least; what making, sending and sorting a probe costs, in codes compared.
LEAST_WIDTH, PROBE = 8, 32


def sign_code(vector: Column, words: int) -> Column:
    """``words`` 64-bit numbers: bit i of word j is set if element 64 j + i is positive; null and missing elements count as 0."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def word(j: int) -> Column:
        bits = F.transform(F.slice(vector, WORD * j + 1, WORD), lambda x, i: F.when(x > 0, F.call_function("shiftleft", one, i)).otherwise(zero))
        return F.aggregate(bits, zero, lambda a, b: a.bitwiseOR(b))

    return F.when(vector.isNotNull(), F.array(*[word(j) for j in range(words)]))


def _bits(code: Column, start: int, end: int) -> Column:
    """Bits ``start`` to ``end`` of a code, fewer than 64, as a number."""
    j, low = divmod(start, WORD)
    value = F.shiftrightunsigned(code[j], low)
    if end > WORD * (j + 1):  # the rest stands in the next word
        value = value.bitwiseOR(F.shiftleft(code[j + 1], WORD - low))
    return value.bitwiseAND(F.lit((1 << (end - start)) - 1))


def _steps(widths: list[int]) -> list[tuple[int, range]]:
    """Radius and segments of each step, in order."""
    m = len(widths)
    turn = -(-m // TURNS)
    return [(r, range(m)) for r in range(TOGETHER)] + [(r, range(j, min(m, j + turn))) for r in range(TOGETHER, max(widths) + 1) for j in range(0, m, turn)]


def _widths(total: int, n: int, k: int) -> list[int]:
    """Widths of the segments of codes of ``total`` bits that would cost a query least, were the n codes random."""
    far, shell, within = 0, 1, 1  # the distance at which the kth would be
    while far < total and n * within < k << total:
        far += 1
        shell = shell * (total - far + 1) // far
        within += shell

    def cost(widths: list[int]) -> float:
        m, spent = len(widths), 0.0
        for r, segments in _steps(widths):
            spent += sum(comb(widths[j], r) * (PROBE + n / 2 ** widths[j]) for j in segments)
            if m * r + segments[-1] >= far:
                break
        return spent

    counts = {max(1, round(total / width)) for width in range(LEAST_WIDTH, max(LEAST_WIDTH, n.bit_length()) + 1)}
    return min(([total * (j + 1) // m - total * j // m for j in range(m)] for m in sorted(counts)), key=cost)


def _first_met(widths: list[int], edges: list[int], r: int) -> Column:
    """If ``_q`` and ``_c``, which differ in r bits of segment ``j``, have not met before, in fewer bits or an earlier segment."""
    m = len(widths)
    met = [F.bit_count(_bits(F.col("_q"), a, b).bitwiseXOR(_bits(F.col("_c"), a, b))) * m + j for j, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    return (F.least(*met) if m > 1 else met[0]) == F.col("j") + r * m


def _flipped(probes: DataFrame, r: int) -> DataFrame:
    """Each row of ``probes`` (s, width, ...) with all values ``s`` that differ in exactly r bits."""
    out = probes.withColumn("_top", F.lit(-1))
    for left in range(r - 1, -1, -1):  # every set of bits once, in ascending order
        first, last = F.col("_top") + 1, F.col("width") - 1 - left
        out = out.withColumn("_top", F.explode(F.when(first <= last, F.sequence(first, last))))
        out = out.withColumn("s", F.col("s").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_top"))))
    return out.drop("_top", "width")


def _first(rows: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= k).drop("_rn")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, id_col, distance``: the k nearest of ``vectors`` for each row of ``queries``.

    Order is by distance, then id. Vectors may have any length; of two different ones the
    shorter has no set bits at the end. Rows with a null id or vector are neither found nor
    asked for; repeated rows are found once. A query finds itself if it is among the vectors. With fewer than k vectors all are returned; empty
    tables give an empty result.
    """
    longest = lambda df: df.agg(F.max(F.size(vector_col))).head()[0] or 0
    total = max(1, longest(vectors), longest(queries))
    words = -(-total // WORD)
    coded = lambda df: df.select(F.col(id_col).alias("_id"), sign_code(F.col(vector_col), words).alias("_c")).filter("_id is not null and _c is not null")
    rows = staged_rows(coded(vectors).distinct(), "codes")
    few = _first(rows.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS))), ["_c", "_salt"], ["_id"], k).drop("_salt")
    ids = staged_rows(_first(few, ["_c"], ["_id"], k), "code-ids")
    codes = staged_rows(ids.select("_c").distinct(), "code-set")
    asked = staged(coded(queries), "query-codes")
    n, rows_in_all = codes._rows, rows._rows
    enough = min(k, rows_in_all)
    widths = _widths(total, n, k)
    m, edges = len(widths), [0, *accumulate(widths)]
    part = lambda c, which: F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(widths[j]).alias("width"), _bits(c, edges[j], edges[j + 1]).alias("s")) for j in which]))
    index = staged_rows(codes.select("_c", part(F.col("_c"), range(m)).alias("p")).select("p.j", "p.s", "_c"), "code-index")
    open_ = staged_rows(asked.select(F.col("_c").alias("_q")).distinct().withColumn("kth", F.lit(total)), "open-queries")
    found = staged(open_.select("_q", F.col("_q").alias("_c"), F.lit(0).alias("distance"), F.lit(0).cast(dict(ids.dtypes)["_id"]).alias("_id")).limit(0), "found")
    finished = []
    for r, segments in _steps(widths):
        if not open_._rows:
            break
        last = (r, segments[-1]) == (max(widths), m - 1)
        made = open_._rows * sum(comb(widths[j], r) for j in segments)
        asking = open_ if made <= TASK_ROWS else open_.repartition(-(-made // TASK_ROWS))  # a small file would be one task
        probes = asking.select("_q", "kth", part(F.col("_q"), segments).alias("p")).select("_q", "kth", "p.*")
        probes = sorted_side(_flipped(probes, r), made)
        lists = index.filter(F.col("j").isin(*segments))
        away = sum((F.bit_count(F.col("_q")[w].bitwiseXOR(F.col("_c")[w])) for w in range(words)), F.lit(0))
        met = probes.join(lists, ["j", "s"]).filter((away <= F.col("kth")) & _first_met(widths, edges, r)).select("_q", "_c", away.alias("distance"))
        met = met.withColumn("_rank", F.rank().over(W.partitionBy("_q").orderBy("distance"))).filter(F.col("_rank") <= k)  # each code has an id
        met = met.join(ids, "_c").select("_q", "_c", "distance", "_id")
        best = staged(_first(met.unionByName(found), ["_q"], ["distance", "_id"], k), "found")
        sure = best.groupBy("_q").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far")).withColumn("far", F.when(F.col("n") >= enough, F.col("far")))
        state = staged(open_.select("_q").join(sure, "_q", "left").select("_q", F.coalesce("far", F.lit(total)).alias("kth"), (F.lit(last) | F.coalesce((F.col("far") <= m * r + segments[-1]) | (F.col("far").isNotNull() & F.lit(enough == rows_in_all)), F.lit(False))).alias("done")), "open-queries")
        finished.append(best.join(state.filter("done").select("_q"), "_q", "left_semi"))
        drop_staged(open_)
        open_ = staged_rows(state.filter("not done").select("_q", "kth"), "open-queries")
        found = best.join(open_.select("_q"), "_q", "left_semi")
    out = finished[0] if finished else found
    for more in finished[1:]:
        out = out.unionByName(more)
    ranked = out.withColumn("rank", F.row_number().over(W.partitionBy("_q").orderBy("distance", "_id")))
    return asked.join(ranked.drop("_c"), asked["_c"] == F.col("_q")).select(asked["_id"].alias("query_id"), "rank", ranked["_id"].alias(id_col), "distance")
