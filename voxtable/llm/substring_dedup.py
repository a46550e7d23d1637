"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text: it doubles and adds a random number for each
byte, so that its high bits depend on the last ``WINDOW`` bytes alone. A chunk ends where
``BITS`` of them are zero: boundaries move with the content, an insertion changes only the
chunks around it. Chunks are counted by digest over all documents. The first occurrence of
a chunk, by document id and place, is kept. A run of later occurrences is a repeated
passage if it covers at least ``LEAST_WORDS`` words.

A passage also covers parts of the chunks around its run, so a shorter run may belong to
one. All chunks of such runs are anchors: wherever one occurs, in any document, each window
of ``LEAST_WORDS`` words that covers it gets a 128-bit digest of its bytes. Equal windows
are found by grouping these digests, so it doesn't matter where else a chunk stands; the
first window by document id and place is kept, later ones are passages, joined where they
overlap. No occurrence is compared with another one, so hot chunks cost no pairs. A passage
is lost only if no whole chunk lies inside of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, Window as W
from pyspark.sql.types import StringType

from voxtable.plans.skew import skew_join
from voxtable.plans.storage import arrow_batches, drop_staged, packed, small_side, staged, trimmed, unpacked

WINDOW, BITS = 16, 5
#: Chunks hold at most so many bytes; words of a run that count as a passage.
LONGEST, LEAST_WORDS = 512, 20
SEED = 11
#: The bit table that spares chunks without a repetition the shuffle has 2**TABLE_BITS words of 64 bits (2 MB).
#: Where repeated digests outnumber its bits it spares less; results don't depend on it.
TABLE_BITS = 18
#: Rows without an id are ordered behind all ids, by a hash of their text.
NO_ID = 1 << 62
GEAR = np.random.default_rng(SEED).integers(0, 1 << WINDOW, 256, dtype=np.uint16)
#: Tables by byte: the two halves of GEAR, and 1 for white space. ``translate`` is faster than indexing by bytes.
LOW, HIGH, BLANK = bytes(GEAR.astype(np.uint8)), bytes((GEAR >> 8).astype(np.uint8)), bytes(c == 32 or 9 <= c <= 13 for c in range(256))
BLOCK = 1 << 20
#: Rows that a task holds before it sends them on.
HELD = 100_000


def _steps(a: np.ndarray) -> np.ndarray:
    """Differences of the items, the first one from 0."""
    out = a.copy()
    out[1:] -= a[:-1]
    return out


def boundaries(data: bytes) -> np.ndarray:
    """Ends of the chunks of ``data``, the last one its length."""
    if not data:
        return np.empty(0, np.int64)
    cuts = []
    for at in range(0, len(data), BLOCK):
        start = max(0, at - WINDOW + 1)
        part = data[start : at + BLOCK]
        h = np.frombuffer(part.translate(HIGH), np.uint8).astype(np.uint16)
        h <<= np.uint16(8)
        h |= np.frombuffer(part.translate(LOW), np.uint8)
        step = 1
        while step < WINDOW:  # after each turn h covers twice as many bytes
            h[step:] += h[:-step] << np.uint16(step)
            step *= 2
        ends = np.flatnonzero(h < 1 << WINDOW - BITS) + start + 1
        cuts.append(ends[ends > at] if at else ends)
    if not len(cuts[-1]) or cuts[-1][-1] < len(data):
        cuts.append(np.array([len(data)]))
    ends = np.concatenate(cuts) if len(cuts) > 1 else cuts[0]
    wide = _steps(ends)
    if wide.max() > LONGEST:  # texts without boundaries are cut at fixed places
        more = [np.arange(e - w + LONGEST, e, LONGEST) for e, w in zip(ends[wide > LONGEST], wide[wide > LONGEST], strict=True)]
        ends = np.unique(np.concatenate([ends, *more]))
    return ends


def _digests(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and digests of the chunks of ``data``."""
    ends = boundaries(data)
    starts = ends - _steps(ends)
    digests = b"".join([xxhash.xxh64_digest(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return starts, ends, np.frombuffer(digests, ">u8").astype(np.uint64)


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the words of ``data``, and their ends."""
    blank = np.frombuffer(data.translate(BLANK), np.bool_)
    head = ~blank
    tail = head.copy()
    head[1:] &= blank[:-1]
    tail[:-1] &= blank[1:]
    return np.flatnonzero(head), np.flatnonzero(tail) + 1


def _marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    return bits[h >> np.uint64(64 - TABLE_BITS)].view(np.uint64) >> (h & np.uint64(63)) & np.uint64(1) == 1


def chunks(docs: DataFrame, table: bytes | None = None) -> DataFrame:
    """``docs`` (_id, _t) as (_id, _x: hash of the text, _k: place of the chunk, _from, _h: digest,
    _p: its bytes, its words and those of the chunks before and after, ten bits each, and 1 if the text has an equal chunk before).

    With ``table``, a bit table of digests, only chunks whose bit is set.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(table) if table else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shipped.value, np.int64) if shipped else None
        for batch in trimmed(batches):
            ids, parts, held = [], [], 0
            for i, text in zip(batch["_id"].to_pylist(), batch["_t"].to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "replace")
                starts, ends, h = _digests(data)
                if bits is None:
                    part = (h,)
                else:
                    # Words that start in a chunk.
                    words = _steps(np.searchsorted(_words(data)[0], ends))
                    seen = _marked(bits, h)
                    x = np.full(len(ends), xxhash.xxh64_intdigest(data), np.uint64).view(np.int64)
                    around = np.concatenate([[0], words, [0]])
                    facts = (ends - starts) | words << 10 | around[:-2] << 20 | around[2:] << 30 | _met_before(h) << 40
                    part = tuple(v[seen] for v in (h, x, np.arange(len(ends)), starts, facts))
                ids.append(i)
                parts.append(part)
                held += len(part[0])
                if held > HELD:
                    yield _frame(ids, parts)
                    ids, parts, held = [], [], 0
            if ids:
                yield _frame(ids, parts)

    names = "_h long" if table is None else "_h long, _x long, _k int, _from long, _p long"
    return docs.mapInArrow(cut, f"_id long, {names}")


def _frame(ids: list, parts: list) -> pa.RecordBatch:
    columns = {n: np.concatenate(v) for n, v in zip(("_h", "_x", "_k", "_from", "_p"), zip(*parts, strict=True), strict=False)}
    columns["_h"] = columns["_h"].view(np.int64)
    place = np.repeat(np.arange(len(ids)), [len(p[0]) for p in parts])
    arrays = [pa.array(v.astype(np.int32) if n == "_k" else v) for n, v in columns.items()]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).take(pa.array(place)), *arrays], ["_id", *columns])


def bit_table(digests: DataFrame) -> bytes:
    """A table of 2**TABLE_BITS words with a bit set for every ``_h``; its size is fixed."""
    word = F.shiftrightunsigned("_h", 64 - TABLE_BITS)
    found = digests.groupBy(word.cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_h & 63 as int))")).alias("b")).toPandas()
    out = np.zeros(1 << TABLE_BITS, np.int64)
    out[found["w"].to_numpy()] = found["b"].to_numpy()
    return out.tobytes()


def _signed(data: bytes) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(data)).view(np.int64))


def covering(data: bytes, starts: np.ndarray, ends: np.ndarray, anchor: np.ndarray, again: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Windows of ``size`` words that cover an ``anchor`` chunk and hold no chunk that can't be repeated with them.

    Number of the first word, first byte, end, anchors covered. A window that occurs
    elsewhere has the same boundaries there, but for those in its first ``WINDOW`` bytes,
    so all chunks between them occur there too: they must be among those marked ``again``.
    """
    heads, tails = _words(data)
    one, other = np.searchsorted(tails, starts[anchor], "right"), np.searchsorted(heads, ends[anchor]) - 1
    low = np.maximum(np.maximum(one, other) - size + 1, 0)
    high = np.minimum(np.minimum(one, other), len(heads) - size)
    low, high = low[low <= high], high[low <= high]
    change = np.zeros(len(heads) + 1, np.int64)
    np.add.at(change, low, 1)
    np.add.at(change, high + 1, -1)
    count = np.cumsum(change)
    at = np.nonzero(count)[0]
    # Places of cuts without a boundary, and the end of the text, depend on bytes outside.
    bound = ~again & (_steps(starts) < LONGEST) & (ends < len(data))
    single = np.concatenate([[0], np.cumsum(bound)])
    before, behind = np.searchsorted(starts, heads[at] + WINDOW), np.searchsorted(ends, tails[at + size - 1], "right")
    at = at[single[np.maximum(before, behind)] == single[before]]
    return at, heads[at], tails[at + size - 1], count[at]


WINDOWS = ("_w1", "_w2", "_x", "_n", "_from", "_to", "_c", "_r")


def windows(docs: DataFrame, anchors: bytes, repeated: bytes, size: int) -> DataFrame:
    """Windows of ``size`` words of ``docs`` (_id, _t) around chunks whose bit is set in ``anchors``, all of it ``repeated``.

    (_id, _w1, _w2: digest, _x: hash of the text, _n: number of the first word, _from, _to, _c: such chunks,
    _r: 1 if the text has an equal window before).
    """
    shipped = docs.sparkSession.sparkContext.broadcast((anchors, repeated))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor_bits, bits = (np.frombuffer(b, np.int64) for b in shipped.value)
        for batch in trimmed(batches):
            ids, parts, held = [], [], 0
            for i, text in zip(batch["_id"].to_pylist(), batch["_t"].to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "replace")
                starts, ends, h = _digests(data)
                anchor = _marked(anchor_bits, h)
                if not anchor.any():
                    continue
                found, x = covering(data, starts, ends, anchor, _marked(bits, h), size), _signed(data)
                digests = b"".join([xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(found[1].tolist(), found[2].tolist(), strict=True)])
                w = np.frombuffer(digests, np.int64).reshape(-1, 2)
                columns = (w[:, 0], w[:, 1], np.full(len(w), x), *found, _met_before(w))
                for at in range(0, len(w), HELD):
                    ids.append(i)
                    parts.append(tuple(v[at : at + HELD] for v in columns))
                    held += len(parts[-1][0])
                    if held >= HELD:
                        yield _long_frame(ids, parts)
                        ids, parts, held = [], [], 0
            if ids:
                yield _long_frame(ids, parts)

    return docs.mapInArrow(read, "_id long, " + ", ".join(f"{c} long" for c in WINDOWS))


def _met_before(w: np.ndarray) -> np.ndarray:
    """1 for rows of ``w`` (one column or two) that equal an earlier one."""
    order = np.argsort(w, kind="stable") if w.ndim == 1 else np.lexsort((w[:, 1], w[:, 0]))
    same = w[order[1:]] == w[order[:-1]]
    out = np.zeros(len(w), np.int64)
    out[order[1:][same if w.ndim == 1 else same.all(axis=1)]] = 1
    return out


def _likely(rows: DataFrame, table: bytes) -> DataFrame:
    """``rows`` whose _w1 has its bit in ``table``: spares the others the shuffle."""
    shipped = rows.sparkSession.sparkContext.broadcast(table)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shipped.value, np.int64)
        for batch in batches:
            yield batch.filter(pa.array(_marked(bits, batch["_w1"].to_numpy().view(np.uint64))))

    return rows.mapInArrow(keep, rows.schema)


def _long_frame(ids: list, parts: list) -> pa.RecordBatch:
    own = np.repeat(np.arange(len(ids)), [len(p[0]) for p in parts])
    columns = [np.concatenate(v).astype(np.int64) for v in zip(*parts, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).take(pa.array(own)), *map(pa.array, columns)], ["_id", *WINDOWS])


def _first_copies(docs: DataFrame) -> DataFrame:
    """``docs`` (_id, _t) without the later copies of equal texts: their whole text is one run, and all their windows are in the first copy."""
    facts = {"_y": F.xxhash64("_t"), "_z": F.hash("_t"), "_l": F.octet_length("_t")}
    keys = staged(docs.filter("_t is not null").select("_id", *[c.alias(n) for n, c in facts.items()]), "chunk-texts")
    groups = staged(keys.groupBy(*facts).agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_len")).filter("_len > 1"), "chunk-text-groups")
    later = staged(skew_join(keys, groups, list(facts), "_len").filter("_id > _keep").select("_id", *facts).distinct(), "chunk-text-copies")
    return docs.withColumns(facts).join(small_side(later), ["_id", *facts], "left_anti").select("_id", "_t")


def _extended(docs: DataFrame, anchors: DataFrame, repeated: bytes, sure: DataFrame, least_words: int) -> DataFrame:
    """Repeated windows around the ``anchors`` (_h), joined where they overlap, without those inside of a ``sure`` passage."""
    with arrow_batches(docs.sparkSession):
        all_ = staged(windows(_first_copies(docs), bit_table(anchors), repeated, least_words), "chunk-windows")
    lists = all_.groupBy("_w1", "_w2").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_len"))
    met = staged(lists.filter("_len > 1"), "chunk-window-lists")
    again = skew_join(_likely(all_, bit_table(met.withColumnRenamed("_w1", "_h"))), met, ["_w1", "_w2"], "_len").filter("_id != _first or _r = 1")
    again = again.drop("_w1", "_w2", "_len", "_r")
    along = W.partitionBy("_id", "_x").orderBy("_from")
    end = F.max("_to").over(along.rowsBetween(W.unboundedPreceding, -1))
    # Rows that repeat both id and text have equal places.
    island = F.sum(F.when(F.col("_from") <= F.col("_end"), 0).otherwise(1)).over(along.rowsBetween(W.unboundedPreceding, 0))
    spans = again.withColumn("_end", end).withColumn("_island", island).groupBy("_id", "_x", "_island").agg(
        F.min("_from").alias("start_byte"),
        F.max("_to").alias("end_byte"),
        (F.max("_n") - F.min("_n") + least_words).alias("n_words"),
        F.max("_c").alias("n_chunks"),
        F.mode("_first", True).alias("first_id"),
    )
    both = spans.select("_id", "_x", *SPAN, F.lit(1).alias("_w")).unionByName(sure.withColumn("_w", F.lit(0)))
    before = W.partitionBy("_id", "_x").orderBy("start_byte", "_w").rowsBetween(W.unboundedPreceding, -1)
    reach = F.max(F.when(F.col("_w") == 0, F.col("end_byte"))).over(before)
    found = both.withColumn("_reach", reach).filter("_w = 1 and coalesce(_reach < end_byte, true)")
    out = staged(found.select("_id", "_x", *SPAN), "chunk-extended")
    drop_staged(all_)
    drop_staged(met)
    return out


SPAN = ("start_byte", "end_byte", "n_words", "n_chunks", "first_id")


def _identified(docs: DataFrame, id_col: str, text_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col).bitwiseAND(F.lit(NO_ID - 1)) + NO_ID)


def _passages(rows: DataFrame, least_words: int) -> DataFrame:
    """Repeated passages of ``rows`` (_id, _t): (_id, _x, ``SPAN``)."""
    lists = chunks(rows).groupBy("_h").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_len"))
    met = staged(lists.filter("_len > 1"), "chunk-lists")
    repeated = bit_table(met)
    cut = staged(chunks(rows, repeated), "chunks")
    ten = lambda i: F.shiftright("_p", 10 * i).bitwiseAND(1023)
    again = skew_join(cut, met, ["_h"], "_len").drop("_len")
    # Runs are by document: one shuffle serves all windows.
    if rows.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        again = again.filter((F.col("_id") != F.col("_first")) | (ten(4) == 1)).repartition("_id", "_x")
    else:  # rows can repeat both id and text: the chunks of the second one occur again
        place = F.row_number().over(W.partitionBy("_id", "_x", "_h").orderBy("_k"))
        again = again.repartition("_id", "_x").withColumn("_n", place).filter((F.col("_id") != F.col("_first")) | (F.col("_n") > 1))
    again = again.withColumns({"_to": F.col("_from") + ten(0), "_words": ten(1), "_before": ten(2), "_after": ten(3)})
    along = W.partitionBy("_id", "_x").orderBy("_k")
    # Rows that repeat both id and text have equal places: they count once.
    new = F.coalesce(F.lag("_k").over(along) != F.col("_k"), F.lit(True)).cast("int")
    run = again.withColumns({"_run": F.col("_k") - F.dense_rank().over(along), "_new": new})
    spans = run.groupBy("_id", "_x", "_run").agg(
        F.min("_from").alias("start_byte"),
        F.max("_to").alias("end_byte"),
        F.sum(F.col("_words") * F.col("_new")).alias("n_words"),
        F.sum("_new").alias("n_chunks"),
        F.mode("_first", True).alias("first_id"),
        F.collect_set("_h").alias("_anchors"),  # a document has no more of them than chunks
        (F.min_by("_before", "_k") + F.max_by("_after", "_k")).alias("_around"),
    )
    # The word that a run starts inside of begins in the chunk before.
    runs = staged(spans.filter(F.col("n_words") + F.col("_around") >= least_words), "chunk-runs")
    drop_staged(cut)
    drop_staged(met)
    anchors = staged(runs.filter(F.col("n_words") < least_words).select(F.explode("_anchors").alias("_h")).distinct(), "chunk-anchors")
    sure = runs.filter(F.col("n_words") >= least_words).select("_id", "_x", *SPAN)
    return sure.unionByName(_extended(rows, anchors, repeated, sure, least_words))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per repeated passage: ``id_col, start_byte, end_byte, n_words, n_chunks, first_id``.

    Passages whose whole chunks have ``least_words`` words are measured by these chunks,
    others by their windows of so many words; one of these may reach over the end of one of
    those. ``first_id`` is the document in which most of the passage's chunks or windows
    occur first, ``n_chunks`` the chunks of the run or the most in one window. Ids are
    integers under 2**62; rows of one id are one document, rows with a null id are told
    apart by their text and come last. Null and empty texts have no chunk. Whole texts are
    cut; documents without a repeated passage have no row. An empty table gives an empty
    result.
    """
    rows = docs.select(_identified(docs, id_col, text_col).alias("_id"), F.col(text_col).alias("_t"))
    known = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return _passages(rows, least_words).select(known("_id").alias(id_col), *SPAN[:-1], known("first_id").alias("first_id"))


@F.pandas_udf(StringType())
def _without(texts: pd.Series, xs: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    out = []
    for text, x, start, end in zip(texts, xs, starts, ends, strict=True):
        data = (text or "").encode("utf-8", "replace")
        keep = np.ones(len(data), bool)
        own = _signed(data)
        for i, a, b in zip(x, start, end, strict=True):
            if i == own:
                keep[a:b] = False
        out.append(np.frombuffer(data, np.uint8)[keep].tobytes().decode("utf-8", "ignore"))
    return pd.Series(out)


def drop_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with their repeated passages cut out of the texts, first occurrences stay; all columns as they were.

    A character of which a cut leaves only a part goes too. Texts without a repeated
    passage, null ones included, are unchanged. Ids as for ``repeated_passages``.
    """
    rows = docs.select(_identified(docs, id_col, text_col).alias("_id"), F.col(text_col).alias("_t"))
    spans = _passages(rows, least_words).groupBy("_id").agg(F.collect_list(F.struct("_x", "start_byte", "end_byte")).alias("_s"))
    base = packed(docs, _id=_identified(docs, id_col, text_col)).join(staged(spans, "chunk-cuts"), "_id", "left")
    text = F.col("_row").getField(text_col)
    cut = _without(text, *[F.coalesce(F.col("_s").getField(c), F.array().cast("array<long>")) for c in ("_x", "start_byte", "end_byte")])
    return unpacked(base.select(F.col("_row").withField(text_col, F.when(F.col("_s").isNotNull(), cut).otherwise(text)).alias("_row")))
