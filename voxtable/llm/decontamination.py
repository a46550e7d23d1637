"""Benchmark decontamination with a positional inverted index of the training tokens.

The index is a table of postings (term, document, position) in segments: every task writes
the postings of the documents that it read, sorted by term, so no list of a frequent term
meets in one task and building it needs no shuffle. A phrase is looked up by its rarest
term first; the list, moved by the term's offset in the phrase, is intersected with that of
the second rarest, and what is left with all others. On the diagonals that remain, matched
places in a row are the occurrences.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voxtable.functions.text import ascii_lower
from voxtable.plans.storage import scratch, small_side, staged

#: Words are runs of digits, letters a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Consecutive words of an item that make a window.
WINDOW = 10


@dataclass
class PositionalIndex:
    """``terms`` (term, tid), ``postings`` (tid, _row, pos from 0) and ``documents`` (_row, the id, n_words)."""

    terms: DataFrame
    postings: DataFrame
    documents: DataFrame


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; a null text has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: DataFrame | None = None) -> PositionalIndex:
    """Postings of every word of every whole document; with ``terms`` (term) only of these, as no other is looked up.

    The words of a document are followed by an empty one, whose posting holds the
    document's id and stands at its number of words: the texts are read once, and
    documents without a word are known too. Rows are numbered as they are written, so
    repeated rows and null ids stay apart. An empty table gives empty tables.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.concat(words(F.col(f"`{text_col}`")), F.array(F.lit(""))).alias("_w"))
    found = rows.select("_row", "_id", F.posexplode("_w").alias("pos", "term"))
    if terms is None:
        found = staged(found, "index-words")
        terms = found.select("term")
    ends = docs.sparkSession.createDataFrame([("",)], "term string")
    names = staged(terms.select("term").unionByName(ends).distinct().withColumn("tid", F.when(F.col("term") == "", F.lit(-1)).otherwise(F.monotonically_increasing_id())), "index-terms")
    listed = found.join(small_side(names), "term").select("tid", "_row", "pos", F.when(F.col("tid") == -1, F.col("_id")).alias("_id"))
    lists = staged(listed.sortWithinPartitions("tid"), "index-postings")
    documents = lists.filter("tid = -1").select("_row", F.col("_id").alias(id_col), F.col("pos").cast("long").alias("n_words"))
    return PositionalIndex(names.filter("tid >= 0"), lists.filter("tid >= 0").select("tid", "_row", "pos"), documents)


def _phrase_terms(index: PositionalIndex, phrases: DataFrame) -> DataFrame:
    """``phrases`` (phrase, at, term) with the terms' numbers and how often they occur; terms that never do have no number."""
    known = phrases.join(small_side(index.terms), "term", "left")
    df = index.postings.groupBy("tid").agg(F.count(F.lit(1)).alias("cf"))
    return staged(known.join(F.broadcast(df) if _few(index.terms) else df, "tid", "left").select("phrase", "at", "tid", F.coalesce("cf", F.lit(0)).alias("cf")), "phrase-terms")


def _few(df: DataFrame, rows: int = 200_000) -> bool:
    return df.limit(rows + 1).count() <= rows


def _windows(terms: DataFrame, size: int) -> DataFrame:
    """Each window of a phrase with its places from the rarest term on: phrase, first, second (structs at, tid).

    A phrase of fewer words than ``size`` is one window. Windows with a term that never
    occurs are left out. Windows of a phrase mostly share their rarest places and appear once.
    """
    place = F.struct("cf", "at", "tid")
    whole = terms.groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("at", "cf", "tid"))).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    windows = whole.select("phrase", F.explode(starts).alias("s"), "w").select("phrase", F.slice("w", F.col("s") + 1, F.lit(size)).alias("w"))
    ranked = windows.filter(~F.exists("w", lambda x: x["cf"] == 0)).select("phrase", F.array_sort(F.transform("w", lambda x: F.struct(x["cf"].alias("cf"), x["at"].alias("at"), x["tid"].alias("tid")))).alias("w"))
    pick = lambda k: F.struct(F.get("w", F.lit(k))["at"].alias("at"), F.get("w", F.lit(k))["tid"].alias("tid"))
    return ranked.select("phrase", pick(0).alias("first"), F.when(F.size("w") > 1, pick(1)).alias("second")).distinct()


def phrase_matches(index: PositionalIndex, phrases: DataFrame, window: int = WINDOW) -> DataFrame:
    """Occurrences of windows of phrases: (_row, phrase, start, length), longest runs of words that windows cover.

    ``phrases`` (phrase, at from 0, term), one row a word. Within a run every ``window``
    consecutive words are an occurrence of a window; a shorter phrase must occur whole.
    Lists are intersected on the diagonal, place in the document minus place in the phrase.
    """
    terms = _phrase_terms(index, phrases)
    lengths = terms.groupBy("phrase").agg(F.count(F.lit(1)).alias("_n"))
    windows = staged(_windows(terms, window), "phrase-windows")
    lists = index.postings
    # Lists of the rarest terms: these are the only ones read whole.
    first = windows.select(F.col("first.tid").alias("tid"), "phrase", F.col("first.at").alias("_at"), "second").distinct()
    found = lists.join(small_side(first), "tid").select("_row", "phrase", (F.col("pos") - F.col("_at")).alias("diagonal"), "second")
    # The second rarest, on the same diagonal.
    alone = found.filter("second is null").select("_row", "phrase", "diagonal")
    asked = found.filter("second is not null").select("_row", "phrase", "diagonal", F.col("second.tid").alias("tid"), (F.col("diagonal") + F.col("second.at")).alias("pos"))
    seconds = staged(windows.filter("second is not null").select(F.col("second.tid").alias("tid")).distinct(), "phrase-seconds")
    other = lists.join(small_side(seconds), "tid", "left_semi")
    both = asked.join(other, ["tid", "_row", "pos"], "left_semi").select("_row", "phrase", "diagonal")
    diagonals = staged(both.unionByName(alone).distinct(), "phrase-diagonals")
    # All other terms of the phrases, on diagonals that are left.
    asked = diagonals.join(small_side(terms), "phrase").select("_row", "phrase", "diagonal", "at", "tid", (F.col("diagonal") + F.col("at")).alias("pos")).filter("tid is not null and pos >= 0")
    rows = staged(diagonals.select("_row").distinct(), "phrase-rows")
    other = lists.join(small_side(rows), "_row", "left_semi")
    met = asked.join(other, ["tid", "_row", "pos"], "left_semi").select("_row", "phrase", "diagonal", "at").distinct()
    order = W.partitionBy("_row", "phrase", "diagonal").orderBy("at")
    runs = met.withColumn("_g", F.col("at") - F.row_number().over(order)).groupBy("_row", "phrase", "diagonal", "_g").agg(F.min("at").alias("_at"), F.count(F.lit(1)).alias("length"))
    whole = runs.join(small_side(lengths), "phrase").filter(F.col("length") >= F.least("_n", F.lit(window)))
    return whole.select("_row", "phrase", (F.col("diagonal") + F.col("_at")).alias("start"), F.col("length").cast("int").alias("length"))


def proximity_matches(index: PositionalIndex, phrases: DataFrame, within: int) -> DataFrame:
    """Places where all terms of a phrase stand near one another: (_row, phrase, pos).

    ``pos`` is a place of the phrase's rarest term; each other term stands at most
    ``within`` words from it, in any order. Places meet in blocks of ``within`` words, so
    the lists are joined by equal keys alone. A phrase with a term that never occurs has none.
    """
    terms = _phrase_terms(index, phrases).groupBy("phrase", "tid").agg(F.max("cf").alias("cf"))
    gone = terms.filter("cf = 0").select("phrase").distinct()
    terms = staged(terms.join(gone, "phrase", "left_anti").withColumn("_k", F.row_number().over(W.partitionBy("phrase").orderBy("cf", "tid"))), "near-terms")
    need = terms.groupBy("phrase").agg(F.count(F.lit(1)).alias("_n"))
    block = F.floor(F.col("pos") / within)
    anchors = staged(index.postings.join(small_side(terms.filter("_k = 1").select("tid", "phrase")), "tid").select("_row", "phrase", "pos"), "near-anchors")
    asked = anchors.join(small_side(terms.filter("_k > 1").select("phrase", "tid")), "phrase").withColumn("_b", F.explode(F.array(block - 1, block, block + 1)))
    other = index.postings.select("tid", "_row", F.col("pos").alias("_p"), F.floor(F.col("pos") / within).alias("_b"))
    near = asked.join(other, ["tid", "_row", "_b"]).filter(F.abs(F.col("_p") - F.col("pos")) <= within)
    met = near.select("_row", "phrase", "pos", "tid").distinct().groupBy("_row", "phrase", "pos").agg(F.count(F.lit(1)).alias("_m"))
    out = anchors.join(met, ["_row", "phrase", "pos"], "left").join(small_side(need), "phrase")
    return out.filter(F.coalesce("_m", F.lit(0)) == F.col("_n") - 1).select("_row", "phrase", "pos").distinct()


def phrases_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Items with a word as numbered phrases: (phrase, the id) and (phrase, at, term)."""
    numbered = items.select(F.monotonically_increasing_id().alias("phrase"), F.col(f"`{id_col}`").alias("_item"), words(F.col(f"`{text_col}`")).alias("_w")).filter(F.size("_w") > 0)
    rows = staged(numbered, "phrases")
    return rows.select("phrase", "_item"), rows.select("phrase", F.posexplode("_w").alias("at", "term"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: ``id_col, n_words, n_hit, n_items, items_sha256, contaminated``.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not
    none, is one window. A word of a document inside any occurrence of a window is hit.
    ``items_sha256`` is of the sorted, comma-joined ids of items with occurring windows,
    as strings (a null id: empty); without any, of the empty string. Null and empty texts
    have no words. Repeated documents each have their row, repeated items count by id.
    Empty tables and extra columns need no special case. Nothing is capped: documents
    meet lists by term, document and place, so neither a frequent term nor a passage that
    many documents share meets in one task.
    """
    with scratch(docs.sparkSession) as keep:
        names, phrases = phrases_of(items, item_id, item_text)
        index = build_index(docs, id_col, text_col, phrases.select("term").distinct())
        runs = staged(phrase_matches(index, phrases, window), "leak-runs")
        named = runs.join(small_side(names), "phrase")
        ids = named.select("_row", F.coalesce(F.col("_item").cast("string"), F.lit("")).alias("_s")).distinct()
        ids = ids.groupBy("_row").agg(F.array_sort(F.collect_list("_s")).alias("_s"))
        places = runs.select("_row", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos")).distinct()
        hits = places.groupBy("_row").agg(F.count(F.lit(1)).alias("n_hit"))
        out = index.documents.join(hits, "_row", "left").join(ids, "_row", "left").select(
            id_col,
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce(F.size("_s"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("_s", ","), F.lit("")), 256).alias("items_sha256"),
            F.col("n_hit").isNotNull().alias("contaminated"),
        )
        return keep(staged(out, "contamination"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_share: float = 0.0, **names) -> DataFrame:
    """The documents of which at most ``most_share`` of the words are hit; ids should be unique.

    Of documents that share an id, all go if one is hit; those with a null id stay.
    """
    bad = contamination(docs, items, id_col, text_col, **names).filter(F.col("n_hit") > most_share * F.col("n_words")).select(F.col(id_col).alias("_bad_id")).distinct()
    return docs.join(bad, docs[id_col] == bad["_bad_id"], "left_anti")
