"""Alignment of the tokens of two tokenizers over the same text.

Both tokenizers give spans: character offsets of the byte-level tokenizer and byte spans of
the sentence-piece protos. These are coarse cuts. A token whose span isn't its own (a part
of a multibyte character, a byte-fallback piece) is placed between two cuts by the lengths
of the decoded tokens. Where tokens of both sides end at one byte, the text is cut into
groups; between neighbouring ends of either side lies exactly one pair of overlapping tokens.

Texts are taken apart where neither tokenizer can join what stands on both sides, so a
word's alignment is computed once per worker and remembered while it is in use. Words that
are new to it are read together, many as one text.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from voxtable.llm.bpe import _Remembered
from voxtable.plans.storage import arrow_batches, resident, scratch, small_side, staged, trimmed

#: Longest piece of text whose alignment is remembered; pieces in a worker's younger generation.
CACHED_LENGTH, CACHED_PIECES = 48, 250_000
#: Pieces that are encoded at once, and about how many characters of a long text are taken apart at once.
PIECES_AT_ONCE, LONG_TEXT = 20_000, 1_000_000
#: How many pieces the tokenizers read as one text.
TOGETHER = 64
#: A pair with more than 1 / HOT_PAIRS of all links is joined by broadcast: there are fewer than HOT_PAIRS such pairs.
HOT_PAIRS = 50_000

# How a piece begins (a blank or a line end with text behind it; a comma or dot; anything else) ...
_BLANK, _MARK, _OTHER = 0, 1, 2
# ... and how it ends: a letter or digit, other text, white space.
_WORD, _TEXT, _SPACE = 0, 1, 2


def byte_letters() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _table(texts: list[bytes]) -> np.ndarray:
    return np.array(texts, dtype=f"S{max(map(len, texts))}")


class _Alignments(_Remembered):
    """Alignments of pieces used of late; they are computed in batches by the aligner."""

    def __init__(self):
        super().__init__(CACHED_PIECES)

    def keep(self, values: dict[str, tuple]) -> None:
        if len(self) + len(values) > self.size:
            self.older = dict(self)
            self.clear()
        self.update(values)


class SpanAligner:
    """Aligns tokenizer A (byte-level BPE, a tokenizers JSON) with B (a sentencepiece model with byte fallback).

    A reads a blank and the text, B the text (it adds the blank). An alignment of a piece is
    (number of A tokens, of B tokens, of groups, of links, how it begins, how it ends, groups
    as text, links as packed 64-bit codes a * size of B + b, its bytes are kept). It is None in
    place of the numbers where the decoded tokens aren't the bytes of the piece.
    """

    def __init__(self, a_json: str, b_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core; threads would wait for each other at its cost
        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters = byte_letters()
        size = max(self.a.get_vocab().values()) + 1
        words = [""] * size
        for word, k in self.a.get_vocab().items():
            words[k] = word
        self.a_bytes = [bytes(letters[c] for c in w) if all(c in letters for c in w) else w.encode() for w in words]
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_fallback = np.array([self.b.is_byte(k) for k in range(len(pieces))])
        self.b_bytes = [bytes([int(p[3:5], 16)]) if f else p.replace("▁", " ").encode() for p, f in zip(pieces, self.b_fallback, strict=True)]
        self.a_len, self.b_len = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        self.b_size = len(pieces)
        self.marks = {s: (_table([b"%d%s" % (k, s) for k in range(size)]), _table([b"%d%s" % (k, s) for k in range(self.b_size)])) for s in (b",", b"|", b";")}
        self.known = _Alignments()
        # May texts be taken apart? A must cut before a blank by itself and B have no piece that goes on over one.
        pre = json.loads(a_json).get("pre_tokenizer") or {}
        self.words_apart = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not any("▁" in p.lstrip("▁") for p in pieces)
        self.marks_apart = self.words_apart and not any("\n" in p or re.search(r"[^\W_][.,\n]", "".join(c for c in p if c.isalpha() or c.isdecimal() or c in ".,\n")) for p in pieces)

    def _ends(self, ids: np.ndarray, lengths: np.ndarray, cut: np.ndarray, sure: np.ndarray) -> np.ndarray:
        """Byte ends of tokens: ``cut`` where the span is ``sure``, from the last sure cut on by decoded lengths elsewhere."""
        total = np.cumsum(lengths[ids])
        last = np.maximum.accumulate(np.where(sure, np.arange(len(ids)), -1))
        return np.where(last < 0, total, cut[last] + total - np.where(last < 0, 0, total[last]))

    def _runs(self, pieces: list[str], together: int) -> list[list[str]]:
        """Pieces in a row, up to ``together``, between which both tokenizers cut: before a blank between words."""
        if together == 1 or not self.words_apart:
            return [[p] for p in pieces]
        runs, last = [], " "
        for piece in pieces:
            if piece[:1] == " " and not last.isspace() and piece[1:2] and not piece[1].isspace() and len(runs[-1]) < together:
                runs[-1].append(piece)
            else:
                runs.append([piece])
            last = piece[-1]
        return runs

    def align(self, pieces: list[str], together: int | None = None) -> list[tuple]:
        """Alignments of pieces, each with its leading blank if it has one; see the class.

        The tokenizers read runs of pieces as one text, as a call for every piece costs more than its tokens.
        """
        if not pieces:
            return []
        together = together or TOGETHER
        runs = self._runs(pieces, together)
        texts = ["".join(r) for r in runs]
        raw = [t.encode() for t in texts]
        size = np.array(list(map(len, raw)), dtype=np.int64)
        joined = b"".join(raw)
        at_char = np.append(np.flatnonzero((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80), len(joined))
        char_base = np.cumsum([0, *map(len, texts)])[:-1]
        stop = np.cumsum(size)
        base = stop - size
        # A: character offsets.
        a = self.a.encode_batch(texts, add_special_tokens=False)
        a_ids = [e.ids for e in a]
        a_n = np.array(list(map(len, a_ids)))
        a_ids = np.fromiter(chain.from_iterable(a_ids), np.int64, a_n.sum())
        span = np.fromiter(chain.from_iterable(chain.from_iterable(e.offsets for e in a)), np.int64, 2 * len(a_ids)).reshape(-1, 2)
        a_of = np.repeat(np.arange(len(texts)), a_n)
        a_last = np.append(a_of[1:] != a_of[:-1], True)[: len(a_of)]
        sure = a_last | np.append(span[1:, 0] >= span[:-1, 1], True)[: len(a_of)]
        a_cut = at_char[char_base[a_of] + span[:, 1]] if len(a_of) else span[:, 1]
        # B: byte spans of the protos. A text without a leading blank is read behind line ends, which never join anything.
        lead = [0 if t[:1] == " " else 1 if t[:1] == "\n" else 2 for t in texts]
        protos = self.b.encode([t[1:] if k == 0 else t if k == 1 else "\n" + t for t, k in zip(texts, lead, strict=True)], return_type="proto", num_threads=1)
        b = [[(x.id, x.end) for x in p.pieces][k:] for p, k in zip(protos, lead, strict=True)]
        b_n = np.array(list(map(len, b)))
        both = np.fromiter(chain.from_iterable(chain.from_iterable(b)), np.int64, 2 * b_n.sum()).reshape(-1, 2)
        b_ids, b_of = both[:, 0], np.repeat(np.arange(len(texts)), b_n)
        b_cut = both[:, 1] + (base + 1 - np.array(lead))[b_of]
        a_end = self._ends(a_ids, self.a_len, a_cut, sure)
        b_end = self._ends(b_ids, self.b_len, b_cut, ~self.b_fallback[b_ids])
        bad = np.zeros(len(texts), bool)
        for ids, tokens, lengths, n in ((a_ids, self.a_bytes, self.a_len, a_n), (b_ids, self.b_bytes, self.b_len, b_n)):
            if (np.bincount(np.repeat(np.arange(len(n)), n), lengths[ids], len(n)) != size).any() or b"".join(map(tokens.__getitem__, ids.tolist())) != joined:
                lists = np.split(ids, np.cumsum(n)[:-1])
                bad |= np.array([b"".join(map(tokens.__getitem__, x.tolist())) != r for x, r in zip(lists, raw, strict=True)])
        if bad.any():  # the others are aligned without them; of a run each piece is tried by itself
            redo = iter(self.align([p for r, x in zip(runs, bad, strict=True) if not x for p in r], together))
            tried = iter(self.align([p for r, x in zip(runs, bad, strict=True) if x and len(r) > 1 for p in r], 1))
            return [self._refused(p) if x and len(r) == 1 else next(tried if x else redo) for r, x in zip(runs, bad, strict=True) for p in r]
        if (a_end[np.cumsum(a_n) - 1] != stop).any() or (b_end[np.cumsum(b_n) - 1] != stop).any() or (np.diff(a_end) <= 0).any() or (np.diff(b_end) <= 0).any():
            # A span that isn't its token's: decoded bytes are what counts.
            a_end, b_end = np.cumsum(self.a_len[a_ids]), np.cumsum(self.b_len[b_ids])
        ends = np.union1d(a_end, b_end)
        to_a, to_b = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
        links = (a_ids[to_a] * self.b_size + b_ids[to_b]).astype("<i8")
        group_ends = ends[(a_end[to_a] == ends) & (b_end[to_b] == ends)]
        stop = np.cumsum(np.fromiter((len(p.encode()) for p in pieces), np.int64, len(pieces)))
        a_stop, b_stop, l_stop, g_stop = (np.searchsorted(x, stop, "right") for x in (a_end, b_end, ends, group_ends))
        if (group_ends[g_stop - 1] != stop).any():
            return self.align(pieces, 1)
        groups = self._texts(a_ids, b_ids, np.searchsorted(group_ends, a_end), np.searchsorted(group_ends, b_end), len(group_ends), a_stop + b_stop)
        packed = links.tobytes()
        columns = [np.diff(x, prepend=0).tolist() for x in (a_stop, b_stop, g_stop, l_stop)]
        return [(na, nb, ng, nl, *self._edges(p), t, packed[8 * (v - nl) : 8 * v]) for p, na, nb, ng, nl, v, t in zip(pieces, *columns, l_stop.tolist(), groups, strict=True)]

    def _texts(self, a_ids, b_ids, a_group, b_group, groups: int, stop: np.ndarray) -> Iterator[bytes]:
        """Groups of every piece as `a1,a2|b1;`, for tokens in order with the number of their group."""
        a_count, b_count = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
        comma, bar, end = (self.marks[s] for s in (b",", b"|", b";"))
        merged = np.empty(len(a_ids) + len(b_ids), dtype=max(comma[0].dtype, comma[1].dtype))
        final = lambda g: np.append(g[1:] != g[:-1], True)[: len(g)]
        a_at = np.arange(len(a_ids)) + (np.cumsum(b_count) - b_count)[a_group]
        b_at = np.arange(len(b_ids)) + np.cumsum(a_count)[b_group]
        merged[a_at] = np.where(final(a_group), bar[0][a_ids], comma[0][a_ids])
        merged[b_at] = np.where(final(b_group), end[1][b_ids], comma[1][b_ids])
        length = np.cumsum(np.char.str_len(merged))
        text, starts = merged.tobytes().replace(b"\0", b""), [0, *length[stop - 1].tolist()]
        return (text[u:v] for u, v in zip(starts, starts[1:], strict=False))

    @staticmethod
    def _edges(piece: str) -> tuple[int, int]:
        first, second, last = piece[:1], piece[1:2], piece[-1:]
        begins = _MARK if first in ",." else _BLANK if first in " \n" and second and not second.isspace() else _OTHER
        return begins, _WORD if last.isalpha() or last.isdecimal() else _SPACE if last.isspace() else _TEXT

    def _refused(self, piece: str) -> tuple:
        return (None, None, None, None, *self._edges(piece), b"", b"")

    def _parts(self, text: str) -> Iterator[str]:
        """A long text in parts that end before a blank between words; the blank stays at the front."""
        start = 0
        while self.words_apart and len(text) - start > LONG_TEXT:
            cut = self._between.search(text, start + LONG_TEXT)
            if cut is None:
                break
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:] if start else text

    _between = re.compile(r"(?<=\S) (?=\S)")

    def fine(self, part: str) -> list[str]:
        """A part cut before every blank, line end, comma and dot."""
        return part.replace(" ", "\0 ").replace(",", "\0,").replace(".", "\0.").replace("\n", "\0\n").split("\0")[1:]

    def coarse(self, part: str) -> list[str]:
        """A part cut before blanks between words alone, which is right for every text."""
        return [" " + x for x in self._between.split(part[1:])] if self.words_apart else [part]

    @staticmethod
    def joins(begins: bytes, ends: bytes) -> bool:
        """Whether fine pieces were cut at places where both tokenizers cut as well."""
        if bytes([_OTHER]) in begins or bytes([_SPACE]) in ends:
            return False
        first, then = np.frombuffer(ends, np.uint8)[:-1], np.frombuffer(begins, np.uint8)[1:]
        return not ((then == _MARK) & (first != _WORD)).any()

    def entries(self, pieces: set[str]) -> dict[str, tuple]:
        """The alignment of every piece."""
        known = self.known
        rest = pieces.difference(known)
        old = rest.intersection(known.older)
        again = {x: known.older[x] for x in old}
        found = {x: known[x] for x in pieces.difference(rest)} | again
        known.keep(again)
        new = sorted(rest - old)  # those before which a text can be cut come together
        for at in range(0, len(new), PIECES_AT_ONCE):
            some = new[at : at + PIECES_AT_ONCE]
            aligned = dict(zip(some, self.align(some), strict=True))
            found |= aligned
            known.keep({x: v for x, v in aligned.items() if len(x) <= CACHED_LENGTH})
        return found

    def documents(self, texts: list[str]) -> list[tuple]:
        """For every text (n_a, n_b, n_groups, n_links, groups as bytes, link codes as an array); zeros where it has no tokens."""
        parts = [[*self._parts(" " + t)] if t else [] for t in texts]
        lists = [[self.fine(p) if self.marks_apart and "\0" not in p else self.coarse(p) for p in ps] for ps in parts]
        found = self.entries({x for ps in lists for p in ps for x in p})
        columns = [[[*zip(*map(found.__getitem__, p), strict=True)] for p in ps] for ps in lists]
        again = [(k, m) for k, ps in enumerate(columns) for m, c in enumerate(ps) if self.marks_apart and not self.joins(bytes(c[4]), bytes(c[5]))]
        coarse = {at: self.coarse(parts[at[0]][at[1]]) for at in again}
        found = self.entries({x for p in coarse.values() for x in p})
        for (k, m), p in coarse.items():
            columns[k][m] = [*zip(*map(found.__getitem__, p), strict=True)]
        out = []
        for text, ps in zip(texts, columns, strict=True):
            if any(None in c[0] for c in ps):
                ps = [[*zip(*self.align([" " + text]), strict=True)]]  # what one piece loses another could make up
            if not ps or ps[0][0][0] is None:
                out.append((0, 0, 0, 0, b"", np.empty(0, np.int64)))
            else:
                total = [sum(sum(c[j]) for c in ps) for j in range(4)]
                out.append((*total, b"".join(b"".join(c[6]) for c in ps)[:-1], np.frombuffer(b"".join(b"".join(c[7]) for c in ps), "<i8")))
        return out


def _aligner(a_json: bytes, b_model: bytes) -> SpanAligner:
    key = hashlib.md5(a_json + b_model).digest()
    return resident(("align", key), lambda: SpanAligner(a_json.decode(), b_model))


def aligned_links(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and distinct linked pair, and one for the document itself, staged.

    ``_row`` (a number of the document), pair (null in the document's own row), n (links of
    that pair), and in the document's own row ``id_col``, n_a, n_b, n_groups, n_links and
    groups_sha256. The tokenizer files are read by the driver and broadcast.
    """
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        shipped = docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))
    kind = docs.schema[id_col].dataType.simpleString()

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*shipped.value)
        for batch in trimmed(batches):
            done = aligner.documents([t or "" for t in batch["t"].to_pylist()])
            row, pair, n, first = [], [], [], []
            for number, x in zip(batch["_row"].to_numpy().tolist(), done, strict=True):
                codes, counts = np.unique(x[5], return_counts=True)
                first.append(sum(map(len, pair)) if not first else first[-1] + len(pair[-1]))
                row.append(np.full(len(codes) + 1, number))
                pair.append(np.append(-1, codes))
                n.append(np.append(0, counts))
            if not done:
                continue
            pair, own = np.concatenate(pair), np.zeros(sum(map(len, row)), bool)
            own[first] = True
            place = np.where(own, np.cumsum(own) - 1, 0)
            spread = lambda values, of: pa.array(values, of).take(pa.array(place, mask=~own))
            columns = {
                "_row": pa.array(np.concatenate(row)),
                "pair": pa.array(pair, mask=own),
                "n": pa.array(np.concatenate(n).astype(np.int64)),
                "_id": batch["i"].take(pa.array(place, mask=~own)),
                **{name: spread([x[k] for x in done], pa.int64()) for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
                "groups_sha256": spread([hashlib.sha256(x[4]).hexdigest() if x[0] else "" for x in done], pa.string()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The tables of alignments have no cycles; searching them for some again and again takes a fifth of the time.
        was = gc.isenabled()
        gc.disable()
        try:
            yield from aligned(batches)
        finally:
            if was:
                gc.enable()

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"))
    with arrow_batches(docs.sparkSession):
        return staged(rows.mapInArrow(run, f"_row long, pair long, n long, _id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"), "aligned")


def pair_counts(links: DataFrame, b_size: int) -> DataFrame:
    """(pair, count, best): links of each pair in the whole corpus, and whether none of its B token's pairs has more."""
    counts = links.filter("pair is not null").groupBy("pair").agg(F.sum("n").alias("count"))
    # A token has at most as many partners as the other vocabulary has tokens.
    same = W.partitionBy(F.expr(f"pair % {b_size}"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(same))


def alignment_report(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``n_best``: links whose pair is, in the whole corpus, the most frequent of its B token,
    ties included; ``count_sum``: the sum of the corpus counts of the document's links.
    Texts that are null, empty, or whose decoded tokens aren't a blank and the text have no
    tokens: zeros and an empty ``groups_sha256``. Repeated rows and null ids stay apart; an
    empty table gives an empty result; other columns are ignored. Pairs with more than
    1 / HOT_PAIRS of all links are joined by broadcast, fewer than HOT_PAIRS by counting;
    all others meet in a shuffled join.
    """
    import sentencepiece

    b_size = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    with scratch(docs.sparkSession) as keep:
        links = aligned_links(docs, a_path, b_path, id_col, text_col)
        counts = staged(pair_counts(links, b_size), "pair-counts")
        least = (counts.agg(F.sum("count")).head()[0] or 0) // HOT_PAIRS
        hot, cold = counts.filter(F.col("count") > least), counts.filter(F.col("count") <= least)
        pairs = links.select("_row", "pair", "n").filter("pair is not null")
        sums = [F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")]
        met = pairs.join(F.broadcast(hot), "pair", "left")
        by_hot = met.filter("count is not null").groupBy("_row").agg(*sums)
        by_cold = met.filter("count is null").select("_row", "pair", "n").join(cold, "pair").groupBy("_row").agg(*sums)
        total = by_hot.unionByName(by_cold).groupBy("_row").agg(*[F.sum(c).alias(c) for c in ("n_best", "count_sum")])
        own = links.filter("pair is null").select("_row", F.col("_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
        zero = F.lit(0).cast("long")
        out = own.join(total, "_row", "left").select(id_col, "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
        return keep(staged(out, "alignment"))
