"""Byte-level BPE by dynamic programming over byte prefixes.

Every prefix of a piece of text has exactly one last token in its BPE encoding. The
table of these last tokens is built left to right: a token that ends at a byte is the
last one if it may stand behind the last token of the prefix before it. Appending bytes
only extends the table, and after an edit it is recomputed from the edited byte on until
it agrees with the old one for a whole token length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from voxtable.plans.storage import resident, trimmed

#: Longest piece whose ids are remembered; pieces and token pairs in a worker's younger generation.
CACHED_LENGTH, CACHED_PIECES, CACHED_PAIRS = 48, 120_000, 150_000
#: Texts over this length are cut into pieces bit by bit.
LONG_TEXT, PIECES_AT_ONCE = 1_000_000, 100_000


class _Remembered(dict):
    """What ``compute`` gave for keys used of late: at most ``size`` of a younger and of an older generation.

    A key of the older one that is used again becomes young, so frequent keys stay.
    """

    def __init__(self, size: int):
        self.size, self.older = size, {}

    def compute(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class _Pairs(_Remembered):
    """Whether the text of two tokens is encoded as just these two; the key is first * tokens + second."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(CACHED_PAIRS)
        self.vocabulary = vocabulary

    def compute(self, key: int) -> bool:
        return self.vocabulary._unmerged(*divmod(key, len(self.vocabulary.tokens)))


class Vocabulary:
    """Token ranks, as ids, of a byte-level BPE whose first 256 merges-free tokens are the bytes."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
        self.tokens = [b""] * (1 + max(self.ranks.values()))
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.tails = {token[i:] for token in self.ranks for i in range(len(token))}
        self.longest = max(map(len, self.ranks))
        self._halves: dict[int, tuple[int, int]] = {}
        self._pairs = _Pairs(self)

    def halves(self, rank: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; a single byte is both of its halves."""
        found = self._halves.get(rank)
        if found is None:
            token = self.tokens[rank]
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                low = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], rank))
                parts[low : low + 2] = [parts[low] + parts[low + 1]]
            found = (rank, rank) if len(parts) == 1 else (self.ranks[parts[0]], self.ranks[parts[1]])
            self._halves[rank] = found
        return found

    def may_follow(self, first: int, second: int) -> bool:
        """Whether the text of the two tokens is encoded as just these two."""
        return self._pairs[first * len(self.tokens) + second]

    def _unmerged(self, a: int, b: int) -> bool:
        # Undo the later merge of the two sides again and again. If at some moment the parts
        # at the border could have merged earlier than what was undone, the border is not one.
        limit = len(self.tokens)
        while True:
            if self.ranks.get(self.tokens[a] + self.tokens[b], limit) < limit:
                return False
            for later_is_left in ((True, False) if a > b else (False, True)):
                whole = a if later_is_left else b
                part = self.halves(whole)[1 if later_is_left else 0]
                if part != whole:
                    break
            else:
                return True
            limit = whole if later_is_left else whole + 1
            a, b = (part, b) if later_is_left else (a, part)


class PrefixTable:
    """The last token of every prefix of one piece, kept up to date under appends and edits."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", [-1]
        self.append(piece)

    def _extend(self, piece: bytes, last: list[int], until: int) -> None:
        """Fill in ``last`` up to the prefix of ``until`` bytes; just one token can end each prefix."""
        tails, ranks, follows, n = self.vocabulary.tails, self.vocabulary.ranks, self.vocabulary._pairs, len(self.vocabulary.tokens)
        for end in range(len(last), until + 1):
            start, found = end - 1, -1
            while start >= 0 and (part := piece[start:end]) in tails:
                rank = ranks.get(part)
                if rank is not None and (start == 0 or follows[last[start] * n + rank]):
                    found = rank
                    break
                start -= 1
            last.append(found)

    def append(self, more: bytes) -> None:
        self.piece += more
        self._extend(self.piece, self.last, len(self.piece))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in place of piece[start:end]; return how many entries were recomputed."""
        piece = self.piece[:start] + new + self.piece[end:]
        shift, last, same, done = len(new) - (end - start), self.last[: start + 1], 0, 0
        for at in range(start + 1, len(piece) + 1):
            self._extend(piece, last, at)
            done += 1
            old = at - shift
            same = same + 1 if at > start + len(new) and last[at] == self.last[old] else 0
            if same > self.vocabulary.longest:
                last += self.last[old + 1 :]
                break
        self.piece, self.last = piece, last
        return done

    def ids(self) -> list[int]:
        out, at = [], len(self.piece)
        while at:
            out.append(self.last[at])
            at -= len(self.vocabulary.tokens[self.last[at]])
        return out[::-1]


class _PieceIds(_Remembered):
    """Ids of a piece as little-endian unsigned 32-bit integers, computed when first asked for."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(CACHED_PIECES)
        self.vocabulary = vocabulary

    def compute(self, piece: str) -> bytes:
        data = piece.encode()
        rank = self.vocabulary.ranks.get(data)
        if rank is not None:
            return rank.to_bytes(4, "little")
        return np.array(PrefixTable(self.vocabulary, data).ids(), dtype="<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        return super().__missing__(piece) if len(piece) <= CACHED_LENGTH else self.compute(piece)


class Encoder:
    """Encodes whole texts, each match of ``pattern`` separately, and decodes ids to bytes."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.vocabulary, self.pattern = Vocabulary(rank_file), regex.compile(pattern)
        self.pieces = _PieceIds(self.vocabulary)

    def encode(self, text: str) -> bytes:
        of = self.pieces.__getitem__
        if len(text) <= LONG_TEXT:
            return b"".join(map(of, self.pattern.findall(text)))
        matches, out = (m[0] for m in self.pattern.finditer(text)), []
        while part := b"".join(map(of, islice(matches, PIECES_AT_ONCE))):
            out.append(part)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _encoder(rank_file: bytes, pattern: str) -> Encoder:
    key = hashlib.md5(rank_file + pattern.encode()).digest()
    return resident(("bpe", key), lambda: Encoder(rank_file, pattern))


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: ``id_col, n_tokens, ids_sha256, decoded_sha256`` (and ``ids``).

    Whole texts are encoded without special tokens and decoded again; a null text is
    empty and has no token. The vocabulary file is read by the driver and broadcast: its
    size is that of the vocabulary, whatever the table. Rows are independent, so the plan
    is one scan of two columns and has no shuffle. Null and repeated ids, repeated rows
    and extra columns need no special case; an empty table gives an empty result.
    """
    with open(rank_path, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shipped.value, pattern)
        for batch in trimmed(batches):
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [encoder.encode(text or "") for text in part["t"].to_pylist()]
                columns = {
                    "i": part["i"],
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() for x in ids], pa.string()),
                }
                if with_ids:
                    columns["ids"] = pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"i {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.selectExpr(f"`{id_col}` as i", f"`{text_col}` as t").mapInArrow(encoded, schema).withColumnRenamed("i", id_col)
