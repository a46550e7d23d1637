import hashlib
import os
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from voxtable.llm import alignment
from voxtable.llm.alignment import SpanAligner, alignment_report, byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a", " ", "  a  b", "x\n", "\n", "\n\na b", "foo, bar. baz", "...", "a.b,c", "l'eau, x²., y", "é🎉 ▁x", "中文 日本語，テスト。", "<|endoftext|> <s> </s> <0x0A>", "tab\tx   y", "a \nb", "á é", "\x00 a", "foo\x1c bar", "a,,b", "1,234.5 67", "don't 's 't", "ﬁ ①", "　x", "a" * 3000, "é" * 500, "r\r\nx", "the end. The start,\nand so on"]


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    letters = byte_letters()
    names = {k: w for w, k in a.get_vocab().items()}
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    a_bytes = lambda k: bytes(letters[c] for c in names[k])
    b_bytes = lambda k: bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()
    return a, b, a_bytes, b_bytes


def brute(tools, text):
    """(A ids, B ids, groups as text, links), or nothing; all pairs of ranges are compared."""
    a, b, a_bytes, b_bytes = tools
    if not text:
        return None
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text, num_threads=1)

    def ranges(ids, of):
        out, at = [], 0
        for k in ids:
            out.append((at, at + len(of(k))))
            at = out[-1][1]
        return out

    if any(b"".join(map(of, ids)) != (" " + text).encode() for ids, of in ((a_ids, a_bytes), (b_ids, b_bytes))):
        return None
    ra, rb = ranges(a_ids, a_bytes), ranges(b_ids, b_bytes)
    links, j0 = [], 0
    for i, (u, v) in enumerate(ra):
        while rb[j0][1] <= u:
            j0 += 1
        j = j0
        while j < len(rb) and rb[j][0] < v:
            links.append((a_ids[i], b_ids[j]))
            j += 1
    groups, i, j = [], 0, 0
    for cut in sorted({v for _, v in ra} & {v for _, v in rb}):
        i2, j2 = i, j
        while i2 < len(ra) and ra[i2][1] <= cut:
            i2 += 1
        while j2 < len(rb) and rb[j2][1] <= cut:
            j2 += 1
        groups.append(",".join(map(str, a_ids[i:i2])) + "|" + ",".join(map(str, b_ids[j:j2])))
        i, j = i2, j2
    return a_ids, b_ids, ";".join(groups), links


def report(tools, rows):
    found = [brute(tools, t) for _, t in rows]
    count = Counter(x for f in found if f for x in f[3])
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for (i, _), f in zip(rows, found, strict=True):
        if f:
            links = f[3]
            out.append((i, len(f[0]), len(f[1]), f[2].count(";") + 1, len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(f[2].encode()).hexdigest()))
        else:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
    return sorted(map(str, out))


def aligner():
    with open(A, encoding="utf-8") as a, open(B, "rb") as b:
        return SpanAligner(a.read(), b.read())


@pytest.mark.parametrize("apart", ["marks", "words", "nothing"])
def test_pieces_equal_whole_texts(tools, apart, monkeypatch):
    monkeypatch.setattr(alignment, "CACHED_PIECES", 40)
    monkeypatch.setattr(alignment, "LONG_TEXT", 50)
    one, rng = aligner(), random.Random(1)
    assert one.words_apart and one.marks_apart
    one.words_apart, one.marks_apart = apart != "nothing", apart == "marks"
    texts = ODD + ["".join(rng.choice(["a", "the", " ", ",", ".", "\n", "é", "中", "²", "3", "'s", "▁", "!", "\t", "B", " "]) for _ in range(rng.randrange(1, 25))) for _ in range(800)] + [" ".join(rng.choice(ODD[:12]) for _ in range(30)), ""]
    for text, out in zip(texts, one.documents(texts), strict=True):
        want = brute(tools, text)
        if want is None:
            assert out[:5] == (0, 0, 0, 0, b""), text
        else:
            a, b, groups, links = want
            assert out[:5] == (len(a), len(b), groups.count(";") + 1, len(links), groups.encode()), text
            assert sorted(out[5].tolist()) == sorted(i * one.b_size + j for i, j in links), text


def test_new_words_are_read_together(tools):
    one, given = aligner(), []

    class Counting:
        def encode_batch(self, texts, **more):
            given.extend(texts)
            return tools[0].encode_batch(texts, **more)

    one.a = Counting()
    words = [f"w{k}x" for k in range(1000)]
    odd = ["\u00a0x", "\u2581", "x\u2581y", "e\u0301", "a\tb", "\U0001f389"]  # some are refused, and their neighbours aren't
    texts = [" ".join(words[k : k + 10]) for k in range(0, 1000, 10)] + [f"{w} {words[k]} {w}z" for k, w in enumerate(odd)]
    for text, out in zip(texts, one.documents(texts), strict=True):
        want = brute(tools, text)
        assert out[:5] == ((len(want[0]), len(want[1]), want[2].count(";") + 1, len(want[3]), want[2].encode()) if want else (0, 0, 0, 0, b"")), text
    assert sum(brute(tools, t) is None for t in texts) in range(1, 6)
    assert len(given) < 200
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"


def test_documents_with_nulls_repeats_clashing_names_and_rare_pairs(spark, tools, monkeypatch):
    monkeypatch.setattr(alignment, "HOT_PAIRS", 30)
    rows = [(2**60 + 1, "the cat"), (2**60 + 1, "the cat"), (None, None), (None, "the dog, the cat"), (2, ""), *[(10 + k, t) for k, t in enumerate(ODD)], (99, "word " * 20000)]
    docs = spark.createDataFrame([(*r, 5, "z") for r in rows], "doc_id long, text string, _row int, pair string")
    assert sorted(str(tuple(r)) for r in alignment_report(docs, A, B).collect()) == report(tools, rows)
    assert alignment_report(docs.limit(0), A, B).count() == 0


def test_query_equals_brute_force_on_the_whole_table(spark, tools):
    from voxtable.llm.queries import op12_alignment

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(str(tuple(r)) for r in op12_alignment(spark, sf).collect()) == report(tools, rows)
