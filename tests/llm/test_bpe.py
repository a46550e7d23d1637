import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from voxtable.llm.bpe import Encoder, PrefixTable, Vocabulary, encode_documents

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as f:
        return Vocabulary(f.read())


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "a" * 3000, "é" * 700, "the cat's  meow\n\n\t x", "\U0001f600" * 50, "<|endoftext|>", "  　x", "ab" * 999 + "12345678901" * 40]


def test_prefix_table_equals_the_reference_on_random_bytes(vocabulary, reference):
    rng = random.Random(3)
    for n in range(400):
        letters = rng.choice([b"ab", b"the andion", bytes(range(256)), b" \n\t", b"0123456789"])
        piece = bytes(rng.choice(letters) for _ in range(rng.randint(1, 60)))
        assert PrefixTable(vocabulary, piece).ids() == reference._encode_single_piece(piece), piece


def test_texts_encode_and_decode(reference):
    with open(PATH, "rb") as f:
        encoder = Encoder(f.read(), public_tokenizers.PATTERN)
    for text in ODD:
        ids = encoder.encode(text)
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == reference.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()


def test_appends_and_edits_are_exact_and_local(vocabulary):
    rng = random.Random(5)
    piece = bytes(rng.choice(b"the tion and erx") for _ in range(1500))
    table = PrefixTable(vocabulary, piece[:700])
    table.append(piece[700:])
    assert table.last == PrefixTable(vocabulary, piece).last
    for _ in range(30):
        at, cut, new = rng.randrange(len(table.piece)), rng.randrange(4), bytes(rng.choice(b"tion he") for _ in range(rng.randrange(4)))
        done = table.replace(at, min(len(table.piece), at + cut), new)
        assert table.last == PrefixTable(vocabulary, table.piece).last
        assert done <= len(table.piece)
    assert table.replace(5, 6, b"zz") < 600


def test_documents_with_nulls_repeats_and_clashing_names(spark, reference):
    rows = [(2**60 + 1, "the cat", 7), (2**60 + 1, "the cat", 7), (None, None, 8), (2, "", 9), *[(10 + i, t, 0) for i, t in enumerate(ODD)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    out = encode_documents(docs, PATH, public_tokenizers.PATTERN, with_ids=True).collect()
    want = sorted((d or -1, len(e := reference.encode_ordinary(t or "")), e, hashlib.sha256((t or "").encode()).hexdigest()) for d, t, _ in rows)
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids, r.decoded_sha256) for r in out) == want
    assert encode_documents(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_query_equals_the_reference_on_the_whole_table(spark, reference):
    from voxtable.llm.queries import op3_byte_bpe

    sf = "/root/testdata/sf0.001"
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = reference.encode_ordinary(r.text or "")
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want.add((r.doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert {tuple(r) for r in op3_byte_bpe(spark, sf).collect()} == want
