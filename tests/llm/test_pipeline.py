import base64
import hashlib
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from tests.llm.test_near_dedup import brute
from voxtable.llm.mixing import mix_report


def test_stages_equal_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, after = docs, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after[name] = stage(spark, before, sf)
        after[name].write.parquet(f"{tmp_path}/{i}")
        after[name] = before = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert before.columns == docs.columns
    ids = lambda name: {r.doc_id for r in after[name].select("doc_id").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert ids("language_id") <= set(texts) and len(ids("language_id")) >= 0.9 * len(texts)
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    first = {}
    for i in sorted(ids("language_id")):
        first.setdefault(fold(texts[i]), i)
    assert ids("exact_dedup") == set(first.values())
    assert ids("near_dedup") == {i for i, _, _, kept in brute([(i, texts[i]) for i in ids("exact_dedup")], 5, 80) if kept}
    took = {r.doc_id: r.taken for r in mix_report(after["near_dedup"]).collect() if r.taken}
    mixed = Counter()
    for r in after["mix"].collect():
        mixed[r.doc_id] += len(r.text.encode().split())
        assert texts[r.doc_id].startswith(r.text)
    assert mixed == took
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((r.doc_id, tuple(reference.encode_ordinary(r.text))) for r in after["mix"].collect())
    rows = after["byte_bpe"].collect()
    assert want == Counter((r.doc_id, tuple(r.ids)) for r in rows)
    assert Counter(r.decoded_sha256 for r in rows) == Counter(hashlib.sha256(r.text.encode()).hexdigest() for r in after["mix"].collect())
    assert corpus_pipeline.run(spark, sf).count() == len(rows)
