import random
from collections import defaultdict

import numpy as np
import pytest

from voxtable.llm.mixing import mix_documents, mix_report, split_tree, targets


def test_targets_are_capped_and_reshared():
    out = targets([10, 100, 1000, 0], [1, 2, 3, 1], 3)
    assert out[0] == 30 and out[3] == 0 and out[1] == 300 and out[2] == pytest.approx(1110 - 330)
    assert sum(targets([5, 5], [1, 3], 3)) == 10


def test_split_tree_keeps_every_quota():
    blocks = [0, 7, 100, 1]
    out = split_tree(blocks, 5, 3)
    assert out.sum(axis=0).tolist() == blocks and np.ptp(out.sum(axis=1)) <= 1
    assert (out == split_tree(blocks, 5, 3)).all()


def rows(n=400, seed=2):
    rng = random.Random(seed)
    return [(i, None if i % 13 == 0 else " ".join("w%d" % rng.randrange(99) for _ in range(rng.randrange(40))), [None, "a", "b", "ü", "hot"][min(4, rng.randrange(9))], 5) for i in range(n)]


def test_report_meets_targets_and_reruns_agree(spark):
    docs = spark.createDataFrame(rows() + [(7, "x y z", "a", 1)] * 3 + [(None, "n n", None, 1)], "doc_id long, text string, source string, size long")
    out = mix_report(docs).collect()
    assert len(out) == 404
    by = defaultdict(int)
    for r in out:
        assert 0 <= r.taken <= 3 * r.size
        by[r.source_size, r.target] += r.taken
    for (_, target), took in by.items():
        assert abs(took - target) <= 4
    again = mix_report(docs.repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_mix_returns_the_columns_and_whole_quota(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string, _shard long")
    out = mix_documents(docs)
    assert out.columns == docs.columns
    got = out.collect()
    plan = {r.doc_id: r.taken for r in mix_report(docs).collect()}
    took = defaultdict(int)
    for r in got:
        took[r.doc_id] += len((r.text or "").split())
    assert {k: v for k, v in plan.items() if v} == dict(took)


def test_empty_and_wordless(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_report(docs).count() == 0 and mix_documents(docs).count() == 0
    docs = spark.createDataFrame([(1, None, None), (2, " \t", "a")], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mix_report(docs).collect()] == [(0, 0.0, 0)] * 2


def test_query_meets_the_contract(spark):
    from voxtable.llm.queries import op4_mixing

    sf = "/root/testdata/sf0.001"
    out = op4_mixing(spark, sf).collect()
    texts = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sizes = defaultdict(int)
    for r in texts.values():
        sizes[r.source] += len((r.text or "").encode().split())
    order = sorted(sizes)
    goal = dict(zip(order, targets([sizes[s] for s in order], [1 + i % 3 for i in range(len(order))], 3), strict=True))
    took = defaultdict(int)
    for r in out:
        source = texts[r.doc_id].source
        assert r.size == len((texts[r.doc_id].text or "").encode().split())
        assert r.source_size == sizes[source] and r.target == pytest.approx(goal[source]) and r.taken <= 3 * r.size
        took[source] += r.taken
    assert len(out) == len(texts)
    assert all(abs(took[s] - goal[s]) <= 1 for s in order)
