import hashlib
from collections import defaultdict

from voxtable.llm.exact_dedup import drop_exact_duplicates, exact_groups

ROWS = [(1, "Same"), (2, "sAME"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 200_000), (8, "X" * 200_000), (None, "same"), (2, "sAME"), (None, "alone"), (9, "other")]
SCHEMA = "doc_id long, text string"


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_groups_equal_brute_force(spark):
    docs = spark.createDataFrame([(*r, 5, "z") for r in ROWS], SCHEMA + ", keep_id int, _h string")
    for keep, pick in (("smallest", min), ("largest", max)):
        groups = defaultdict(list)
        for i, t in ROWS:
            groups[fold(t)].append(i)
        want = []
        for i, t in ROWS:
            ids = groups[fold(t)]
            best = pick((x for x in ids if x is not None), default=None)
            want.append((i, best, len(ids), i == best, hashlib.sha256(fold(t).encode()).hexdigest()))
        out = [tuple(r) for r in exact_groups(docs, keep=keep).collect()]
        assert sorted(map(str, out)) == sorted(map(str, want))


def test_filter_keeps_one_row_each_with_all_columns(spark):
    docs = spark.createDataFrame([(*r, 5, "z") for r in ROWS], SCHEMA + ", _row int, _sha string")
    out = drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(map(str, [1, 3, 5, 6, 7, None, 9]))


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_groups(docs).count() == 0 and drop_exact_duplicates(docs).count() == 0
