import random

from voxtable.llm.topk import search

SCHEMA = "vec_id long, embedding array<float>, rank int"


def brute(rows, queries, k):
    code = lambda v: sum(1 << i for i, x in enumerate(v) if x is not None and x > 0)
    known = {(i, code(v)) for i, v, *_ in rows if i is not None and v is not None}
    out = []
    for q, v, *_ in queries:
        if q is not None and v is not None:
            near = sorted(((code(v) ^ c).bit_count(), i) for i, c in known)[:k]
            out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    return sorted(out)


def test_equals_brute_force_with_hot_codes_and_ties(spark):
    rng = random.Random(1)
    center = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(4)]
    rows = [(i, [c + rng.uniform(-0.7, 0.7) for c in rng.choice(center)], 1) for i in range(500)]
    rows += [(1000 + i, center[0], 1) for i in range(250)] + [(None, center[0], 1), (5000, None, 1), (5001, [1.0] * 65, 1), (5002, [None, 1.0], 1), (3, rows[3][1], 1)]
    queries = rows[::40] + rows[500:505] + [(9, [], 1)]
    for k in (1, 10):
        got = search(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(queries, SCHEMA), k).collect()
        assert sorted(map(tuple, got)) == brute(rows, queries, k)


def test_few_and_no_vectors(spark):
    rows = [(1, [1.0] * 64, 0), (2, [-1.0] * 64, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, search(docs, docs).collect())) == brute(rows, rows, 10)
    assert search(docs.limit(0), docs).count() == 0 and search(docs, docs.limit(0)).count() == 0


def test_codes_of_any_length(spark):
    rng = random.Random(2)
    for length in (5, 65, 128, 200):
        center = [[rng.uniform(-1, 1) for _ in range(length)] for _ in range(3)]
        rows = [(i, [c + rng.uniform(-0.8, 0.8) for c in rng.choice(center)], 1) for i in range(150)]
        rows += [(200 + i, [rng.uniform(-1, 1) for _ in range(rng.choice((3, 64, length)))], 1) for i in range(30)] + [(300, [], 1), (301, None, 1)]
        docs, queries = spark.createDataFrame(rows, SCHEMA), rows[::30] + rows[150:152] + rows[-2:]
        assert sorted(map(tuple, search(docs, spark.createDataFrame(queries, SCHEMA), 7).collect())) == brute(rows, queries, 7)


def test_every_value_at_a_radius_is_probed_once(spark):
    from voxtable.llm.topk import _flipped

    for width in (1, 5, 9):
        for r in range(width + 2):
            got = [x.s for x in _flipped(spark.range(1).selectExpr("21L as s", f"{width} as width"), r).collect()]
            assert sorted(got) == sorted(v ^ 21 for v in range(1 << width) if v.bit_count() == r)


def test_many_probes_of_few_queries_are_not_broadcast(spark, monkeypatch):
    from voxtable.llm import topk
    from voxtable.plans import storage

    plans = []

    def watched(df, label="stage"):
        if label == "found":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return storage.staged(df, label)

    monkeypatch.setattr(topk, "staged", watched)
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 2000)
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(64)], 1) for i in range(200)]
    queries = rows[::20]  # 10 queries: 80 probes at radius 0, 640 at 1, 2240 at 2; the index has 1600 rows
    got = search(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(queries, SCHEMA), 4).collect()
    assert sorted(map(tuple, got)) == brute(rows, queries, 4)
    steps = [("SortMergeJoin [j#" in plan, "BroadcastHashJoin [j#" in plan) for plan in plans[1:]]  # the first has no rows
    assert steps[:3] == [(False, True), (False, True), (True, False)]


def test_segments_are_so_many_that_probes_stay_few():
    from voxtable.llm.topk import _widths

    for total in (1, 5, 64, 65, 200, 4096):
        for n in (0, 1, 300, 10**6):
            assert sum(_widths(total, n, 10)) == total and max(_widths(total, n, 10)) < 64
    assert [len(_widths(64, n, 10)) for n in (500, 50_000, 600_000, 3_000_000, 15_000_000)] == [8, 6, 5, 4, 4]


def test_many_probes_are_made_by_many_tasks(spark, monkeypatch):
    from voxtable.llm import topk
    from voxtable.plans import storage

    plans = []

    def watched(df, label="stage"):
        if label == "found":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return storage.staged(df, label)

    monkeypatch.setattr(topk, "staged", watched)
    monkeypatch.setattr(topk, "TASK_ROWS", 500, raising=False)
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(64)], 1) for i in range(200)]
    queries = rows[::20]  # 10 queries: 80 probes at radius 0, 640 at 1, 2240 at 2
    got = search(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(queries, SCHEMA), 4).collect()
    assert sorted(map(tuple, got)) == brute(rows, queries, 4)
    assert [f"RoundRobinPartitioning({n})" in plan for n, plan in zip((1, 2, 5), plans[1:], strict=False)] == [False, True, True]
