"""Hand matrices of the sequence decoder."""

import pytest

from voxtable.operators.labelling import decode_sequence, fix_transitional, gauss_rows, normalize_columns_rel, normalize_columns_t13, valid_sequence


def matrix(spark, rows, cols, cells, name="cls"):
    data = [(1, r, c, -float(cells.get((r, c), 0))) for r in range(rows) for c in range(cols)]
    return spark.createDataFrame(data, f"scan_id int, rw int, {name} int, w double")


def run(cost, classes, **options):
    r = decode_sequence(cost, classes=classes, **{"repeat": (), "skip": ()} | options).head()
    return r.path, r.cost


DIAGONAL = {(i, i): 10 for i in range(4)}
TWICE = {(0, 0): 10, (1, 1): 10, (2, 1): 10, (3, 2): 10}
JUMP = {(0, 0): 10, (1, 2): 10, (2, 3): 10, (3, 4): 10}


@pytest.mark.parametrize(
    ("cols", "cells", "options", "path", "cost"),
    [
        (6, DIAGONAL, {}, [0, 1, 2, 3], -40),
        (8, {(k, k + 2): 5 for k in range(4)}, {"start": 2}, [2, 3, 4, 5], -20),
        (5, TWICE, {"repeat": (1,)}, [0, 1, 1, 2], -40),
        (5, TWICE, {}, [0, 1, 2, 3], -20),
        (5, TWICE, {"repeat": (1,), "repeat_cost": 100.0}, [0, 1, 2, 3], -20),
        (6, JUMP, {"skip": (0,)}, [0, 2, 3, 4], -40),
        (6, JUMP, {}, [1, 2, 3, 4], -30),
    ],
)
def test_hand_matrices(spark, cols, cells, options, path, cost):
    assert run(matrix(spark, 4, cols, cells), cols, **options) == (path, cost)


def test_relative_costs_pull_a_region_start(spark):
    rel = matrix(spark, 4, 4, {(2, 2): 8}, "col")
    assert run(matrix(spark, 4, 5, {}), 5, rel=rel, regions=(0, 3)) == ([1, 2, 3, 4], -8)


def test_last_and_first_costs_together(spark):
    rel = matrix(spark, 4, 4, {(1, 1): 10, (2, 2): 11}, "col")
    path, cost = run(matrix(spark, 4, 5, {(0, 1): 10}), 5, rel=rel, regions=(0, 3))
    assert path == [1, 2, 3, 4] and cost == -31


def test_a_class_stays_twice_at_most(spark):
    path, _ = run(matrix(spark, 4, 5, {(r, 1): 10 for r in range(4)}), 5, repeat=(1,))
    assert path.count(1) == 2


def test_transitional_labels_and_legal_steps(spark):
    path = spark.createDataFrame([(1, i, c) for i, c in enumerate([17, 18, 18, 19])] + [(2, i, c) for i, c in enumerate([22, 23, 23])] + [(3, 0, 17), (3, 1, 19)], "scan_id int, rw int, cls int")
    labels = fix_transitional(path)
    got = {}
    for r in labels.orderBy("scan_id", "rw").collect():
        got.setdefault(r.scan_id, []).append(r.label)
    assert got == {1: [18, 19, 28, 20], 2: [23, 24, 25], 3: [18, 20]}
    assert {r.scan_id: r.valid for r in valid_sequence(labels).collect()} == {1: False, 2: True, 3: True}
    assert {r.scan_id: r.valid for r in valid_sequence(labels, strict=False).collect()} == {1: True, 2: True, 3: True}


def test_columns_are_normalised_but_the_first(spark):
    rows = spark.createDataFrame([(1, r, c, w) for r in range(2) for c, w in ((0, 5.0), (1, 2.0), (2, 0.1))], "scan_id int, rw int, col int, w double")
    rel = {(r.rw, r.col): round(r.w, 6) for r in normalize_columns_rel(rows).collect()}
    assert rel[0, 0] == 5 and rel[0, 1] == 0.5 and rel[0, 2] == round(0.1 / 1.2, 6)
    t13 = {(r.rw, r.col): round(r.w, 6) for r in normalize_columns_t13(rows.filter("col < 2")).collect()}
    assert t13[1, 0] == 5 and t13[1, 1] == 0.5


def test_edges_of_smoothing(spark):
    rows = spark.createDataFrame([(1, r, 1.0) for r in range(5)], "scan_id int, rw int, v double")
    near = [round(r.s, 6) for r in gauss_rows(rows, "v", "s", 0.8, 2, ["scan_id"], ["rw"]).orderBy("rw").collect()]
    damped = [round(r.s, 6) for r in gauss_rows(rows, "v", "s", 0.8, 2, ["scan_id"], ["rw"], edge="constant").orderBy("rw").collect()]
    assert near == [1.0] * 5 and damped[2] == 1.0 and damped[0] < damped[1] < 1.0
