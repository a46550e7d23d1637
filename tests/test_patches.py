"""Rotated patches against a spline that solves its interpolation equations directly."""

import numpy as np

from voxtable.operators.tiles import rotated_patches, spline_coefficients


def basis(x):
    x = np.abs(x)
    return np.where(x < 1, 2 / 3 - x**2 + x**3 / 2, np.where(x < 2, (2 - x) ** 3 / 6, 0.0))


def mirrored(k, n):
    while not 0 <= k < n:
        k = -k if k < 0 else 2 * (n - 1) - k
    return k


def matrix(x, n):
    """Weights of n mirrored coefficients at each x."""
    out = np.zeros((len(x), n))
    for row, v in enumerate(x):
        for k in range(int(np.floor(v)) - 1, int(np.floor(v)) + 3):
            out[row, mirrored(k, n) if n > 1 else 0] += basis(np.array(v - k))
    return out


def solved(cube):
    for axis, n in enumerate(cube.shape):
        a = np.moveaxis(cube, axis, 0)
        cube = np.moveaxis(np.linalg.solve(matrix(np.arange(n, dtype=float), n), a.reshape(n, -1)).reshape(a.shape), 0, axis)
    return cube


def test_cubic_patches_equal_a_dense_version(spark):
    rng, rows, want, size = np.random.default_rng(4), [], {}, (7, 8, 5)
    for k in range(10):
        cube = rng.random((11, 12, 6 if k % 2 else 5)) + 0.5
        angle = float(rng.integers(-60, 60)) if k else 0.0
        rows += [(0, k, *map(int, x), float(cube[tuple(x)]), angle) for x in np.argwhere(cube)]
        c, a = solved(cube), np.deg2rad(angle)
        assert np.allclose(c, spline_coefficients(cube), atol=1e-9)
        for p, i, r in np.ndindex(*size):
            dp, di = p - 3.0, i - 3.5
            at = (np.cos(a) * dp - np.sin(a) * di + 5.0, np.sin(a) * dp + np.cos(a) * di + 5.5, r - 2.0 + (cube.shape[2] - 1) / 2)
            if all(0 <= x <= n - 1 for x, n in zip(at, cube.shape, strict=True)):
                w = [matrix([x], n)[0] for x, n in zip(at, cube.shape, strict=True)]
                want[(k, p, i, r)] = np.einsum("a,b,c,abc->", *w, c)
    patches = spark.createDataFrame(rows, "scan_id int, com_idx int, p int, i int, r int, value double, angle double")
    got = {(r.com_idx, r.p, r.i, r.r): r.value for r in rotated_patches(patches, size, cubic=True).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - v) for k, v in want.items()) < 1e-6


def test_no_turn_gives_the_middle_of_the_patch(spark):
    rows = [(0, 0, p, i, r, float(100 * p + 10 * i + r + 1), 0.0) for p in range(6) for i in range(6) for r in range(4)]
    patches = spark.createDataFrame(rows, "scan_id int, com_idx int, p int, i int, r int, value double, angle double")
    near = {(r.p, r.i, r.r): r.value for r in rotated_patches(patches, (4, 4, 4)).collect()}
    smooth = {(r.p, r.i, r.r): r.value for r in rotated_patches(patches, (4, 4, 4), cubic=True).collect()}
    assert near == {(p, i, r): 100.0 * (p + 1) + 10 * (i + 1) + r + 1 for p in range(4) for i in range(4) for r in range(4)}
    assert max(abs(near[k] - smooth[k]) for k in near) < 1e-9
