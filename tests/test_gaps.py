"""Gaps by triangles and not-a-knot splines, against direct solutions."""

import itertools

import numpy as np
import pytest

from thalweg.operators import focal, gaps


def frame(spark, x):
    rows = [(r, c, None if v != v else float(v)) for r, row in enumerate(x.tolist()) for c, v in enumerate(row)]
    return spark.createDataFrame(rows, "r bigint, c bigint, v double").repartition(3)


def back(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["r"], r["c"]] = np.nan if r["v"] is None else r["v"]
    return out


def possible(x, r, c):
    """Values at a missing pixel on all triangles of valid pixels that hold it and whose circle holds no valid pixel: more than one where four lie on a circle."""
    pts = np.argwhere(~np.isnan(x)).astype(float)
    out = set()
    for t in itertools.combinations(range(len(pts)), 3):
        a, b, d = pts[list(t)]
        area = np.cross(b - a, d - a)
        if area == 0:
            continue
        w = np.array([np.cross(b - (r, c), d - (r, c)), np.cross(d - (r, c), a - (r, c)), np.cross(a - (r, c), b - (r, c))]) / area
        if (w < -1e-12).any():
            continue
        m = np.linalg.solve(2 * np.array([b - a, d - a]), [b @ b - a @ a, d @ d - a @ a])
        if (((pts - m) ** 2).sum(axis=1) > ((a - m) ** 2).sum() - 1e-9).all():
            out.add(round(float(w @ [x[tuple(map(int, p))] for p in (a, b, d)]), 9))
    return out


@pytest.mark.filterwarnings("ignore::DeprecationWarning")
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_triangles(spark, seed):
    """Every missing pixel takes a value of a Delaunay triangle of all valid pixels, or none outside of their hull; blocks don't show."""
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 10, (7, 8))
    x[2:5, 2:6] = np.nan
    x[rng.random(x.shape) < 0.15] = np.nan
    x[0, 0] = np.nan
    got = back(gaps.fill(frame(spark, x), *x.shape, 3), x.shape)
    np.testing.assert_array_equal(got[~np.isnan(x)], x[~np.isnan(x)])
    for r, c in np.argwhere(np.isnan(x)).tolist():
        want = possible(x, r, c)
        assert (round(got[r, c], 9) in want) if not np.isnan(got[r, c]) else not want


def test_plane_with_large_and_open_gaps(spark, monkeypatch):
    """A plane is a plane again; a gap over several blocks is one gap; the outside of the hull stays missing; gaps too large for a group go by lines."""
    plane = 3 * np.arange(24.0)[:, None] - 2 * np.arange(20.0) + 7
    x = plane.copy()
    x[4:19, 3:15] = np.nan
    x[10, 5] = plane[10, 5]
    x[:5, 17:] = np.nan
    x[20:, 0] = np.nan
    got = back(gaps.fill(frame(spark, x), *x.shape, 5), x.shape)
    inside = ~np.isnan(got)
    np.testing.assert_allclose(got[inside], plane[inside], atol=1e-9)
    assert inside[4:19, 3:15].all() and not inside[:4, 18:].any() and not inside[23, 0]
    monkeypatch.setattr(gaps, "LARGEST", 20)
    lines = back(gaps.fill(frame(spark, x), *x.shape, 5), x.shape)
    np.testing.assert_allclose(lines[4:19, 3:15], plane[4:19, 3:15], atol=1e-9)


def test_labels_and_components(spark):
    rng = np.random.default_rng(7)
    m = rng.random((30, 41)) < 0.6
    got = gaps.labelled(m)
    seen = np.zeros_like(got)
    for r, c in np.argwhere(m).tolist():  # a flood from each cell that has no number yet
        if seen[r, c]:
            continue
        todo, cells = [(r, c)], {(r, c)}
        while todo:
            i, j = todo.pop()
            near = [(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)]
            new = [(a, b) for a, b in near if 0 <= a < 30 and 0 <= b < 41 and m[a, b] and (a, b) not in cells]
            cells |= set(new)
            todo += new
        for i, j in cells:
            seen[i, j] = 1
        assert len({got[i, j] for i, j in cells}) == 1 and (got == got[r, c]).sum() == len(cells)
    assert (got[~m] == 0).all()
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (205, 201), (203, 205), (203, 203)]
    roots = {r["node"]: r["root"] for r in gaps.connected(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert roots == {i: 0 for i in range(1, 61)} | {101: 100, 203: 201, 205: 201}
    assert gaps.connected(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def dense_spline(y, at):
    """The not-a-knot cubic through y at 0, 1, .., from all its conditions in one system."""
    n = len(y)
    rows, right = [], []

    def row(piece, t, order, sign=1.0, into=None):
        out = np.zeros(4 * (n - 1)) if into is None else into
        for k in range(order, 4):
            out[4 * piece + k] += sign * np.prod(np.arange(k - order + 1, k + 1)) * t ** (k - order)
        return out

    for i in range(n - 1):
        rows += [row(i, 0.0, 0), row(i, 1.0, 0)]
        right += [y[i], y[i + 1]]
    for i in range(n - 2):
        for order in (1, 2):
            rows.append(row(i + 1, 0.0, order, -1.0, row(i, 1.0, order)))
            right.append(0.0)
    for i in (0, n - 3):
        rows.append(row(i + 1, 0.0, 3, -1.0, row(i, 1.0, 3)))
        right.append(0.0)
    q = np.linalg.lstsq(np.array(rows), np.array(right), rcond=None)[0].reshape(n - 1, 4)
    i = np.minimum(np.floor(at).astype(int), n - 2)
    return ((q[i, 3] * (at - i) + q[i, 2]) * (at - i) + q[i, 1]) * (at - i) + q[i, 0]


@pytest.mark.parametrize("n, n_out", [(4, 9), (5, 5), (9, 31), (12, 7), (30, 1)])
def test_not_a_knot(n, n_out):
    y = np.random.default_rng(n).normal(0, 1, (3, n))
    at = np.arange(n_out) * ((n - 1) / max(n_out - 1, 1))
    np.testing.assert_allclose(focal.knotted_row(y, n_out), [dense_spline(line, at) for line in y], atol=1e-9)


def test_short_lines():
    np.testing.assert_allclose(focal.knotted_row(np.array([[2.0]]), 3), [[2, 2, 2]])
    np.testing.assert_allclose(focal.knotted_row(np.array([[2.0, 4.0]]), 3), [[2, 3, 4]])
    np.testing.assert_allclose(focal.knotted_row(np.array([[0.0, 1.0, 4.0]]), 5), [[0, 0.25, 1, 2.25, 4]])


def test_resize_spline(spark):
    """Cubic polynomials along both axes come back exactly; what was a gap is missing again where more than half of it is."""
    r, c = np.arange(9.0)[:, None], np.arange(11.0)
    x = r**3 / 50 - r * c + c**2
    got = back(focal.resize(frame(spark, x), x.shape, (17, 21), "spline"), (17, 21))
    r, c = np.arange(17.0)[:, None] / 2, np.arange(21.0) / 2
    np.testing.assert_allclose(got, r**3 / 50 - r * c + c**2, atol=1e-9)
    x[3:6, 4:7] = np.nan
    got = back(focal.resize(frame(spark, x), x.shape, (17, 21), "spline"), (17, 21))
    assert np.isnan(got[8, 10]) and not np.isnan(got[2, 2])
