"""Operators over several features against brute force: neighbours, density clusters, outlier factors, imputation, information."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import anomaly as an
from gaugeworks.operators import density, space
from gaugeworks.operators import quality as q


def frame(spark, x, names=None):
    names = names or [f"c{j}" for j in range(x.shape[1])]
    return spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)], "id long, " + ", ".join(f"{n} double" for n in names)).repartition(3)


def cloud(seed, n, d):
    """A wide cloud, a tight one that fills a cell, copies of one position, a lattice with ties, and a far point."""
    r = np.random.default_rng(seed)
    return np.vstack([r.normal(size=(n, d)), r.normal(size=(n, d)) * 0.01 + 3, np.repeat(r.normal(size=(1, d)), n // 4, 0), r.integers(0, 3, (n // 4, d)).astype(float), np.full((1, d), 50.0)])


def distances(x, metric="euclidean"):
    g = np.abs(x[:, None, :] - x[None, :, :])
    return g.max(2) if metric == "chebyshev" else np.sqrt((g**2).sum(2))


def brute_near(points, k, metric, partial):
    ids = np.array([p.id for p in points])
    x = np.array([[np.nan if v is None else v for v in p.vec] for p in points])
    w = np.array([p.w for p in points])
    d, out = x.shape[1], {}
    for i in range(len(points)):
        g = np.abs(x - x[i])
        known = ~np.isnan(g)
        if metric == "chebyshev":
            dist = g.max(1)
        else:
            dist = np.where(known.any(1), np.sqrt(np.where(known, g, 0).__pow__(2).sum(1) * d / np.maximum(known.sum(1), 1)), np.inf)
        rest, need, got = w.copy(), k, []
        rest[i] -= 1
        for j in np.lexsort((ids, dist)):
            if rest[j] > 0 and need > 0 and np.isfinite(dist[j]):
                use = min(need, rest[j])
                got.append((pytest.approx(dist[j]), ids[j], use))
                need -= use
        out[ids[i]] = got
    return out


@pytest.mark.parametrize("d, k, metric, partial, rows", [(3, 20, "euclidean", False, "1000000"), (2, 3, "chebyshev", False, "1000000"), (3, 5, "euclidean", True, "100")])
def test_nearest(spark, d, k, metric, partial, rows):
    x = cloud(d + k, 240, d)
    if partial:
        x = np.where(np.random.default_rng(1).random(x.shape) < 0.2, np.nan, x)
    df = frame(spark, x).select("id", F.array(*[f"c{j}" for j in range(d)]).alias("vec"))
    points = space.positions(df, "id")
    spark.conf.set("spark.gaugeworks.groupRows", rows)
    try:
        got = {r.id: [(n.distance, n.id, n.w) for n in r.near] for r in space.nearest(points, d, k, metric=metric, partial=partial, most=16).collect()}
    finally:
        spark.conf.unset("spark.gaugeworks.groupRows")
    want = brute_near(points.collect(), k, metric, partial)
    assert {i: got.get(i, []) for i in want} == want


def test_leaves_hold_few_points_and_agree(spark):
    x = cloud(4, 400, 3)
    points = space.positions(frame(spark, x).select("id", F.array("c0", "c1", "c2").alias("vec")), "id")
    got = space.with_leaves(space.along_curve(points, 3), 3, most=16)
    assert got.groupBy("leaf").count().agg(F.max("count")).first()[0] <= 16
    names = sorted(r.leaf for r in got.select("leaf").distinct().collect())
    assert all(not b.startswith(a) for a, b in zip(names, names[1:]))


def brute_clusters(x, eps, least):
    near = distances(x) <= eps
    core = near.sum(1) >= least
    label = np.where(core, np.arange(len(x)), -1)
    while True:
        new = np.array([min([label[i], *label[near[i] & core]]) if core[i] else -1 for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    return [int(min(label[near[i] & core], default=-1)) if not core[i] else int(label[i]) for i in range(len(x))]


@pytest.mark.parametrize("d, eps", [(3, 0.5), (8, 2.0)])
def test_density_clusters(spark, d, eps):
    x = np.vstack([cloud(7, 200, d), np.random.default_rng(3).uniform(-4, 4, (150, d))])
    df = frame(spark, x).union(spark.createDataFrame([(10_000, *[None] * d)], "id long, " + ", ".join(f"c{j} double" for j in range(d))))
    got = {r.id: r.cluster for r in density.dbscan(df, "id", [f"c{j}" for j in range(d)], eps, 5, scale=False).collect()}
    assert got.pop(10_000) is None
    assert [got[i] for i in range(len(x))] == brute_clusters(x, eps, 5)


def test_touching_dense_cells_meet_in_few_boxes(spark, monkeypatch):
    """Two full cells whose nearest points are just in, or just out of reach."""
    n, seen = 20_000, []
    r = np.random.default_rng(5)
    left = np.column_stack([r.uniform(0, 0.5, n), r.uniform(0, 0.5, n)])
    right = left + [1.3, 0]
    gap = right[:, 0].min() - left[:, 0].max()
    monkeypatch.setattr(density, "touches", lambda *a, f=density.touches: seen.append(1) or f(*a))
    real, rows = density.durable, []
    monkeypatch.setattr(density, "durable", lambda df: (out := real(df), rows.append(out.count()) if "hit" in out.columns else None)[0])
    for eps, want in ((gap + 0.02, 1), (gap - 1e-6, 2)):
        df = frame(spark, np.vstack([left, right]))
        got = density.dbscan(df, "id", ["c0", "c1"], float(eps), 5, scale=False)
        assert got.filter("cluster >= 0").select("cluster").distinct().count() == want
    assert seen and max(rows) < 5_000  # of 400,000,000 pairs of points


def test_outlier_factors(spark):
    x = np.vstack([cloud(9, 150, 3), [[8.0, 8.0, 8.0]]])
    k = 20
    got = {r.id: r for r in an.outlier_factors(frame(spark, x), "id", ["c0", "c1", "c2"], k, scale=False).collect()}
    dist = distances(x)
    np.fill_diagonal(dist, np.inf)
    # Ties of copies share one position, so only distances and densities matter.
    near = np.argsort(dist, 1, kind="stable")[:, :k]
    kd = np.take_along_axis(dist, near, 1)[:, -1]
    lrd = 1 / (np.maximum(np.take_along_axis(dist, near, 1), kd[near]).mean(1) + 1e-10)
    lof = lrd[near].mean(1) / lrd
    smooth = [i for i in range(300)]  # the two clouds have no ties
    assert [got[i].lof for i in smooth] == pytest.approx(lof[smooth].tolist(), rel=1e-6)
    flagged = sum(r.anomaly for r in got.values())
    assert 0 < flagged <= round(0.1 * len(x)) and got[len(x) - 1].anomaly


def test_few_leaves_meet(spark, monkeypatch):
    """What a leaf finds among its own points bounds its search: 20,000 points in three dimensions meet in a few thousand pairs of leaves."""
    x = np.random.default_rng(6).random((20_000, 3))
    real, rows = space.durable, []
    monkeypatch.setattr(space, "durable", lambda df: (out := real(df), rows.append(out.count()) if "bound" in out.columns else None)[0])
    points = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "id long, vec array<double>, w long")
    got = {r.id: [n.id for n in r.near] for r in space.nearest(points, 3, 20).filter("id % 1000 = 0").collect()}
    for i in range(0, 20_000, 1000):
        assert got[i] == np.argsort(((x - x[i]) ** 2).sum(1), kind="stable")[1:21].tolist()
    assert max(rows) < 5_000


def test_factor_on_one_axis_takes_blocks(spark):
    """A key's rows are dealt over blocks of places, also below the group limit; missing readings stay unknown."""
    x = np.random.default_rng(4).normal(size=700).round(2)
    df = spark.createDataFrame([(i, "k", float(v)) for i, v in enumerate(x)] + [(900, "one", 1.0), (901, "void", None), (902, "void", None)], "id long, key string, v double")
    real, asked = an.in_blocks, []
    for rows in (100, 100_000):
        an.in_blocks = lambda *a, rows=rows: asked.append(rows) or real(*a, rows=rows)
        try:
            got = {r.id: r.lof for r in an.local_outlier_factor(df, ["key"], "v", "id", 5).collect()}
        finally:
            an.in_blocks = real
        order = np.lexsort((np.arange(700), x))
        v = x[order]
        near = [sorted((abs(v[j] - v[i]), j) for j in range(max(0, i - 5), min(700, i + 6)) if j != i)[:5] for i in range(700)]
        kd = [n[-1][0] for n in near]
        lrd = [1 / (np.mean([max(d, kd[j]) for d, j in n]) + 1e-10) for n in near]
        want = [np.mean([lrd[j] for _, j in n]) / lrd[i] for i, n in enumerate(near)]
        assert [got[i] for i in order.tolist()] == pytest.approx(want) and got[900] is got[901] is got[902] is None
    assert asked == [100, 100_000]


def test_imputation_by_neighbours(spark):
    r = np.random.default_rng(11)
    x = r.normal(size=(300, 3))
    holes = r.random(x.shape) < 0.25
    y = np.where(holes, np.nan, x)
    got = {row.id: row for row in q.impute_neighbours(frame(spark, y), "id", ["c0", "c1", "c2"], 5).collect()}
    for i in range(len(y)):
        for j in range(3):
            if not np.isnan(y[i, j]):
                assert got[i][f"c{j}"] == y[i, j]
                continue
            g = (y - y[i]) ** 2
            known = ~np.isnan(g) & (np.arange(3) != j)
            dist = np.where(known.any(1) & ~np.isnan(y[:, j]), np.where(known, g, 0).sum(1) * 3 / np.maximum(known.sum(1), 1), np.inf)
            pick = [p for p in np.argsort(dist, kind="stable")[:5] if np.isfinite(dist[p])]
            want = y[pick, j].mean() if pick else np.nanmean(y[:, j])
            assert got[i][f"c{j}"] == pytest.approx(want)


def test_information_by_neighbours(spark):
    r = np.random.default_rng(2)
    n, rho = 500, 0.8
    a = r.normal(size=n)
    b = rho * a + np.sqrt(1 - rho**2) * r.normal(size=n)
    x = np.column_stack([a, b, r.normal(size=n), np.round(a)])
    got = {row.feature: row.mutual_information for row in q.mutual_information_nearest(frame(spark, x, ["y", "close", "apart", "coarse"]), "id", ["close", "apart", "coarse"], "y").collect()}
    assert got["close"] == pytest.approx(-0.5 * np.log(1 - rho**2), abs=0.12) and got["apart"] < 0.1
    psi = lambda m: sum(1 / j for j in range(1, int(m))) - 0.5772156649015329
    for name, j in (("close", 1), ("apart", 2), ("coarse", 3)):
        u, v = x[:, j] / x[:, j].std(), x[:, 0] / x[:, 0].std()
        du, dv = np.abs(u[:, None] - u), np.abs(v[:, None] - v)
        both = np.sort(np.maximum(du, dv), 1)[:, 3] * (1 - 1e-12)
        want = psi(n) + psi(3) - np.mean([psi(m) for m in (du <= both[:, None]).sum(1)]) - np.mean([psi(m) for m in (dv <= both[:, None]).sum(1)])
        assert got[name] == pytest.approx(max(0, want), abs=1e-8)
