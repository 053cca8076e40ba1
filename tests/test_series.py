"""Series methods that run over ranges, against the plain recurrences and sums on one array."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import series as s


def table(spark, named, gaps=False):
    rows = [(k, j, float(v)) for k, x in named.items() for j, v in enumerate(x)]
    rows += [(k, 10_000 + j, None) for k in named for j in range(3 if gaps else 0)]
    return spark.createDataFrame(rows, "k string, t long, v double").repartition(4)


@pytest.fixture()
def small_groups(spark):
    spark.conf.set("spark.gaugeworks.groupRows", "25")
    yield
    spark.conf.unset("spark.gaugeworks.groupRows")


def test_transform(spark):
    r = np.random.default_rng(1)
    named = {f"n{n}": r.normal(size=n) + 1j * r.normal(size=n) for n in (1, 2, 7, 12, 97, 64, 360, 303)}
    rows = [(k, j, len(x), float(v.real), float(v.imag)) for k, x in named.items() for j, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, j long, n long, re double, im double")
    for inverse, size in ((False, 24), (True, 24), (False, 1000)):
        got = {k: np.zeros(len(x), complex) for k, x in named.items()}
        for row in s.transform(df, ["k"], size, inverse).collect():
            got[row.k][row.j] = row.re + 1j * row.im
        for k, x in named.items():
            assert np.allclose(got[k], np.fft.ifft(x) if inverse else np.fft.fft(x))


def test_spectrum_of_long_series(spark, small_groups):
    x = {"p": np.sin(2 * np.pi * np.arange(211) * 20 / 211), "q": np.random.default_rng(2).normal(size=150), "flat": np.zeros(30), "one": np.ones(1)}
    got = {r.k: r for r in s.spectrum(table(spark, x, gaps=True), ["k"], "t", "v").collect()}
    assert got["p"].dominant_frequency == pytest.approx(20 / 211)
    for k, v in x.items():
        power = np.abs(np.fft.fft(v)) ** 2
        share = power / power.sum() if power.sum() else np.full(len(v), 1 / len(v))
        assert got[k].n == len(v) and got[k].spectral_entropy == pytest.approx(-(share * np.log2(share + 1e-12)).sum(), abs=1e-6)


def recurrence(x, m, horizon, a=0.3, b=0.05, g=0.2):
    level, err = x[:m].mean(), []
    trend, season = (x[m : 2 * m].mean() - level) / m, list(x[:m] - level)
    for i in range(m, len(x)):
        old = season[i - m]
        err.append(x[i] - level - trend - old)
        new = a * (x[i] - old) + (1 - a) * (level + trend)
        trend = b * (new - level) + (1 - b) * trend
        level = new
        season.append(g * (x[i] - level) + (1 - g) * old)
    return [level + h * trend + season[len(x) - m + (h - 1) % m] for h in range(1, horizon + 1)], np.std(err)


@pytest.mark.parametrize("limit", [7, 1000])
def test_holt_winters_over_ranges(spark, limit):
    r = np.random.default_rng(3)
    x = {k: 5 + 0.01 * np.arange(n) + np.sin(np.arange(n) * 2 * np.pi / 6) + r.normal(size=n) * 0.2 for k, n in (("a", 100), ("b", 47), ("c", 12), ("short", 8))}
    got = {(q.k, q.step): q for q in s.holt_winters(table(spark, x, gaps=True), ["k"], "t", "v", 6, 9, limit=limit).collect()}
    for k in "abc":
        point, err = recurrence(x[k], 6, 9)
        for h in range(1, 10):
            assert got[k, h].forecast == pytest.approx(point[h - 1]) and got[k, h].upper - got[k, h].forecast == pytest.approx(1.96 * err * math.sqrt(h))
    assert got["short", 4].forecast == pytest.approx(x["short"].mean()) and len(got) == 36


def arma(n, phi, theta, seed):
    e = np.random.default_rng(seed).normal(size=n + 50)
    y = np.zeros(n + 50)
    for t in range(2, n + 50):
        y[t] = sum(p * y[t - 1 - i] for i, p in enumerate(phi)) + e[t] + sum(q * e[t - 1 - i] for i, q in enumerate(theta))
    return y[50:] + 10


def test_autoregression_finds_its_coefficients(spark, small_groups):
    x = {"a": arma(3000, (0.6, -0.3), (), 1), "b": arma(3000, (), (), 2)}
    got = {r.k: r for r in s.ar_coefficients(table(spark, x), ["k"], ["t"], "v", 2).collect()}
    assert got["a"].phi == pytest.approx([0.6, -0.3], abs=0.06) and got["a"].variance == pytest.approx(1, abs=0.1)
    y = x["a"]
    design = np.column_stack([np.ones(len(y) - 2), y[1:-1], y[:-2]])
    assert [got["a"].constant, *got["a"].phi] == pytest.approx(np.linalg.lstsq(design, y[2:], rcond=None)[0].tolist(), rel=1e-6)


def test_moving_average_term_and_interval(spark):
    x = {"ma": arma(3000, (), (0.8,), 5), "ar": arma(3000, (0.9,), (), 6), "walk": np.cumsum(np.random.default_rng(7).normal(size=2000)), "tiny": np.array([1.0, 2.0, 4.0])}
    got = {(r.k, r.step): r for r in s.arima_forecast(table(spark, x, gaps=True), ["k"], "t", "v", 6).collect()}
    assert len(got) == 24 and got["tiny", 6].forecast == 4.0
    half = lambda k, h: (got[k, h].upper - got[k, h].lower) / 2 / 1.96
    assert half("ma", 1) == pytest.approx(1, abs=0.06) and half("ma", 4) == pytest.approx(math.sqrt(1 + 0.8**2), abs=0.1)
    assert got["ma", 5].forecast == pytest.approx(x["ma"].mean(), abs=0.25)
    assert half("ar", 3) == pytest.approx(math.sqrt(1 + 0.81 + 0.6561), abs=0.15)
    assert got["ar", 1].forecast == pytest.approx(10 + 0.9 * (x["ar"][-1] - 10), abs=0.3)
    assert half("walk", 6) == pytest.approx(math.sqrt(6), abs=0.6) and got["walk", 1].forecast == pytest.approx(x["walk"][-1], abs=1.5)


def brute_adf(y, lags):
    dy, found = np.diff(y), []
    for k in range(lags + 1):
        rows = range(lags, len(dy))
        design = np.array([[1, y[t], *dy[t - k : t][::-1]] for t in rows])
        rest = dy[lags:] - design @ np.linalg.lstsq(design, dy[lags:], rcond=None)[0]
        found.append(len(rows) * math.log((rest**2).mean()) + 2 * (k + 2))
    k = int(np.argmin(found))
    design, to = np.array([[1, y[t], *dy[t - k : t][::-1]] for t in range(k, len(dy))]), dy[k:]
    coef = np.linalg.lstsq(design, to, rcond=None)[0]
    var = ((to - design @ coef) ** 2).sum() / (len(to) - k - 2)
    return k, len(to), coef[1] / math.sqrt(var * np.linalg.inv(design.T @ design)[1, 1])


def brute_kpss(y):
    r, n = y - y.mean(), len(y)
    s0, s1 = (r**2).sum() / n, 0.0
    for i in range(1, int(n ** (2 / 9)) + 1):
        c = (r[i:] * r[:-i]).sum() / (n / 2)
        s0, s1 = s0 + c, s1 + i * c
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    long = (r**2).sum() + 2 * sum((r[i:] * r[:-i]).sum() * (1 - i / (lags + 1)) for i in range(1, lags + 1))
    return lags, (np.cumsum(r) ** 2).sum() / n**2 / (long / n)


def test_unit_root_and_level(spark, small_groups):
    x = {"noise": np.random.default_rng(1).normal(size=240), "walk": np.cumsum(np.random.default_rng(2).normal(size=180) + 0.5), "ar": arma(200, (0.5, 0.2), (), 3)}
    got = {r.k: r for r in s.stationarity_tests(table(spark, x), ["k"], ["t"], "v", 6).collect()}
    for k, y in x.items():
        lags, n, t = brute_adf(y, 6)
        assert (got[k].lags, got[k].observations) == (lags, n) and got[k].adf_statistic == pytest.approx(t, rel=1e-6)
        width, stat = brute_kpss(y)
        assert got[k].kpss_lags == width and got[k].kpss_statistic == pytest.approx(stat, rel=1e-6)
    assert got["noise"].stationary and not got["walk"].stationary and got["walk"].adf_p_value > 0.05


def test_lag_sums_make_no_arrays_a_row(spark, small_groups, monkeypatch):
    """Products at many lags are added up per block of plain numbers, across the cuts of blocks."""
    monkeypatch.setattr(s, "lagged", None)
    y = np.cumsum(np.random.default_rng(8).normal(size=150))
    df = table(spark, {"walk": y})
    r = y - y.mean()
    got = s.lag_products(df.withColumn("v", F.col("v") - float(y.mean())), ["k"], ["t"], 60).first()
    assert got.n == 150 and got.g == pytest.approx([(r[i:] * r[: len(r) - i]).sum() for i in range(61)])
    assert s.stationarity_tests(df, ["k"], ["t"], "v").count() == 1


def test_p_values_at_published_points():
    for t, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)):
        assert s.unit_root_p(t) == pytest.approx(p, abs=0.002)
    assert s.unit_root_p(-30) == 0 and s.unit_root_p(3) == 1 and s.unit_root_p(-1.6099) == pytest.approx(s.unit_root_p(-1.6101), abs=0.01)
