"""The models at size: what they count and hold, and that their results are those of plain versions."""

import tracemalloc

import numpy as np
import pytest

from tickloom.operators import models
from tickloom.sources import io


def plain_tree(bins, y, rows, depth, least, shrink):
    """Node -> (column, bin) and node -> value; every node counts all of its draws in all columns."""
    split, value, stack = {}, {}, [(1, rows, depth)]
    m, offset = bins.shape[1], np.arange(bins.shape[1]) * 64
    while stack:
        node, rows, left = stack.pop()
        t, n = y[rows].sum(), len(rows)
        value[node] = t / (n + shrink)
        if not left or n < 2 * least:
            continue
        flat = (bins[rows] + offset).ravel()
        count = np.bincount(flat, minlength=m * 64).reshape(m, 64).cumsum(1)
        total = np.bincount(flat, np.repeat(y[rows], m), m * 64).reshape(m, 64).cumsum(1)
        other, rest = n - count, t - total
        gain = np.where((count >= least) & (other >= least), total**2 / np.maximum(count + shrink, 1e-12) + rest**2 / np.maximum(other + shrink, 1e-12), -np.inf)
        best = int(np.argmax(gain))
        if gain.flat[best] > t * t / (n + shrink) + 1e-15:
            j, b = split[node] = divmod(best, 64)
            low = bins[rows, j] <= b
            stack += [(2 * node, rows[low], left - 1), (2 * node + 1, rows[~low], left - 1)]
    return split, value


def plain_leaf(tree, row):
    node = 1
    while node in tree[0]:
        j, b = tree[0][node]
        node = 2 * node + int(row[j] > b)
    return tree[1][node]


def tied(n, copies):
    """Repeated rows, a column that mirrors another, one with few values and one with a single value."""
    r = np.random.default_rng(3)
    x = r.standard_normal((n // copies, 7))
    x[:, 0] = r.integers(1, 4, len(x))
    x[:, 1], x[:, 2] = 1 / x[:, 0], 1.0
    y = np.exp(2 * r.standard_normal(len(x))) * (1 + x[:, 3] ** 2)
    return np.repeat(x, copies, 0), np.repeat(y, copies), r.standard_normal((200, 7))


@pytest.mark.parametrize("n,copies", [(500, 5), (12000, 1), (12000, 12)])
def test_forest_takes_the_splits_of_plain_trees(n, copies):
    x, y, z = tied(n, copies)
    bins = models.Bins(n, iter(x.T))
    got = models.fit_forest(bins, y, trees=4)(z)
    flat = np.stack([np.searchsorted(e, c) for e, c in zip(bins.edges, x.T)], 1)
    held = np.stack([np.searchsorted(e, c) for e, c in zip(bins.edges, z.T)], 1)
    rng, want = np.random.default_rng(42), np.zeros(len(z))
    for _ in range(4):
        tree = plain_tree(flat, y, rng.integers(0, n, n), 8, 20, 0.0)
        want += np.array([plain_leaf(tree, row) for row in held]) / 4
    np.testing.assert_allclose(got, want, rtol=1e-10)


def counted(monkeypatch, name, n, m):
    """How many values a fit puts in histograms."""
    r, seen, plain = np.random.default_rng(0), [0], np.bincount
    x = r.standard_normal((n, m))
    y = x[:, 0] + 0.5 * x[:, 1] ** 2 + r.standard_normal(n)

    def bincount(v, *rest, **more):
        seen[0] += len(v)
        return plain(v, *rest, **more)

    with monkeypatch.context() as at:
        at.setattr(np, "bincount", bincount)
        models.fit(name, x, y)
    return seen[0]


def test_forest_counts_a_fraction_of_its_draws(monkeypatch):
    n, m = 60000, 6
    assert counted(monkeypatch, "RandomForest", n, m) < 0.4 * 100 * 8 * 2 * n * m


@pytest.mark.parametrize("n,copies", [(500, 5), (12000, 1), (12000, 12)])
def test_boosting_takes_the_splits_of_plain_trees(n, copies):
    x, y, z = tied(n, copies)
    bins = models.Bins(n, iter(x.T))
    got = models.fit_boosting(bins, y, trees=4)(z)
    flat = np.stack([np.searchsorted(e, c) for e, c in zip(bins.edges, x.T)], 1)
    held = np.stack([np.searchsorted(e, c) for e, c in zip(bins.edges, z.T)], 1)
    rest, want = y - y.mean(), np.full(len(z), y.mean())
    for _ in range(4):
        tree = plain_tree(flat, rest, np.arange(n), 4, 1, 1.0)
        rest = rest - 0.01 * np.array([plain_leaf(tree, row) for row in flat])
        want += 0.01 * np.array([plain_leaf(tree, row) for row in held])
    np.testing.assert_allclose(got, want, rtol=1e-12)


def test_boosting_counts_a_fraction_of_its_rows(monkeypatch):
    n, m = 60000, 6
    assert counted(monkeypatch, "XGBoost", n, m) < 0.4 * 100 * 4 * 2 * n * m


@pytest.mark.parametrize("name", models.MODELS)
def test_blocks_of_rows_fit_like_all_at_once(name):
    r = np.random.default_rng(2)
    x = r.standard_normal((1003, 5))
    y = 2 * x[:, 0] - x[:, 1] + 0.3 * r.standard_normal(1003)
    x[r.random(x.shape) < 0.03] = np.nan
    x[:, 4] = np.nan
    rows = models.Rows(5, held=1000)
    for at in range(0, 1003, 97):
        rows.add(x[at : at + 97], y[at : at + 97])
    np.testing.assert_allclose(models.fit_rows(name, rows)(x[:200]), models.fit(name, x, y)(x[:200]), rtol=1e-9)


@pytest.mark.parametrize("name", ["Ridge", "Lasso", "ElasticNet"])
def test_linear_fits_hold_a_fraction_of_their_rows(name):
    n, m, r = 8000, 24, np.random.default_rng(0)
    tracemalloc.start()
    rows = models.Rows(m, held=1 << 20)
    for _ in range(25):
        x = r.standard_normal((n, m))
        rows.add(x, x[:, 0] + r.standard_normal(n))
    models.fit_rows(name, rows)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 0.5 * 25 * n * m * 8


def test_batches_of_any_size_give_the_same_predictions(spark):
    rows = [("d", (i * 7919) % 6000, i, float(i % 7), float(i % 11) / 10 + i % 7) for i in range(600)]
    df = spark.createDataFrame(rows, "date string, trade_ts bigint, ticker int, f double, y_5s_ret double")
    found = []
    for most in ("7", "10000"):
        with io.setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", most):
            got = models.rolling_predict(df, ["f"], ["Ridge", "RandomForest"], train=1800, step=300, least=50, keep=["ticker"])
            assert got.columns == ["ticker", "date", "trade_ts", "y_5s_ret", "refit", "model", "y_pred"]
            found.append({(v.ticker, v.model): (v.refit, v.y_pred) for v in got.collect()})
    assert len(found[0]) == 2 * sum(t >= 1800 for _, t, *_ in rows) and found[0].keys() == found[1].keys()
    assert all(found[0][k][0] == v[0] and abs(found[0][k][1] - v[1]) < 1e-9 for k, v in found[1].items())
