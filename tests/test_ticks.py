"""Tick operators against direct versions on seeded ticks and at the edges."""

import bisect
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import numeric, symbols, times
from tickloom.operators import clean, features, labels, metrics, models, rolling, select
from tickloom.operators.asof import asof_join
from tickloom.operators.windows import span_label
from tickloom.plans.config import UNDERLYINGS, Settings

SECOND = 1_000_000_000
TICK = "g string, trade_ts bigint, sequence_number bigint, price double, size double, bid_price double, ask_price double, bid_size double, ask_size double, mid double"


def tick_rows(seed=1, groups=3, n=120, holes=True):
    r, rows = random.Random(seed), []
    for g in range(groups):
        t, p = 0, 5.0
        for i in range(n):
            t += int(r.expovariate(1 / 3) * SECOND) * (r.random() > 0.1)
            p = max(0.05, p + r.choice([-0.05, 0, 0, 0.05]))
            bid, ask = p - r.choice([0, 0.05]), p + r.choice([0, 0.05, 0.1])
            row = [f"g{g}", t, i, p, float(r.randint(0, 9)), bid, ask, float(r.randint(0, 5)), float(r.randint(0, 5)), (bid + ask) / 2]
            if holes and r.random() < 0.08:
                row[r.choice([3, 4, 9])] = r.choice([None, math.nan, math.inf, 0.0])
            rows.append(tuple(row))
    return rows


def fin(x):
    return x is not None and math.isfinite(x)


def test_asof_takes_the_latest_quote_and_breaks_ties_by_sequence(spark):
    r = random.Random(3)
    trades = [(r.choice("ab"), r.randint(0, 50), i) for i in range(200)] + [(None, 3, 900), ("a", None, 901), ("z", 9, 902)]
    quotes = [(r.choice("ab"), r.randint(5, 50), s, float(s)) for s in range(150)] + [(None, 3, 999, 1.0)]
    got = asof_join(spark.createDataFrame(trades, "ticker string, trade_ts bigint, i int"), spark.createDataFrame(quotes, "ticker string, quote_ts bigint, sequence_number bigint, bid double")).collect()
    assert len(got) == 201
    for x in got:
        fits = [(t, s) for k, t, s, _ in quotes if k == x.ticker and t <= x.trade_ts]
        assert (x.quote_ts, x.sequence_number) == (max(fits) if fits else (None, None))


def test_labels_count_later_trades_only(spark):
    rows = [x for x in tick_rows() if fin(x[3]) and fin(x[9])]
    df = spark.createDataFrame(tick_rows(), TICK)
    for h in (5, 30):
        for x in labels.add_label(df, h, ["g"]).collect():
            later = [y[3] for y in rows if y[0] == x.g and x.trade_ts < y[1] <= x.trade_ts + h * SECOND]
            assert x.n_future_trades_5s == len(later)
            assert x.future_avg_trade_price_5s == (pytest.approx(sum(later) / len(later)) if later else None)
            assert x.y_5s_ret == (pytest.approx(sum(later) / len(later) / x.mid - 1) if later and x.mid > 0 else None)


def brute_direction(rows):
    out, last = [], 0.0
    for i, x in enumerate(rows):
        p, m = (v if fin(v) else None for v in (x[3], x[9]))
        before = rows[i - 1][3] if i else None
        tick = None
        if p is not None and fin(before):
            tick = float(np.sign(p - before))
            if tick:
                last = tick
            else:
                tick = last
        out.append(0 if p is None else int(np.sign(p - m)) if m is not None and p != m else int(tick or 0))
    return out


def test_direction_and_features(spark):
    rows = tick_rows(seed=5)
    spans = ((0, 5), (5, 20), (0.5, 60))
    got = {(x.g, x.sequence_number): x for x in features.add_features(spark.createDataFrame(rows, TICK), spans, ["g"], turnover_base="size").collect()}
    for g in ("g0", "g1", "g2"):
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1], x[2]))
        d, ts = brute_direction(own), [x[1] for x in own]
        ok = lambda v: v if fin(v) else None
        col = lambda k: [ok(x[k]) for x in own]
        px, sz, bid, ask, bs, as_, mid = (col(k) for k in (3, 4, 5, 6, 7, 8, 9))
        pos = lambda v: v is not None and v > 0
        for i, x in enumerate(own):
            row = got[g, x[2]]
            assert row.dir_proxy == d[i]
            for left, right in spans:
                a, b = bisect.bisect_right(ts, ts[i] - int(right * SECOND)), bisect.bisect_right(ts, ts[i] - int(left * SECOND))
                w = range(a, b)
                val = lambda f: row[features.column_name(f, left, right)]  # noqa: E731, B023
                if not w:
                    assert all(val(f) is None for f in features.FAMILIES)
                    continue
                near = lambda v: None if v is None else pytest.approx(v, rel=1e-9, abs=1e-12)
                mean = lambda v: (lambda u: sum(u) / len(u) if u else None)([y for y in v if y is not None])
                volume = sum(sz[j] for j in w if sz[j] is not None)
                last, first = mid[b - 1], mid[a]
                assert val("breadth") == len(w) and val("immediacy") == near((right - left) / len(w)) and val("volume_all") == near(volume) and val("volume_avg") == near(volume / len(w))
                assert val("volume_max") == max((sz[j] for j in w if sz[j] is not None), default=None)
                assert val("lambda_") == near((last - first) / volume if volume > 0 and last is not None and first is not None else None)
                assert val("lob_imbalance") == near(mean([(as_[j] - bs[j]) / (as_[j] + bs[j]) if as_[j] + bs[j] > 0 else None for j in w]))
                assert val("txn_imbalance") == near(sum(sz[j] * d[j] for j in w if sz[j] is not None) / volume if volume > 0 else None)
                m = mean([px[j] for j in w])
                assert val("past_return") == near(1 - m / last if pos(last) and m is not None else None)
                assert val("turnover") == near(volume / sz[i] if pos(sz[i]) else None)
                cov = [math.log(px[j] / px[j - 1]) * math.log(px[j - 1] / px[j - 2]) if j > 1 and pos(px[j]) and pos(px[j - 1]) and pos(px[j - 2]) else None for j in w]
                assert val("autocov") == near(mean(cov))
                assert val("quoted_spread") == near(mean([(ask[j] - bid[j]) / mid[j] if pos(mid[j]) else None for j in w]))
                den = sum(sz[j] * px[j] for j in w if pos(px[j]) and sz[j] is not None)
                num = sum(math.log(px[j] / mid[j]) * d[j] * sz[j] * px[j] for j in w if pos(px[j]) and pos(mid[j]) and sz[j] is not None)
                assert val("effective_spread") == near(num / den if den > 0 else None)


def test_later_rows_change_no_feature(spark):
    rows = tick_rows(groups=1, n=60)
    late = ("g0", rows[-1][1] + 10**12, 999, 9.0, 1.0, 8.0, 9.0, 1.0, 1.0, 8.5)
    a, b = (sorted(map(str, features.add_features(spark.createDataFrame(x, TICK), ((0, 30),), ["g"]).filter("sequence_number < 999").collect())) for x in (rows, [*rows, late]))
    assert a == b


def test_names_and_selection():
    assert [span_label(*s) for s in ((0, 5), (0.5, 1))] == ["0_5s", "0p5_1s"]
    cols = [features.column_name(f, *s) for f in features.FAMILIES for s in Settings().spans]
    assert len(cols) == 117 and "lambda__0_5s" in cols and len(features.predictor_columns(cols)) == 108 and len(features.predictor_columns(cols, include_lambda=True)) == 117
    assert len(UNDERLYINGS) == 78 == len(set(UNDERLYINGS))


def test_cleaning_rules(spark):
    good = ("a", "d", 5.0, 3, 4.9, 5.1, 5, 5)
    cases = {
        "c1": ("a", "d", 0.0, 3, 4.9, 5.1, 5, 5), "c2": ("a", "d", 5.0, 3, 5.1, 4.9, 5, 5), "c3": ("a", "d", 5.0, 3, 4.9, 5.1, 1, 1),
        "c4": ("a", "d", 5.0, 3, 4.9, 20.0, 5, 5), "c6": ("a", "d", 5.0, 3, 1.0, 5.1, 5, 5), "c7": ("a", "d", 9.0, 3, 4.9, 5.1, 5, 5),
    }
    rows = [(*good, i) for i in range(60)] + [(*c, 100 + i) for i, c in enumerate(cases.values())] + [("a", "d", None, 3, 4.9, 5.1, 5, 5, 200), ("a", "d", 5.0, 3, 44.9, 45.1, 5, 5, 30)]
    df = spark.createDataFrame(rows, "ticker string, date string, price double, size int, bid_price double, ask_price double, bid_size int, ask_size int, trade_ts bigint")
    flags = {r.trade_ts: r for r in clean.flag_rules(df).collect() if r.trade_ts >= 100}
    for i, rule in enumerate(cases):
        assert flags[100 + i][rule] and flags[100 + i].bad
    assert not flags[200].bad  # what can't be decided stays
    kept = clean.clean_rows(df)
    counts = {r.rule: r["count"] for r in clean.rule_counts(clean.flag_rules(df)).collect()}
    assert counts["any_rule"] == df.count() - kept.count() and len(counts) == 8
    assert [r["count"] for r in clean.rule_counts(clean.flag_rules(df.limit(0))).collect()] == [0] * 8


def test_simultaneous_trades(spark):
    rows = [("a", 1, 10, 5, 1.0, 2.0, 3, 4, None), ("a", 1, 9, 4, 3.0, 4.0, 5, 6, 7), ("a", 2, 1, 1, 1.0, 2.0, 1, 1, 1)]
    df = spark.createDataFrame(rows, "ticker string, trade_ts bigint, quote_ts bigint, size bigint, bid_price double, ask_price double, bid_size bigint, ask_size bigint, sequence_number bigint").withColumn("price", F.col("size").cast("double"))
    x = clean.merge_simultaneous(df).filter("trade_ts = 1").first()
    assert (x.price, x.size, x.bid_price, x.ask_price, x.bid_size, x.ask_size, x.sequence_number, x.quote_ts, x.mid) == (4.5, 9, 2.0, 3.0, 8, 10, 7, 9, 2.5)
    assert clean.merge_simultaneous(df, sum_quote_sizes=False).filter("trade_ts = 1").first().bid_size == 5


def test_ties_do_not_depend_on_the_order_of_input(spark):
    rows = [("a", 5, 3, c, float(p), 1.0, 2.0, 1, 1, 1, o) for o, (c, p) in enumerate([(None, 3), ("X", 1), ("Y", 2), ("Z", 4)])]
    names = "ticker string, trade_ts bigint, quote_ts bigint, conditions string, price double, bid_price double, ask_price double, size int, bid_size int, ask_size int, trade_order int"
    r = random.Random(1)
    for known in (True, False):
        found = set()
        for _ in range(4):
            r.shuffle(rows)
            df = spark.createDataFrame(rows, names).repartition(3)
            found.add(clean.merge_simultaneous(df if known else df.drop("trade_order")).first().conditions)
        assert len(found) == 1 and (not known or found == {"X"})
    ticks = [("a", "d", t // 10, float(r.randint(1, 99))) for t in range(120)]
    got = []
    for _ in range(2):
        r.shuffle(ticks)
        df = spark.createDataFrame(ticks, "ticker string, date string, trade_ts bigint, mid double").repartition(4)
        got.append(sorted(map(str, clean.add_rolling_deviation(df).collect())))
    assert got[0] == got[1]


def test_symbols(spark):
    names = ["O:AAPL251219C00150000", "SPY250103P00412500", "O:AAPL1251219C00150000", "O:aapl251219C00150000", "", None, "O:AAPL251219C0015000", "O:AAPL251399C00150000"]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    got = [tuple(r) for r in df.select(*symbols.parse_symbol(F.col("s")).values()).collect()]
    assert got[0][0] == "AAPL" and str(got[0][1]) == "2025-12-19" and got[0][2:] == ("C", 150.0) and got[1][3] == 412.5
    assert all(g == (None,) * 4 for g in got[2:7]) and got[7][1] is None
    assert [r[0] for r in df.select(symbols.of_roots(F.col("s"), ["AAPL"])).collect()][:3] == [True, False, False]


def test_clocks(spark):
    # both switches of 2025 and the ends of the session in New York
    at = {"2025-03-09 06:59:59": "01:59:59", "2025-03-09 07:00:00": "03:00:00", "2025-11-02 05:59:59": "01:59:59", "2025-11-02 06:00:00": "01:00:00"}
    rows = [(t,) for t in at]
    df = spark.createDataFrame(rows, "t string").withColumn("ns", F.unix_micros(F.to_timestamp("t")) * 1000 + 999)
    got = df.select("t", *(c.alias(n) for n, c in times.clock_columns(F.col("ns")).items())).collect()
    assert {r.t: r.dt_et.strftime("%H:%M:%S") for r in got} == at and all(r.dt.microsecond == 0 for r in got)
    edges = [("09:29:59.999999", False), ("09:30:00", True), ("16:00:00", True), ("16:00:00.000001", False)]
    e = spark.createDataFrame([(f"2025-01-02 {c}", w) for c, w in edges], "c string, w boolean")
    assert e.filter(times.in_session(F.to_timestamp("c")) != F.col("w")).count() == 0
    assert spark.range(1).select(times.instant(F.lit(-1).cast("long")).alias("x")).first().x.microsecond == 999999


def test_missing_numbers(spark):
    df = spark.createDataFrame([("1.5",), ("nan",), ("inf",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(numeric.coerce(F.col("s"))).collect()] == [1.5, None, None, None, None]
    assert spark.createDataFrame([(math.nan, 1)], "a double, b int").transform(numeric.normalise).first().a is None


def test_spots_and_contracts(spark):
    rows = [("A", "A1", 1, 90.0, 5), ("A", "A2", 1, 110.0, 5), ("B", "B1", 1, 50.0, 0), ("B", "B2", 3, 70.0, 0), ("C", "C1", 99, 10.0, 1)]
    df = spark.createDataFrame(rows, "underlying string, ticker string, dte int, strike double, size int")
    spots = spark.createDataFrame([("A", 100.0), ("B", math.nan)], "underlying string, spot double")
    got = {r.ticker: r for r in select.add_moneyness(select.add_spot(df, spots)).collect()}
    assert set(got) == {"A1", "A2", "B1", "B2"} and got["A1"].abs_moneyness == pytest.approx(0.1) and got["B1"].spot == pytest.approx(60.0)
    assert [r.ticker for r in select.top_contracts(df, n=1).orderBy("underlying").collect()] == ["A1", "B1", "C1"]
    assert select.at_least(df, ["underlying"], 2).count() == 4


def test_refits(spark):
    r = random.Random(4)
    rows = [("x", r.randint(0, 5000), float(i)) for i in range(300)] + [("y", t, 1.0) for t in (0, 100)]
    train, step = 1800, 300
    got = rolling.assign(spark.createDataFrame(rows, "d string, t bigint, y double"), ["d"], "t", train, step).collect()
    ts = [t for d, t, _ in rows if d == "x"]
    first, last, want = min(ts) + train, max(ts), []
    for k in range((last - first) // step + 1):
        at = first + k * step
        want += [(t, y, k, False) for d, t, y in rows if d == "x" and at - train <= t < at]
        want += [(t, y, k, True) for d, t, y in rows if d == "x" and at <= t < at + step]
    assert sorted((x.t, x.y, x.refit, x.test) for x in got) == sorted(want)


def test_linear_models_reach_their_optimum():
    r = np.random.default_rng(0)
    x = r.standard_normal((300, 8))
    y = x @ np.array([1.0, -2, 0, 0, 0.5, 0, 0, 0]) * 1e-3 + 1e-3 * r.standard_normal(300) + 0.01
    xc, yc = x - x.mean(0), y - y.mean()
    for a, (w, c) in zip((0.1, 10.0), models.ridge(x, y, (0.1, 10.0))):
        np.testing.assert_allclose(w, np.linalg.solve(xc.T @ xc + a * np.eye(8), xc.T @ yc), rtol=1e-8)
        assert c == pytest.approx(y.mean() - x.mean(0) @ w)
    for l1 in (1.0, 0.5):
        for a, (w, _) in zip(grid := models.alpha_grid(x, y, 20, l1), models.enet_path(x, y, grid, l1, tol=1e-10)):
            slope = xc.T @ (yc - xc @ w) / 300 - a * (1 - l1) * w
            assert (np.abs(slope[w == 0]) <= a * l1 + 1e-9).all()
            np.testing.assert_allclose(slope[w != 0], a * l1 * np.sign(w[w != 0]), atol=1e-7)
    assert [(len(a), len(b), b[0]) for a, b in models.expanding_folds(103)] == [(28, 25, 28), (53, 25, 53), (78, 25, 78)]


@pytest.mark.parametrize("name", models.MODELS)
def test_models_learn_and_bear_missing_values(name):
    r = np.random.default_rng(1)
    x = r.standard_normal((600, 5))
    y = 2 * x[:, 0] - x[:, 1] + 0.1 * r.standard_normal(600)
    x[r.random(x.shape) < 0.02] = np.nan
    x[:, 4] = np.nan
    p = models.fit(name, x[:400], y[:400])(x[400:])
    assert np.isfinite(p).all() and models.r2(y[400:], p) > (0.25 if name == "XGBoost" else 0.7)


# ---- independent solvers
def plain_lasso(x, y, a, l1, steps=4000):
    """Proximal gradient with momentum on squares / 2n + a (l1 |w| + (1 - l1) w^2 / 2)."""
    n, m = x.shape
    mx, my = x.mean(0), y.mean()
    x, y = x - mx, y - my
    rate = 1 / (np.linalg.norm(x, 2) ** 2 / n + a * (1 - l1))
    w, v, t = np.zeros(m), np.zeros(m), 1.0
    for _ in range(steps):
        z = v - rate * (x.T @ (x @ v - y) / n + a * (1 - l1) * v)
        new = np.sign(z) * np.maximum(np.abs(z) - rate * a * l1, 0)
        t, last = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        v = new + (last - 1) / t * (new - w)
        if np.abs(new - w).max() < 1e-13:
            break
        w = new
    return w, my - mx @ w


def plain_ridge(x, y, a):
    mx, my = x.mean(0), y.mean()
    w = np.linalg.solve((x - mx).T @ (x - mx) + a * np.eye(x.shape[1]), (x - mx).T @ (y - my))
    return w, my - mx @ w


def plain_tree(bins, y, depth, least, shrink):
    if depth and len(y) >= 2 * least:
        own, best = y.sum() ** 2 / (len(y) + shrink), (1e-15, None, None)
        for j in range(bins.shape[1]):
            for b in range(64):
                low = bins[:, j] <= b
                if low.sum() >= least and (~low).sum() >= least:
                    gain = y[low].sum() ** 2 / (low.sum() + shrink) + y[~low].sum() ** 2 / ((~low).sum() + shrink) - own
                    if gain > best[0] + 1e-12:
                        best = gain, j, b
        if best[1] is not None:
            _, j, b = best
            low = bins[:, j] <= b
            left, right = plain_tree(bins[low], y[low], depth - 1, least, shrink), plain_tree(bins[~low], y[~low], depth - 1, least, shrink)
            return lambda z: left(z) if z[j] <= b else right(z)
    value = y.sum() / (len(y) + shrink)
    return lambda z: value


def plain_fit(name, x, y, z):
    """Predictions at z by other means than the library's."""
    middle = np.array([np.median(c[~np.isnan(c)]) for c in x.T])
    x, z = (np.where(np.isnan(v), middle, v) for v in (x, z))
    if name != "RandomForest":
        mean, std = x.mean(0), x.std(0)
        x, z = (x - mean) / std, (z - mean) / std
    n = len(y)
    if name in ("Ridge", "Lasso", "ElasticNet"):
        l1 = 0.5 if name == "ElasticNet" else 1.0
        if name == "Ridge":
            grid, solve = np.logspace(-3, 3, 50), plain_ridge
        else:
            top = np.abs((x - x.mean(0)).T @ (y - y.mean())).max() / (n * l1)
            grid, solve = np.geomspace(top, top / 1000, 50 if name == "Lasso" else 100), lambda a, b, c: plain_lasso(a, b, c, l1)
        size, score = n // 4, np.zeros(len(grid))
        for s in (n - 3 * size, n - 2 * size, n - size):
            test = slice(s, s + size)
            for k, a in enumerate(grid):
                w, c = solve(x[:s], y[:s], a)
                sse = ((y[test] - x[test] @ w - c) ** 2).sum()
                score[k] += -sse if name != "Ridge" else 1 - sse / ((y[test] - y[test].mean()) ** 2).sum()
        w, c = solve(x, y, grid[int(np.argmax(score))])
        return z @ w + c
    cut = [np.unique(np.quantile(c, np.linspace(0, 1, 64)[1:-1])) for c in x.T]
    binned = lambda v: np.array([[int((e < u).sum()) for e, u in zip(cut, row)] for row in v])
    bx, bz, out = binned(x), binned(z), np.zeros(len(z))
    if name == "RandomForest":
        rng = np.random.default_rng(42)
        for _ in range(100):
            rows = rng.integers(0, n, n)
            tree = plain_tree(bx[rows], y[rows], 8, 20, 0.0)
            out += np.array([tree(v) for v in bz]) / 100
        return out
    rest = y - y.mean()
    for _ in range(100):
        tree = plain_tree(bx, rest, 4, 1, 1.0)
        rest = rest - 0.01 * np.array([tree(v) for v in bx])
        out += 0.01 * np.array([tree(v) for v in bz])
    return out + y.mean()


def test_all_models_against_independent_solvers(spark):
    r = np.random.default_rng(5)
    n, names = 150, ["f0", "f1", "f2"]
    x = r.standard_normal((n, 3))
    y = 0.8 * x[:, 0] - 0.4 * x[:, 1] ** 2 + 0.5 * r.standard_normal(n)
    x[r.random(x.shape) < 0.03] = np.nan
    rows = [("d", i * 10, i, *(None if math.isnan(v) else float(v) for v in x[i]), float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "date string, trade_ts bigint, i int, f0 double, f1 double, f2 double, y_5s_ret double")
    # one refit: the rows before 1100 train, the others are predicted
    got = models.rolling_predict(df, names, train=1100, step=1000, least=50, keep=["i"]).collect()
    for name in models.MODELS:
        mine = {v.i: v.y_pred for v in got if v.model == name}
        assert sorted(mine) == list(range(110, 150))
        want = plain_fit(name, x[:110], y[:110], x[110:])
        np.testing.assert_allclose([mine[i] for i in sorted(mine)], want, atol=2e-3 * y.std(), err_msg=name)


def test_rolling_predictions_are_one_a_row(spark):
    rows = [("d", i * 10, i, float(i % 7), float(i % 7) / 10) for i in range(600)]
    df = spark.createDataFrame(rows, "date string, trade_ts bigint, ticker int, f double, y_5s_ret double")
    got = models.rolling_predict(df, ["f"], ["Ridge"], train=1800, step=300, least=50, keep=["ticker"]).collect()
    assert len(got) == len({r.ticker for r in got}) == 420 and max(abs(r.y_pred - r.y_5s_ret) for r in got) < 1e-3
    assert models.rolling_predict(df, ["f"], ["Ridge"], train=1800, step=300, least=500).count() == 0


def test_metrics_at_the_edges(spark):
    schema = "m string, y_5s_ret double, y_pred double"
    rows = [("a", 1.0, 1.0), ("a", 2.0, 1.0), ("b", 1.0, 1.0), ("b", 1.0, 1.0), ("c", 1.0, 2.0), ("c", 1.0, 2.0), ("d", 1.0, 1.0), ("e", None, 1.0)]
    got = {r.m: r for r in metrics.evaluate(spark.createDataFrame(rows, schema), ["m"]).collect()}
    assert got["a"].r2 == -1.0 and got["b"].r2 == 1.0 and got["c"].r2 == 0.0 and got["d"].r2 is None and "e" not in got
    assert metrics.evaluate(spark.createDataFrame([], schema)).count() == 0
    r = random.Random(2)
    values = [("a", r.random(), r.random()) for _ in range(500)]
    e = np.array([a - b for _, a, b in values])
    want, _ = np.histogram(e, 80)
    hist = {x.bin: x.n for x in metrics.residual_histogram(spark.createDataFrame(values, schema)).collect()}
    assert [hist.get(i, 0) for i in range(80)] == want.tolist()
