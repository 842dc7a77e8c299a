"""Five regressors in NumPy, fitted once per refit inside one grouped map.

Linear models choose their penalty by expanding-window cross-validation. The trees are grown on
quantile bins; they follow the same settings as the usual libraries but not their random streams,
so they agree in distribution, not digit by digit.

A refit's training rows come as a stream and lie on disk; columns and blocks of them are read again. Linear models need
only a triangular factor of each block between fold edges, trees one byte a value.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.rolling import assign


class Rows:
    """Training rows in the order in which they are added, in a temporary file beyond ``held`` bytes; labels stay in memory."""

    def __init__(self, m: int, held: int = 16 << 20):
        self.m, self.n, self._blocks, self._y = m, 0, [], []
        self._file = tempfile.SpooledTemporaryFile(held, dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        self._blocks.append((self.n * self.m * 8, len(y)))
        self._file.seek(0, os.SEEK_END)
        self._file.write(np.ascontiguousarray(x.T, float).tobytes())
        self._y.append(np.array(y, float))
        self.n += len(y)

    def _read(self, at: int, values: int) -> np.ndarray:
        self._file.seek(at)
        return np.frombuffer(self._file.read(values * 8))

    def column(self, j: int) -> np.ndarray:
        return np.concatenate([self._read(at + j * k * 8, k) for at, k in self._blocks]) if self._blocks else np.zeros(0)

    def blocks(self) -> Iterator[np.ndarray]:
        for at, k in self._blocks:
            yield self._read(at, k * self.m).reshape(self.m, k).T

    def labels(self) -> np.ndarray:
        self._y = [np.concatenate(self._y)] if self._y else [np.zeros(0)]
        return self._y[0]

    def close(self) -> None:
        self._file.close()


class Prepared:
    """Median imputation and, for linear models and boosting, scaling by the population deviation."""

    def __init__(self, rows: Rows, scale: bool):
        self.keep, found = np.zeros(rows.m, bool), []
        for j in range(rows.m):
            c = rows.column(j)
            known = np.isfinite(c)
            if known.any():
                self.keep[j] = True
                middle = np.median(c[known])
                c = np.where(known, c, middle)
                std = c.std() if scale else 1.0
                found.append((middle, c.mean() if scale else 0.0, std if std > 0 else 1.0))
        self.median, self.mean, self.std = np.array(found).reshape(-1, 3).T

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = x[:, self.keep]
        return (np.where(np.isfinite(x), x, self.median) - self.mean) / self.std

    def columns(self, rows: Rows) -> Iterator[np.ndarray]:
        """The kept columns, imputed and scaled, one after the other."""
        for i, j in enumerate(np.flatnonzero(self.keep)):
            c = rows.column(j)
            yield (np.where(np.isfinite(c), c, self.median[i]) - self.mean[i]) / self.std[i]


def expanding_folds(n: int, folds: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """The last ``folds`` blocks of n // (folds + 1) rows, each tested on all rows before it."""
    size = n // (folds + 1)
    starts = [n - (folds - k) * size for k in range(folds)]
    return [(np.arange(s), np.arange(s, s + size)) for s in starts if s > 0 and size > 0]


def ridge(x: np.ndarray, y: np.ndarray, alphas: Sequence[float]) -> list[tuple[np.ndarray, float]]:
    """(coefficients, intercept) for each alpha, minimising squares + alpha |w|^2, from one decomposition."""
    return Factor.of(x, y).solve(_ridge, alphas)


class Factor:
    """The triangular factor of the columns 1, x and y of some rows: sums of squares over the rows are the same over it."""

    def __init__(self, m: int):
        self.n, self.r = 0, np.zeros((0, m + 2))

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray) -> Factor:
        f = cls(x.shape[1])
        f.add(x, y)
        return f

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        self._put(np.column_stack([np.ones(len(y)), x, y]), len(y))

    def _put(self, rows: np.ndarray, n: int) -> None:
        self.r, self.n = np.linalg.qr(np.concatenate([self.r, rows]), mode="r"), self.n + n

    @classmethod
    def joined(cls, parts: Sequence[Factor]) -> Factor:
        f = cls(parts[0].r.shape[1] - 2)
        for p in parts:
            f._put(p.r, p.n)
        return f

    def centred(self) -> tuple[np.ndarray, np.ndarray]:
        """Few rows that stand for those of x and y without their means."""
        return self.r[1:, 1:-1], self.r[1:, -1]

    def solve(self, path: Callable, alphas: Sequence[float]) -> list[tuple[np.ndarray, float]]:
        """(coefficients, intercept) for each alpha of a path over (centred x, centred y, number of rows, alphas)."""
        x, y = self.centred()
        mean = self.r[0] / self.r[0, 0]
        return [(w, float(mean[-1] - mean[1:-1] @ w)) for w in path(x, y, self.n, alphas)]

    def squares(self, w: np.ndarray, c: float) -> float:
        """Of the rows' distances from x @ w + c."""
        d = self.r @ np.concatenate([[-c], -w, [1.0]])
        return float(d @ d)


def _ridge(x: np.ndarray, y: np.ndarray, n: int, alphas: Sequence[float]) -> list[np.ndarray]:
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    p = u.T @ y
    return [vt.T @ (p * s / (s * s + a)) for a in alphas]


def _duality_gap(w: np.ndarray, q: np.ndarray, grad: np.ndarray, energy: float, l1: float, l2: float) -> float:
    """How far squares / 2 + l1 |w|_1 + l2 |w|^2 / 2 can be above its least value; all terms are means over rows."""
    rest = max(energy - 2 * float(q @ w) + float(w @ grad), 0.0)
    steepest = float(np.abs(q - grad - l2 * w).max(initial=0))
    c = l1 / steepest if steepest > l1 else 1.0
    gap = 0.5 * rest * (1 + c * c) if c < 1 else rest
    return gap + l1 * float(np.abs(w).sum()) - c * (energy - float(q @ w)) + 0.5 * l2 * (1 + c * c) * float(w @ w)


def enet_path(x: np.ndarray, y: np.ndarray, alphas: Sequence[float], l1: float, most: int = 20000, tol: float = 1e-4) -> list[tuple[np.ndarray, float]]:
    """Coordinate descent on squares / 2n + alpha (l1 |w|_1 + (1 - l1) |w|^2 / 2), warm from alpha to alpha."""
    return Factor.of(x, y).solve(lambda *a: _enet(*a, l1, most, tol), alphas)


def _enet(xc: np.ndarray, yc: np.ndarray, n: int, alphas: Sequence[float], l1: float, most: int = 20000, tol: float = 1e-4) -> list[np.ndarray]:
    m = xc.shape[1]
    gram, q = xc.T @ xc / n, xc.T @ yc / n
    w, out = np.zeros(m), []
    diag, energy = np.diag(gram).copy(), float(yc @ yc) / n
    for a in alphas:
        grad = gram @ w
        for _ in range(most):
            widest = biggest = 0.0
            for j in range(m):
                if diag[j] == 0:
                    continue
                old = w[j]
                z = q[j] - grad[j] + diag[j] * old
                new = np.sign(z) * max(abs(z) - a * l1, 0.0) / (diag[j] + a * (1 - l1))
                if new != old:
                    grad += gram[:, j] * (new - old)
                    w[j] = new
                widest, biggest = max(widest, abs(new - old)), max(biggest, abs(new))
            if (widest <= tol * biggest or biggest == 0) and _duality_gap(w, q, grad, energy, a * l1, a * (1 - l1)) <= tol * energy:
                break
        out.append(w.copy())
    return out


def alpha_grid(x: np.ndarray, y: np.ndarray, n: int, l1: float, eps: float = 1e-3) -> np.ndarray:
    return _grid(*Factor.of(x, y).centred(), len(y), n, l1, eps)


def _grid(xc: np.ndarray, yc: np.ndarray, rows: int, n: int, l1: float, eps: float = 1e-3) -> np.ndarray:
    top = np.abs(xc.T @ yc).max(initial=0) / (rows * l1)
    return np.geomspace(top, top * eps, n) if top > 0 else np.full(n, np.finfo(float).resolution)


def r2(y: np.ndarray, p: np.ndarray) -> float:
    sse, sst = float(((y - p) ** 2).sum()), float(((y - y.mean()) ** 2).sum())
    return 1 - sse / sst if sst else float(sse == 0)


def factors(rows: Rows, prepared: Prepared) -> list[Factor]:
    """Of the rows between the edges of the expanding folds, in order: what trains first, then the tested blocks."""
    n, m = rows.n, int(prepared.keep.sum())
    edges = [b[0] for _, b in expanding_folds(n)] + [n]
    out, y, at, k = [Factor(m)], rows.labels(), 0, 0
    for x in rows.blocks():
        first, last = 0, len(x)
        while first < last:
            if at == edges[k]:
                out.append(Factor(m))
                k += 1
            to = min(last, first + edges[k] - at)
            out[-1].add(prepared(x[first:to]), y[at : at + to - first])
            first, at = to, at + to - first
    return out


def fit_linear(name: str, rows: Rows, prepared: Prepared) -> Callable[[np.ndarray], np.ndarray]:
    """Each fold trains on the blocks before the one that it is tested on."""
    parts, y = factors(rows, prepared), rows.labels()
    whole = Factor.joined(parts)
    if name == "Ridge":
        alphas, path = np.logspace(-3, 3, 50), _ridge
    else:
        l1, n = (1.0, 50) if name == "Lasso" else (0.5, 100)
        alphas, path = _grid(*whole.centred(), whole.n, n, l1), lambda *a: _enet(*a, l1)
    total, at = np.zeros(len(alphas)), parts[0].n
    for i, test in enumerate(parts[1:], 1):
        held, at = y[at : at + test.n], at + test.n
        sst = float(((held - held.mean()) ** 2).sum())
        for k, (w, c) in enumerate(Factor.joined(parts[:i]).solve(path, alphas)):
            sse = test.squares(w, c)
            total[k] += -sse / test.n if name != "Ridge" else 1 - sse / sst if sst else float(sse == 0)
    best = int(np.argmax(total))
    w, c = whole.solve(path, alphas[best : best + 1] if name == "Ridge" else alphas[: best + 1])[-1]
    return lambda z: z @ w + c


WIDTH = 64  # bins of a column
DIRECT = 4096  # nodes of no more rows are counted a column at a time


class Bins:
    """Binned columns two by two: 64 times the bin of the first plus that of the second; the last may have no partner."""

    def __init__(self, n: int, columns: Iterator[np.ndarray] = iter(())):
        self.edges, self.n, pairs = [], n, []
        for j, c in enumerate(columns):
            e = np.unique(np.quantile(c, np.linspace(0, 1, WIDTH)[1:-1]))
            self.edges.append(e)
            b = np.searchsorted(e, c).astype(np.uint16)
            if j % 2:
                pairs[-1] += b
            else:
                pairs.append(b * np.uint16(WIDTH))
        self.pairs, self._whole = np.stack(pairs) if pairs else np.zeros((0, n), np.uint16), None

    def column(self, j: int, rows: np.ndarray | None) -> np.ndarray:
        p = self.pairs[j // 2] if rows is None else self.pairs[j // 2].take(rows)
        return p % WIDTH if j % 2 else p // WIDTH

    def histograms(self, rows: np.ndarray | None, y: np.ndarray, weight: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Weights and labels by column and bin; ``y`` and ``weight`` are those of the rows. All rows without weights are counted once for all trees."""
        m = 2 * len(self.pairs)
        if len(y) <= DIRECT:
            p = self.pairs if rows is None else self.pairs.take(rows, axis=1)
            flat = np.stack([p // WIDTH, p % WIDTH], 1).reshape(m, -1) + np.arange(0, m * WIDTH, WIDTH)[:, None]
            sums = lambda v: np.bincount(flat.ravel(), None if v is None else np.tile(v, m), m * WIDTH).reshape(m, WIDTH)
            return sums(weight), sums(y)
        whole = rows is None and weight is None
        counted = whole and self._whole is not None
        count, total = self._whole if counted else np.empty((m, WIDTH)), np.empty((m, WIDTH))
        for i, p in enumerate(self.pairs):
            code = (p if rows is None else p.take(rows)).astype(np.intp)
            for out, v in ((total, y),) if counted else ((count, weight), (total, y)):
                both = np.bincount(code, v, WIDTH * WIDTH).reshape(WIDTH, WIDTH)
                out[2 * i], out[2 * i + 1] = both.sum(1), both.sum(0)
        if whole:
            self._whole = count
        return count, total


class Tree:
    """A regression tree on binned columns; splits maximise the drop of squared error.

    ``draws`` are the rows that it is grown on, with repeats, or all; ``fitted`` gets the value of each row's leaf. Rows are
    counted once with their number of draws, and of two large children the smaller is counted, the other is what is left of
    their parent. Splits that this leaves within rounding of the best are summed again draw by draw, so that the same one
    is taken as if all were.
    """

    def __init__(self, bins: Bins, y: np.ndarray, depth: int, least: int, shrink: float = 0.0, draws: np.ndarray | None = None, fitted: np.ndarray | None = None):
        self.depth, labels, weight = depth, y, None
        if draws is not None:
            self._draws = draws, np.argsort(draws, kind="stable")
            times = np.bincount(draws, minlength=len(y))
            self._spans = np.cumsum(times) - times, times
            weight = times.astype(float)
            y = weight * y
        self.feature, self.cut, self.value = np.zeros(2 << depth, np.intp), np.full(2 << depth, WIDTH, np.intp), np.zeros(2 << depth)
        stack = [(1, None if weight is None else np.flatnonzero(weight), depth, None)]
        while stack:
            node, rows, left, known = stack.pop()
            own = y if rows is None else y.take(rows)
            many = None if weight is None else weight.take(rows)
            t, n = own.sum(), len(own) if many is None else many.sum()
            self.value[node] = t / (n + shrink)
            split = None
            if left and n >= 2 * least and len(bins.pairs):
                known = known or bins.histograms(rows, own, many)
                split, near = self._best(*known, t, n, least, shrink)
                if len(near):
                    again = rows if draws is None else self._drawn(rows)
                    split = self._exact(bins, labels, near, again, least, shrink)
            if split is None:
                if fitted is not None:
                    fitted[slice(None) if rows is None else rows] = self.value[node]
                for k in range(1, left + 1):  # below a leaf all rows go left
                    self.value[node << k] = self.value[node]
                continue
            j, b = self.feature[node], self.cut[node] = split
            low = bins.column(j, rows) <= b
            halves = [np.flatnonzero(v) if rows is None else rows[v] for v in (low, ~low)]
            found = [None, None]
            if left > 1 and len(own) > DIRECT:
                small = int(len(halves[1]) < len(halves[0]))
                at = halves[small]
                part = bins.histograms(at, y.take(at), None if weight is None else weight.take(at))
                other = known[0] - part[0]
                found[small], found[1 - small] = part, (other, np.where(other > 0, known[1] - part[1], 0.0))
            stack += [(2 * node + i, halves[i], left - 1, found[i]) for i in (0, 1)]

    def drop_draws(self) -> Tree:
        self._draws = self._spans = None
        return self

    @staticmethod
    def _gain(count: np.ndarray, total: np.ndarray, t: float, n: float, least: int, shrink: float) -> np.ndarray:
        count, total = count.cumsum(1), total.cumsum(1)
        other, rest = n - count, t - total
        ok = (count >= least) & (other >= least)
        return np.where(ok, total**2 / np.maximum(count + shrink, 1e-12) + rest**2 / np.maximum(other + shrink, 1e-12), -np.inf)

    @classmethod
    def _best(cls, count: np.ndarray, total: np.ndarray, t: float, n: float, least: int, shrink: float) -> tuple[tuple[int, int] | None, np.ndarray]:
        """The split, and the columns of those that rounding may hide behind it."""
        gain, whole = cls._gain(count, total, t, n, least, shrink), t * t / (n + shrink)
        best = int(np.argmax(gain))
        top = gain.flat[best]
        if top == -np.inf:
            return None, np.zeros(0, int)
        slack = 1e-9 * max(top, whole)
        close = (gain >= top - slack) & (count > 0)  # an empty bin is exactly like the one before
        near = np.flatnonzero(close.any(1)) if close.sum() > 1 or abs(top - whole) <= slack + 1e-15 else np.zeros(0, int)
        return divmod(best, WIDTH) if top > whole + 1e-15 else None, near

    def _drawn(self, rows: np.ndarray) -> np.ndarray:
        """All draws of the rows, in their order."""
        (draws, order), (first, times) = self._draws, self._spans
        many = times.take(rows)
        ends = many.cumsum()
        at = np.repeat(first.take(rows) - (ends - many), many) + np.arange(ends[-1])
        return draws.take(np.sort(order.take(at)))

    def _exact(self, bins: Bins, y: np.ndarray, near: np.ndarray, rows: np.ndarray | None, least: int, shrink: float) -> tuple[int, int] | None:
        own = y if rows is None else y.take(rows)
        codes = [bins.column(j, rows).astype(np.intp) for j in near]
        count, total = (np.stack([np.bincount(c, v, minlength=WIDTH) for c in codes]) for v in (None, own))
        t, n = own.sum(), len(own)
        gain = self._gain(count, total, t, n, least, shrink)
        j, b = divmod(int(np.argmax(gain)), WIDTH)
        return (int(near[j]), b) if gain[j, b] > t * t / (n + shrink) + 1e-15 else None

    def predict(self, binned: np.ndarray) -> np.ndarray:
        """Of rows of bins, one column each."""
        n, m = binned.shape
        if not m:
            return np.full(n, self.value[1])
        flat, first, node = binned.ravel(), np.arange(0, n * m, m), np.ones(n, np.intp)
        for _ in range(self.depth):
            node = 2 * node + (flat.take(first + self.feature.take(node)) > self.cut.take(node))
        return self.value.take(node)


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c).astype(np.uint8) for e, c in zip(edges, x.T)], 1) if edges else np.zeros((len(x), 0), np.uint8)


def fit_forest(bins: Bins, y: np.ndarray, trees: int = 100, depth: int = 8, least: int = 20, seed: int = 42) -> Callable[[np.ndarray], np.ndarray]:
    """Bagged trees on all columns."""
    rng, edges, grown = np.random.default_rng(seed), bins.edges, []
    for _ in range(trees):
        t = Tree(bins, y, depth, least, draws=rng.integers(0, len(y), len(y)))
        grown.append(t.drop_draws())

    def predict(z: np.ndarray) -> np.ndarray:
        held, out = _binned(z, edges), np.zeros(len(z))
        for t in grown:
            out += t.predict(held)
        return out / trees

    return predict


def fit_boosting(bins: Bins, y: np.ndarray, trees: int = 100, depth: int = 4, rate: float = 0.01, shrink: float = 1.0) -> Callable[[np.ndarray], np.ndarray]:
    """Squared-error boosting from the mean, with leaf weights shrunk by one row."""
    edges, base, fitted, grown = bins.edges, float(y.mean()), np.empty(len(y)), []
    rest = y - base
    for _ in range(trees):
        grown.append(Tree(bins, rest, depth, 1, shrink, fitted=fitted))
        rest -= rate * fitted

    def predict(z: np.ndarray) -> np.ndarray:
        held, out = _binned(z, edges), np.zeros(len(z))
        for t in grown:
            out += t.predict(held)
        return base + rate * out

    return predict


MODELS = ("Lasso", "Ridge", "ElasticNet", "RandomForest", "XGBoost")


def fit_rows(name: str, rows: Rows) -> Callable[[np.ndarray], np.ndarray]:
    """A predictor on raw columns."""
    if name not in MODELS:
        raise ValueError(f"no such model: {name}")
    prepared, y = Prepared(rows, scale=name != "RandomForest"), rows.labels()
    if name in ("RandomForest", "XGBoost"):
        bins = Bins(rows.n, prepared.columns(rows))
        inner = fit_forest(bins, y) if name == "RandomForest" else fit_boosting(bins, y)
    else:
        inner = fit_linear(name, rows, prepared)
    return lambda v: inner(prepared(v))


def fit(name: str, x: np.ndarray, y: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A predictor on raw columns."""
    rows = Rows(x.shape[1])
    rows.add(x, y)
    return fit_rows(name, rows)


def valid_labels(df: DataFrame, ts: str, y: str) -> DataFrame:
    """The rows with a time and a finite label."""
    return df.filter(f"{ts} is not null and {y} is not null and not isnan({y}) and abs({y}) <> double('inf')")


def rolling_predict(df: DataFrame, features: Sequence[str], models: Sequence[str] = MODELS, groups: Sequence[str] = ("date",), ts: str = "trade_ts", y: str = "y_5s_ret", train: int = 1_800_000_000_000, step: int = 300_000_000_000, least: int = 200, keep: Sequence[str] = (), purge: int = 0) -> DataFrame:
    """(keep, groups, ts, y, refit, model, y_pred): every row that a refit predicts, once a model.

    All refits of all groups are one shuffle and no job of their own. A refit's rows are sorted, those that train it before those that
    it predicts, and come batch by batch, so that no task holds them all; ties follow the features.
    """
    own = list(dict.fromkeys([*keep, *groups, ts, y]))
    clean = valid_labels(df, ts, y)
    rows = assign(clean.select(*own, *features), groups, ts, train, step, purge)
    schema = T.StructType([clean.schema[c] for c in own] + [T.StructField("refit", T.LongType()), T.StructField("model", T.StringType()), T.StructField("y_pred", T.DoubleType())])
    values = [F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate([*features, y])]
    order = [*groups, "refit", "test", *(F.col(c).asc_nulls_last() for c in dict.fromkeys([ts, *own]) if c not in groups), *(f"__x{i}" for i in range(len(features)))]
    sorted_ = rows.select(*own, "refit", "test", *values).repartition(*groups, "refit").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fitted = Rows(len(features)), None
        for batch in batches:
            x = np.empty((batch.num_rows, len(features) + 1))
            for i in range(x.shape[1]):
                x[:, i] = batch.column(f"__x{i}").to_numpy(zero_copy_only=False)
            tests = batch.column("test").to_numpy(zero_copy_only=False)
            if not tests.all():
                if fitted is not None:
                    raise ValueError("a refit's training rows must come before those that it predicts")
                held.add(x[~tests, :-1], x[~tests, -1])
            if tests.any() and held.n >= max(least, 1):
                if fitted is None:
                    fitted = {name: fit_rows(name, held) for name in models}
                    held.close()
                part = batch.filter(pa.array(tests))
                for name, predict in fitted.items():
                    found = [*(part.column(c) for c in (*own, "refit")), pa.array([name] * part.num_rows), pa.array(predict(x[tests, :-1]))]
                    yield pa.RecordBatch.from_arrays(found, names=schema.names)

    return sorted_.groupBy(*groups, "refit").applyInArrow(run, schema)
