"""Best-fit packing by non-negative least squares over length patterns.

Lengths are counted in a histogram of ``bins`` equal steps of the sequence length. Patterns of one
to three lengths that fill a sequence are enumerated, and non-negative repeat counts are fitted to
the histogram; they are rounded to whole repeats, as many as the histogram can fill, and what is left is packed
best-fit decreasing on the residual histogram. The plan is a list of (pattern, repeats) whose size
depends on ``bins`` alone, so the driver holds no documents. Each piece then finds its place from
its rank among the pieces of its bin, which needs counts by (bucket, bin) and one shuffle.

Lengths are UTF-8 bytes (tokens of a byte-level model), or any integer column. A text longer than
a sequence is cut into full sequences and a rest, so nothing is dropped.

Defined results: null and empty texts have no bytes and give no rows; an empty table gives an
empty result; repeated rows and equal lengths are each packed, in order of (doc_id, piece); other
columns are not read.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.staging import materialise

SEQUENCE = 8192
BINS = 256
BUCKET_ROWS = 20_000
SCHEMA = "pack_id long, slot int, doc_id long, piece int, start long, length int"


def patterns(bins: int) -> list[tuple[int, ...]]:
    """All descending one- to three-part sums of ``bins``."""
    out: list[tuple[int, ...]] = [(bins,)]
    out += [(bins - b, b) for b in range(1, bins // 2 + 1)]
    out += [(bins - b - c, b, c) for c in range(1, bins // 3 + 1) for b in range(c, (bins - c) // 2 + 1)]
    return out


def nnls(a: np.ndarray, y: np.ndarray, most: int | None = None) -> np.ndarray:
    """argmin |a x - y| over x >= 0, by the active-set method of Lawson and Hanson.

    It ends at the optimum; the bound on its steps, 30 for each row of a, is against cycles by rounding only.
    """
    m, n = a.shape
    x = np.zeros(n)
    held: list[int] = []
    inside = np.zeros(n, bool)
    tol = 1e-9 * max(1.0, float(np.abs(y).max(initial=0)))
    for _ in range(most or 30 * m):
        w = a.T @ (y - a @ x)
        w[inside] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= tol:
            break
        held.append(j)
        inside[j] = True
        while held:
            s = np.linalg.lstsq(a[:, held], y, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[held] = s
                break
            now = x[held]
            low = s <= 0
            step = float(np.min(now[low] / np.maximum(now[low] - s[low], 1e-300)))
            moved = now + step * (s - now)
            x[:] = 0
            x[held] = np.maximum(moved, 0)
            gone = [c for c, v, z in zip(held, moved, low) if z and v <= 1e-12 * max(1.0, float(now.max()))]
            for c in gone or [held[int(np.argmin(moved))]]:
                held.remove(c)
                inside[c] = False
                x[c] = 0
    return x


def plan(histogram: np.ndarray, bins: int = BINS) -> list[tuple[tuple[int, ...], int]]:
    """(pattern of bins, repeats) that hold every counted piece exactly once. histogram[b]: pieces of b steps, b >= 1."""
    left = histogram.astype(np.int64).copy()
    total = int(left.sum())
    out: list[tuple[tuple[int, ...], int]] = []
    if not total:
        return out
    left[bins], full = 0, int(left[bins])
    if full:
        out.append(((bins,), full))
    options = [p for p in patterns(bins)[1:] if all(left[b] for b in p)]
    if options:
        a = np.zeros((bins, len(options)))
        for j, p in enumerate(options):
            for b in p:
                a[b, j] += 1
        # short pieces fill gaps later, so their residuals weigh less
        weight = np.where(np.arange(bins) < bins // 32, 0.1, 1.0)
        x = nnls(a * weight[:, None], left[:bins] * weight)
        for j in np.argsort(-x, kind="stable"):
            p, need = options[j], defaultdict(int)
            for b in p:
                need[b] += 1
            repeats = min(int(np.rint(x[j])), *(int(left[b]) // c for b, c in need.items()))
            if repeats > 0:
                out.append((p, repeats))
                for b, c in need.items():
                    left[b] -= c * repeats
    return out + best_fit(left, bins)


def best_fit(left: np.ndarray, bins: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: equal sequences are kept once, with their number."""
    open_: dict[int, list[list]] = defaultdict(list)  # free steps -> [pattern, number]
    for b in range(bins, 0, -1):
        count = int(left[b])
        while count:
            free = next((f for f in range(b, bins) if open_[f]), None)
            if free is None:
                each = min(bins // b, count)
                whole, rest = divmod(count, each)
                open_[bins - each * b].append([(b,) * each, whole])
                if rest:
                    open_[bins - rest * b].append([(b,) * rest, 1])
                break
            held, number = open_[free][-1]
            used = min(number, count)
            if used == number:
                open_[free].pop()
            else:
                open_[free][-1][1] -= used
            open_[free - b].append([held + (b,), used])
            count -= used
    return [(p, n) for f in sorted(open_) for p, n in open_[f]]


def _slots(packs: list[tuple[tuple[int, ...], int]], bins: int) -> list[tuple[np.ndarray, ...]]:
    """By bin: ranks from which a place begins, its first pack and its position in the pack."""
    rows: list[list[tuple[int, int, int]]] = [[] for _ in range(bins + 1)]
    at, first = [0] * (bins + 1), 0
    for p, repeats in packs:
        for k, b in enumerate(p):
            rows[b].append((at[b], first, k))
            at[b] += repeats
        first += repeats
    return [tuple(np.array(r, np.int64).reshape(-1, 3).T) for r in rows]


def pack_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length_col: str | None = None, sequence: int = SEQUENCE, bins: int = BINS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per piece: the sequence that holds it (``pack_id``), its place there and the bytes of the text that it covers."""
    if sequence % bins:
        raise ValueError("bins must divide the sequence length")
    step = sequence // bins
    n = F.col(length_col) if length_col else F.octet_length(F.col(text_col))
    lengths = docs.select(F.col(id_col).cast("long").alias("doc_id"), n.cast("long").alias("n")).filter("n > 0")
    lengths = materialise(lengths, "pack-lengths")
    pieces = lengths.select("doc_id", F.posexplode(F.expr(f"sequence(0L, n - 1, {sequence}L)")).alias("piece", "start"), "n")
    pieces = pieces.select("doc_id", "piece", "start", F.least(F.lit(sequence), F.col("n") - F.col("start")).cast("int").alias("length"))
    buckets = max(1, -(-lengths.count() // bucket_rows))
    pieces = pieces.withColumns({"bin": F.ceil(F.col("length") / step).cast("int"), "bucket": F.pmod(F.xxhash64("doc_id"), F.lit(buckets))})
    counts = pieces.groupBy("bucket", "bin").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts.withColumn("before", F.sum("n").over(Window.partitionBy("bin").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))), "pack-counts")
    histogram = np.zeros(bins + 1, np.int64)
    for r in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect():  # at most ``bins`` rows
        histogram[r.bin] = r.n
    slots = _slots(plan(histogram, bins), bins)
    rank = F.row_number().over(Window.partitionBy("bucket", "bin").orderBy("doc_id", "piece", "length")) - 1
    ranked = pieces.join(counts.select("bucket", "bin", "before"), ["bucket", "bin"]).select("bin", (rank + F.coalesce("before", F.lit(0))).alias("rank"), "doc_id", "piece", "start", "length")

    def place(batches):
        for batch in batches:
            bin_ = batch.column("bin").to_numpy()
            rank_ = batch.column("rank").to_numpy()
            pack, slot = np.zeros(len(bin_), np.int64), np.zeros(len(bin_), np.int32)
            order = np.argsort(bin_, kind="stable")
            cuts = np.flatnonzero(np.diff(bin_[order], prepend=-1))
            for i, j in zip(cuts, np.append(cuts[1:], len(order))):
                rows = order[i:j]
                begin, first, where = slots[bin_[rows[0]]]
                k = np.searchsorted(begin, rank_[rows], "right") - 1
                pack[rows] = first[k] + rank_[rows] - begin[k]
                slot[rows] = where[k]
            yield pa.RecordBatch.from_arrays([pa.array(pack), pa.array(slot), *(batch.column(c) for c in ("doc_id", "piece", "start", "length"))], names=["pack_id", "slot", "doc_id", "piece", "start", "length"])

    return ranked.mapInArrow(place, SCHEMA)
