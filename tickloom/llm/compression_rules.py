"""Quality rules: compression bands.

A document is compressed with zstandard as a whole and in fixed chunks. Text that compresses
far better than prose of its length is repetitive, text that compresses far worse is noise; the
limits depend on the length, as short inputs compress badly whatever they hold.

``fit_bands`` takes the limits from rows labelled good: their lengths are cut into half octaves, and in each the
limits lie beyond the quantiles ``TAIL`` and 1 - ``TAIL`` of the ratios by ``MARGIN`` times these quantiles' distance from the median. All
rows labelled good count; with less than ``LEAST`` of them in a half octave the fixed
``BANDS``, which are wide, hold there.

Defined results: a null text is rejected (``null_text``); an empty or blank text is kept when
shorter than the first band, as no ratio can be judged there; very long texts are read whole;
repeated rows get equal verdicts; labels without an id, of no quality or of absent rows are passed over, and without any label the fixed
bands hold; other columns pass through, and columns whose names clash with
``quality`` are replaced by it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.kernels import text_buffers

#: (bytes from, least ratio, largest ratio). Below the first band no ratio is judged.
BANDS: tuple[tuple[int, float, float], ...] = (
    (64, 0.70, 1.70),
    (128, 0.90, 2.25),
    (256, 1.00, 2.40),
    (512, 1.10, 2.50),
    (1024, 1.20, 2.60),
    (2048, 1.30, 2.75),
    (4096, 1.40, 3.00),
    (16384, 1.50, 3.40),
    (65536, 1.50, 4.00),
)
CHUNK_BYTES = 4096
MAX_BAD_CHUNKS = 0.4
LEVEL = 3
LEAST = 30
TAIL = 0.005
QUANTILES = (TAIL, 0.5, 1 - TAIL)
MARGIN = 0.75
RESULT = "n_bytes long, ratio double, n_chunks int, bad_chunks int, reason string"


def _limits(n: int, bands: Sequence[tuple[int, float, float]]) -> tuple[float, float]:
    low, high = 0.0, float("inf")
    for start, least, most in bands:
        if n >= start:
            low, high = least, most
    return low, high


def judge(raw: bytes | None, bands=BANDS, chunk_bytes=CHUNK_BYTES, max_bad_chunks=MAX_BAD_CHUNKS, compressor=None) -> tuple:
    """(n_bytes, ratio, n_chunks, bad_chunks, reason) of one text; reason is None when it is kept."""
    if raw is None:
        return None, None, 0, 0, "null_text"
    compressor = compressor or zstandard.ZstdCompressor(level=LEVEL)
    n = len(raw)
    if n < bands[0][0]:
        return n, None, 0, 0, None
    ratio = n / len(compressor.compress(raw))
    low, high = _limits(n, bands)
    reason = "repetitive" if ratio > high else "incompressible" if ratio < low else None
    n_chunks = bad = 0
    if n > chunk_bytes:
        view = memoryview(raw)
        n_chunks = max(1, round(n / chunk_bytes))  # a short tail joins the chunk before it
        for i in range(n_chunks):
            chunk = view[i * chunk_bytes : n if i == n_chunks - 1 else (i + 1) * chunk_bytes]
            r = len(chunk) / len(compressor.compress(chunk))
            low, high = _limits(len(chunk), bands)
            bad += not low <= r <= high
        if reason is None and bad > max_bad_chunks * n_chunks:
            reason = "chunks"
    return n, ratio, n_chunks, bad, reason


def _step(n: int) -> int:
    """The half octave of a length."""
    return math.floor(2 * math.log2(n) + 1e-9)


def fit_bands(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality") -> tuple[tuple[int, float, float], ...]:
    """Bands as ``BANDS``, from the rows of ``docs`` that ``labels`` (id, 1 for good) calls good."""
    first = BANDS[0][0]
    good = labels.filter(F.col(label_col) == 1).select(F.col(id_col).alias("id")).distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(f"id is not null and octet_length(text) >= {first}")
    level = LEVEL

    def ratios(batches):
        compressor = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            found = [(len(t), len(t) / len(compressor.compress(bytes(t)))) for t in _views(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([_step(n) for n, _ in found], pa.int32()), pa.array([r for _, r in found], pa.float64())], names=["id", "step", "ratio"])

    # only ids and ratios are shuffled; of each half octave the ratios beside its quantiles come back, counted by exact rank
    rows = texts.mapInArrow(ratios, f"id {texts.schema['id'].dataType.simpleString()}, step int, ratio double").join(good, "id", "left_semi")
    ranked = rows.groupBy("step", "ratio").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("step").orderBy("ratio").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = ranked.withColumns({"end": upto, "count": F.sum("n").over(Window.partitionBy("step"))})
    wanted = F.array(*(f(q * (F.col("count") - 1)) for q in QUANTILES for f in (F.floor, F.ceil)))
    held = ranked.withColumn("at", F.explode(F.array_distinct(wanted))).filter("at >= end - n and at < end")
    by_step: dict[int, dict[int, float]] = {}
    sizes: dict[int, int] = {}
    for r in held.select("step", "count", "at", "ratio").collect():  # at most six a half octave
        by_step.setdefault(r.step, {})[r.at] = r.ratio
        sizes[r.step] = r["count"]
    return _bands({k: (sizes[k], *(_between(v, q * (sizes[k] - 1)) for q in QUANTILES)) for k, v in by_step.items()})


def _between(ratios: dict[int, float], at: float) -> float:
    """The value at a place between two ranks."""
    low = ratios[math.floor(at)]
    return low + (ratios[math.ceil(at)] - low) * (at - math.floor(at))


def bands_of(by_step: dict[int, list[float]]) -> tuple[tuple[int, float, float], ...]:
    """Bands from the ratios of good rows by half octave, the fixed ones where these are too few."""
    return _bands({k: (len(v), *np.quantile(v, QUANTILES)) for k, v in by_step.items()})


def _bands(by_step: dict[int, tuple]) -> tuple[tuple[int, float, float], ...]:
    """Bands from (count, low, middle, high) of the ratios of good rows by half octave."""
    out = {start: _limits(start, BANDS) for start, _, _ in BANDS}
    for step in range(min(by_step, default=0), max(by_step, default=-1) + 1):
        start, found = math.ceil(2 ** (step / 2) - 1e-9), by_step.get(step)
        if found is None or found[0] < LEAST:
            out[start] = _limits(start, BANDS)
        else:
            low, middle, high = found[1:]
            out[start] = float(low - MARGIN * (middle - low)), float(high + MARGIN * (high - middle))
    if by_step:  # beyond the last half octave with labels
        end = math.ceil(2 ** ((max(by_step) + 1) / 2) - 1e-9)
        out[end] = _limits(end, BANDS)
        fitted = {math.ceil(2 ** (k / 2) - 1e-9) for k in range(min(by_step), max(by_step) + 2)}
        out = {s: v for s, v in out.items() if s in fitted or not min(fitted) <= s < end}
    return tuple((s, *out[s]) for s in sorted(out) if s >= BANDS[0][0])


def score_quality(docs: DataFrame, text_col: str = "text", bands=BANDS, chunk_bytes: int = CHUNK_BYTES, max_bad_chunks: float = MAX_BAD_CHUNKS) -> DataFrame:
    """Every row of ``docs`` with a struct ``quality`` (see ``RESULT``). Only the text goes to Python."""
    bands, level = tuple(bands), LEVEL

    def quality(texts: pa.Array) -> pa.Array:
        compressor = zstandard.ZstdCompressor(level=level)
        rows = [judge(None if t is None else bytes(t), bands, chunk_bytes, max_bad_chunks, compressor) for t in _views(texts)]
        cols = list(zip(*rows)) if rows else [()] * 5
        kinds = (pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.string())
        names = ("n_bytes", "ratio", "n_chunks", "bad_chunks", "reason")
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    # a filter on the result would otherwise have it computed twice
    once = F.arrow_udf(quality, RESULT).asNondeterministic()
    return docs.withColumn("quality", once(F.col(text_col).cast("string")))


def _views(texts: pa.Array):
    """The UTF-8 bytes of each text, without decoding; None for nulls."""
    buf, off = text_buffers(texts)
    valid = np.asarray(texts.is_valid()) if texts.null_count else None
    view = memoryview(buf)
    for i in range(len(off) - 1):
        yield None if valid is not None and not valid[i] else view[off[i] : off[i + 1]]


def filter_quality(docs: DataFrame, text_col: str = "text", **rules) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only."""
    scored = score_quality(docs, text_col, **rules)
    kept = scored.filter(F.col("quality.reason").isNull())
    return kept.drop("quality") if "quality" not in docs.columns else _without_clash(docs, text_col, rules)


def _without_clash(docs: DataFrame, text_col: str, rules: dict) -> DataFrame:
    held = docs.withColumnRenamed("quality", "__own_quality")
    kept = score_quality(held, text_col, **rules).filter(F.col("quality.reason").isNull()).drop("quality")
    return kept.withColumnRenamed("__own_quality", "quality").select(docs.columns)
