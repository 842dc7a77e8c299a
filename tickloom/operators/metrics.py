"""Evaluation of predictions and the data behind each plot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Y, P = "y_5s_ret", "y_pred"


def valid(df: DataFrame, y: str = Y, p: str = P) -> DataFrame:
    """Rows with a label and a prediction."""
    return df.filter(f"{y} is not null and {p} is not null and not isnan({y}) and not isnan({p})")


def _r2(y: str, p: str, least: int = 2) -> Column:
    n, e = F.count(F.lit(1)), F.sum((F.col(y) - F.col(p)) * (F.col(y) - F.col(p)))
    spread = F.var_pop(y) * n
    score = F.when(spread > 0, 1 - e / F.when(spread > 0, spread)).otherwise(F.when(e == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return F.when(n >= least, score)


def _hit(y: str, p: str) -> Column:
    return (F.signum(y) == F.signum(p)).cast("int")


def evaluate(df: DataFrame, groups: Sequence[str] = (), y: str = Y, p: str = P) -> DataFrame:
    """n, rmse, r2 and dir_acc of each group; a group without rows has no row. r2 is one less the error over the spread."""
    e = F.col(y) - F.col(p)
    out = valid(df, y, p).groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), _r2(y, p).alias("r2"), F.avg(_hit(y, p)).alias("dir_acc"))
    return out.filter("n > 0")


def pairs(df: DataFrame, y: str = Y, p: str = P) -> DataFrame:
    return valid(df, y, p).select(y, p)


def residuals(df: DataFrame, y: str = Y, p: str = P) -> DataFrame:
    return valid(df, y, p).select(p, (F.col(y) - F.col(p)).alias("residual"))


def residual_histogram(df: DataFrame, bins: int = 80, y: str = Y, p: str = P) -> DataFrame:
    """(bin, low, high, n) of equal steps from the least to the largest residual; the last bin holds its upper end."""
    r = residuals(df, y, p)
    ends = r.agg(F.min("residual").alias("a"), F.max("residual").alias("b"))
    at = r.crossJoin(F.broadcast(ends))  # one row
    step = (F.col("b") - F.col("a")) / bins
    k = F.when(step > 0, F.least(F.floor((F.col("residual") - F.col("a")) / F.when(step > 0, step)).cast("int"), F.lit(bins - 1))).otherwise(F.lit(0))
    counts = at.groupBy(k.alias("bin"), "a", "b").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("bin", (F.col("a") + step * F.col("bin")).alias("low"), (F.col("a") + step * (F.col("bin") + 1)).alias("high"), "n")


def comparison(df: DataFrame, groups: Sequence[str] = ("model",), y: str = Y, p: str = P) -> DataFrame:
    """(groups, metric, value) in long form."""
    m = evaluate(df, groups, y, p)
    return m.select(*groups, F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("rmse", "r2", "dir_acc")))).alias("m")).select(*groups, "m.metric", "m.value")


def bin_r2(df: DataFrame, ts: str, width: int, groups: Sequence[str] = (), least: int = 30, y: str = Y, p: str = P) -> DataFrame:
    """(groups, bin, n, bin_r2) of every bin of the integer time key from the first to the last, empty ones included."""
    w = F.lit(width).cast("long")
    at = valid(df, y, p).withColumn("bin", F.col(ts) - F.pmod(F.col(ts), w))
    some = at.groupBy(*groups, "bin").agg(F.count(F.lit(1)).alias("n"), _r2(y, p, max(least, 1)).alias("bin_r2"))
    spine = some.groupBy(*groups).agg(F.explode(F.sequence(F.min("bin"), F.max("bin"), w)).alias("bin"))
    return spine.join(some, [*groups, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def rolling_r2(df: DataFrame, ts: str, width: int, groups: Sequence[str] = (), window: int = 6, **how) -> DataFrame:
    """``bin_r2`` with the mean of the last ``window`` bins, where at least half of them have a value."""
    by = Window.partitionBy(*groups).orderBy("bin").rowsBetween(1 - window, 0)
    value = F.when(F.count("bin_r2").over(by) >= window // 2, F.avg("bin_r2").over(by))
    return bin_r2(df, ts, width, groups, **how).withColumn("rolling_r2", value)


def hourly_accuracy(df: DataFrame, clock: str, y: str = Y, p: str = P) -> DataFrame:
    """(hour, dir_acc) by the hour of a wall-clock column."""
    return valid(df, y, p).filter(F.col(clock).isNotNull()).groupBy(F.hour(clock).alias("hour")).agg(F.avg(_hit(y, p)).alias("dir_acc"))


def top_coefficients(coefs: DataFrame, n: int = 20) -> DataFrame:
    """(feature, mean_abs) of the n features of largest mean magnitude."""
    return coefs.groupBy("feature").agg(F.avg(F.abs("coef")).alias("mean_abs")).orderBy(F.desc("mean_abs"), "feature").limit(n)


def coefficient_heatmap(coefs: DataFrame, times: Sequence, n: int = 20) -> DataFrame:
    """The top features' mean coefficient by refit time, a column each time, with their rank."""
    order = Window.orderBy(F.desc("mean_abs"), "feature")
    top = top_coefficients(coefs, n).withColumn("rank", F.row_number().over(order))  # n rows
    wide = coefs.join(F.broadcast(top), "feature").groupBy("feature", "rank").pivot("refit_time", list(times)).agg(F.avg("coef"))
    return wide
