"""Statistics on columns and groups: Pearson r, p-values, exact medians."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from civicspark.session import settled


def pearson(x: Column, y: Column) -> Column:
    """Pearson r as an aggregate; NULL below two pairs or without variance.

    Built from covariance and deviations because ``corr`` divides by zero on constant input.
    """
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    return F.when(
        F.count(px + py) >= 2,
        F.covar_pop(px, py) / F.nullif(F.stddev_pop(px) * F.stddev_pop(py), F.lit(0.0)),
    )


def settled_round(col: Column, digits: int) -> Column:
    """Rounded so that the last bits of a double cannot tip a half."""
    return F.round(F.round(col, 10), digits)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series eight steps up, where it is exact to double precision."""
    z = x + 8.0
    series = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return series - sum(np.log(x + k) for k in range(8))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, evaluated from the tail."""
    value = np.ones_like(x)
    for m in range(200, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        value = 1.0 + odd / (1.0 + even / value)
    return 1.0 / value


def _beta_share(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, from the end where the fraction converges fast."""
    swap = x > (a + 1) / (a + b + 2)
    p, q = np.where(swap, b, a), np.where(swap, a, b)
    inside = (x > 0) & (x < 1)
    y = np.where(inside, np.where(swap, 1.0 - x, x), 0.5)
    front = np.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(y) + q * np.log1p(-y))
    share = front / p * _beta_fraction(p, q, y)
    return np.where(inside, np.where(swap, 1.0 - share, share), (x >= 1).astype(float))


@F.pandas_udf(T.DoubleType())
def pearson_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation (Student t, n - 2 degrees), one batch at a time; runs on result rows only."""
    x, size = r.to_numpy(np.float64, na_value=np.nan), n.to_numpy(np.float64, na_value=np.nan)
    usable = (size >= 3) & np.isfinite(x)
    # 1 - r^2 = df / (df + t^2)
    rest = np.clip(1.0 - np.where(usable, x, 0.0) ** 2, 0.0, 1.0)
    p = _beta_share((np.where(usable, size, 3.0) - 2) / 2, np.full(len(x), 0.5), rest)
    return pd.Series(p).where(pd.Series(usable), None)


ACCURACY = 10_000


def bucket_of(value: Column, lo: Column, hi: Column, buckets: int) -> Column:
    """Equal-width bucket of a value; the largest value belongs to the last bucket."""
    return F.when(
        hi > lo, F.least(F.floor((value - lo) / (hi - lo) * buckets), F.lit(buckets - 1))
    ).otherwise(F.lit(0)).cast("int")


def exact_median(df: DataFrame, keys: list[str], value: str, out: str = "median", accuracy: int = ACCURACY) -> DataFrame:
    """Exact median per group."""
    return describe_groups(df, keys, value, accuracy=accuracy).where("non_null > 0").select(
        *keys, F.col("median").alias(out))


def describe_groups(df: DataFrame, keys: list[str], value: str, *extra: Column, accuracy: int = ACCURACY) -> DataFrame:
    """n, non_null, min, max, mean, sample deviation and exact median per group.

    No pass shuffles raw values or holds a group in one task, as an exact percentile aggregate would.
    The first pass aggregates and sketches two quantiles around the middle, so a bracket of some
    6 / ``accuracy`` of the ranks whatever the distribution. The second counts the values below and inside
    it; a side that misses the middle goes out to the end of the range, so the result never rests on the
    sketch. Only distinct values of the bracket are counted one by one and ordered in the third."""
    rows = df.withColumn("_v", F.col(value).cast("double"))
    margin = 2.0 / accuracy
    stats = settled(
        rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.count("_v").alias("non_null"), F.min("_v").alias("min"),
            F.max("_v").alias("max"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("stddev"), *extra,
            F.percentile_approx("_v", [max(0.5 - margin, 0.0), min(0.5 + margin, 1.0)], accuracy).alias("_mid")),
        "group-stats")
    span = stats.where("non_null > 0").select(
        *keys, F.col("min").alias("_min"), F.col("max").alias("_max"), F.col("_mid")[0].alias("_lo"), F.col("_mid")[1].alias("_hi"), F.col("non_null").alias("_n"))
    values = rows.where("_v is not null").select(*keys, "_v")
    first, second = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    placed = values.join(span, keys).groupBy(*keys).agg(
        F.count_if(F.col("_v") < F.col("_lo")).alias("_below"), F.count_if(F.col("_v") <= F.col("_hi")).alias("_upto"),
        *[F.max(c).alias(c) for c in ("_min", "_max", "_lo", "_hi", "_n")])
    bracket = settled(
        placed.select(
            *keys, "_n", F.when(F.col("_below") > first, F.col("_min")).otherwise(F.col("_lo")).alias("_lo"),
            F.when(F.col("_upto") <= second, F.col("_max")).otherwise(F.col("_hi")).alias("_hi"),
            F.when(F.col("_below") > first, 0).otherwise(F.col("_below")).alias("_before")),
        "median-brackets")
    counted = values.join(bracket, keys).where(F.col("_v").between(F.col("_lo"), F.col("_hi"))).groupBy(*keys, "_v").agg(
        F.count(F.lit(1)).alias("_c"), F.max("_before").alias("_before"), F.max("_n").alias("_n"))
    inside = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("_at", F.col("_before") + F.coalesce(F.sum("_c").over(inside), F.lit(0)))

    def value_at(rank):
        return F.max(F.when((F.col("_at") <= rank) & (rank < F.col("_at") + F.col("_c")), F.col("_v")))

    median = ranked.groupBy(*keys).agg(value_at(first).alias("_v1"), value_at(second).alias("_v2")).select(
        *keys, (F.col("_v1") + (F.col("_v2") - F.col("_v1")) * 0.5).alias("median"))
    return stats.drop("_mid").join(median, keys, "left")
