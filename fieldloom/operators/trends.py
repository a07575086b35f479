"""Trends and standardisation of yields by region."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.functions.numeric import t_two_sided_p


#: Deviations below this share of a series' largest value are rounding, not variation.
LEAST_SPREAD = 1e-9


def real_spread(deviation: Column, largest: Column) -> Column:
    """``deviation``, null where it is rounding."""
    return F.when(deviation > LEAST_SPREAD * largest, deviation)


def slope_p_value(t: Column, dof: Column) -> Column:
    """Two-sided p-value of a slope from its t statistic and degrees of freedom; runs on one row a series."""

    @F.pandas_udf("double")
    def p_value(t: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([t_two_sided_p(x, d) if d > 0 and x == x else None for x, d in zip(t, dof)], dtype="float64")

    return p_value(t, dof)


def slope_t(r2: Column, n: Column) -> Column:
    """Size of the slope's t statistic; a perfect fit gives infinity."""
    return F.when(n > 2, F.when(r2 >= 1, F.lit(float("inf"))).otherwise(F.sqrt(F.greatest(r2, F.lit(0.0)) * (n - 2) / (1 - r2))))


def linear_trend(df: DataFrame, group: Sequence[str], x: str = "harv_year", y: str = "yield") -> DataFrame:
    """(group, n, slope, intercept, r2, p_value) of the least-squares line in each series; slope null for fewer than two x."""
    a, b = F.col(y).cast("double"), F.col(x).cast("double")
    fits = df.groupBy(*group).agg(
        F.regr_count(a, b).alias("n"), F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"), F.regr_r2(a, b).alias("r2")
    )
    return fits.withColumn("p_value", slope_p_value(slope_t(F.col("r2"), F.col("n")), (F.col("n") - 2).cast("double")))


def fitted_line(df: DataFrame, group: Sequence[str], x: str = "harv_year", y: str = "yield", out: str = "fitted") -> DataFrame:
    """Every row with its series' least-squares line at its x."""
    w = W.partitionBy(*group)
    a, b = F.col(y).cast("double"), F.col(x).cast("double")
    return df.withColumn(out, F.avg(F.when(b.isNotNull(), a)).over(w) + F.regr_slope(a, b).over(w) * (b - F.avg(F.when(a.isNotNull(), b)).over(w)))


def standardized_yield(df: DataFrame, group: Sequence[str], x: str = "harv_year", y: str = "yield") -> DataFrame:
    """Residual of the line divided by the residuals' population deviation, ``standardized_yield``.

    Null in series of fewer than three rows, which a line meets exactly, and where the deviation is mere rounding (``LEAST_SPREAD`` of
    the largest value), as all residuals are zero then.
    """
    w = W.partitionBy(*group)
    rows = fitted_line(df, group, x, y, "__fit").withColumn("__r", F.col(y) - F.col("__fit"))
    spread = F.when(F.count("__r").over(w) > 2, real_spread(F.stddev_pop("__r").over(w), F.max(F.abs(F.col(y))).over(w)))
    return rows.withColumn("standardized_yield", F.col("__r") / spread).drop("__fit", "__r")


def region_counts(df: DataFrame, by: Sequence[str] = ("adm",)) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def region_mean(df: DataFrame, col: str, by: Sequence[str] = ("adm",)) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(col).alias(f"mean_{col}"))
