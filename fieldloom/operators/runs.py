"""Runs over many folds that can be stopped and taken up again."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.lineage import cut_lineage
from fieldloom.operators.folds import loyo_folds, pending_folds


def stored_predictions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What a run has stored so far, nothing where it has not begun."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def run_folds(df: DataFrame, split: str, fit: Callable[[DataFrame], DataFrame], path: str, steps: int = 8, only: Iterable[int] | None = None) -> DataFrame:
    """Fit the folds that ``path`` lacks, and return the stored predictions of all.

    ``fit`` takes rows of some splits and returns (split, year_out, adm, harv_year, y_pred, ...) for all of their folds, as ``fold_model`` does. Splits are
    dealt to ``steps`` jobs by a hash; a job writes each fold (split, year_out) as a partition of its own and overwrites only these. A run that
    was killed goes on with the folds that are missing or short of rows with a prediction, in every split that has any; a run that is complete fits
    and writes nothing. ``only`` names the steps to do now. Rows without a split are left out.
    """
    spark, kind = df.sparkSession, dict(df.dtypes)[split]
    schema = f"adm string, harv_year int, y_pred double, train_mse double, n_trials int, split {kind}, year_out int"
    rows = cut_lineage(df.where(F.col(split).isNotNull() & F.col("harv_year").isNotNull()))  # read by every step
    # A fold has as many rows as its year, less those that the fit leaves out for a null target.
    expected = rows.where(F.col("yield").isNotNull()).groupBy(F.col(split).alias("split"), F.col("harv_year").alias("year_out")).agg(F.count("*").alias("n"))
    of = F.pmod(F.xxhash64(F.col("split").cast("string")), F.lit(steps))
    for step in range(steps) if only is None else only:
        lacking = pending_folds(loyo_folds(rows, split), stored_predictions(spark, path, schema), expected).where(of == step).select("split", "year_out")
        if lacking.isEmpty():
            continue
        own = rows.join(lacking.select(F.col("split").alias(split)).distinct(), split, "left_semi")
        found = fit(own).join(lacking, ["split", "year_out"], "left_semi")
        found = found.select("adm", "harv_year", "y_pred", "train_mse", "n_trials", "split", "year_out")
        found.repartition("split", "year_out").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("split", "year_out").parquet(path)
    return stored_predictions(spark, path, schema)
