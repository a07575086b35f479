import os

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import models, runs

SCHEMA = "split string, adm string, harv_year int, a double, yield double, y_bench double"


def table(spark):
    rows = [(s, f"r{i}", 2000 + y, float(i * y % 7), float(i + 0.5 * y), 0.0) for s in "pqrst" for y in range(4) for i in range(5)]
    return spark.createDataFrame([*rows, (None, "r0", 2000, 1.0, 1.0, 0.0), ("p", "r9", 2001, 1.0, None, 0.0)], SCHEMA)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_killed_run_goes_on(spark, tmp_path):
    """Killed after two steps; taken up, it gives what one run gives, and a complete run is left alone."""
    df, fitted = table(spark), []
    fit = lambda rows: models.fold_model(rows, "split", ["a"], grid=[{"alpha": 0.1}], upper=1e9)

    def killed(rows):
        if len(fitted) == 2:
            raise KeyboardInterrupt
        fitted.append(sorted(r.split for r in rows.select("split").distinct().collect()))
        return fit(rows)

    half, whole = str(tmp_path / "half"), str(tmp_path / "whole")
    with pytest.raises(KeyboardInterrupt):
        runs.run_folds(df, "split", killed, half, steps=7)
    before = files(half)
    assert len(fitted) == 2 and before
    first = sorted(map(tuple, runs.run_folds(df, "split", fit, half, steps=7).collect()))
    assert {f: t for f, t in files(half).items() if f in before} == before
    want = sorted(map(tuple, runs.run_folds(df, "split", fit, whole, steps=1).collect()))
    assert len(first) == len(want) == 100 and [r[:2] + r[4:] for r in first] == [r[:2] + r[4:] for r in want]
    assert [r[2] for r in first] == pytest.approx([r[2] for r in want])
    done = files(half)
    again = runs.run_folds(df, "split", killed, half, steps=7)
    assert again.count() == 100 and files(half) == done


def test_a_fold_that_lost_rows_is_fitted_again(spark, tmp_path):
    df, path = table(spark), str(tmp_path / "run")
    fit = lambda rows: models.fold_model(rows, "split", ["a"], grid=[{"alpha": 0.1}], upper=1e9)
    want = sorted(map(tuple, runs.run_folds(df, "split", fit, path, steps=2).collect()))
    lost = [f for f in files(path) if "split=q" in f and "year_out=2002" in f]
    for f in lost:
        os.remove(f)
    others = {f: t for f, t in files(path).items()}
    assert sorted(map(tuple, runs.run_folds(df, "split", fit, path, steps=2).collect())) == want
    assert {f: t for f, t in files(path).items() if f in others} == others
    assert runs.run_folds(df.limit(0), "split", fit, str(tmp_path / "none")).count() == 0


def test_input_is_read_once(spark, tmp_path):
    """Whatever made the rows runs once: not for every step and fold of a run, tree, held-out year or selection."""
    from fieldloom.operators import models, selection

    read = spark.sparkContext.accumulator(0)

    @F.udf("double", useArrow=False)
    def seen(v):
        read.add(1)
        return v

    rows = [(s, f"r{i % 5}", 2000 + i // 5, float(i * 7 % 11), float(i * 5 % 13), 1.0) for s in "pq" for i in range(30)]
    plain = spark.createDataFrame(rows, "country string, adm string, harv_year int, a double, yield double, y_bench double")
    df = plain.withColumn("a", seen.asNondeterministic()("a"))
    fit = lambda part: models.fold_model(part, "country", ["a"], grid=[{"alpha": 0.5}], upper=1e9)
    for job in (
        lambda: runs.run_folds(df, "country", fit, f"{tmp_path}/run", steps=2),
        lambda: models.tree_models(df, "country", ["a"], grid=[{"trees": 1, "depth": 1}], upper=1e9, n_folds=2)[0],
        lambda: models.distributed_predictions(df, [2001, 2002], ["a"], "yield", "rf", numTrees=1, maxDepth=1),
        lambda: models.feature_importance(df, ["a"], "yield", [2001, 2002], numTrees=1, maxDepth=1),
        lambda: selection.mi_vif_selection(df, "country", ["a", "y_bench"], "yield"),
    ):
        before = read.value
        job().collect()
        assert read.value - before == 60
