"""Sea-ice features, models and evaluation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from icefathom.functions.numeric import clamp


def lagged_features(
    grid: DataFrame, lags: list[int], value: str = "sic", cell: list[str] | None = None, slot: str = "slot"
) -> DataFrame:
    """Adds ``<value>_lag<k>``: the value exactly ``k`` slots earlier, or null.

    A value-range frame of one slot respects gaps and serves all lags from a
    single shuffle; a cell has one row per slot, so windows stay small.
    """
    w = W.partitionBy(*(cell or ["cell_i", "cell_j"])).orderBy(slot)
    return grid.withColumns({f"{value}_lag{k}": F.max(value).over(w.rangeBetween(-k, -k)) for k in lags})


def fit_sea_ice(
    train: DataFrame, features: list[str], label: str = "sic", kind: str = "forest", trees: int = 20, depth: int = 5,
    seed: int = 42,
):
    """Random forest or gradient boosting regression as a saved-able pipeline model.

    A forest of one tree sees every row once, without drawing. Rows with an unknown feature or label teach nothing and are left out;
    ``usable_rows`` counts both kinds.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    common = {"featuresCol": "features", "labelCol": label, "predictionCol": "prediction", "seed": seed, "maxDepth": depth}
    if kind == "forest":
        learner = RandomForestRegressor(numTrees=trees, bootstrap=trees > 1, **common)
    elif kind == "boosting":
        learner = GBTRegressor(maxIter=trees, **common)
    else:
        raise ValueError(f"unknown model kind {kind!r}")
    return Pipeline(stages=[assembler, learner]).fit(train.filter(_known([*features, label])))


def _known(columns: list[str]) -> Column:
    """All of ``columns`` are numbers."""
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return known


def usable_rows(train: DataFrame, features: list[str], label: str = "sic") -> DataFrame:
    """Rows that ``fit_sea_ice`` learns from, and rows it leaves out."""
    known = _known([*features, label])
    return train.agg(F.count(F.when(known, 1)).alias("n_used"), F.count(F.when(~known, 1)).alias("n_left_out"))


def predict(model, df: DataFrame, out: str = "sic_pred") -> DataFrame:
    """Predicted concentration, cut to [0, 1]; null where a feature is unknown. Every row stays."""
    known = _known(model.stages[0].getInputCols())
    scored = model.transform(df).withColumn(out, F.when(known, clamp(F.col("prediction"), 0.0, 1.0)))
    return scored.drop("features", "prediction")


def regression_report(df: DataFrame, truth: str, pred: str, group: list[str] | None = None) -> DataFrame:
    """R squared, MAE and count, overall or by group.

    Written with one-pass moments, so it is one partial aggregation.
    """
    y, p = F.col(truth), F.col(pred)
    known = df.filter(y.isNotNull() & p.isNotNull())
    sums = known.groupBy(*(group or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.sum((y - p) * (y - p)).alias("_sse"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("_sst"),
    )
    return sums.withColumn("r2", F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst"))).drop("_sse", "_sst")


def classification_report(df: DataFrame, truth: Column, pred: Column, group: list[str] | None = None) -> DataFrame:
    """Confusion counts, accuracy, precision and recall."""
    t, p = truth.cast("boolean"), pred.cast("boolean")

    def tally(cond: Column) -> Column:
        return F.sum(cond.cast("bigint"))

    counts = df.groupBy(*(group or [])).agg(
        tally(t & p).alias("tp"), tally(~t & p).alias("fp"), tally(t & ~p).alias("fn"), tally(~t & ~p).alias("tn")
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {
            "accuracy": (tp + tn) / (tp + fp + fn + tn),
            "precision": F.when(tp + fp > 0, tp / (tp + fp)),
            "recall": F.when(tp + fn > 0, tp / (tp + fn)),
        }
    )
