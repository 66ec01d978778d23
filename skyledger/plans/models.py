"""Forecast models on pyspark.ml with chronological splits."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.bands import entry_window
from skyledger.operators import dists
from skyledger.session import materialize


def _features(columns: list[str]) -> list:
    """Median imputation and assembly; the doubles are imputed in copies so the inputs stay as they are."""
    filled = [f"_imp_{c}" for c in columns]
    return [Imputer(inputCols=columns, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="features", handleInvalid="keep")]


def _doubles(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def _score(df: DataFrame) -> DataFrame:
    return df.withColumn("raw_probability", vector_to_array("probability")[1])


def train_threshold(df: DataFrame, features: list[str], target: str, date: str, calibrate_from: Column, validate_from: Column,
                    trees: int = 20, depth: int = 4) -> DataFrame:
    """Boosted trees on the oldest dates, isotonic calibration on the next block, scores on the newest block."""
    rows = _doubles(df, [*features, target])
    fit = rows.where(F.col(date) < calibrate_from)
    middle = rows.where((F.col(date) >= calibrate_from) & (F.col(date) < validate_from))
    model = Pipeline(stages=[*_features(features), GBTClassifier(labelCol=target, maxIter=trees, maxDepth=depth, seed=7)]).fit(fit)
    calibrator = IsotonicRegression(labelCol=target, featuresCol="raw_probability", predictionCol="calibrated_probability").fit(_score(model.transform(middle)))
    return calibrator.transform(_score(model.transform(rows.where(F.col(date) >= validate_from))))


def tune_depth(df: DataFrame, features: list[str], target: str, date: str, boundary: Column, depths: tuple[int, ...], trees: int = 10) -> DataFrame:
    """Log loss of each depth on the dates after the boundary."""
    from skyledger.functions.prob import log_loss

    rows = _doubles(df, [*features, target])
    out = None
    for depth in depths:
        model = Pipeline(stages=[*_features(features), GBTClassifier(labelCol=target, maxIter=trees, maxDepth=depth, seed=7)]).fit(rows.where(F.col(date) < boundary))
        part = _score(model.transform(rows.where(F.col(date) >= boundary))).agg(F.lit(depth).alias("depth"), F.avg(log_loss(F.col("raw_probability"), F.col(target))).alias("log_loss"))
        out = part if out is None else out.unionByName(part)
    return out


def train_bucket(df: DataFrame, features: list[str], ladder: list[str], target: str, date: str, boundary: Column, trees: int = 20) -> DataFrame:
    """Boosted trees over ladder rows; scores are normalised inside each ladder of the newer dates."""
    rows = _doubles(df, [*features, target])
    model = Pipeline(stages=[*_features(features), GBTClassifier(labelCol=target, maxIter=trees, maxDepth=4, seed=7)]).fit(rows.where(F.col(date) < boundary))
    scored = _score(model.transform(rows.where(F.col(date) >= boundary)))
    return dists.normalize_ladder(scored, ladder, "raw_probability", "normalized_probability")


def train_regressor(df: DataFrame, features: list[str], final: str, date: str, hour: str, boundary: Column, trees: int = 20) -> tuple[DataFrame, DataFrame]:
    """Boosted regression of the final value: predictions of the newer dates and the residual table by entry window."""
    rows = _doubles(df, [*features, final])
    model = Pipeline(stages=[*_features(features), GBTRegressor(labelCol=final, maxIter=trees, maxDepth=4, seed=7)]).fit(rows.where(F.col(date) < boundary))
    scored = model.transform(rows.where(F.col(date) >= boundary)).withColumn("window", entry_window(F.col(hour)))
    residuals = scored.select("window", (F.col(final) - F.col("prediction")).alias("residual"))
    return scored, residuals


def regressor_report(scored: DataFrame, final: str) -> DataFrame:
    error = F.col("prediction") - F.col(final)
    return scored.groupBy("window").agg(F.count(F.lit(1)).alias("rows"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(error).alias("bias"))


def fit_hurdle(df: DataFrame, features: list[str], delta: str, date: str, boundary: Column) -> DataFrame:
    """Peak (delta = 0) by a binary logistic and the positive delta by a multinomial one, both with Laplace-smoothed fallback.

    Adds `peak_probability` and `delta_mass` to the newer dates; its cells are +1 to the largest step of the training dates.
    """
    rows = _doubles(df, features).withColumns({"_peak": (F.col(delta) <= 0).cast("double"), "_delta": F.greatest(F.col(delta), F.lit(1)) - 1.0})
    train, newer = rows.where(F.col(date) < boundary), rows.where(F.col(date) >= boundary)
    peak = Pipeline(stages=[*_features(features), LogisticRegression(labelCol="_peak", regParam=0.01, probabilityCol="_pp", rawPredictionCol="_pr", predictionCol="_pq")]).fit(train)
    climbing = train.where(F.col(delta) > 0)
    mass = Pipeline(stages=[*_features(features), LogisticRegression(labelCol="_delta", family="multinomial", regParam=0.01, probabilityCol="_dp", rawPredictionCol="_dr", predictionCol="_dq")]).fit(climbing)
    drop = ["features", "_pr", "_pq", "_dr", "_dq", *[f"_imp_{c}" for c in features]]
    scored = mass.transform(peak.transform(newer).drop("features", *[f"_imp_{c}" for c in features]))
    classes = mass.stages[-1].numClasses
    smoothed = F.transform(vector_to_array("_dp"), lambda x: (x + 1e-4) / (1.0 + 1e-4 * classes))
    return scored.withColumns({"peak_probability": vector_to_array("_pp")[1], "delta_mass": smoothed}).drop("_pp", "_dp", *drop)


def fit_spatial(df: DataFrame, features: list[str], residual: str, eligible: Column, date: str, boundary: Column, limit: float = 5.0) -> DataFrame:
    """Ridge correction without intercept on standardised features of eligible rows, clipped to a few degrees; others get zero."""
    rows = _doubles(df, [*features, residual])
    stages = [*_features(features), StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
              LinearRegression(labelCol=residual, featuresCol="scaled", elasticNetParam=0.0, regParam=1.0, fitIntercept=False)]
    model = Pipeline(stages=stages).fit(rows.where((F.col(date) < boundary) & eligible & F.col(residual).isNotNull()))
    scored = model.transform(rows.where(F.col(date) >= boundary))
    return scored.withColumn("correction", F.when(eligible, F.greatest(F.least(F.col("prediction"), F.lit(limit)), F.lit(-limit))).otherwise(0.0))


def fit_surprise(df: DataFrame, base: list[str], surprise: str, regime: str, target: str, date: str, boundary: Column) -> DataFrame:
    """Baseline logistic against one with the surprise and its interactions, rows weighted to equal dates.

    Imputation, fit and scoring read the rows many times, so they are stored once.
    """
    rows = materialize(_doubles(df, [*base, surprise, target]))
    sizes = rows.groupBy(date).agg((1.0 / F.count(F.lit(1))).alias("_weight"))
    rows = rows.join(sizes, [date]).withColumns({"_si": F.col(surprise) * (F.col(regime) == "CLEAR").cast("double"), "_sm": F.col(surprise) * (F.col(regime) == "CLOUDY").cast("double")})
    train, newer = rows.where(F.col(date) < boundary), rows.where(F.col(date) >= boundary)
    out = newer
    for name, cols in (("baseline", base), ("challenger", [*base, surprise, "_si", "_sm"])):
        model = Pipeline(stages=[*_features(cols), LogisticRegression(labelCol=target, weightCol="_weight", regParam=0.001)]).fit(train)
        out = model.transform(out).withColumn(f"{name}_probability", vector_to_array("probability")[1]).drop(
            "features", "rawPrediction", "probability", "prediction", *[f"_imp_{c}" for c in cols])
    return out.drop("_si", "_sm")
