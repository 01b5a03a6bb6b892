"""Next-hour risk model on Spark ML: standardise, logistic regression, evaluate, score."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.functions.times import literal
from gridpulse.operators import newton
from gridpulse.operators.ranks import ranking_metrics
from gridpulse.operators.signals import TARGET, confusion, risk_level
from gridpulse.schemas import FEATURES, MODEL_VERSION

# Feature sets of the ablation.
FEATURE_SETS = {
    "All six features": FEATURES,
    "avg_activity only": ["avg_activity"],
    "Without avg_activity": [f for f in FEATURES if f != "avg_activity"],
    "avg_activity and variability": ["avg_activity", "variability"],
}


def train(
    rows: DataFrame, features: list[str] = FEATURES, c: float = 1.0, max_iter: int = 1000, tol: float = 1e-6
) -> PipelineModel:
    """Fit on labelled rows; L2 strength ``1 / c`` per the summed-loss convention.

    Spark minimises the mean loss, so the penalty is 1 / (c n). The scaler
    divides by the sample deviation instead of the population one; scaling by
    k scales the penalty by k^2, and (n - 1) / n on it gives the same model.
    Input rows are read several times: pass a stored table or a persisted frame.
    """
    n = rows.count()
    penalty = (n - 1) / (c * n * n)
    stages = [
        VectorAssembler(inputCols=features, outputCol="raw_features"),
        StandardScaler(
            withMean=True, withStd=True, inputCol="raw_features", outputCol="scaled_features"
        ),
        LogisticRegression(
            featuresCol="scaled_features",
            labelCol=TARGET,
            maxIter=max_iter,
            tol=tol,
            regParam=penalty,
            standardization=False,
        ),
    ]
    return Pipeline(stages=stages).fit(rows)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str, features: list[str] = FEATURES) -> PipelineModel:
    """Load and check that the model takes the expected features."""
    model = PipelineModel.load(path)
    have = model.stages[0].getInputCols()
    if have != features or model.stages[-1].numFeatures != len(features):
        raise ValueError(f"model takes {have}, expected {features}")
    return model


def score(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Adds ``risk_score`` (probability of a high next hour)."""
    out = model.transform(features)
    probability = vector_to_array("probability")[1]
    return out.withColumn("risk_score", probability).select(*features.columns, "risk_score")


def row_at(features: DataFrame, grid_id: int, at: datetime) -> DataFrame:
    """Stored features of one cell and stamp."""
    return features.filter((F.col("grid_id") == grid_id) & (F.col("feature_timestamp") == literal(at)))


def point(scored: DataFrame) -> DataFrame:
    """Published form of scored rows."""
    return scored.select(
        "grid_id",
        F.col("feature_timestamp").alias("timestamp"),
        "risk_score",
        risk_level(F.col("risk_score")).alias("risk_level"),
        F.lit(MODEL_VERSION).alias("model_version"),
    )


def predict_point(
    model: PipelineModel, features: DataFrame, grid_id: int, at: datetime
) -> DataFrame:
    """Prediction for one cell and stamp; no row means no stored features."""
    return point(score(model, row_at(features, grid_id, at)))


def coefficients(model: PipelineModel, spark: SparkSession, rows: int | None = None) -> DataFrame:
    """(feature, coefficient, direction); as many rows as features.

    With the number of training ``rows`` the coefficients refer to population
    standardisation, else to sample standardisation.
    """
    names = model.stages[0].getInputCols()
    factor = ((rows - 1) / rows) ** 0.5 if rows else 1.0
    values = [float(v) * factor for v in model.stages[-1].coefficients]
    frame = spark.createDataFrame(list(zip(names, values)), "feature string, coefficient double")
    sign = F.when(F.col("coefficient") > 0, "positive").when(F.col("coefficient") < 0, "negative")
    return frame.withColumn("direction", sign.otherwise("neutral"))


def evaluate(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: confusion figures with ROC-AUC and average precision."""
    ranks = ranking_metrics(scored, "risk_score", TARGET)
    figures = confusion(scored, "risk_score", TARGET, threshold)
    return figures.withColumns(
        {
            "roc_auc": ranks.select("roc_auc").scalar(),
            "average_precision": ranks.select("average_precision").scalar(),
        }
    )


def ablation(
    train_rows: DataFrame, test_rows: DataFrame, sets: dict[str, list[str]] = FEATURE_SETS
) -> DataFrame:
    """Test metrics per feature set; all sets are fitted together, one pass over the training rows a step."""
    fits = newton.fit_sets(train_rows, sets)
    rows = [evaluate(newton.score(fits[name], test_rows)).withColumn("model", F.lit(name)) for name in sets]
    return reduce(DataFrame.unionByName, rows).select(
        "model", "accuracy", "precision", "recall", "roc_auc", "average_precision"
    )


def describe_split(rows: DataFrame) -> DataFrame:
    """Rows, stamps range, positives, negatives and base rate per split."""
    label = F.col(TARGET)
    return rows.groupBy("split").agg(
        F.count("*").alias("rows"),
        F.min("feature_timestamp").alias("earliest_timestamp"),
        F.max("feature_timestamp").alias("latest_timestamp"),
        F.count_if(label == 1).alias("positive_rows"),
        F.count_if(label == 0).alias("negative_rows"),
        F.avg(label.cast("double")).alias("base_rate"),
    )
