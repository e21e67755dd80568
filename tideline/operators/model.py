"""Model operators on ``pyspark.ml``: W15 chronological split, M1 fit,
M2 batch score, M3 score latest, M4 persist/reload, M6 horizon choice,
T2 latest complete row.

Missing feature values: a tree cannot take NULL, so every feature is
filled with a sentinel far below any real value (the split isolates it)
before the ``VectorAssembler``. The assembler stores the feature order.
"""
from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .blocked import series_positions

MISSING_SENTINEL = -1.0e6

# Reference hyper-parameters mapped onto GBTRegressor (see README).
DEFAULT_PARAMS = dict(maxIter=600, maxDepth=6, stepSize=0.05, subsamplingRate=0.85,
                      featureSubsetStrategy="0.85", minInstancesPerNode=5, maxBins=256, seed=42,
                      validationTol=0.01)


def time_split(df: DataFrame, *, series_cols: Sequence[str] = ("series_id",), ts_col: str = "timestamp",
               train_frac: float = 0.70, val_frac: float = 0.15, embargo_steps: int = 0) -> DataFrame:
    """Per series by row position after sorting by time:
    [0, int(n*train)) train, [.., int(n*(train+val))) val, rest test.
    ``embargo_steps`` rows before each boundary are dropped (default 0)."""
    x = series_positions(df, series_cols, ts_col)
    n = F.col("_len").cast("double")
    tr_end = F.floor(n * F.lit(float(train_frac))).cast("long")
    va_end = F.floor(n * F.lit(float(train_frac + val_frac))).cast("long")
    pos = F.col("_pos")
    split = F.when(pos < tr_end, "train").when(pos < va_end, "val").otherwise("test")
    out = x.withColumn("split", split)
    if embargo_steps:
        e = F.lit(int(embargo_steps))
        out = out.filter(~(((pos >= tr_end - e) & (pos < tr_end)) | ((pos >= va_end - e) & (pos < va_end))))
    return out.drop("_len").withColumnRenamed("_pos", "row_pos")


def stored_split(features: DataFrame, **how) -> DataFrame:
    """``time_split`` of features that are computed and split once, into the shared
    folder: counts, boosting passes, validation, scores and other targets scan that table."""
    spark = features.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"fit-{uuid.uuid4().hex}")
    features.write.parquet(f"{path}/rows")
    time_split(spark.read.parquet(f"{path}/rows"), **how).write.parquet(f"{path}/split")
    return spark.read.parquet(f"{path}/split")


def _fill_sql(feature_cols: Sequence[str]) -> str:
    cols = ", ".join(f"coalesce(CAST(`{c}` AS DOUBLE), {MISSING_SENTINEL}) AS `_f_{c}`" for c in feature_cols)
    return f"SELECT *, {cols} FROM __THIS__"


def fit(features: DataFrame, feature_cols: Sequence[str], *, target_col: str = "target_30m",
        series_cols: Sequence[str] = ("series_id",), params: dict | None = None,
        train_frac: float = 0.70, val_frac: float = 0.15, patience: int | None = None) -> tuple[PipelineModel, DataFrame]:
    """M1: fit on train, stop early on val. Returns the fitted pipeline and the
    split table (for metrics, and for fits of other targets: ``features`` that
    have a ``split`` are not split again).

    With ``patience``, all ``maxIter`` trees are grown on train, the mean absolute
    error on val is taken after each, and the ensemble is cut at its best tree
    before ``patience`` trees in a row that bring no better one; without,
    Spark's own rule (``validationIndicatorCol``) holds."""
    spark = features.sparkSession
    p = {**DEFAULT_PARAMS, **(params or {})}
    sp = features if "split" in features.columns else stored_split(
        features, series_cols=series_cols, train_frac=train_frac, val_frac=val_frac)
    lab = sp.filter(F.col(target_col).isNotNull())
    counts = {r["split"]: r["n"] for r in lab.groupBy("split").agg(F.count("*").alias("n")).collect()}
    if any(counts.get(k, 0) == 0 for k in ("train", "val", "test")):
        raise ValueError(f"Empty split {counts}; not enough labelled rows")
    fitdata = lab.filter(F.col("split") != "test").withColumn("_is_val", F.col("split") == "val")
    gbt = GBTRegressor(featuresCol="features", labelCol=target_col, predictionCol="prediction", **p)
    prepare = [SQLTransformer(statement=_fill_sql(feature_cols)),
               VectorAssembler(inputCols=[f"_f_{c}" for c in feature_cols], outputCol="features", handleInvalid="keep")]
    if patience is None:
        return Pipeline(stages=[*prepare, gbt.setValidationIndicatorCol("_is_val")]).fit(fitdata), sp
    model = Pipeline(stages=[*prepare, gbt]).fit(fitdata.filter("not _is_val"))
    scored = PipelineModel(model.stages[:-1]).transform(fitdata.filter("_is_val")).select("features", target_col)
    errors = model.stages[-1].evaluateEachIteration(scored, "absolute")
    best = best_iteration(errors, patience)
    return PipelineModel([*model.stages[:-1], first_trees(spark, model.stages[-1], best)]), sp


def best_iteration(errors: Sequence[float], patience: int) -> int:
    """Number of trees with the least error before ``patience`` ones without a better."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def first_trees(spark, model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The ensemble of the first ``n`` trees: the saved model with the other trees left out."""
    path = os.path.join(checkpoint_dir(spark), f"gbt-{uuid.uuid4().hex}")
    model.write().save(f"{path}/whole")
    meta = json.loads(spark.read.text(f"{path}/whole/metadata").first()[0])
    if "numTrees" not in meta:
        raise ValueError("a saved ensemble without a tree count")
    meta["numTrees"] = n
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/cut/metadata")
    for part in ("data", "treesMetadata"):  # the first column is the tree's number
        rows = spark.read.parquet(f"{path}/whole/{part}")
        rows.filter(F.col(rows.columns[0]) < n).write.parquet(f"{path}/cut/{part}")
    return GBTRegressionModel.load(f"{path}/cut")


def predict(model: PipelineModel, df: DataFrame, *, target_col: str | None = "target_30m",
            keep_cols: Sequence[str] = ("timestamp", "glucose_mg_dl")) -> DataFrame:
    """M2: score every row (NULL features included)."""
    out = model.transform(df).select(*keep_cols, *( [target_col] if target_col else []),
                                     F.col("prediction").alias("prediction_30m"))
    if target_col:
        out = out.withColumnRenamed(target_col, "actual_30m") \
            .withColumn("abs_error", F.abs(F.col("prediction_30m") - F.col("actual_30m")))
    return out


def latest_complete(features: DataFrame, cols: Sequence[str], *, series_cols: Sequence[str] = ("series_id",),
                    ts_col: str = "timestamp", report_missing: bool = False) -> DataFrame:
    """Per series the newest row with no NULL in ``cols`` (a max over
    (ts, row) per series, with a partial step before the shuffle). A series
    without such a row is left out, or has NULLs with ``report_missing``."""
    rest = [c for c in features.columns if c not in series_cols]
    row = F.struct(F.col(ts_col).alias("_t"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_r"))
    if report_missing:
        complete = F.forall(F.array(*[F.col(f"`{c}`").isNotNull() for c in cols]), lambda x: x)
        m = features.groupBy(*series_cols).agg(F.max(F.when(complete, row)).alias("_m"))
    else:
        m = features.dropna(subset=list(cols)).groupBy(*series_cols).agg(F.max(row).alias("_m"))
    return m.select(*series_cols, *[F.col("_m._r").getField(c).alias(c) for c in rest])


def predict_latest(model: PipelineModel, features: DataFrame, cols: Sequence[str], *,
                   series_cols: Sequence[str] = ("series_id",)) -> DataFrame:
    """M3: as_of, current_glucose, prediction_30m, predicted_change per series."""
    last = latest_complete(features, cols, series_cols=series_cols)
    s = model.transform(last)
    return s.select(*series_cols, F.col("timestamp").alias("as_of"), F.col("glucose_mg_dl").alias("current_glucose"),
                    F.col("prediction").alias("prediction_30m"),
                    (F.col("prediction") - F.col("glucose_mg_dl")).alias("predicted_change"))


def save(model: PipelineModel, path: str) -> None:
    """M4: the pipeline stores the assembler's feature order with the trees."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def model_feature_cols(model: PipelineModel) -> list[str]:
    va = [s for s in model.stages if isinstance(s, VectorAssembler)][0]
    return [c[len("_f_"):] for c in va.getInputCols()]
