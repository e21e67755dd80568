"""Explanations: M5 per-row contributions, A15 global importance, T4
top-k per row, T6 seeded sample.

M5 is a Spark job: the fitted trees (size bounded by the model, not the
data) are read once from the saved model, shipped to tasks as a broadcast
of NumPy arrays, and ``mapInPandas`` explains Arrow batches. Contributions are
the exact Shapley values of the path-dependent game (TreeSHAP): a coalition's
value is the tree's mean over the features it doesn't know, weighted by the rows
each node was trained on. A leaf's share of them depends only on which of its
path's features the row satisfies, so it is tabled once for the at most
``2^depth`` patterns and looked up for all rows of a batch at once.
``bias + sum(contributions) == prediction``; the bias is the weighted mean of the leaves.
"""
from __future__ import annotations

import os
import uuid
from collections.abc import Sequence
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir, ship_package
from .model import MISSING_SENTINEL, model_feature_cols


def tree_arrays(spark: SparkSession, gbt: GBTRegressionModel) -> list[dict]:
    """Per tree: children, split feature, threshold, node mean, training rows, weight."""
    path = os.path.join(checkpoint_dir(spark), f"gbt-{uuid.uuid4().hex}")
    gbt.write().overwrite().save(path)
    nodes = spark.read.parquet(os.path.join(path, "data")).select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild",
        "nodeData.rawCount", "nodeData.split.featureIndex", "nodeData.split.leftCategoriesOrThreshold").toPandas()
    weights = list(gbt.treeWeights)
    trees = []
    for tid, g in nodes.groupby("treeID"):
        g = g.sort_values("id")
        n = int(g["id"].max()) + 1
        left = np.full(n, -1, np.int64)
        right = np.full(n, -1, np.int64)
        feat = np.full(n, -1, np.int64)
        thr = np.zeros(n)
        pred, cover = np.zeros(n), np.zeros(n)
        ids = g["id"].to_numpy()
        left[ids] = g["leftChild"].to_numpy()
        right[ids] = g["rightChild"].to_numpy()
        feat[ids] = g["featureIndex"].to_numpy()
        pred[ids] = g["prediction"].to_numpy()
        cover[ids] = g["rawCount"].to_numpy()
        thr[ids] = [float(t[0]) if t is not None and len(t) else 0.0 for t in g["leftCategoriesOrThreshold"]]
        # the root is the node no other node points to
        child = set(left[left >= 0]) | set(right[right >= 0])
        root = int([i for i in ids if i not in child][0])
        trees.append(dict(left=left, right=right, feat=feat, thr=thr, pred=pred, cover=cover, root=root,
                          w=float(weights[int(tid)])))
    return trees


def leaf_paths(t: dict) -> list[tuple]:
    """Of each leaf (features, lower bounds, upper bounds, shares, value): a path's
    splits on one feature are one interval (low, high], and its share is the part of
    the training rows that follow these splits."""
    out, todo = [], [(t["root"], {})]
    while todo:
        node, held = todo.pop()
        if t["left"][node] < 0:
            f = list(held)
            low, high, share = (np.array([held[k][i] for k in f]) for i in range(3))
            out.append((np.array(f, dtype=np.int64), low, high, share, float(t["pred"][node])))
            continue
        k, x = int(t["feat"][node]), float(t["thr"][node])
        low, high, share = held.get(k, (-np.inf, np.inf, 1.0))
        whole = t["cover"][node]
        for child, bounds in ((int(t["left"][node]), (low, min(high, x))), (int(t["right"][node]), (max(low, x), high))):
            part = t["cover"][child] / whole if whole else 0.0
            todo.append((child, {**held, k: (*bounds, share * part)}))
    return out


def shapley_table(share: np.ndarray) -> np.ndarray:
    """[pattern, feature]: Shapley values of a leaf of value 1 for each pattern of
    satisfied features (bit i: the i-th). A coalition of k others weighs
    ``k! (d - 1 - k)! / d!``; the sums over coalitions of one size are the
    coefficients of the product of ``share + satisfied * y`` over the others."""
    d = len(share)
    has = (np.arange(1 << d)[:, None] >> np.arange(d) & 1).astype(np.float64)
    weight = np.array([factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)])
    out = np.empty((1 << d, d))
    for i in range(d):
        sums = np.zeros((1 << d, d))
        sums[:, 0] = 1.0
        for j in range(d):
            if j != i:
                grown = sums * share[j]
                grown[:, 1:] += sums[:, :-1] * has[:, [j]]
                sums = grown
        out[:, i] = (sums @ weight) * (has[:, i] - share[i])
    return out


def shapley_leaves(trees: list[dict]) -> tuple[float, list[tuple]]:
    """The bias, and (features, low, high, table of the weighted leaf) of all leaves."""
    bias, leaves = 0.0, []
    for t in trees:
        for f, low, high, share, value in leaf_paths(t):
            bias += t["w"] * value * float(np.prod(share))
            if len(f):
                leaves.append((f, low, high, t["w"] * value * shapley_table(share)))
    return bias, leaves


def _contrib_batch(x: np.ndarray, bias: float, leaves: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    cols = np.ascontiguousarray(x.T)
    contrib = np.zeros_like(cols)
    for f, low, high, table in leaves:
        pattern = np.zeros(len(x), dtype=np.int64)
        for i, k in enumerate(f):
            pattern |= ((cols[k] > low[i]) & (cols[k] <= high[i])).astype(np.int64) << i
        contrib[f] += table[pattern].T
    return np.full(len(x), bias), contrib.T


def contributions(spark: SparkSession, model: PipelineModel, df: DataFrame, *,
                  key_cols: Sequence[str]) -> DataFrame:
    """M5: key..., bias, prediction, contribs and vals array<double> (model
    feature order; a missing value is NULL in ``vals``)."""
    ship_package(spark)
    gbt = [s for s in model.stages if isinstance(s, GBTRegressionModel)][0]
    cols = model_feature_cols(model)
    bc = spark.sparkContext.broadcast(tree_arrays(spark, gbt))
    filled = df.select(*key_cols, *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(MISSING_SENTINEL))
                                    .alias(f"_f{i}") for i, c in enumerate(cols)])
    fcols = [f"_f{i}" for i in range(len(cols))]
    schema = T.StructType([*[filled.schema[k] for k in key_cols],
                           T.StructField("bias", T.DoubleType()), T.StructField("prediction", T.DoubleType()),
                           T.StructField("contribs", T.ArrayType(T.DoubleType())),
                           T.StructField("vals", T.ArrayType(T.DoubleType()))])

    def run(it):
        total, leaves = shapley_leaves(bc.value)
        for pdf in it:
            x = pdf[fcols].to_numpy(dtype=np.float64)
            bias, con = _contrib_batch(x, total, leaves)
            out = pdf[list(key_cols)].copy()
            out["bias"] = bias
            out["prediction"] = bias + con.sum(axis=1)
            out["contribs"] = list(con)
            out["vals"] = list(x)
            yield out

    return filled.mapInPandas(run, schema).withColumn(
        "vals", F.transform("vals", lambda v: F.nullif(v, F.lit(MISSING_SENTINEL))))


def global_importance(contribs: DataFrame, feature_cols: Sequence[str]) -> DataFrame:
    """Mean |contribution| per feature (partial aggregation per task)."""
    names = F.array(*[F.lit(c) for c in feature_cols])
    x = contribs.select(F.posexplode("contribs").alias("ix", "c"))
    g = x.groupBy("ix").agg(F.avg(F.abs("c")).alias("mean_abs_contribution"))
    return g.select(F.element_at(names, F.col("ix") + 1).alias("feature"), "mean_abs_contribution")


def top_k_contributions(contribs: DataFrame, feature_cols: Sequence[str], *, key_cols: Sequence[str],
                        k: int = 8) -> DataFrame:
    """T4: per row the k contributions largest in |value|, with the feature
    value, as array<struct<feature, value, contribution>>."""
    names = F.array(*[F.lit(c) for c in feature_cols])
    trip = F.transform(F.arrays_zip(names.alias("f"), F.col("vals").alias("v"), F.col("contribs").alias("c")),
                       lambda z: F.struct(F.abs(z["c"]).alias("a"), z["f"].alias("feature"),
                                          z["v"].alias("value"), z["c"].alias("contribution")))
    top = F.slice(F.sort_array(trip, asc=False), 1, k)
    return contribs.select(*key_cols, "bias", "prediction",
                    F.transform(top, lambda z: F.struct(z["feature"].alias("feature"), z["value"].alias("value"),
                                                        z["contribution"].alias("contribution"))).alias("top"))


def seeded_sample(df: DataFrame, n: int = 2000, *, key_cols: Sequence[str], seed: int = 0) -> DataFrame:
    """Deterministic sample of ``n`` rows (order of the MD5 of the seed and
    the key, with a timestamp as its microseconds; top-n per task, then one
    merge), re-sorted by ``key_cols``, the last one (the time) first."""
    kinds = dict(df.dtypes)
    key = [F.unix_micros(c) if kinds[c] == "timestamp" else F.col(c) for c in key_cols]
    h = F.md5(F.concat_ws("|", F.lit(seed).cast("string"), *[F.coalesce(c.cast("string"), F.lit("")) for c in key]))
    return df.orderBy(h, *key_cols).limit(n).orderBy(key_cols[-1], *key_cols[:-1])
