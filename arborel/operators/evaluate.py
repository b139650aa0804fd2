"""Scores of predicted tree tops against reference positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spatial import nearest

#: A prediction matches its nearest reference position up to this distance (centimetres), which counts.
MATCH = 200


def nearest_reference(tops: DataFrame, truth: DataFrame, match: int = MATCH) -> DataFrame:
    """tops (treeID, xi, yi) with their nearest of truth (gt_id, gx, gy): gt_id, d2 and is_match. Many tops may have one reference position."""
    a = tops.select("treeID", F.col("xi").alias("ax"), F.col("yi").alias("ay"))
    b = truth.select("gt_id", F.col("gx").alias("bx"), F.col("gy").alias("by"))
    near = nearest(a, b, 2 * match, "treeID", "gt_id")
    return near.select("treeID", "gt_id", "d2", (F.col("d2") <= match * match).alias("is_match"))


def one_to_one(matches: DataFrame) -> DataFrame:
    """matches where each reference position counts for its nearest prediction only."""
    first = F.row_number().over(Window.partitionBy("gt_id").orderBy("d2", "treeID")) == 1
    return matches.withColumn("is_match", F.col("is_match") & first)


def metrics(predictions: DataFrame, truth: DataFrame, *keys: str) -> DataFrame:
    """predictions (keys, is_match) and truth (keys) by tile: true and false positives, false negatives (negative if predictions share reference positions),
    precision, recall and F1; null where a denominator is 0. Tiles that lack either side have no row."""
    p = predictions.groupBy(*keys).agg(F.count_if("is_match").alias("true_positives"), F.count("*").alias("n_pred"))
    t = truth.groupBy(*keys).agg(F.count("*").alias("n_true"))
    tp = F.col("true_positives")
    out = p.join(t, list(keys)) if keys else p.crossJoin(t)
    out = out.withColumns({"false_positives": F.col("n_pred") - tp, "false_negatives": F.col("n_true") - tp})
    out = out.withColumns({"precision": F.try_divide(tp, F.col("n_pred")), "recall": F.try_divide(tp, F.col("n_true"))})
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.withColumn("f1_score", f1).select(*keys, "true_positives", "false_positives", "false_negatives", "precision", "recall", "f1_score")


def match_labels(tops: DataFrame, matches: DataFrame, truth: DataFrame) -> DataFrame:
    """Predictions as 'true positive' or 'false positive', and reference positions as 'ground truth': x, y, label."""
    own = tops.join(matches.select("treeID", "is_match"), "treeID")
    label = F.when(F.col("is_match"), F.lit("true positive")).otherwise("false positive")
    predicted = own.select(F.col("treeID").alias("id"), F.col("xi").alias("x"), F.col("yi").alias("y"), label.alias("label"))
    return predicted.unionByName(truth.select(F.col("gt_id").alias("id"), F.col("gx").alias("x"), F.col("gy").alias("y"), F.lit("ground truth").alias("label")))


def relative_count_error(predicted: DataFrame, truth: DataFrame, *keys: str) -> DataFrame:
    """By tile, the numbers of predicted and true trees and their difference in percent of the true."""
    p = predicted.groupBy(*keys).agg(F.count("*").alias("n_pred"))
    t = truth.groupBy(*keys).agg(F.count("*").alias("n_true"))
    return p.join(t, list(keys)).withColumn("error_percent", F.round(F.abs(F.col("n_pred") - F.col("n_true")) * 100 / F.col("n_true"), 4))
