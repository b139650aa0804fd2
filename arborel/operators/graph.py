"""Smallest labels over links, for clusters that reach across tiles."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut_lineage(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder of spark.checkpoint.dir (a local one only where that is unset)."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="arborel-"))
    return df.checkpoint()


def smallest_labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, label): each node's smallest id among those that links (a, b, in both directions) reach.

    Each round takes the smallest label of the neighbours and then that label's own label, so the rounds grow with the logarithm of a
    chain's length rather than with its length.
    """
    labels = cut_lineage(nodes.select("id", F.col("id").alias("label")))
    while True:
        near = links.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        new = labels.join(near, "id", "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        # A label's owner passes on the smallest label that any of its members has found, and then its own.
        passed = new.groupBy(F.col("old").alias("id")).agg(F.min("label").alias("passed"))
        new = new.join(passed, "id", "left").select("id", "old", F.least("label", F.coalesce("passed", "label")).alias("label"))
        up = new.select(F.col("id").alias("label"), F.col("label").alias("up"))
        new = cut_lineage(new.join(up, "label", "left").select("id", "old", F.least("label", F.coalesce("up", "label")).alias("label")))
        if new.where("label <> old").isEmpty():
            return new.select("id", "label")
        labels = new.select("id", "label")
