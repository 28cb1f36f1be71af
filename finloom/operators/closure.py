"""Transitive closure of name links by least labels and pointer jumping."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _checkpoints(spark: SparkSession) -> None:
    """The session's shared checkpoint folder; under a local master, where none is set, a temporary one."""
    if spark.sparkContext.getCheckpointDir() is None:
        held = spark.conf.get("spark.checkpoint.dir", None)
        if not held and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(held or tempfile.mkdtemp(prefix="finloom-closure-"))


def least_labels(links: DataFrame) -> DataFrame:
    """name, root: the least name that each name of ``links`` (a, b) reaches.

    Every round takes the least label of the neighbours and then the label of that
    label, so that chains shrink by half; it ends when nothing changes.  Rounds are
    checkpointed; only the count of changes comes to the driver.
    """
    _checkpoints(links.sparkSession)
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.select(F.col("a").alias("name"), F.col("a").alias("root")).distinct().checkpoint()
    while True:
        near = both.join(labels.withColumnRenamed("name", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        met = labels.join(near, labels["name"] == near["a"]).select("name", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        up = met.select(F.col("name").alias("root"), F.col("root").alias("above"))
        moved = met.join(up, "root").select("name", F.least("root", "above").alias("root"), "was").checkpoint()
        if moved.where("root <> was").isEmpty():
            return moved.select("name", "root")
        labels = moved.select("name", "root")
