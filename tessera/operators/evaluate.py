"""Quality of clusters against a ground truth. Both are tables of (record_id, cluster)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _pairs(table: DataFrame, by: list[str], kind: str) -> DataFrame:
    n = F.col("count")
    return table.groupBy(*by).count().select(F.lit(kind).alias("kind"), (n * (n - 1) / 2).cast("long").alias("pairs"))


def pairwise(truth: DataFrame, predicted: DataFrame, truth_id: str = "entity_id", cluster: str = "cluster_id") -> DataFrame:
    """tp, fp, fn, precision, recall, f1 over unordered pairs, 0 where undefined.

    Pairs are counted, n(n - 1)/2 for each cluster and each overlap, and never listed.
    """
    truth, predicted = truth.dropDuplicates(["record_id", truth_id]), predicted.dropDuplicates(["record_id", cluster])
    both = truth.join(predicted, "record_id")
    listed = _pairs(both, [truth_id, cluster], "tp").unionByName(_pairs(predicted, [cluster], "found"))
    listed = listed.unionByName(_pairs(truth, [truth_id], "real"))
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("pairs"))), F.lit(0)).alias(kind)
    sums = listed.agg(total("tp"), total("found"), total("real"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, found, real = F.col("tp"), F.col("found"), F.col("real")
    return sums.select(
        "tp",
        (found - tp).alias("fp"),
        (real - tp).alias("fn"),
        share(tp, found).alias("precision"),
        share(tp, real).alias("recall"),
        share(2 * tp, found + real).alias("f1"),
    )


def purity(truth: DataFrame, predicted: DataFrame, truth_id: str = "entity_id", cluster: str = "cluster_id") -> DataFrame:
    """cluster, size, dominant, purity: of clusters with a record of the truth; ties go to the least entity."""
    size = predicted.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    votes = predicted.join(truth, "record_id").groupBy(cluster, truth_id).agg(F.count(F.lit(1)).alias("votes"))
    best = Window.partitionBy(cluster).orderBy(F.desc("votes"), truth_id)
    top = votes.withColumn("place", F.row_number().over(best)).filter("place = 1")
    return top.join(size, cluster).select(
        cluster, "size", F.col(truth_id).alias("dominant"), (F.col("votes") / F.col("size")).alias("purity")
    )
