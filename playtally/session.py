"""Session settings the jobs are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# No join in the package carries a hint. Catalyst broadcasts a side only if its
# size is below the threshold, adaptive execution does so from measured sizes,
# and a join key that is too hot for one task is split at run time - also where
# the split costs one more shuffle for the operator above the join.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Events are tested against a Bloom filter of the valid asset keys where they are scanned.
    # Spark sizes it by the keys; with more than this, it would keep too few events out.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1GB",
    # A union that zips equally partitioned inputs fails when adaptive execution
    # re-partitions one of them ("Can't zip RDDs with unequal numbers of
    # partitions"), and it would leave a hot key's rows in one task.
    "spark.sql.unionOutputPartitioning": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session and return it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
