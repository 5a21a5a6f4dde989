"""Session settings the jobs are written for."""

from pyspark.sql import SparkSession

# Adaptive execution sizes the shuffles and splits hot join keys; UTC keeps text and clock in step.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


def configured(builder: SparkSession.Builder, shuffle_partitions: int) -> SparkSession.Builder:
    """`shuffle_partitions` is the ceiling that adaptive execution coalesces from."""
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
