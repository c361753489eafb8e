"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Field maps keep the last value of a repeated key; event times are UTC.
_REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def ensure_session(spark: SparkSession) -> SparkSession:
    """Set the few SQL options every transform assumes; leaves sizing to the cluster."""
    for key, value in _REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark
