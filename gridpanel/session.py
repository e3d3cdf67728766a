"""Session settings the engine is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# The JVM does not compile generated methods above 8000 bytes of bytecode; stages
# over wide panels reach that and would be interpreted. Such stages, and those
# beyond 60 columns (which also covers reading wide files), run operator by
# operator, with code that is split into small methods.
RUNTIME = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.codegen.maxFields": "60",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; none of them needs a new session."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark
