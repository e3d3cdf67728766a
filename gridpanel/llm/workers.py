"""Memory of Python workers.

A worker lives on after its task, and what numpy and Arrow have freed stays with it as long as the
C library keeps it for reuse. These settings give arrays of some megabytes back at once, so that idle workers are small
and a stage does not carry the peak of the one before.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

MAPPED = 4 << 20  # bytes from which on an array has pages of its own
SETTINGS = {
    "MALLOC_MMAP_THRESHOLD_": str(MAPPED),
    "MALLOC_TRIM_THRESHOLD_": str(MAPPED),
    "MALLOC_ARENA_MAX": "2",
    "ARROW_DEFAULT_MEMORY_POOL": "system",
}


def lean(spark: SparkSession) -> None:
    """For the workers that the session starts from now on; settings of the user's own stay."""
    for name, value in SETTINGS.items():
        spark.sparkContext.environment.setdefault(name, value)


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS = 2000  # texts that are handed to a worker at once


def in_small_batches(work: Callable) -> Callable:
    """For functions of a table that run jobs over whole texts: while they do, batches have up to ``ROWS``
    rows, on both sides of the pipe. The session's own setting is put back after."""

    @wraps(work)
    def run(df: DataFrame, *args, **named):
        conf = df.sparkSession.conf
        own = conf.get(BATCH)
        conf.set(BATCH, str(min(ROWS, int(own)) if int(own) > 0 else ROWS))
        try:
            return work(df, *args, **named)
        finally:
            conf.set(BATCH, own)

    return run
