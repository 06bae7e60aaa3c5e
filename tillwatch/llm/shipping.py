"""Make a session ready for the text operators: code for the Python workers, batches of long texts."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tillwatch.session import send_package

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000  # texts are far longer than other rows; Spark's own default is 10,000


def ship(spark: SparkSession) -> None:
    """The package goes to the executors. Arrow batches get ``BATCH_ROWS`` rows unless the session says otherwise."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    send_package(spark)
