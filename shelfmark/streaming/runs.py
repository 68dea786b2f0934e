"""News as a stream: new files are read once, and each run is reported once.

The checkpoint holds the cursor and the keys reported so far, dealt by key; a batch that is
repeated after a failure sees the same keys and overwrites its own folder, so a repeat
changes nothing and no batch reads what earlier ones wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_runs(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", per_batch).load(path)


def report_new(runs: DataFrame, out: str, checkpoint: str, key: str, first_run: str | None = None) -> None:
    """Writes the runs not reported yet to ``out``, for all files there are now, then stops."""

    fresh = runs if first_run is None else runs.filter(~F.coalesce(F.col(first_run), F.lit(False)))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number:08d}")

    query = fresh.dropDuplicates([key]).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
