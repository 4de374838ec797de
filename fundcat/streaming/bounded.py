"""Streams that are run over what is there and then end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fundcat.tables import new_folder

#: The state store that ``transformWithStateInPandas`` needs.
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(spark: SparkSession, source: str, schema, flow: Callable[[DataFrame], DataFrame], folder: str | None = None) -> DataFrame:
    """Rows that ``flow`` appends for the Parquet files in ``source`` that no run with this
    ``folder`` has seen, with all rows of earlier runs. Progress, state and output are in
    the folder, in the shared one unless named: a run that fails goes on where it stopped,
    and the file sink's log lets no row through twice."""
    folder = folder or new_folder(spark, "stream")
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        out = flow(spark.readStream.schema(schema).parquet(source))
        run = out.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(_STORE, before)
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")
