"""Landed bar files as an incremental stream into the bar table."""

from pyspark.sql import DataFrame, SparkSession

from ..operators.upsert import upsert_bar_table
from ..schema import PRICE_BAR


def drain_landed_bars(
    spark: SparkSession, landing: str, table: str, stocks: DataFrame, checkpoint: str, file_format: str = "parquet"
):
    """Merge every file landed since the last run, then stop.

    The merge is keyed, so a batch replayed after a failure gives the same table.
    """
    stream = spark.readStream.schema(PRICE_BAR).format(file_format).load(landing)

    def merge(batch: DataFrame, _batch_id: int) -> None:
        upsert_bar_table(batch.sparkSession, table, batch, stocks)

    query = (
        stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query
