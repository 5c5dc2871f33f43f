"""A layer store kept up to date from a stream of new files: each micro-batch is upserted as a new version.

Of entries of one item in a batch the newest counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trove.operators.layers import load, save, upsert


def maintain(spark: SparkSession, entries: DataFrame, store_path: str, checkpoint: str, empty: DataFrame) -> StreamingQuery:
    """Start a query that upserts streamed entries (the store's columns) into the store at store_path."""

    def batch(rows: DataFrame, _: int) -> None:
        newest = Window.partitionBy("volume", "rel_path").orderBy(F.desc_nulls_last("modified"), F.desc_nulls_last("size"), F.hash(*empty.columns))
        rows = rows.withColumn("_turn", F.row_number().over(newest)).filter("_turn = 1").select(*empty.columns)
        save(upsert(load(rows.sparkSession, store_path, empty.limit(0)), rows), store_path)

    return entries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
