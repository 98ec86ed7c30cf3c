"""Streaming ingest: new vectors are encoded as they arrive and appended to an index's tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from vecspark.operators.clustering import assign
from vecspark.operators.compress import binary_codes


def read(spark: SparkSession, path: str, schema: str = "vec_id long, v array<double>") -> DataFrame:
    """A stream of the parquet files that appear in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def start(stream: DataFrame, centroids: np.ndarray, dim: int, out: str, checkpoint: str, bits: int | None = None, once: bool = False) -> StreamingQuery:
    """Appends each batch's codes and postings under ``out``; a batch that is repeated after a failure replaces its own rows.

    Encoding has no state.  With ``once`` the stream ends when it has taken what is there.
    """
    def append(batch: DataFrame, number: int) -> None:
        batch.persist()
        binary_codes(batch, dim, bits).write.mode("overwrite").parquet(f"{out}/codes/batch={number}")
        assign(batch, centroids).write.mode("overwrite").parquet(f"{out}/postings/batch={number}")
        batch.unpersist()

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
