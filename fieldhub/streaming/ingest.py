"""Registry rows as a stream: the stateless ingest columns on an unbounded table.

Cleaning and filtering keep no state, so the batch operators apply unchanged.  Whether the
standard headcount column is used cannot be decided on a stream's total and is therefore
stated up front.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from fieldhub.operators import registry as R


def permit_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """New CSV exports in a folder, all columns text."""
    return spark.readStream.schema(schema).csv(path, header=True)


def clean(stream: DataFrame, id_column: str | None = None, standard: bool = True) -> DataFrame:
    return R.active(R.parse_permits(stream, id_column, assume_standard=standard))


def land(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a parquet layer, once per available file."""
    return (
        stream.writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(availableNow=True).start()
    )
