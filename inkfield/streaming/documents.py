"""The document plan over a stream of replies: a stateless map, so neither watermark nor state store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from inkfield.options import Options
from inkfield.plans.parse import parse_nested
from inkfield.schema import WIRE
from inkfield.sources.wire import nested_blocks


def reply_stream(spark: SparkSession, path: str, files_at_once: int = 64) -> DataFrame:
    return spark.readStream.schema(WIRE).option("maxFilesPerTrigger", files_at_once).json(path)


def parsed_stream(replies: DataFrame, options: Options | None = None) -> DataFrame:
    return parse_nested(nested_blocks(replies), options)


def run_available(results: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes what is there to Parquet and ends; started again it takes up where it stopped."""
    return results.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
