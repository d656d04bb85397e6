"""Recipes on streams: fitted states are broadcast dictionaries, so a recipe is a stateless stream transformation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..search.recipe import Recipe


def transform_stream(recipe: Recipe, stream: DataFrame) -> DataFrame:
    """The stream with the recipe's columns."""
    return recipe.transform(stream)


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def write_stream(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Append a stream to Parquet files; ``checkpoint`` makes each input row count once."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
