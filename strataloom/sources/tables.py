"""Reading and writing tables, and the search's event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "orc", "csv", "json")


def read_table(spark: SparkSession, path: str, kind: str | None = None, schema=None, **options) -> DataFrame:
    """A table by its file extension or ``kind``; CSV has a header unless told otherwise."""
    kind = kind or path.rstrip("/").rpartition(".")[2].lower()
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}; known: {', '.join(FORMATS)}")
    reader = spark.read.options(**({"header": True, **options} if kind == "csv" else options))
    return (reader.schema(schema) if schema else reader).format(kind).load(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None, **options) -> None:
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}; known: {', '.join(FORMATS)}")
    writer = df.write.mode(mode).options(**({"header": True, **options} if kind == "csv" else options))
    (writer.partitionBy(*partition_by) if partition_by else writer).format(kind).save(path)
