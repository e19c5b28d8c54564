"""Reading texts, chunks and logs, and writing results, with Spark's own formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from blackbar.session import shared_folder

CHUNKS = "stream_id string, seq bigint, ts timestamp, chunk binary, eof boolean"
FRAMES = "stream_id string, seq bigint, frame string"
REQUESTS = (
    "request_id string, ts timestamp, method string, path string, origin string, "
    "authorization_sha256 string, content_length string, body_bytes bigint, "
    "upstream_status int, send_error boolean, retry_after string, content_type string"
)
STREAMS = "request_id string, started timestamp, ended timestamp, end_reason string"

_SMALL_INPUT_BYTES = 256 * 1024 * 1024


def read_table(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None
) -> DataFrame:
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def read_stream(
    spark: SparkSession,
    path: str,
    schema: str = CHUNKS,
    fmt: str = "parquet",
    files_per_trigger: int | None = None,
    bytes_per_trigger: str | None = None,
) -> DataFrame:
    """A folder as a stream; the trigger limits bound how much one micro-batch takes."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    return reader.load(path)


def spread_small(df: DataFrame) -> DataFrame:
    """Spread a table that is small in bytes (so possibly one split) over all cores.

    Text work per byte is much dearer than shuffling it once. A large table already has
    a split per 128 MB and is left as it is.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(size) > _SMALL_INPUT_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    df.write.format(fmt).mode(mode).save(path)


def stream_writer(
    df: DataFrame, path: str, query: str, fmt: str = "parquet", checkpoint: str | None = None
) -> DataStreamWriter:
    """A file sink whose progress lives in the shared checkpoint folder."""
    return (
        df.writeStream.format(fmt)
        .outputMode("append")
        .queryName(query)
        .option("path", path)
        .option("checkpointLocation", checkpoint or shared_folder(df.sparkSession, query))
    )
