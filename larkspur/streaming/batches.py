"""Record batches of bounded size from files through Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.operators.frame import Frame
from larkspur.session import fresh_dir, remove
from larkspur.sources.infer import flatten
from larkspur.sources.readers import NdjsonScan, json_rows, json_schema


def stream_frames(spark: SparkSession, path: str, kind: str | None = None, schema: T.StructType | None = None, **options) -> DataFrame:
    """An unstarted stream over a folder or glob of JSON, NDJSON, CSV or Parquet files."""
    kind = kind or next((k for k in ("ndjson", "parquet", "csv", "tsv") if path.rstrip("/*").endswith(k)), "json")
    source = spark.readStream.option("maxFilesPerTrigger", options.pop("max_files", 100))
    if kind == "parquet":
        return source.schema(schema or spark.read.parquet(path).schema).parquet(path)
    if kind in ("csv", "tsv"):
        sep = options.get("delimiter", "\t" if kind == "tsv" else ",")
        schema = schema or spark.read.option("header", True).option("sep", sep).csv(path).schema
        return source.schema(schema).option("header", True).option("sep", sep).option("escape", '"').csv(path)
    if kind == "ndjson":
        return flatten(source.schema(schema or NdjsonScan(spark, path)._nested).json(path))
    return json_rows(source.text(path, wholetext=True), schema or json_schema(spark, path))


def stream_batches(spark: SparkSession, path: str, on_batch: Callable[[Frame], None], batch_size: int = 5000, kind: str | None = None, checkpoint: str | None = None, **options) -> Frame:
    """Calls ``on_batch`` with frames of at most ``batch_size`` rows until the files are read.

    The checkpoint makes a stopped stream resumable. What ``on_batch`` gets is readable until its micro-batch ends. Batches inside a micro-batch are cut per
    partition, so no global order or sort is needed; they are unordered. Returns an empty frame.
    """
    stream = stream_frames(spark, path, kind, **options)
    schema = stream.schema

    def each(batch: DataFrame, _: int) -> None:
        placed = batch.withColumn("_id", F.monotonically_increasing_id())
        # The id holds the partition above bit 33 and the row in it below: a batch is a run of rows of one partition.
        placed = placed.withColumn("_part", F.shiftright("_id", 33)).withColumn("_batch", F.floor(F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) / batch_size))
        # One job writes every batch to a folder of its own, so a batch reads its own rows alone.
        path = fresh_dir(spark, "batches")
        placed.write.partitionBy("_part", "_batch").parquet(path)
        rows = placed.drop("_part", "_batch").schema
        for r in spark.read.parquet(path).select("_part", "_batch").distinct().orderBy("_part", "_batch").toLocalIterator():
            held = spark.read.schema(rows).parquet(f"{path}/_part={r._part}/_batch={r._batch}")
            on_batch(Frame(held.withColumnRenamed("_id", "_row_id"), ["_row_id"]))
        remove(spark, path)

    query = (
        stream.writeStream.foreachBatch(each).trigger(availableNow=True)
        .option("checkpointLocation", checkpoint or fresh_dir(spark, "stream")).start()
    )
    query.awaitTermination()
    return Frame(spark.createDataFrame([], schema), metadata={"source": path, "mode": "stream"})
