"""New run files as a stream: only what arrived since the last pass is cleaned."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..params import Params
from ..plans.clean import clean_runs
from ..scale import attach, fits, with_positions
from ..session import cut
from ..sources.runs import clean_lines, line_reader, rows_by_header, run_name

#: Folders that the raw rows of deliveries are kept in.
PARTS = 256


def ingest_stream(spark: SparkSession, path: str, checkpoint: str, sink: str, schema: T.StructType, fmt: str = "csv",
                  params: Params = Params(), shape: Callable[[DataFrame], DataFrame] | None = None, parts: int = PARTS, **options) -> StreamingQuery:
    """Clean the run files that appeared in ``path`` and append them to ``sink``.

    A run is one whole file, so no state or watermark is needed; CSV files are read by their own headers. ``shape`` may
    turn a batch into raw run rows first; then a run may span files, and a batch cleans every run it touches from all raw rows delivered so
    far. Those are kept beside the sink in ``<sink>-raw``, in ``parts`` folders by a hash of the run, and a batch reads the folders of its
    own runs only. Each batch overwrites its own ``batch_id`` folders, so a repeated batch is harmless.
    """
    lined = fmt == "csv"
    if lined:
        source = line_reader(spark.readStream, **options).load(path).select("value")
    else:
        source = spark.readStream.schema(schema).options(**options).format(fmt).load(path)
    source = source.select("*", run_name(spark, path).alias("run_id"), F.col("_metadata.file_block_start").alias("_start"))

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("_id", F.monotonically_increasing_id())
        if lined:
            rows = rows_by_header(clean_lines(rows, **options), schema, **options)
        elif shape is None:
            rows = with_positions(rows, "run_id", ["_start", "_id"], "seq", "_total", chunk=F.col("_start")).drop("_id", "_start", "_total")
        if shape is not None:
            rows = deliver(shape(rows.drop("run_id", "_start", "_id", *(["seq"] if lined else []))), sink, batch_id, parts)
        clean_runs(rows, params).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    query = (source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    return query


def deliver(rows: DataFrame, sink: str, batch_id: int, parts: int = PARTS) -> DataFrame:
    """Keep the raw rows of a batch; returns all rows delivered so far of the runs it touches, read from their folders alone."""
    spark, raw = rows.sparkSession, f"{sink}-raw"
    rows = cut(rows.withColumn("_part", F.pmod(F.xxhash64("run_id"), F.lit(parts)).cast("int")))
    touched = [r._part for r in rows.select("_part").distinct().collect()]  # ``parts`` numbers at most
    mine = rows.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    # a hot run's part is split over tasks; other parts are one file each
    (mine.hint("rebalance", "_part").write.partitionBy("_part", "batch_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(raw))
    if not touched:
        return rows.drop("_part")
    return delivered(spark, sink, touched, mine.schema).filter(F.col("batch_id") <= batch_id).join(
        F.broadcast(rows.select("run_id").distinct()) if fits(rows.select("run_id").distinct()) else rows.select("run_id").distinct(),
        "run_id", "left_semi").drop("_part", "batch_id")


def delivered(spark: SparkSession, sink: str, touched: list[int], schema: T.StructType) -> DataFrame:
    """Raw rows of some parts of all deliveries; other parts are not even listed."""
    return spark.read.schema(schema).option("basePath", f"{sink}-raw").parquet(*[f"{sink}-raw/_part={k}" for k in sorted(touched)])


def read_clean(spark: SparkSession, sink: str, run: str = "run_id") -> DataFrame:
    """All ingested runs; where a run was delivered again, its newest delivery."""
    d = spark.read.parquet(sink)
    newest = d.groupBy(run).agg(F.max("batch_id").alias("batch_id"))
    return attach(d, newest, [run, "batch_id"]).drop("batch_id")
