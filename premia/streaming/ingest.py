"""Incremental load of appended written-details CSV chunks with Structured Streaming.

A landing folder receives CSV chunks (source column names, header per file) over
time. The stream binds columns by name, types them, adds the report-month
partition column and appends plain Parquet files to the partitioned fact, next to
those of a batch load. A micro-batch is first written to a folder of its own that
readers ignore, named by the query's own id (kept in its checkpoint) and the batch
number; then its files are renamed into the table. A batch that is run again finds its
folder by that name and only moves what is left, so each chunk lands exactly once. A
new checkpoint, also at an old one's path, starts a query of its own: it skips no batch, and
of the landing folder's files only those that the table's record of loaded files (path, size,
time) already holds. A staged folder whose files are not the batch's is an error.
``availableNow`` processes what has arrived and stops, so the same job serves batch back-fills and
scheduled increments. All landing files share one column order.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.schema import PARTITION_COLUMN, WRITTEN_DETAILS_COLUMNS
from ..sources.written_details import CSV_OPTIONS, deal_by_month


FILE = "_landed_file"


def written_details_stream(spark: SparkSession, landing_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    raw_schema = T.StructType([T.StructField(src, T.StringType()) for src, _, _ in WRITTEN_DETAILS_COLUMNS])
    reader = spark.readStream.schema(raw_schema).options(**CSV_OPTIONS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.csv(landing_dir)
    typed = raw.select(*[F.col(f"`{src}`").cast(typ).alias(eng) for src, eng, typ in WRITTEN_DETAILS_COLUMNS],
                       F.struct("_metadata.file_path", "_metadata.file_size",
                                F.unix_millis("_metadata.file_modification_time").alias("modified")).alias(FILE))
    return typed.withColumn(PARTITION_COLUMN, F.trunc("report_date", "month"))


def _query_id(spark: SparkSession, checkpoint_path: str) -> str:
    """The id that Structured Streaming wrote to the checkpoint when the query first started."""
    lines = spark.read.text(f"{checkpoint_path.rstrip('/')}/metadata").collect()
    return json.loads("".join(r.value for r in lines))["id"]


class _Append:
    """``foreachBatch`` target: stages a batch, then renames its files into the table."""

    def __init__(self, table_path: str, checkpoint_path: str):
        self.table, self.checkpoint, self.rows, self.stream = table_path.rstrip("/"), checkpoint_path, 0, None

    def _fresh(self, batch: DataFrame, path, fs) -> tuple[DataFrame, list]:
        """The batch without rows of files that another query loaded, and the files of the batch."""
        spark = batch.sparkSession
        files = [tuple(r) for r in batch.select(f"{FILE}.*").distinct().collect()]      # one row per landed file
        others = [x.getPath().toString() for x in fs.globStatus(path(f"{self.table}/_staged/*/*/inputs.json")) or []
                  if f"/{self.stream}/" not in x.getPath().toString()]
        if others and files:
            known = spark.read.schema("file_path string, file_size long, modified long").json(others)
            seen = [tuple(r) for r in known.where(F.col("file_path").isin([f[0] for f in files])).distinct().collect()]
            gone = [f[0] for f in files if f in set(seen)]
            if gone:
                batch = batch.where(~F.col(f"{FILE}.file_path").isin(gone))
        return batch, files

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path
        self.stream = self.stream or _query_id(spark, self.checkpoint)
        stage = f"{self.table}/_staged/{self.stream}/{batch_id}"
        fs = path(stage).getFileSystem(conf)
        files: list = []
        if FILE in batch.columns:
            batch, files = self._fresh(batch, path, fs)
            batch = batch.drop(FILE)
        listed = "".join(json.dumps(dict(zip(("file_path", "file_size", "modified"), f, strict=True))) + "\n" for f in sorted(files))
        if not fs.exists(path(f"{stage}/_SUCCESS")):
            deal_by_month(batch, stage)
            self.rows += spark.read.schema(batch.schema).parquet(stage).count()
        elif fs.exists(path(f"{stage}/inputs.json")):
            staged = "".join(r.value + "\n" for r in spark.read.text(f"{stage}/inputs.json").collect())
            if staged != listed:
                raise RuntimeError(f"{stage} was staged from other files than this batch has")
        out = fs.create(path(f"{stage}/inputs.json"), True)
        out.write(listed.encode())
        out.close()
        for folder in fs.listStatus(path(stage)):
            if folder.isDirectory():
                target = path(f"{self.table}/{folder.getPath().getName()}")
                fs.mkdirs(target)
                for f in fs.listStatus(folder.getPath()):
                    if not fs.rename(f.getPath(), path(target, f.getPath().getName())):
                        raise OSError(f"cannot move {f.getPath()} to {target}")


def ingest(spark: SparkSession, landing_dir: str, table_path: str, checkpoint_path: str,
           max_files_per_trigger: int | None = None, append: _Append | None = None) -> StreamingQuery:
    """Start an ``availableNow`` stream from the landing folder into the fact table."""
    stream = written_details_stream(spark, landing_dir, max_files_per_trigger)
    return (stream.writeStream.foreachBatch(append or _Append(table_path, checkpoint_path))
            .option("checkpointLocation", checkpoint_path)
            .outputMode("append")
            .trigger(availableNow=True)
            .start())


def ingest_available(spark: SparkSession, landing_dir: str, table_path: str, checkpoint_path: str) -> int:
    """Run the stream over everything that has arrived and wait for it; returns the
    number of rows appended in this run."""
    append = _Append(table_path, checkpoint_path)
    ingest(spark, landing_dir, table_path, checkpoint_path, append=append).awaitTermination()
    return append.rows
