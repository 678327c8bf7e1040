"""Shared folder, written intermediate tables and connected components."""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from premia.session import shared_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a table under the cluster's shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
SMALL_BATCH = "2m"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches under 2 MB from here on, for a job whose caller writes the result.

    A batch lies in an executor's and its worker's memory several times over, outside the heap.
    """
    spark.conf.set(ARROW_BYTES, SMALL_BATCH)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    While it runs, Arrow batches stay under 2 MB, so that Python workers hold little at once.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    old = spark.conf.get(ARROW_BYTES)
    spark.conf.set(ARROW_BYTES, SMALL_BATCH)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(ARROW_BYTES, old)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    for tables in _SCOPES:
        tables.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table from ``materialise`` that no later plan reads."""
    _delete(df.sparkSession, df.written_to)


_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end the tables that ``materialise`` wrote inside.

    It yields their paths; one that is taken off the list stays. The result of the work must
    have been written by then. After an error all of them stay.
    """
    tables: list[str] = []
    _SCOPES.append(tables)
    try:
        yield tables
    finally:
        _SCOPES.remove(tables)
    for path in tables:
        _delete(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


BROADCAST_ROWS = 2_000_000   # of narrow tables (two 8-byte columns at most): 32 MB


def bounded(df: DataFrame) -> DataFrame:
    """``df``, a written narrow table, marked for broadcast if its counted rows fit; else a shuffle joins it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` for every endpoint of ``edges``; component is the smallest reachable id.

    Each round hooks every vertex to its smallest neighbour, follows the hooks to
    their roots by pointer jumping, and contracts the graph to the roots. At
    least half of the vertices that still have an edge disappear per round.
    Self-loops and repeated edges are ignored; no edges give an empty result.
    """
    ab = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    e = materialise(ab, "cc-edges")
    mapping = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        p = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select(
            "id", F.least("id", "m").alias("parent"))
        p = materialise(p, "cc-hook")
        while True:
            up = p.select(F.col("id").alias("parent"), F.col("parent").alias("root"))
            p = materialise(p.join(up, "parent").select("id", F.col("root").alias("parent"),
                                                        (F.col("root") < F.col("parent")).alias("moved")), "cc-jump")
            moved = not is_empty(p.where("moved"))
            p = p.drop("moved")
            if not moved:
                break
        if mapping is None:
            mapping = p.select("id", F.col("parent").alias("component"))
        else:
            step = p.select(F.col("id").alias("component"), "parent")
            mapping = mapping.join(step, "component", "left").select(
                "id", F.coalesce("parent", "component").alias("component"))
        pa = p.select(F.col("id").alias("a"), F.col("parent").alias("pa"))
        pb = p.select(F.col("id").alias("b"), F.col("parent").alias("pb"))
        e = materialise(e.join(pa, "a").join(pb, "b").where("pa <> pb").select(
            F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "cc-edges")
        if is_empty(e):
            return mapping


def complete_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups (consecutive rows with equal integer ``keys``) and each group's first row."""
    def opened(cols: list[np.ndarray]) -> np.ndarray:
        new = np.ones(len(cols[0]), bool)
        new[1:] = False
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(new)

    waiting: list[pa.RecordBatch] = []     # the rows of a group that may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        at = opened(cols)
        goes_on = waiting and all(waiting[-1].column(k)[-1].as_py() == c[0] for k, c in zip(keys, cols, strict=True))
        if goes_on and len(at) == 1:
            waiting.append(batch)
            continue
        if waiting or len(at) > 1:
            whole = pa.Table.from_batches([*waiting, batch.slice(0, at[-1])]).combine_chunks()
            yield whole, opened([whole[k].to_numpy() for k in keys])
        waiting = [batch.slice(at[-1])]
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks(), np.zeros(1, np.int64)


TOGETHER = 2 << 20           # bytes of small groups that a function takes at once


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.Table], schema: str,
               together: bool = False) -> DataFrame:
    """``fn`` over each group of equal non-null integer ``keys``; many small groups share an Arrow batch.

    ``together``: ``fn`` takes several whole groups at once, about ``TOGETHER`` bytes or one group.
    """
    def run(batches):
        for whole, at in complete_groups(batches, keys):
            ends = [*at[1:].tolist(), len(whole)]
            if together:
                most, i = max(1, TOGETHER * len(whole) // max(1, whole.nbytes)), 0
                while i < len(whole):
                    j = ends[max(bisect_right(ends, i + most) - 1, bisect_right(ends, i))]
                    yield from fn(whole.slice(i, j - i)).combine_chunks().to_batches()
                    i = j
                continue
            out = [fn(whole.slice(i, j - i)) for i, j in zip(at.tolist(), ends, strict=True)]
            yield from pa.concat_tables(out).combine_chunks().to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
