"""Helpers that several operators share: shared storage, document batches, worker caches, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows, and bytes of text and binary values, of one slice that an operator works on (a longer single row is one slice).
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    Where the session names none, one process (a local master) gets a temporary folder; a cluster is refused.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="crease-checkpoint-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def let_go(spark: SparkSession) -> None:
    """Have the driver collect its garbage, so that Spark deletes the shuffle files of plans that nothing refers to any more.

    Else they stay until the driver happens to be short of memory, which on executors' disks may be too late.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most `rows` rows and about `size` bytes of text and binary values."""
    wide = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type):
            wide += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(wide)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        n = int(np.searchsorted(ends[at : at + rows], before + size, side="right"))
        yield batch.slice(at, max(1, n))
        at += max(1, n)


def map_batches(
    df: DataFrame,
    schema: str,
    start: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]],
    rows: int = SLICE_ROWS,
) -> DataFrame:
    """mapInArrow with one set-up per task, on slices() of the batches, so long texts do not pile up in one step.

    A task without rows sets nothing up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for batch in batches:
            f = f or start()
            for part in slices(batch, rows):
                yield from f(part)

    return df.mapInArrow(run, schema)


_HELD: dict[tuple, object] = {}


def held(name: tuple, make: Callable[[], object]) -> object:
    """What all tasks of a Python worker share under this name; the object of another name is let go first.

    A worker thus holds the cache of one operator, however many stages run in it.
    """
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch, null read as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of every vertex of an undirected graph: columns v, label (a written table).

    edges: long columns a, b (ids not null; loops and repeated edges allowed). Each round gives every vertex the
    smallest label around it and then the label of its label (pointer jumping), so rounds grow with the logarithm of
    the longest path on usual graphs; labels only ever fall, so it ends on every graph. A hot vertex is only ever the
    large side of a join on the unique label table (AQE splits it) and its minimum is combined before the shuffle.
    """
    both = materialize(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    labels = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("label")))
    while True:
        seen = (
            both.join(labels.select(F.col("v").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("v"))
            .agg(F.min("label").alias("near"))
        )
        hooked = labels.join(seen, "v").select("v", "label", F.least("label", "near").alias("next"))
        target = labels.select(F.col("v").alias("next"), F.col("label").alias("jump"))
        new = materialize(
            hooked.join(target, "next", "left").select(
                "v", F.coalesce(F.least("next", "jump"), "next").alias("label"), F.col("label").alias("old")
            )
        )
        moved = not new.filter("label <> old").isEmpty()
        discard(labels)
        labels = new
        if not moved:
            discard(both)
            return labels


def merged_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (v, label) of connected_components() with more edges (a, b) taken in: v, label (a written table).

    Only the edges between different components are followed, as edges between their labels.
    """
    of = lambda end: labels.select(F.col("v").alias(end), F.col("label").alias(f"{end}_label"))
    ends = edges.join(of("a"), "a", "left").join(of("b"), "b", "left")
    named = ends.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    above = connected_components(named.filter("a <> b").distinct())
    moved = labels.join(above.select(F.col("v").alias("label"), F.col("label").alias("top")), "label", "left")
    new = above.join(labels.select("v"), "v", "left_anti").select("v", "label")
    out = materialize(moved.select("v", F.coalesce("top", "label").alias("label")).unionByName(new))
    discard(above)
    return out


def hook(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join the components of u[k] and v[k] for all k; parent points to smaller numbers and is flat afterwards."""
    while len(u):
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            flat = parent[parent]
            if (flat == parent).all():
                break
            parent[:] = flat
