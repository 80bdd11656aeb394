"""Tables written into the folder that driver and executors share, in the middle of a job."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one process (a local master) gets a temporary one where none is named, a cluster is refused."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="crease-checkpoint-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/crease-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as Parquet in the shared folder: it is worked out once, and a lost executor costs nothing that is done."""
    path = path or new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows_seen(seen: Observation) -> int:
    """The count `rows` that a write has observed; 0 where Spark has found the plan empty and left the count out of it."""
    try:
        return seen.get["rows"] or 0
    except Py4JJavaError:
        return 0


def drop_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
