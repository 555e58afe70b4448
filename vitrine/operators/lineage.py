"""Lineage cuts.

Iterative operators (the multi-level rank) and shared base tables are read
several times; without a cut the logical plan grows with every reuse and a lost
executor forces a recompute from the sources.  ``materialize`` writes the
DataFrame as Parquet under the session's reliable checkpoint folder
(``spark.checkpoint.dir``: a shared path on a cluster) and returns a DataFrame
reading it back -- columnar, so later reads get column pruning and filter
pushdown, unlike an RDD checkpoint.  Never a local checkpoint: executors can
be lost at any time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from vitrine.session import ensure_checkpoint_dir


#: Folders that this process has written, by application.
_WRITTEN: dict[str, list[str]] = {}


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/vitrine-tables/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.mode("error").parquet(path)
    return spark.read.parquet(path)


def release(spark) -> None:
    """Deletes what ``materialize`` has written for this application; DataFrames that read it end with it."""
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
