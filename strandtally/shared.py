"""Tables written to the folder that the driver and all executors share.

Results are lazy and read these tables, so they stay until their caller is done: ``scratch`` deletes what was
written within it, ``discard`` all that this application has written.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from strandtally.files import delete

_own: dict[str, str] = {}
#: Paths handed out and not deleted yet.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, a folder of our own.

    A local session gets a temporary folder; on a cluster the warehouse, which is shared too.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        base = "file://" + tempfile.mkdtemp(prefix="spark-strandtally-")
    else:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_strandtally"
    _own[spark.sparkContext.applicationId] = base
    return base


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nobody has used yet."""
    path = f"{shared_dir(spark)}/strandtally/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Delete, at the end, all that was written in the shared folder within; read what depends on it before."""
    at = len(_made)
    try:
        yield
    finally:
        discard(at)


def discard(first: int = 0) -> None:
    """Delete what was written in the shared folder, from the path of this number on."""
    while len(_made) > first:
        delete(_made.pop())


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
