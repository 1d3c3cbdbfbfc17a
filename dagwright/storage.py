"""Tables that cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the
    session. Where it is unset, a folder of the warehouse on a local master, where
    all is one machine, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.intermediate"
    return path.rstrip("/")


@contextlib.contextmanager
def _no_shuffle_left(spark: SparkSession) -> Iterator[None]:
    """What a query shuffled goes when the query ends: what it wrote needs none of it."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """Cuts the lineage of ``df``: writes it to the shared folder and reads it back.
    A lost executor costs a re-read, never what came before. The table goes with
    :func:`dropped`, or else when the driver process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _no_shuffle_left(spark):
        df.write.options(**options).parquet(path)
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


class Growing:
    """A table that is written block by block; goes as those of :func:`stored` do."""

    def __init__(self, spark: SparkSession, schema: str, name: str = "table"):
        self.spark, self.schema = spark, schema
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        if not _made:
            atexit.register(_clean)
        _made.append((spark, self.path))

    def add(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, self.schema).write.mode("append").parquet(self.path)

    def frame(self) -> DataFrame:
        """What has been written; empty if nothing has."""
        self.spark.createDataFrame([], self.schema).write.mode("append").parquet(self.path)
        out = self.spark.read.schema(self.schema).parquet(self.path)
        out._stored_at = self.path
        return out


def dropped(*tables: DataFrame | None) -> None:
    """Deletes tables of :func:`stored` that nothing reads any more."""
    paths = {getattr(t, "_stored_at", None) for t in tables}
    for spark, path in [x for x in _made if x[1] in paths]:
        _made.remove((spark, path))
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):
            _delete(spark, path)
