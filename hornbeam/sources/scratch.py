"""Intermediate tables: small ones stay with the driver, others are files that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Tables up to this many rows are kept as local relations; larger ones are written.
LOCAL_ROWS = 5_000
#: Plans that read more than this are evaluated once, into files, instead of first being tried for a small result.
LOCAL_INPUT = 256 << 20
_made: dict[str, SparkSession] = {}
_own: list[str] = []


def _delete(path: str, spark: SparkSession) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clean() -> None:
    for path, spark in list(_made.items()):
        try:
            _delete(path, spark)
        except Exception:  # the session is gone: the folder's owner clears it
            pass


atexit.register(_clean)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``; only where that is unset, in a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="hornbeam-"))
        base = _own[0]
    path = f"{base}/hornbeam-{uuid.uuid4().hex}-{name}"
    _made[path] = spark
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a path made here that nothing reads any more; its last part is unique, however the rest is spelt."""
    name = path.rstrip("/").rpartition("/")[2]
    for known in [k for k in _made if k.endswith(f"/{name}")]:
        _delete(known, spark)
        del _made[known]


class Stored:
    """A set of rows that later plans read without its lineage: one local part, some written ones, or a registered table."""

    def __init__(self, spark: SparkSession, schema, local: pa.Table | None, paths: list[str], count: int):
        self.spark, self.schema, self.local, self.paths, self._count = spark, schema, local, paths, count
        self._df: DataFrame | None = None
        self.registered = False

    @classmethod
    def view(cls, spark: SparkSession, df: DataFrame) -> Stored:
        """A registered table where it lies. Its rows may repeat: heads are distinct and aggregates fold distinct rows."""
        out = cls(spark, df.schema, None, [], -1)
        out._df, out.registered = df, True
        return out

    @property
    def count(self) -> int:
        if self._count < 0:
            self._count = (self.df.distinct() if self.registered else self.df).count()
        return self._count

    @property
    def df(self) -> DataFrame:
        if self._df is None:
            if self.paths:
                self._df = self.spark.read.schema(self.schema).parquet(*self.paths)
            else:
                self._df = self.spark.createDataFrame(self.local if self.local is not None else [], self.schema)
        return self._df

    def written(self) -> list[str]:
        if self.paths or not self.count:
            return self.paths
        path = new_path(self.spark, "part")
        self.df.coalesce(1).write.parquet(path)  # a local part, LOCAL_ROWS at most
        return [path]

    def union(self, more: Stored) -> Stored:
        """Of two tables without common rows."""
        if self.registered:
            return Stored.view(self.spark, self.df.union(more.df))
        if not more.count or not self.count:
            return more if more.count else self
        count = self.count + more.count
        if not self.paths and not more.paths and count <= LOCAL_ROWS:
            return Stored(self.spark, self.schema, pa.concat_tables([self.local, more.local.cast(self.local.schema)]), [], count)
        return Stored(self.spark, self.schema, None, self.written() + more.written(), count)


def input_bytes(df: DataFrame) -> int:
    """Estimated size of the tables that a plan reads."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size()))


def store(df: DataFrame, large: bool = False) -> Stored:
    """Evaluate a plan. A small result comes to the driver, unless the plan reads much or the caller expects more rows."""
    spark = df.sparkSession
    if not large and input_bytes(df) < LOCAL_INPUT:
        table = df.limit(LOCAL_ROWS + 1).toArrow()
        if table.num_rows <= LOCAL_ROWS:
            return Stored(spark, df.schema, table, [], table.num_rows)
    path = new_path(spark, "table")
    df.write.parquet(path)
    return Stored(spark, df.schema, None, [path], -1)
