"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent and the session runs on one machine a
    temporary folder is made and used for checkpoints too.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="kairograph-")
        spark.sparkContext.setCheckpointDir(_OWN_DIRS[app])
    return _OWN_DIRS[app]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _quiet_delete(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the session is already gone at interpreter exit
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared folder, removed at exit."""
    path = f"{shared_dir(spark)}/kairograph/{name}-{uuid.uuid4().hex}"
    atexit.register(_quiet_delete, spark, path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a stage once to the shared folder and read it back.

    Cuts lineage; a lost executor re-reads files instead of recomputing Python.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test-data layout."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, renamed to ``doc_id`` and ``text``."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def join_same(left: DataFrame, right: DataFrame, *names: str, how: str = "inner") -> DataFrame:
    """Join on columns of equal names, where null meets null; they are kept once."""
    other = right.withColumnsRenamed({n: f"_same_{n}" for n in names})
    on = reduce(Column.__and__, (F.col(n).eqNullSafe(F.col(f"_same_{n}")) for n in names))
    return left.join(other, on, how).drop(*(f"_same_{n}" for n in names))


def binary(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    if pa.types.is_string(column.type):
        return column.cast(pa.binary()).to_pylist()
    return column.to_pylist()


Batches = Iterator[pa.RecordBatch]


def slices(batches: Batches, rows: int = 512) -> Batches:
    """Smaller batches, so that what a task derives from one stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with per-task state: ``make()`` runs once in each task."""

    def run(batches: Batches) -> Batches:
        step = make()
        for batch in slices(batches):
            yield step(batch)

    return df.mapInArrow(run, schema)
