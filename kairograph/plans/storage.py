"""Stages kept in the folder that all executors share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame

from kairograph.errors import BadInput

_OWN: dict[str, str] = {}
#: Rows of a task where rows are dealt by their number.
ROWS = 500_000


def keep(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write a stage under ``spark.checkpoint.dir``, in folders ``by`` a column if named, and read it again.

    Only where that setting is absent and the session runs on one machine a
    temporary folder takes its place.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise BadInput("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="kairograph-")
        root = _OWN[app]
    path = f"{root.rstrip('/')}/kairograph/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows of a stored table dealt by columns to as many tasks as their number asks for, so that a task's memory does not grow with the table."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, math.ceil(df.count() / ROWS)), *by)
