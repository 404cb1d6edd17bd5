"""Working folders for streams and written tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: folders made inside each open :func:`temporary_tables`, innermost last
_scopes: list[list[str]] = []


def _folder(spark: SparkSession, path: str):
    """The file system of a path and the path itself, as Hadoop objects."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), folder


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, in any file system that Spark reads."""
    files, path = _folder(spark, pattern)
    return sorted(str(found.getPath().toString()) for found in files.globStatus(path) or [])


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, if it is there."""
    files, folder = _folder(spark, path)
    files.delete(folder, True)


def scratch_dir(spark: SparkSession, label: str, *, keep: bool = False) -> str:
    """A new folder below ``spark.checkpoint.dir``, or below the warehouse where that is unset.

    It goes when the innermost :func:`temporary_tables` closes (``keep``: the one around it), at the latest with the driver.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/casewise/{label}-{uuid.uuid4().hex}"
    files, folder = _folder(spark, path)
    files.deleteOnExit(folder)
    open_ = _scopes[:-1] if keep else _scopes
    if open_:
        open_[-1].append(path)
    return path


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what was written inside; what shall stay is written with ``keep``."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.pop()
        for path in made:
            deleted(spark, path)


def written(df: DataFrame, label: str, by: list[str] | None = None, *, keep: bool = False) -> DataFrame:
    """The same rows, read back from a table in the working folder: cuts the lineage and gives exact sizes."""
    path = scratch_dir(df.sparkSession, label, keep=keep) + "/table"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
