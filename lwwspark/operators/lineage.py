"""Cutting lineage, and scratch paths, in the folder that executors share.

What is made there is written as tables, not kept on executors, so that lost executors cost nothing. A table goes when it
is forgotten, and all that is left goes when the driver's Python ends.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths that were made here and are still there, each with what opens its file system.
_MADE: dict[str, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of this machine, if all of Spark runs on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lwwspark-")
        spark.conf.set("spark.checkpoint.dir", path)
        _note(spark, path)
    return path


def _note(spark: SparkSession, path: str) -> None:
    _MADE[path] = (spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())


def _drop(path: str, jvm, conf) -> None:
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _note(spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    _MADE.pop(path, None)
    _drop(path, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a table that is written now."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Removes the tables behind results of ``cut`` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_cut_path", None)
        if path in _MADE:
            remove(df.sparkSession, path)


@atexit.register
def _clear() -> None:
    while _MADE:
        path, (jvm, conf) = _MADE.popitem()
        try:
            _drop(path, jvm, conf)
        except Exception:  # noqa: BLE001  Spark's process may have gone
            return
