"""Shared scratch storage: where lineage is cut and where result files lie.

The folder is the one the cluster names in ``spark.checkpoint.dir``; only where that is unset (tests on one
machine) a folder of this session's own is made.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers, unless the workers' search path has it already."""
    root, app = Path(__file__).parents[2], spark.sparkContext.applicationId
    if app not in _shipped and str(root) not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        path = Path(tempfile.mkdtemp(prefix="strata-code-")) / "strata_code.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted((root / "strata").rglob("*.py")):
                z.write(p, p.relative_to(root))
        spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: executors of a cluster need a folder that all share")
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="strata-")
    return _own[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; two calls never give the same one."""
    return f"{shared_dir(spark)}/strata-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This computes an input that is used more than once exactly once, and a lost executor costs only the tasks that
    ran there: what was written is in shared storage.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, df_or_path) -> None:
    """Delete what :func:`materialise` wrote (or a path), once nothing lazy reads it any more."""
    paths = [df_or_path] if isinstance(df_or_path, str) else list({p.rsplit("/", 1)[0] for p in df_or_path.inputFiles()})
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
