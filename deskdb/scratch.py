"""A folder that the driver and all executors reach."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Folders of sessions that name none, by application.
_OWN: dict[str, str] = {}
#: Folders as given, and with their file system's scheme.
_WHOLE: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir`` (a path without a scheme is one of the default file system).

    Where that is unset, a folder of this session's own if all runs on one machine (master local, as in tests); else it is refused, as executors
    would write to disks of their own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        context = spark.sparkContext
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        at = _OWN[context.applicationId] = _OWN.get(context.applicationId) or "file://" + tempfile.mkdtemp(prefix="deskdb-")
    if at not in _WHOLE:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        _WHOLE[at] = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return _WHOLE[at].rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for something that this application keeps on the way."""
    return f"{shared_dir(spark)}/deskdb-scratch/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes everything at scratch paths of this application; call it once the results that read it are consumed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/deskdb-scratch/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
