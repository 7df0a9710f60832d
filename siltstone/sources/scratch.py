"""Where tools put files that a query needs: a folder of the application, under the cluster's shared one."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_folders: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """Under ``spark.checkpoint.dir``, removed when the session ends. A private folder serves local mode only: on a
    cluster each executor would write to a disk of its own."""
    sc = spark.sparkContext
    if sc.applicationId not in _folders:
        root = sc.getConf().get("spark.checkpoint.dir", None)
        if not root and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"{(root or 'file://' + tempfile.mkdtemp(prefix='siltstone-')).rstrip('/')}/siltstone-tools/{sc.applicationId}"
        at = sc._jvm.org.apache.hadoop.fs.Path(root)
        fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _folders[sc.applicationId] = root
    return _folders[sc.applicationId]


def path(spark: SparkSession, tag: str) -> str:
    return f"{folder(spark)}/{tag}-{uuid.uuid4().hex}"
