"""The shared folder for tables that cut a long lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


_LOCAL: dict[str, str] = {}


def workspace(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``.

    Only a local session without that setting, as in tests, gets a folder of
    this machine, one per application; a cluster must name one that every
    executor can reach.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="corpusloom-")
        shared = _LOCAL[app]
    return f"{shared.rstrip('/')}/corpusloom-{uuid.uuid4().hex}"
