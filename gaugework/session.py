"""Session settings and the shared work folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app_name: str = "gaugework", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    ``master`` is for tests and benches; on a cluster the submitter sets it.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, the folder that all executors share.

    Only a local session, which has no other executors, may do without: it gets a temporary folder.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        return tempfile.mkdtemp(prefix="gaugework-")
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def work_dir(spark: SparkSession, purpose: str, root: str | None = None) -> str:
    """A fresh folder name under ``root``, or else ``spark.checkpoint.dir``, which all executors share."""
    root = root or shared_dir(spark)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
