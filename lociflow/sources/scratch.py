"""Folders for tables that a query writes and reads back: below spark.checkpoint.dir, which the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    said = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not said:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        said = tempfile.gettempdir()
    return f"{said.rstrip('/')}/lociflow/{name}-{uuid.uuid4().hex}"
