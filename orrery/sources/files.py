"""Small files beside tables, on any file system that Spark can reach."""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from orrery.errors import EngineIOError


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def work_path(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or a local one if all is on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise EngineIOError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = root or "file://" + os.path.join(tempfile.gettempdir(), "orrery-work")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder, read again."""
    path = work_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """Written beside the path and renamed, so that it is there whole or not at all."""
    p, fs = _fs(spark, path)
    beside = p.suffix(".new")
    out = fs.create(beside, True)
    out.write(json.dumps(value).encode())
    out.close()
    fs.delete(p, False)
    if not fs.rename(beside, p):
        raise EngineIOError(f"cannot write {path}")


def read_json(spark: SparkSession, path: str) -> dict:
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        raise EngineIOError(f"{path} is missing or was not completed")
    text = spark.read.text(path, wholetext=True).first()[0]
    try:
        return json.loads(text)
    except ValueError as e:
        raise EngineIOError(f"{path} is not valid") from e


def read_all_json(spark: SparkSession, pattern: str) -> list[dict]:
    """The values of all files that the pattern matches, in any order."""
    p, fs = _fs(spark, pattern)
    paths = [f.getPath().toString() for f in fs.globStatus(p) or []]
    return [json.loads(r[0]) for r in spark.read.text(paths, wholetext=True).collect()] if paths else []


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)
