"""Results kept in shared storage under the digest of what they are made of."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _filesystem(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def inputs_digest(spark: SparkSession, inputs: list[str]) -> str:
    """Digest of names, sizes and times of all files below the given paths; a missing path counts as such. No file is
    read and no job started, so a rewritten file of the same size within one tick of the store's clock goes unseen."""
    seen = []
    for name in sorted(inputs):
        fs, path = _filesystem(spark, name)
        if not fs.exists(path):
            seen.append([name, None])
            continue
        files = fs.listFiles(path, True)
        rows = []
        while files.hasNext():
            f = files.next()
            rows.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
        seen.append([name, sorted(rows)])
    return hashlib.sha256(json.dumps(seen).encode()).hexdigest()


def materialised(spark: SparkSession, folder: str, label: str, inputs: list[str], parameters: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """``build()`` of these inputs and parameters, computed once: a later call with the same reads the table.

    The result stands at folder/label/digest. It is written beside and renamed when whole, so a run that dies leaves
    nothing that could be read, and of two runs at once the first to finish counts. ``parameters`` must be JSON, and
    name whatever else the result depends on, the version of the code for one.
    """
    key = hashlib.sha256(json.dumps([label, inputs_digest(spark, inputs), parameters], sort_keys=True).encode()).hexdigest()[:32]
    home = f"{folder}/{label}"
    fs, done = _filesystem(spark, f"{home}/{key}")
    if not fs.exists(done):
        part = f"{home}/.{key}-{uuid.uuid4().hex}"
        build().write.parquet(part)
        own = _filesystem(spark, part)[1]
        # renaming to a folder that has come into being meanwhile would move into it
        if fs.exists(done) or not fs.rename(own, done):
            fs.delete(own, True)
        stray = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(done, own.getName())
        if fs.exists(stray):
            fs.delete(stray, True)
    return spark.read.parquet(f"{home}/{key}")


def forget(spark: SparkSession, folder: str, label: str) -> None:
    """Delete all results of a label."""
    fs, path = _filesystem(spark, f"{folder}/{label}")
    fs.delete(path, True)
