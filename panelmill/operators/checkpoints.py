"""Tables in the session's shared folder, to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame

_LOCAL: dict[str, str] = {}
#: Folders that ``written`` made and nothing has deleted, by application.
_MADE: dict[str, set[str]] = {}


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` under spark.checkpoint.dir and read it back. Where that is unset, a temporary folder serves if
    all tasks run inside the driver's own process; on a cluster it is an error, as executors share no such folder.
    The folder is deleted by ``drop_written`` or when the program ends."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = _LOCAL.setdefault(app, "file://" + tempfile.mkdtemp(prefix="panelmill-"))
    path = f"{root}/{label}-{uuid.uuid4().hex}"
    _MADE.setdefault(app, set()).add(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(sc: SparkContext, paths: set[str]) -> None:
    for name in paths:
        path = sc._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        _MADE[sc.applicationId].discard(name)


def drop_written(*frames: DataFrame) -> None:
    """Delete the folders that ``written`` made and these frames read, once no later frame does; tables of other
    origin that they read stay."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        names = {p.rpartition("/")[2]: p for p in _MADE.get(sc.applicationId, ())}
        read = {f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()}
        _delete(sc, {names[n] for n in read if n in names})


@atexit.register
def _drop_all() -> None:
    sc = SparkContext._active_spark_context
    if sc is not None and sc._jsc is not None and _MADE.get(sc.applicationId):
        _delete(sc, set(_MADE[sc.applicationId]))
    for folder in _LOCAL.values():
        shutil.rmtree(folder.removeprefix("file://"), ignore_errors=True)
