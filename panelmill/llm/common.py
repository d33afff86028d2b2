"""Shared plumbing of the corpus operators: table access, shared scratch tables, Arrow batches."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_SCRATCH: dict[str, str] = {}
#: Scratch folders that are not deleted yet, by application, in the order they were made.
_MADE: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns (all if none are given) of one input table."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where the session names none, a temporary one if all tasks run inside the
    driver's own process; else there is no folder that all executors share, which is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[key] = "file://" + tempfile.mkdtemp(prefix="panelmill-")
    return _LOCAL_SCRATCH[key]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder, deleted at the session's end at the latest."""
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back: cuts the lineage and
    survives the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def made(spark: SparkSession) -> int:
    """How many scratch folders there are: a mark for ``drop_since``."""
    return len(_MADE.get(spark.sparkContext.applicationId, []))


def _delete(sc: SparkContext, paths: Iterable[str]) -> None:
    own = _MADE.get(sc.applicationId, [])
    for name in paths:
        path = sc._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        own.remove(name)


def _path_of(df: DataFrame) -> set[str]:
    own = _MADE.get(df.sparkSession.sparkContext.applicationId, [])
    ends = {f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()}
    return {p for p in own if p.rpartition("/")[2] in ends}


def drop_written(*frames: DataFrame) -> None:
    """Delete scratch tables whose last reader has finished."""
    for df in frames:
        _delete(df.sparkSession.sparkContext, _path_of(df))


def drop_since(spark: SparkSession, mark: int, *kept: DataFrame) -> None:
    """Delete the scratch folders made since ``mark`` (see ``made``) but those that ``kept`` read."""
    stay = set().union(*map(_path_of, kept))
    _delete(spark.sparkContext, [p for p in _MADE.get(spark.sparkContext.applicationId, [])[mark:] if p not in stay])


@atexit.register
def _drop_all() -> None:
    """What results still read at the end of the program goes then."""
    sc = SparkContext._active_spark_context
    if sc is not None and sc._jsc is not None and _MADE.get(sc.applicationId):
        _delete(sc, list(_MADE[sc.applicationId]))
    for folder in _LOCAL_SCRATCH.values():
        shutil.rmtree(folder.removeprefix("file://"), ignore_errors=True)


#: Bits of ``perhaps_in``, 64 to a row that is broadcast.
FILTER_BITS = 2**25


def perhaps_in(df: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """``df`` with a column ``_perhaps``, false only for rows whose ``columns`` equal those of no row of ``keys`` (null
    equals null), so that only the others need a join. One hash of the keys sets one of ``FILTER_BITS`` bits; they are
    broadcast, at most 8 MB however many keys there are, which only lets more rows through."""
    bit = F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))
    word, place = F.floor(bit / 64).alias("_word"), F.pmod(bit, F.lit(64)).cast("int")
    words = keys.select(word, F.call_function("shiftleft", F.lit(1).cast("long"), place).alias("b")).groupBy("_word").agg(F.bit_or("b").alias("_bits"))
    met = df.withColumn("_word", word).join(F.broadcast(words), "_word", "left")
    return met.select(*df.columns, (F.getbit(F.coalesce("_bits", F.lit(0).cast("long")), place) == 1).alias("_perhaps"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


_TYPES = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
    "array<string>": pa.list_(pa.string()),
    "array<array<int>>": pa.list_(pa.list_(pa.int32())),
}


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def map_batches(df: DataFrame, rows: Callable[..., Iterable[tuple]], ddl: str, own: Callable | None = None) -> DataFrame:
    """``df.mapInArrow``, where ``rows(batch)`` yields the columns of each output batch in the order of ``ddl``;
    ``rows(batch, own())`` where a task makes something of its own first.

    Columns that are handed on as Arrow arrays keep their nulls and all their bits, which pandas
    would not grant: one null turns a whole batch of ids into floats.
    """
    schema = arrow_schema(ddl)

    def run(batches):
        state = () if own is None else (own(),)
        for batch in batches:
            for columns in rows(batch, *state):
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return df.mapInArrow(run, ddl)


#: Bytes of an Arrow batch after ``small_batches``.
BATCH_BYTES = 4_000_000


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches end at about ``BATCH_BYTES``. By itself Spark ends them at 10,000 rows,
    which may be a task's whole input; the task holds it as a batch, as Python texts and as a result, beside the
    executor's buffers. Where batches end bears on one thing: as at the ends of files, toxicity's character model counts
    no trigram across them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null is empty."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def sha_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def slices(texts: list[str], budget: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``budget`` characters, at least one text each."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > budget:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def span_digest(spans: list[tuple[str, int, int]], order: dict[str, int]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    spans = sorted(spans, key=lambda s: (s[1], order[s[0]], s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def hits_sql(kind: str, rank: int, pattern: str) -> str:
    """SQL of (doc_id, kind, rank, hit, start, i): the matches of a pattern in ``documents``, those with i > 1. Two
    private-use characters mark a match; the lengths of what stands before it give its start."""
    marked = rf"regexp_replace(coalesce(text, ''), '{pattern}', chr(57344) || '\0' || chr(57345), 'g')"
    return f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, split_part(part, chr(57345), 1) AS hit,
    CAST(sum(length(replace(part, chr(57345), ''))) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS start, i
    FROM (SELECT doc_id, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split({marked}, chr(57344)) AS parts FROM documents))"""
