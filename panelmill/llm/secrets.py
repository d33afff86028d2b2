"""Secret scans over an incremental blob ledger.

Every version of a text is content-addressed (SHA-256). The ledger is a table in shared storage with one
row for each (blob, rule version) that has been scanned, with its findings. A run scans only the pairs
that the ledger has not seen, once each whatever the number of paths, appends them in one commit, and
joins the findings back to all paths.

A path may hold any number of versions, and a blob may stand at any number of paths: texts are met by
(blob, path), so neither gathers the texts of the other in one task. Only blobs with findings travel in
the last join, whose hot blobs AQE splits on the side of the paths.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm.common import drop_written, hits_sql, map_batches, scratch_path, sha_hex, span_digest, table, text_or_empty, texts_of, written

RULE_VERSION = "base-1"
KINDS = {"assign": 0, "access": 1, "hex": 2}
_ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
LEDGER = "blob string, rule_version string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
#: Setting that names the ledger's folder; without it the query starts one of its own.
LEDGER_SETTING = "panelmill.secrets.ledger"


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, leftmost and non-overlapping for each kind."""
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def _scan(batch):
    rows = []
    for text in texts_of(batch):
        found = find_secrets(text)
        digest = span_digest(found, KINDS)
        rows.append((RULE_VERSION, *(sum(k == kind for k, _, _ in found) for kind in KINDS), sha_hex(digest.encode()), digest))
    yield batch.column("blob"), *(zip(*rows, strict=True) if rows else [()] * 6)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """One row for each (blob, rule version); empty where no ledger stands yet. Two runs that appended the
    same blob at once agree on it, so either row counts."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(ledger).dropDuplicates(["blob", "rule_version"])


def update_ledger(paths: DataFrame, ledger: str) -> tuple[DataFrame, DataFrame]:
    """Scan the blobs of ``paths`` (path, text) that the ledger lacks for this rule version and append them.

    Returns (the rows added, addressed paths), both read from shared storage. A null text counts as the
    empty blob, a null path is a path. A path may hold several versions; rows that repeat keep their number.
    """
    spark = paths.sparkSession
    texts = paths.select("path", text_or_empty().alias("text")).withColumn("blob", F.sha2("text", 256))
    addressed = written(texts.select("path", "blob"), "blob-paths")
    seen = read_ledger(spark, ledger).where(F.col("rule_version") == RULE_VERSION).select("blob")
    # paths are counted out before the join, so a blob that many share is one row there
    todo = addressed.groupBy("blob").agg(F.min("path").alias("path")).join(seen, "blob", "left_anti")
    chosen = texts.alias("t").join(todo.alias("d"), (F.col("t.blob") == F.col("d.blob")) & F.col("t.path").eqNullSafe(F.col("d.path"))).select("t.blob", "t.text")
    # a version that repeats at its path comes several times: one ledger row for each blob
    fresh = written(map_batches(chosen, _scan, LEDGER).dropDuplicates(["blob", "rule_version"]), "blob-ledger")
    fresh.write.mode("append").parquet(ledger)
    return fresh, addressed


def scan_history(paths: DataFrame, ledger: str) -> DataFrame:
    """The findings of every row of ``paths``, by way of the ledger, which grows by the unseen blobs.

    Null texts hold nothing; null paths are paths; repeated rows give repeated results; extra columns are
    ignored. Empty input gives an empty result and leaves an empty ledger.
    """
    fresh, addressed = update_ledger(paths, ledger)
    drop_written(fresh)
    # Most blobs hold nothing: only blobs with findings travel, the others are filled in.
    held = read_ledger(paths.sparkSession, ledger).where((F.col("rule_version") == RULE_VERSION) & (F.col("spans") != "")).drop("rule_version")
    found = addressed.join(held, "blob", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_assign", "n_access", "n_hex")]
    return found.select("path", "blob", *zero, F.coalesce("base_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def op6_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of ``documents`` by the ledger that the session names, or by a new one in the shared folder."""
    ledger = spark.conf.get(LEDGER_SETTING, None) or scratch_path(spark, "secret-ledger")
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return scan_history(docs.withColumnRenamed("doc_id", "path"), ledger).withColumnRenamed("path", "doc_id").drop("blob")


QUERIES = {"op6_secret_ledger": op6_secret_ledger}

_SQL_ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?[A-Za-z0-9+/_.=-]+"

ORACLE_SQL = {
    "op6_secret_ledger": rf"""
WITH hits AS (
    {hits_sql("assign", 0, _SQL_ASSIGN)}
    UNION ALL {hits_sql("access", 1, "AKIA[A-Z0-9]+")}
    UNION ALL {hits_sql("hex", 2, "[0-9a-f]+")}),
found AS (SELECT doc_id, kind, rank, start, start + length(hit) AS stop FROM hits WHERE i > 1 AND CASE kind WHEN 'access' THEN length(hit) >= 20 WHEN 'hex' THEN length(hit) >= 24
    ELSE length(regexp_extract(hit, '^(?i:password|passwd|secret|token|api_?key)[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6 END),
per AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM found GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
    sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN per USING (doc_id)""",
}
