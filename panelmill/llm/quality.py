"""Quality rules: cross-document line frequency.

Lines are normalised and hashed; for every host (``source``) the distinct documents that hold a
line are counted. Lines above the limit are removed, and a document of which removal leaves less
than ``LEAST_LEFT`` of the words is rejected as depleted. Every line with a word is hashed and counted,
whatever its length.

A line above the limit stands in over ``MAX_SHARE`` of its host's documents, so there are at most
1 / ``MAX_SHARE`` times as many of them as an average document has lines, for each host. They are
counted: few enough, they are broadcast, and no line is shuffled again; else both sides are salted.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm.common import drop_written, map_batches, slices, table, text_or_empty, texts_of, written
from panelmill.llm.wordhash import Words, mix, rolling

MIN_DOCS = 20
MAX_SHARE = 0.05
LEAST_LEFT = 0.25
SLICE = 250_000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Common lines up to this number are broadcast (some 30 bytes each), more are joined by salted keys.
BROADCAST_LINES = 500_000
SALTS = 32
_STATS = "doc_id long, host string, text_id string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, hashes array<long>, line_words array<long>"


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[bounds[1:]] - total[bounds[:-1]]


def repeat_words(w: Words, width: int = 8) -> np.ndarray:
    """Words of each text inside windows of ``width`` words that occur twice or more in it."""
    owner = np.repeat(np.arange(len(w.counts)), w.counts)
    h = rolling(w.hashes, width)
    cover = np.zeros(len(w.hashes) + 1, np.int64)
    if len(h):
        inside = np.flatnonzero(owner[: len(h)] == owner[width - 1 :])
        key = mix(h[inside] + mix(owner[inside].astype(np.uint64) + np.uint64(1)))
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        twice = np.zeros(len(by), bool)
        twice[1:] |= same
        twice[:-1] |= same
        at = inside[by[twice]]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + width, -1)
    return _per_text(np.cumsum(cover)[:-1] > 0, w.offsets)


def _line_rows(lines: list[str]) -> tuple[int, dict[bytes, list[int]]]:
    """(lines with a word that equal an earlier one, normalised lines with their words and times)."""
    seen: set[str] = set()
    dup = 0
    rows: dict[bytes, list[int]] = {}
    for line in lines:
        words = line.encode("utf-8", "surrogatepass").split()
        if not words:
            continue
        if line in seen:
            dup += 1
        else:
            seen.add(line)
        rows.setdefault(b" ".join(words).lower(), [len(words), 0])[1] += 1
    return dup, rows


def _stats(batch):
    texts, at = texts_of(batch), 0
    for a, b in slices(texts, SLICE):
        w = Words(texts[a:b])
        chars = ((w.raw & 0xC0) != 0x80) & ~w.space
        lined = [_line_rows(t.split("\n")) for t in texts[a:b]]
        yield (
            batch.column("doc_id").slice(at, b - a),
            batch.column("host").slice(at, b - a),
            [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()[:32] for t in texts[a:b]],
            w.counts,
            _per_text(chars, w.bounds),
            _per_text(_SYMBOL[w.raw], w.bounds),
            [d for d, _ in lined],
            repeat_words(w),
            [[xxhash.xxh3_64_intdigest(k) - 2**63 for k in rows] for _, rows in lined],
            [[n * times for n, times in rows.values()] for _, rows in lined],
        )
        at = b


def judged(docs: DataFrame) -> DataFrame:
    """One row for each input row of ``docs`` (doc_id, source, text).

    A null text has no words and so fails the base rule; documents of a null source form one host.
    A document is a doc_id: rows that repeat one count once in a line's documents, whatever their texts.
    Rows of null doc_id are documents by their text. Extra columns are ignored.
    """
    read = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("host"), text_or_empty().alias("text"))
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), "text_id"))
    # row numbers are fixed once the table is written
    stats = written(map_batches(read, _stats, _STATS).select(F.monotonically_increasing_id().alias("row"), own.alias("doc"), "*").drop("text_id"), "quality-stats")
    line = stats.select("row", "doc", "host", F.explode(F.arrays_zip(F.col("hashes").alias("hash"), F.col("line_words").alias("n"))).alias("line")).select("row", "doc", "host", "line.hash", "line.n")
    spread = line.select("host", "hash", "doc").distinct().groupBy("host", "hash").agg(F.count("*").alias("docs"))
    hosts = stats.select("host", "doc").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    # only lines past the absolute limit meet the table of hosts
    common = spread.where(F.col("docs") > MIN_DOCS).join(hosts, "host").where(F.col("docs") > MAX_SHARE * F.col("host_docs"))
    common = written(common.select("host", "hash"), "common-lines")
    if common.count() <= BROADCAST_LINES:
        met = line.join(F.broadcast(common), ["host", "hash"])
    else:
        salt = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
        met = line.withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS))).join(common.withColumn("salt", salt), ["host", "hash", "salt"])
    removed = written(met.groupBy("row").agg(F.sum("n").alias("n_removed")), "removed-lines")
    drop_written(common)
    out = stats.drop("hashes", "line_words").join(removed, "row", "left").withColumn("n_common_words", F.coalesce("n_removed", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_common_words")
    depleted = left < LEAST_LEFT * F.col("n_words")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "n_common_words")


def op7_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents", "doc_id", "source", "text"))


QUERIES = {"op7_line_frequency": op7_line_frequency}

_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = {
    "op7_line_frequency": rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS s FROM w WHERE len(ws) >= 8),
windows AS (SELECT doc_id, s, array_to_string(list_slice(ws, s, s + 7), ' ') AS h FROM starts),
repeated AS (SELECT doc_id, h FROM windows GROUP BY doc_id, h HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + 8)) AS p FROM windows JOIN repeated USING (doc_id, h)) GROUP BY doc_id),
lines AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d),
worded AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM worded GROUP BY doc_id),
normal AS (SELECT doc_id, host, {_AZ.format("array_to_string(lw, ' ')")} AS line, len(lw) AS n FROM worded),
hosts AS (SELECT host, count(DISTINCT doc_id) AS docs FROM d GROUP BY host),
common AS (SELECT host, line FROM normal JOIN hosts USING (host) GROUP BY host, line, docs HAVING count(DISTINCT doc_id) > {MIN_DOCS} AND count(DISTINCT doc_id) > {MAX_SHARE} * docs),
removed AS (SELECT doc_id, sum(n) AS n FROM normal JOIN common USING (host, line) GROUP BY doc_id),
s AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(removed.n, 0) AS BIGINT) AS n_common_words
    FROM d JOIN w USING (doc_id) LEFT JOIN dups USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN removed USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - n_common_words >= {LEAST_LEFT} * n_words AS kept, n_common_words
FROM s""",
}
