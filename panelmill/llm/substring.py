"""Substring deduplication with fixed-block anchors.

A repeat of ``WINDOW`` words holds at least one of the non-overlapping ``BLOCK``-word blocks of its
document (2 * BLOCK - 1 <= WINDOW). So:

1. Every rolling BLOCK-word window of every document probes the index of blocks. Windows and blocks
   travel as sorted 62-bit hashes, delta-coded, one blob for each (gathered windows, hash range); equal
   hashes are merged before. Over ``FAN`` ranges the blobs are dealt twice, first by groups of ranges, so
   that they stay long however many ranges the input needs. A block is hot if its hash has a second
   occurrence at any offset; a chance collision makes a block hot without need and does no harm.
2. Documents with hot blocks are extended from them: each start whose window holds the hot block sends
   the 128-bit hash of its whole window, again in blobs by hash range. The reply is a bit for each hash:
   does the window start anywhere else. Runs of such windows are the maximal exact repeats. The two
   halves of the hash come from unlike hashes of the words, so no chance collision is to be expected
   among 10^14 windows.
3. Covered words go.

No pairs of occurrences are made, so a passage in n documents costs n rows at most.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm.common import arrow_schema, drop_since, made, map_batches, sha_hex, slices, table, text_or_empty, texts_of, written
from panelmill.llm.wordhash import Words, rolling

WINDOW = 35
BLOCK = 18
SLICE = 250_000
RANGE_BYTES = 32_000_000  # input bytes for each range of block hashes
RANGE_WINDOWS = 4_000_000  # whole windows for each range of their hashes
FAN = 4_096
GATHER = 2_000_000  # windows that a task holds before it sends them
CHUNK_CHARS = 2_000_000
_TWO = np.uint64(2)
_BLOB = "range long, blob binary"
_CHUNK = "chunk long, ids array<long>, texts array<string>, hot array<array<int>>"


def hash_ranges(docs: DataFrame) -> int:
    """Number of hash ranges: in proportion to the input, at least the session's shuffle partitions; those
    alone where Spark does not know the input's size."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size if size < 1 << 55 else 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), known // RANGE_BYTES, 1)


def _inside(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of windows that stay in one text, their hashes)."""
    h = rolling(w.hashes, width)
    owner = np.repeat(np.arange(len(w.counts)), w.counts)
    at = np.flatnonzero(owner[: len(h)] == owner[width - 1 :]) if len(h) else np.empty(0, np.int64)
    return at, h[at]


def pack(sorted_values: np.ndarray) -> bytes:
    """6 bytes for each gap, or 8 for each value where a gap is too wide."""
    gaps = np.diff(sorted_values, prepend=sorted_values[:1])
    if len(gaps) and gaps.max() < 2**48:
        return b"d" + sorted_values[:1].tobytes() + (gaps >> np.uint64(32)).astype(np.uint16).tobytes() + gaps.astype(np.uint32).tobytes()
    return b"r" + sorted_values.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if blob[:1] == b"r":
        return np.frombuffer(blob[1:], np.uint64)
    n = (len(blob) - 9) // 6
    gaps = np.frombuffer(blob[9 : 9 + 2 * n], np.uint16).astype(np.uint64) << np.uint64(32)
    gaps += np.frombuffer(blob[9 + 2 * n :], np.uint32)
    return np.cumsum(gaps, dtype=np.uint64) + np.frombuffer(blob[1:9], np.uint64)


def merged(values: np.ndarray) -> np.ndarray:
    """Sorted values of distinct hashes; the low bits of equal ones are joined, and the lowest set: it occurs again."""
    values = np.sort(values)
    runs = np.flatnonzero(np.concatenate(([True], (values[1:] >> _TWO) != (values[:-1] >> _TWO))))
    many = np.diff(np.append(runs, len(values))) > 1
    return np.bitwise_or.reduceat(values, runs) | many.astype(np.uint64)


def _sent(parts: list[np.ndarray], ranges: int, per: int = 1) -> pa.RecordBatch:
    """One blob for each range that the parts meet; ``per`` consecutive ones of ``ranges`` go together."""
    values = merged(np.concatenate(parts))
    span = np.uint64((1 << 62) // ranges + 1)
    where = (values >> _TWO) // span // np.uint64(per)
    cuts = np.flatnonzero(where[1:] != where[:-1]) + 1
    bounds = [0, *cuts.tolist(), len(values)]
    blobs = [pack(values[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(where[np.array(bounds[:-1])].astype(np.int64)), pa.array(blobs, pa.binary())], schema=arrow_schema(_BLOB))


def _gathered(arrays, send):
    """``send`` of as many arrays at a time as hold about ``GATHER`` values."""
    parts, held = [], 0
    for values in arrays:
        parts.append(values)
        held += len(values)
        if held >= GATHER:
            yield send(parts)
            parts, held = [], 0
    if held:
        yield send(parts)


def _probes(ranges: int, per: int):
    """Distinct hashes of all rolling windows; low bits: is a block, occurs again."""

    def arrays(batches):
        for batch in batches:
            texts = texts_of(batch)
            for a, b in slices(texts, SLICE):
                w = Words(texts[a:b])
                at, h = _inside(w, BLOCK)
                first = np.repeat(w.offsets[:-1], w.counts)[at]
                block = (at - first) % BLOCK == 0
                yield ((h >> _TWO) << _TWO) | (block.astype(np.uint64) << np.uint64(1))

    return lambda batches: _gathered(arrays(batches), lambda parts: _sent(parts, ranges, per))


def _dealt_again(ranges: int):
    """Blobs of groups of ranges, cut into single ranges. A task holds one group or a few at a time."""

    def arrays(batches):
        for batch in batches:
            for blob in batch.column("blob"):
                yield unpack(blob.as_py())

    return lambda batches: _gathered(arrays(batches), lambda parts: _sent(parts, ranges))


def _hot_blocks(key, pdf):
    """Hashes of a range that are a block somewhere and occur twice or more in all."""
    values = merged(np.concatenate([unpack(b) for b in pdf["blob"]]))
    return pd.DataFrame({"hash": (values[(values & np.uint64(3)) == np.uint64(3)] >> _TWO).astype(np.int64)})


def hot_blocks(texts: DataFrame, ranges: int) -> DataFrame:
    per = -(-ranges // FAN)
    blobs = texts.select("text").mapInArrow(_probes(ranges, per), _BLOB)
    if per > 1:
        blobs = blobs.repartition("range").mapInArrow(_dealt_again(ranges), _BLOB)
    return blobs.groupBy("range").applyInPandas(_hot_blocks, "hash long")


def _doc_blocks(batch):
    """Every document with its word count, the hash of all its words, and its block hashes in order."""
    texts = texts_of(batch)
    for a, b in slices(texts, SLICE):
        w = Words(texts[a:b])
        h = (rolling(w.hashes, BLOCK) >> _TWO).astype(np.int64)
        blocks = [h[s : s + n - BLOCK + 1 : BLOCK] if n >= WINDOW else [] for s, n in zip(w.offsets[:-1].tolist(), w.counts.tolist(), strict=True)]
        shas = [sha_hex(b" ".join(t.encode("utf-8", "surrogatepass").split())) for t in texts[a:b]]
        yield batch.column("key").slice(a, b - a), batch.column("doc_id").slice(a, b - a), w.counts, shas, blocks


def _chunked(batches):
    """Gather documents with hot blocks into chunk rows of bounded size."""
    number = itertools.count(TaskContext.get().partitionId() << 32)
    for batch in batches:
        texts = texts_of(batch)
        for a, b in slices(texts, CHUNK_CHARS):
            cells = ([next(number)], [batch.column("doc_id").slice(a, b - a).to_pylist()], [texts[a:b]], [batch.column("hot").slice(a, b - a).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, arrow_schema(_CHUNK), strict=True)], schema=arrow_schema(_CHUNK))


def _candidates(texts: list[str], hot: list) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, starts and both hashes of the windows that hold a hot block."""
    w = Words(texts)
    at, h = _inside(w, WINDOW)
    near = np.zeros(len(w.hashes) + 1, np.int64)
    for s, n, blocks in zip(w.offsets[:-1].tolist(), w.counts.tolist(), hot, strict=True):
        q = np.unique(np.asarray(blocks, dtype=np.int64)) * BLOCK
        q = q[q < n]
        np.add.at(near, s + np.maximum(q - BLOCK + 1, 0), 1)
        np.add.at(near, s + q + 1, -1)
    keep = np.cumsum(near)[:-1][at] > 0
    at = at[keep]
    return w, at, h[keep], rolling(w.second(), WINDOW)[at]


def _distinct(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by both hashes, where each distinct pair begins in it, which distinct pair each place holds)."""
    by = np.lexsort((g, h))
    new = np.ones(len(by), bool)
    new[1:] = (h[by][1:] != h[by][:-1]) | (g[by][1:] != g[by][:-1])
    return by, np.flatnonzero(new), np.cumsum(new) - 1


def _window_hashes(ranges: int):
    span = np.uint64((1 << 64) // ranges + 1 if ranges > 1 else 2**64 - 1)

    def run(batch):
        for chunk, texts, hot in zip(*(batch.column(c) for c in ("chunk", "texts", "hot")), strict=True):
            _, _, h, g = _candidates(texts.as_py(), hot.as_py())
            if not len(h):
                continue
            by, first, _ = _distinct(h, g)
            again = np.diff(np.append(first, len(by))) > 1
            h, g = h[by][first], g[by][first]
            part = (h // span).astype(np.int64)
            bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(h)]
            cells = [(part[a], h[a:b].tobytes() + g[a:b].tobytes(), np.packbits(again[a:b]).tobytes()) for a, b in zip(bounds, bounds[1:], strict=False)]
            yield [chunk.as_py()] * len(cells), *zip(*cells, strict=True)

    return run


def _replies(key, pdf):
    """For each chunk's hashes of the range: one bit, set if the window starts anywhere else."""
    sizes = [len(x) // 16 for x in pdf["hashes"]]
    again = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(pdf["again"], sizes, strict=True)])
    h = np.concatenate([np.frombuffer(x, np.uint64, n) for x, n in zip(pdf["hashes"], sizes, strict=True)])
    g = np.concatenate([np.frombuffer(x, np.uint64, n, 8 * n) for x, n in zip(pdf["hashes"], sizes, strict=True)])
    by, first, which = _distinct(h, g)
    many = np.diff(np.append(first, len(by))) > 1
    twice = again
    twice[by] |= many[which]
    bounds = np.cumsum([0, *sizes]).tolist()
    return pd.DataFrame({"chunk": pdf["chunk"], "range": pdf["range"], "bits": [np.packbits(twice[a:b]).tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], "n": sizes})


def _without_repeats(batch):
    """Drop covered words of every document of a chunk."""
    for ids, texts, hot, replies in zip(*(batch.column(c) for c in ("ids", "texts", "hot", "replies")), strict=True):
        w, at, h, g = _candidates(texts.as_py(), hot.as_py())
        replies = sorted(replies.as_py() or [], key=lambda r: r["range"])
        cover = np.zeros(len(w.hashes) + 1, np.int64)
        if replies:
            bits = np.concatenate([np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]) for r in replies]).astype(bool)
            by, _, which = _distinct(h, g)
            starts = at[by[bits[which]]]
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + WINDOW, -1)
        gone = np.cumsum(cover)[:-1] > 0
        removed, kept = [], []
        for a, b in zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist(), strict=True):
            removed.append(int(gone[a:b].sum()))
            kept.append(b" ".join([w.word_bytes(k) for k in (np.flatnonzero(~gone[a:b]) + a).tolist()]))
        yield ids.values, w.counts, removed, [sha_hex(k) for k in kept], [k.decode("utf-8", "surrogatepass") for k in kept]


def without_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text where words went, else null) for every row.

    Null and empty texts have no words; texts under 35 words lose none. Rows that repeat a doc_id, null
    included, are all returned; their equal passages are repeats of each other. Extra columns are ignored.
    """
    spark = docs.sparkSession
    mark = made(spark)
    # a null id is replaced by the text's hash, so that its rows meet their own blocks
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.md5(text_or_empty()))).alias("key")
    texts = docs.select(key, "doc_id", text_or_empty().alias("text"))
    hot = written(hot_blocks(texts, hash_ranges(docs)), "hot-blocks")
    listed = written(map_batches(texts, _doc_blocks, "key string, doc_id long, n_words long, sha string, blocks array<long>"), "doc-blocks")
    blocks = listed.select("key", F.posexplode("blocks").alias("number", "hash"))
    marked = written(blocks.join(hot, "hash").groupBy("key").agg(F.collect_set("number").alias("hot")), "hot-docs")
    held = listed.join(marked, "key", "left_semi").agg(F.sum("n_words")).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), held // RANGE_WINDOWS)
    chunks = written(marked.join(texts, "key").select("doc_id", "text", "hot").mapInArrow(_chunked, _CHUNK), "repeat-chunks")
    windows = map_batches(chunks.select("chunk", "texts", "hot"), _window_hashes(ranges), "chunk long, range long, hashes binary, again binary")
    replies = windows.groupBy("range").applyInPandas(_replies, "chunk long, range long, bits binary, n long")
    replies = written(replies.groupBy("chunk").agg(F.collect_list(F.struct("range", "bits", "n")).alias("replies")), "repeat-replies")
    drop_since(spark, mark, listed, marked, chunks, replies)
    cut = map_batches(chunks.join(replies, "chunk", "left"), _without_repeats, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    whole = listed.join(marked.select("key"), "key", "left_anti").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), F.lit(None).cast("string").alias("kept_text"))
    out = whole.unionByName(cut)
    return out if keep_text else out.drop("kept_text")


def op8_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op8_block_anchors": op8_block_anchors}

ORACLE_SQL = {
    "op8_block_anchors": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS s FROM w WHERE len(ws) >= 35),
windows AS (SELECT doc_id, s, md5(array_to_string(list_slice(ws, s, s + 34), ' ')) AS h FROM starts),
repeated AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM windows JOIN repeated USING (h)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""",
}
